"""Sinks: JSONL, append with resume, packed sets with metadata, caches by parameter, logs of runs, checkpoints by name."""

from __future__ import annotations

import hashlib
import platform
import subprocess
from collections.abc import Callable
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.functions import text


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls left out, no escapes beyond JSON's own; replaces the folder as one job."""
    df.write.mode("overwrite").json(path)


class AppendSink:
    """JSON lines in batches below one folder, each id once, with a ledger of the ids in hash buckets beside it.

    A batch is a folder of its own and is written whole before its log entry, so a batch repeated after a failure replaces
    what the failed one left, rows without an id too. Ids meet the ledger bucket by bucket; the sink itself is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.entries = runtime.log_entries(spark, f"{self.path}/_log")
        n = self.entries[0]["buckets"] if self.entries else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.ids = runtime.Buckets(spark, f"{self.path}/_ids", "id STRING", "id", n)

    def done(self) -> DataFrame:
        """(id) of all rows written."""
        return self.ids.read().filter(F.col("version") < len(self.entries)).select("id")

    def append(self, df: DataFrame, id_col: str = "id", batch: int | None = None) -> int:
        """Writes the rows whose id the sink lacks, the first of each id, and all rows without one; returns how many. A batch
        whose number is in the log is there already."""
        if batch is not None and any(e["batch"] == batch for e in self.entries):
            return 0
        version = len(self.entries)
        new = df.join(self.done().withColumnRenamed("id", id_col), id_col, "left_anti").select(df.columns) if self.entries else df
        to = f"{self.path}/part={version:08d}"
        keyed = new.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(new.filter(F.col(id_col).isNull()))
        keyed.write.mode("overwrite").json(to)
        back = self.spark.read.schema(df.schema).json(to)
        n = back.count()
        self.ids.write(back.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id")).groupBy("id").count().select("id"), version)
        entry = {"batch": version if batch is None else batch, "rows": n, "buckets": self.ids.n}
        runtime.commit_entry(self.spark, f"{self.path}/_log", version, entry)
        self.entries.append(entry)
        return n


def append_new(df: DataFrame, path: str, id_col: str = "id", batch: int | None = None) -> int:
    """Appends the rows whose id the sink doesn't hold; returns how many."""
    return AppendSink(df.sparkSession, path).append(df, id_col, batch)


def write_packed(df: DataFrame, path: str) -> None:
    """Chunks by split, so that readers of one split never open the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def content_digest(df: DataFrame) -> str:
    """sha256 over the number, sum and exclusive or of the rows' hashes: the same in every order and layout."""
    h = F.xxhash64(*sorted(df.columns))
    r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first()
    return hashlib.sha256("-".join(map(str, r)).encode()).hexdigest()


def pack_meta(lengths: DataFrame, capacity: int, sep_id: int, pad_id: int, source: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """One row per split of (split, n_tokens): rows, kept rows, chunks and tokens with one separator each; with the digest of the
    source rows and the seed where given."""
    kept = F.col("n_tokens") > 0
    a = lengths.groupBy("split").agg(F.count(F.lit(1)).alias("n_source_rows"), F.count_if(kept).alias("n_kept"), F.sum(F.when(kept, F.col("n_tokens") + 1).otherwise(0)).alias("total_tokens_packed"))
    a = a.withColumns({"n_skipped": F.col("n_source_rows") - F.col("n_kept"), "n_chunks": F.ceil(F.col("total_tokens_packed") / capacity), "sep_id": F.lit(sep_id), "pad_id": F.lit(pad_id)})
    if source is not None:
        a = a.withColumn("input_sha256", F.lit(content_digest(source)))
    return a if seed is None else a.withColumn("seed", F.lit(seed))


def run_meta(spark: SparkSession, args: dict[str, Any], data: DataFrame | None = None) -> DataFrame:
    """One row on a run: versions, git state where there is one, arguments as JSON, and the head of the data's digest."""
    import json

    def git(*a: str) -> str | None:
        try:
            return subprocess.run(["git", *a], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    head, changed = git("rev-parse", "HEAD"), git("status", "--porcelain")
    row = (platform.python_version(), pyspark.__version__, head, None if changed is None else changed != "", json.dumps(args, sort_keys=True, default=str), content_digest(data)[:16] if data is not None else None)
    return spark.createDataFrame([row], "python STRING, pyspark STRING, git_head STRING, git_dirty BOOLEAN, args STRING, data_sha STRING")


def write_run_meta(spark: SparkSession, path: str, args: dict[str, Any], data: DataFrame | None = None) -> None:
    write_json(run_meta(spark, args, data).coalesce(1), path)


def log_step(spark: SparkSession, path: str, step: int, values: dict[str, Any]) -> None:
    """Adds a step to a log of one entry a step; the driver is the only writer."""
    runtime.commit_entry(spark, path, step, {"step": step, **values})


def steps(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, value) of all numbers in a step log."""
    rows = [(e["step"], k, float(v)) for e in runtime.log_entries(spark, path) for k, v in e.items() if k != "step" and isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "step INT, name STRING, value DOUBLE")


def metrics_row(mode: str, loss: float, accuracy: float, lr: float) -> dict[str, float]:
    """The numbers of a step under the names that logs have them by."""
    return {f"{mode}/loss": loss, f"{mode}/accuracy": accuracy, "lr": lr}


def write_eval(result: DataFrame, path: str) -> None:
    """An evaluation's result rows as JSON, one file."""
    write_json(result.coalesce(1), path)


def cache_key(*parts: object) -> str:
    """Name of a cached data set: md5 of its parameters joined by dashes."""
    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def cached(build: Callable[[], DataFrame], spark: SparkSession, root: str, *parts: object) -> DataFrame:
    """The data set cached under its parameters, built when it isn't there: written aside and moved to its name as one step,
    so that readers find it whole; of two builders at once the first one's stays."""
    path = f"{root}/{cache_key(*parts)}"
    if not runtime.exists(spark, f"{path}/_SUCCESS"):
        aside = f"{root}/.{cache_key(*parts)}-{id(build)}"
        build().write.mode("overwrite").parquet(aside)
        if not runtime.rename(spark, aside, path):
            runtime.remove(spark, aside)
    return spark.read.parquet(path)


def cached_vocabulary(counts: Callable[[], DataFrame], spark: SparkSession, root: str, draft: int, target: int, *parts: object) -> tuple[DataFrame, DataFrame]:
    """(draft_id, offset) and (target_id, kept) of a draft vocabulary, read from the cache or counted and stored there."""
    from quillspark.operators import tokens

    made: list[tuple[DataFrame, DataFrame]] = []

    def mapping() -> tuple[DataFrame, DataFrame]:
        if not made:
            made.append(tokens.vocab_mapping(counts(), draft, target))
        return made[0]

    return tuple(cached(lambda k=k: mapping()[k], spark, root, *parts, draft, target, name) for k, name in enumerate(("d2t", "t2d")))


def latest_checkpoint(names: DataFrame, col: str = "name") -> DataFrame:
    """(name, epoch, step) of the last checkpoint by epoch and step; no row if no name is one."""
    e, s = text.checkpoint_place(F.col(col))
    best = F.max(F.struct(e.alias("epoch"), s.alias("step"), F.col(col).alias("name")))
    return names.filter(e.isNotNull()).agg(best.alias("b")).filter("b IS NOT NULL").select("b.name", "b.epoch", "b.step")
