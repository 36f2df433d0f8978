"""Session helpers: sessions, tables, the shared scratch folder and exact global ranks without a global window."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(master: str | None = None, app: str = "quillspark", partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for; settings given by the cluster stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only the columns used later are read, as Catalyst prunes the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it, else a folder of this host.

    The latter is for local masters only (tests): on a cluster executors wouldn't see it, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        master = spark.conf.get("spark.master", "") or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, whatever its scheme is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a file or folder; False where the target is there already."""
    fs, p = _fs(spark, old)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    return not fs.exists(to) and fs.rename(p, to)


def commit_entry(spark: SparkSession, log: str, number: int, entry: dict[str, Any]) -> None:
    """Adds an entry to a log folder: written aside and renamed, so it is there whole or not at all. A number is taken once."""
    fs, tmp = _fs(spark, f"{log}/.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not rename(spark, tmp.toString(), f"{log}/{number:08d}.json"):
        fs.delete(tmp, True)
        raise RuntimeError(f"entry {number} of {log} is taken: another writer was faster")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, whole or not at all; one that is there stays."""
    fs, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(data))
    out.close()
    if not rename(spark, tmp.toString(), path):
        fs.delete(tmp, True)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a small file; None where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    out = bytes(stream.readAllBytes())
    stream.close()
    return out


def log_entries(spark: SparkSession, log: str) -> list[dict[str, Any]]:
    """The entries of a log folder in order of their numbers; none where there is no folder."""
    fs, p = _fs(spark, log)
    if not fs.exists(p):
        return []
    out = []
    for name in sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")):
        fs, file = _fs(spark, name)
        stream = fs.open(file)
        out.append(json.loads(bytes(stream.readAllBytes()).decode()))
        stream.close()
    return out


class Buckets:
    """Versions of a table in fixed hash buckets of a key, below one folder that outlives the session.

    Joins on the key don't exchange these rows. Names in the catalog are of one use; the files are all that counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n: int):
        self.spark, self.path, self.schema, self.key, self.n = spark, path, schema, key, n

    def bucket(self) -> Column:
        """The bucket that a key's rows are in."""
        return F.pmod(F.hash(self.key), F.lit(self.n))

    def aligned(self, df: DataFrame) -> DataFrame:
        """df, grouped by the key before, in the buckets' partitions: only exchanged where the session has another number."""
        return df if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) == self.n else df.repartition(self.n, self.key)

    def write(self, df: DataFrame, version: int) -> None:
        """Writes one version, in place of what a failed attempt may have left of it."""
        to, name = f"{self.path}/version={version}", f"quillspark_{uuid.uuid4().hex}"
        remove(self.spark, to)
        df.write.format("parquet").option("compression", "zstd").bucketBy(self.n, self.key).option("path", to).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def read(self) -> DataFrame:
        """All versions on disk, with the column version to choose by."""
        name, schema = f"quillspark_{uuid.uuid4().hex}", f"{self.schema}, version INT"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        at = self.path.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (version) CLUSTERED BY ({self.key}) INTO {self.n} BUCKETS LOCATION '{at}'")
        _tables.append((self.spark, name))
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name)

    def drop(self, version: int) -> None:
        remove(self.spark, f"{self.path}/version={version}")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001 - the session may be gone by now
            pass
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            pass


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and lost executors cost nothing.

    An empty df gives an empty df of the same schema.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size, an upper bound for files read whole."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_or_shuffled(df: DataFrame, max_bytes: int) -> DataFrame:
    """Hints a broadcast only where Catalyst's upper bound of the plan's size is at most max_bytes; else Spark decides at run
    time, when the shuffled size is known. Nothing is counted for it."""
    return F.broadcast(df) if size_bytes(df) <= max_bytes else df


def kth_smallest(df: DataFrame, col: str, k: int, step: int = 4, leaf: int = 20_000) -> str | None:
    """The k-th smallest value (from 1) of a column of distinct lower-case hex strings, without a global sort.

    Counts by prefix, step digits at a time (16**step counts at most reach the driver), goes down into the one
    prefix that holds the value, and sorts only a prefix that holds leaf rows or fewer. None when k < 1; the largest
    value when k exceeds the count; nulls don't count.
    """
    if k < 1:
        return None
    at, left = "", k
    rows = df.filter(F.col(col).isNotNull()).select(col)
    while True:
        part = rows.filter(F.col(col).startswith(at)) if at else rows
        bins = part.groupBy(F.substring(col, 1, len(at) + step).alias("b")).count().collect()
        if not bins:
            return None
        bins.sort(key=lambda r: r["b"])
        if at == "" and left > sum(r["count"] for r in bins):
            return rows.agg(F.max(col)).first()[0]
        for r in bins:
            if left <= r["count"]:
                break
            left -= r["count"]
        at, n = r["b"], r["count"]
        if n <= leaf or len(at) >= 28:
            found = rows.filter(F.col(col).startswith(at)).orderBy(col).limit(left).agg(F.max(col)).first()
            return found[0]


def kth_smallest_by(df: DataFrame, by: str, col: str, ks: dict[int, int], sizes: dict[int, int], leaf: int = 20_000) -> dict[int, str]:
    """kth_smallest for each value of an INT column: ks has k by it, sizes the number of its rows; a value without any isn't in the result.

    All values are gone down together, a pass a step, and one place of each reaches the driver. Only counts and the rows
    of the last prefixes are sorted; of those there are at most leaf a value, and fewer where the values are many.
    """
    spark, rows, depth = df.sparkSession, df.filter(F.col(col).isNotNull()).select(by, col), 0
    at = {g: ("", min(k, sizes[g]), sizes[g]) for g, k in ks.items() if k >= 1 and sizes.get(g)}
    if not at:
        return {}

    def here() -> DataFrame:
        places = spark.createDataFrame([(g, p, k) for g, (p, k, _) in at.items()], f"{by} INT, _at STRING, _k BIGINT")
        return rows.join(F.broadcast(places), by).filter(F.col(col).startswith(F.col("_at")))

    while depth < 28:
        most, total = max(n for _, _, n in at.values()), sum(n for _, _, n in at.values())
        if most <= leaf and (depth or total <= 50 * leaf):
            break
        depth += next((s for s in (1, 2, 3) if most <= leaf * 16**s), 4)
        bins = here().groupBy(by, "_k", F.substring(col, 1, depth).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        bins = bins.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by).orderBy("_b")))
        at = {r[by]: (r["_b"], r["_k"] - r["_upto"] + r["_n"], r["_n"]) for r in bins.filter("_upto >= _k AND _upto - _n < _k").collect()}
    ranked = here().withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(col)))
    return {r[by]: r[col] for r in ranked.filter("_r = _k").collect()}


def canonical_text(c: Column) -> Column:
    """Text with letter case, white space, invisible characters and punctuation set aside; null stays null.

    Keeps letters, numbers, marks and symbols. Beside lower case, sharp s is ss, and final sigma, long s and the micro
    sign are the letters they stand for.
    """
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}\p{S}]+", "")
    return F.translate(F.replace(F.lower(kept), F.lit("ß"), F.lit("ss")), "ςſµ", "σsμ")


def canonical_label(c: Column) -> Column:
    """A label with uneven writing set aside, as canonical_text; blank becomes null."""
    t = canonical_text(c)
    return F.when(t != "", t)


def canonical_uuid(c: Column) -> Column:
    """A 128-bit id in one spelling: 32 lower-case hex digits. Other strings are trimmed and lower-cased; blank is null."""
    t = F.lower(F.regexp_replace(c, r"[\s{}]", ""))
    bare = F.regexp_replace(t, "-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).when(t != "", t)


def env_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
