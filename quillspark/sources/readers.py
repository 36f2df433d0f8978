"""Readers with explicit schemas; broken rows are counted or left out, never fatal."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATION = "array<struct<role:string,content:string>>"


def read_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Named columns of one or more Parquet files; the scan reads no others."""
    return spark.read.parquet(path).select(*cols)


def shard_paths(root: str, category: str, n: int) -> list[str]:
    """Names of a category's shards, category-i-of-n."""
    return [f"{root}/{category}-{i:05d}-of-{n:05d}.parquet" for i in range(n)]


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a pattern in order of their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [])


def read_shards(spark: SparkSession, pattern: str, cols: list[str]) -> DataFrame:
    """Named columns of all shards of a pattern, with shard, the place of a row's file in the order of names."""
    paths = glob_paths(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    place = F.array_position(F.array(*(F.lit(p.rsplit("/", 1)[-1]) for p in paths)), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)) - 1
    return spark.read.parquet(*paths).select(*cols, place.cast("int").alias("shard"))


def exclude_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ids, as text, of several JSONL files; a missing file is warned of and left out."""
    found = []
    for p in paths:
        if spark_exists(spark, p):
            found.append(json_lines(spark, p, "id STRING").filter("id IS NOT NULL"))
        else:
            warnings.warn(f"{p} isn't there", stacklevel=2)
    out = spark.createDataFrame([], "id STRING")
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def spark_exists(spark: SparkSession, path: str) -> bool:
    from quillspark import runtime

    return runtime.exists(spark, path)


def benchmark_prompts(spark: SparkSession, name: str, source: Callable[[], DataFrame], root: str) -> DataFrame:
    """(position, prompt) of a known benchmark kind, built from the columns of its source and cached under its name; an unknown
    kind raises before anything is read."""
    from quillspark.functions import chat
    from quillspark.sources import sinks

    need = {"gsm8k": ["question"], "math500": ["problem"], "humaneval": ["prompt"], "mbpp": ["prompt"], "mt-bench": ["prompt"], "longbench": ["context", "question"]}
    if name not in need and name not in chat.DATASETS:
        raise ValueError(f"unknown kind {name!r}")

    def build() -> DataFrame:
        df = source()
        cols = need.get(name) or [c for c in df.columns if c != "position"]
        return df.select("position", chat.dataset_prompt(name, **{c: F.col(c) for c in cols}).alias("prompt"))

    return sinks.cached(build, spark, root, "benchmark", name)


def resolve_template(value: str | None) -> str | None:
    """default: none; the name of a file: its contents; anything else is the template itself."""
    if value is None or value == "default":
        return None
    return Path(value).read_text() if len(value) < 4096 and Path(value).is_file() else value


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL with a given schema; blank and broken lines are left out."""
    return parse_lines(spark.read.text(path), "value", schema)


def parse_lines(df: DataFrame, col: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """A text column of JSON objects parsed; lines that aren't one are left out. Fields the line lacks are null."""
    text = F.trim(col)
    good = df.filter((text != "") & F.expr(f"try_parse_json(`{col}`) IS NOT NULL") & text.startswith("{"))
    return good.select(*(keep or []), F.from_json(col, schema).alias("_r")).select(*(keep or []), "_r.*")


def line_quality(df: DataFrame, col: str) -> DataFrame:
    """One row: lines, blank, good and broken."""
    text = F.trim(col)
    blank = F.coalesce(text == "", F.lit(True))
    ok = F.expr(f"try_parse_json(`{col}`) IS NOT NULL")
    return df.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & ok).alias("n_good"), F.count_if(~blank & ~ok).alias("n_broken"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines of a text file, stripped; column id."""
    from quillspark.operators.select import distinct_ids

    return distinct_ids(spark.read.text(path).withColumnRenamed("value", "id"))


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a JSONL folder; none where it doesn't exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "id STRING")
    return json_lines(spark, path, "id STRING").filter("id IS NOT NULL").distinct()


def local_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, size) of all files below a folder with a suffix, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", F.col("length").alias("size")).orderBy("path")


def metrics(lines: DataFrame, col: str = "line") -> DataFrame:
    """(name, total): the sum over all label sets of each counter in exposition text, all of them in one scan; comments and
    lines without a number don't count."""
    name = F.regexp_extract(col, r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{.*\})? \S+\s*$", 1)
    value = F.expr(f"try_cast(substring_index(trim(`{col}`), ' ', -1) AS double)")
    return lines.select(name.alias("name"), value.alias("v")).filter("name <> '' AND v IS NOT NULL").groupBy("name").agg(F.sum("v").alias("total"))


def metric(lines: DataFrame, name: str, col: str = "line") -> DataFrame:
    """One row: the sum over all label sets of one counter in exposition text; null if it was never seen."""
    mine = lines.filter(F.col(col).rlike(rf"^{name}[{{ ]"))
    return mine.agg(F.sum(F.expr(f"try_cast(substring_index(`{col}`, ' ', -1) AS double)")).alias("total"))


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base with over's values, dictionaries merged level by level; the result shares nothing with either."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(defaults: dict[str, Any], path: str | None) -> dict[str, Any]:
    """Defaults merged with a JSON or (if the library is there) YAML file; a missing file leaves the defaults."""
    import json

    if not path or not Path(path).is_file():
        return copy.deepcopy(defaults)
    text = Path(path).read_text()
    if path.endswith(".json"):
        got = json.loads(text)
    else:
        import yaml  # optional

        got = yaml.safe_load(text)
    return deep_merge(defaults, got or {})
