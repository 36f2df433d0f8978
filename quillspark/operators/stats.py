"""Aggregates of corpora, latencies, gates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with how many rows lie up to each; the window runs over distinct values, not rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    return counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))


def _at(index: Column) -> Column:
    """The value whose rows cover a 0-based index."""
    return F.min(F.when(F.col("_upto") > index, F.col("_v")))


def index_percentiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Per group the value at index min(n - 1, int(p * n)) of the sorted rows: nearest rank, never interpolated."""
    r = _ranked(df, by, value).withColumnRenamed(value, "_v")
    cols = [_at(F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1)).alias(k) for k, p in ps.items()]
    return r.groupBy(*by).agg(*cols)


def length_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, total, least, most and the upper-index p50, p95 and p99 per group."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    pct = index_percentiles(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(pct, by)


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, num_runs, median): interpolated medians of the values that aren't null, rounded to 2."""
    return df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count(value).alias("num_runs"), F.round(F.percentile(value, 0.5), 2).alias("median"))


def speedup(med: DataFrame, baseline: DataFrame, by: str) -> DataFrame:
    """Medians beside a baseline table (by, baseline_ms), as a ratio; categories without a median give null."""
    return baseline.join(med, by, "left").select(by, "baseline_ms", "median", (F.col("baseline_ms") / F.nullif("median", F.lit(0.0))).alias("speedup"))


def gates(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(task, score, threshold, passed): a null score and a missing one fail; a score at the threshold passes."""
    return thresholds.join(scores, "task", "left").select("task", "score", "threshold", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).alias("passed"))


def all_passed(gated: DataFrame) -> DataFrame:
    """One row; no tasks at all have passed."""
    return gated.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"), F.count(F.lit(1)).alias("n_tasks"))


def histogram(df: DataFrame, value: str, top: int) -> DataFrame:
    """(b, share) for b = 0..top, zeros filled in; values above top count in the whole only."""
    n = df.agg(F.count(value).alias("_all"))
    counts = df.groupBy(F.col(value).alias("b")).agg(F.count(F.lit(1)).alias("_n"))
    bins = df.sparkSession.range(top + 1).select(F.col("id").alias("b"))
    return bins.join(counts, "b", "left").crossJoin(F.broadcast(n)).select("b", (F.coalesce("_n", F.lit(0)) / F.greatest("_all", F.lit(1))).alias("share"))


def mean_of_means(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("macro_mean"))


def acceptance_from_counters(counters: DataFrame) -> DataFrame:
    """(drafts, accepted) after minus before as a mean acceptance length; null where no draft was made.

    counters: snapshot (before or after), drafts, accepted.
    """
    d = lambda c: F.sum(F.when(F.col("snapshot") == "after", F.col(c)).otherwise(-F.col(c)))
    out = counters.agg(d("drafts").alias("drafts"), d("accepted").alias("accepted"))
    return out.withColumn("mal", F.when(F.col("drafts") > 0, (F.col("accepted") + F.col("drafts")) / F.col("drafts")))


def masked_mean(value: Column, mask: Column, eps: float = 1e-8) -> Column:
    return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(eps))


def counter_delta(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def generator_counters(regen: DataFrame) -> DataFrame:
    """One row: done, truncated, empty answers and their shares, as a generator logs them."""
    from quillspark.functions import chat, text

    c = chat.normal_roles(F.col("conversations"))
    last = F.get(c, F.size(c) - 1)
    empty = (F.coalesce(last["role"], F.lit("")) != "assistant") | text.is_blank(last["content"])
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    return regen.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~cut & ~empty).alias("done"),
        F.count_if(cut).alias("truncated"),
        F.count_if(~cut & empty).alias("empty"),
    )
