"""Draft blocks over token positions: labels, masks, acceptance with invalid places, lookups between vocabularies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.functions import text
from quillspark.operators import select


def noise_block(anchor_token: Column, size: int, mask_id: int) -> Column:
    """The anchor's token and size - 1 masks behind it."""
    return F.concat(F.array(anchor_token.cast("int")), F.array_repeat(F.lit(mask_id), size - 1))


def block_labels(df: DataFrame, anchor: str, length: str, size: int) -> DataFrame:
    """df with one row per place k of the block: label_at (anchor + k, clamped to the sequence) and valid."""
    e = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    at = F.col(anchor) + F.col("k")
    return e.withColumns({"label_at": F.least(at, F.col(length) - 1), "valid": at < F.col(length)})


def masked_accept_length(pred: Column, target: Column, valid: Column) -> Column:
    """Length of the matching prefix where invalid places count as right but add nothing."""
    z = F.arrays_zip(pred.alias("p"), target.alias("t"), valid.alias("v"))
    wrong = F.transform(z, lambda x, i: F.when((x["v"] == 1) & (x["p"] != x["t"]), i).otherwise(F.size(pred)))
    return F.aggregate(F.slice(valid, F.lit(1), F.coalesce(F.array_min(wrong), F.lit(0))), F.lit(0), lambda a, x: a + x)


def draft_visible(q_block: Column, q_anchor: Column, kv: Column, kv_block: Column, length: int) -> Column:
    """Whether a draft query sees a key: context before its anchor, or its own block."""
    return ((kv < length) & (kv < q_anchor)) | ((kv >= length) & (kv_block == q_block))


def causal_visible(q: Column, kv: Column, n_valid: Column) -> Column:
    """Causal with padding: keys up to the query that are inside the sequence."""
    return (q >= kv) & (kv < n_valid)


def draft_to_target(ids: DataFrame, d2t: DataFrame, col: str) -> DataFrame:
    """ids with target_id = draft id + its offset; the mapping has one row per draft id and is broadcast where Spark finds it small."""
    return ids.join(d2t.withColumnRenamed("draft_id", col), col).withColumn("target_id", (F.col(col) + F.col("offset")).cast("int")).drop("offset")


def triplets(tensors: DataFrame) -> DataFrame:
    """(module, weight_packed, weight_scale, weight_shape) from (module, suffix, value), modules lacking one left out."""
    pick = lambda s: F.max(F.when(F.col("suffix") == s, F.col("value"))).alias(s)
    names = ("weight_packed", "weight_scale", "weight_shape")
    return tensors.groupBy("module").agg(*map(pick, names)).dropna(subset=list(names))


def stitched(base: DataFrame, extra: DataFrame, key: str, prefix: str) -> DataFrame:
    """base and those rows of extra whose key has the prefix and that base lacks."""
    more = extra.filter(F.col(key).startswith(prefix)).join(base.select(key), key, "left_anti")
    return base.unionByName(more.select(base.columns))


def split_by_lengths(flat: DataFrame, order: str, lengths: DataFrame, most: int = 1_000_000) -> DataFrame:
    """flat (order from 0 without gaps) with the index of the piece each row falls to; lengths: index, n, in order of index.

    Up to most pieces (16 MB) go to the executors as sorted ends, which each batch of rows is searched in. Longer lists are
    spelled out, one row for each position, and joined on it.
    """
    ends = runtime.materialize(select.running_total(lengths.filter("n > 0").select("index", F.col("n").cast("long").alias("n")), "index", "n", "_from"), "pieces")
    if ends.count() > most:
        step = 100_000
        block = ends.withColumn("_a", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("n") - 1, F.lit(step).cast("long"))))
        each = block.select("index", F.explode(F.sequence("_a", F.least(F.col("_a") + step, F.col("_from") + F.col("n")) - 1)).alias(order))
        return flat.join(each, order)
    known = ends.orderBy("_from").toPandas()
    start, last, name = known["_from"].to_numpy(dtype=np.int64), (known["_from"] + known["n"]).to_numpy(dtype=np.int64), known["index"].to_numpy()
    sent = flat.sparkSession.sparkContext.broadcast((start, last, name))

    @F.pandas_udf(lengths.schema["index"].dataType)
    def piece(at: pd.Series) -> pd.Series:
        start, last, name = sent.value
        p = at.to_numpy(dtype=np.int64)
        j = np.searchsorted(start, p, side="right") - 1
        ok = (j >= 0) & (p < last[np.maximum(j, 0)]) if len(last) else np.zeros(len(p), dtype=bool)
        return pd.Series(np.where(ok, name[np.maximum(j, 0)] if len(name) else 0, -1)).where(ok, None)

    return flat.withColumn("index", piece(F.col(order))).filter("index IS NOT NULL")


def audit(modules: DataFrame, expected: str, actual: str) -> DataFrame:
    """One row: n_quantized, n_skipped, n_mismatched, ok."""
    a = modules.agg(F.count_if(~F.col(actual)).alias("n_quantized"), F.count_if(F.col(actual)).alias("n_skipped"), F.count_if(F.col(expected) != F.col(actual)).alias("n_mismatched"))
    return a.withColumn("ok", F.col("n_mismatched") == 0)


def mismatches(modules: DataFrame, expected: str, actual: str, name: str) -> DataFrame:
    """(name) of the modules that aren't as expected, as rows."""
    return modules.filter(F.col(expected) != F.col(actual)).select(name)


def inject_scales(modules: DataFrame, scales: DataFrame, top: int = 7) -> DataFrame:
    """modules (name, n) with amax = scale * top and outcome: written, no_scale, or shape where the numbers of values differ.

    scales: name, scale ARRAY<DOUBLE>. Wrappers' prefixes of the names don't count.
    """
    key = text.strip_prefixes(F.col("name"), ("_teacher_model.", "_student."))
    got = modules.withColumn("_k", key).join(scales.withColumnRenamed("name", "_k"), "_k", "left").drop("_k")
    fits = F.size("scale") == F.col("n")
    outcome = F.when(F.col("scale").isNull(), "no_scale").when(~fits, "shape").otherwise("written")
    return got.select(*modules.columns, F.when(fits, F.transform("scale", lambda x: x * top)).alias("amax"), outcome.alias("outcome"))


def embedding_rows(ids: DataFrame, vectors: DataFrame, id_col: str, vec_id: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """ids with the columns of their vector; with a shard's range [first, end) only ids in it have one, as in a sharded table."""
    v = vectors if first is None else vectors.filter((F.col(vec_id) >= first) & (F.col(vec_id) < end))
    return ids.join(v.withColumnRenamed(vec_id, id_col), id_col, "inner" if first is None else "left")


def block_starts(df: DataFrame, by: str, order: str, size: int | None = None, block: str | None = None) -> DataFrame:
    """df with position in its group and starts: where the block column changes, or every size places where there is none."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.withColumn("position", F.row_number().over(w) - 1)
    if block is not None:
        return rows.withColumn("starts", F.coalesce(F.col(block) != F.lag(block).over(w), F.lit(True)))
    return rows.withColumn("starts", F.col("position") % size == 0)


def random_anchors(mask: Column, seed: Column, size: int, most: int) -> Column:
    """Struct (anchors, keep): up to most places with a mask of 1, size or more before the end, drawn by the hash of seed and place, in
    order; keep is 1 for each, and the rest up to most is 0 with keep 0."""
    last = F.greatest(F.size(mask) - size, F.lit(0))
    at = F.filter(F.transform(mask, lambda m, i: F.when((m == 1) & (i <= last), i)), lambda i: i.isNotNull())
    drawn = F.array_sort(F.transform(at, lambda i: F.struct(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i"))))
    picked = F.array_sort(F.transform(F.slice(drawn, 1, most), lambda x: x["i"]))
    rest = F.lit(most) - F.size(picked)
    return F.struct(F.concat(picked, F.array_repeat(F.lit(0), rest)).alias("anchors"), F.concat(F.transform(picked, lambda _: F.lit(1)), F.array_repeat(F.lit(0), rest)).alias("keep"))


def metric_or_like(metrics: DataFrame, by: str, key: str) -> DataFrame:
    """Per group the value of the metric named key, else of the first whose name contains it; (by, position, metric, value)."""
    hit = metrics.filter(F.col("metric").contains(key) & F.col("value").isNotNull())
    best = F.min(F.struct((F.col("metric") != key).alias("x"), F.col("position"), F.col("value")))
    return hit.groupBy(by).agg(best.getField("value").alias("value"))


def bucket_quota(df: DataFrame, bucket: str, position: str, id_col: str, target: int, over: float = 3.0) -> DataFrame:
    """Per bucket target rows by seeded hash out of the first round(target * over) by position."""
    first = F.row_number().over(Window.partitionBy(bucket).orderBy(position))
    head = df.withColumn("_k", first).filter(F.col("_k") <= round(target * over)).drop("_k")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(F.md5(F.concat(F.lit("0:"), F.col(id_col).cast("string"))), id_col))
    return head.withColumn("rank", rank).filter(F.col("rank") <= target)


def sampled_token(logits: Column, temperature: float, u: Column) -> Column:
    """0-based token: argmax below 1e-5, else where the cumulative softmax(l / T) passes the uniform u; the largest logit is taken
    off before, so nothing overflows."""
    best = (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
    if temperature < 1e-5:
        return best
    top = F.array_max(logits)
    w = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    walk = F.aggregate(
        w, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("k")), lambda a, x: F.struct((a["c"] + x).alias("c"), (a["k"] + F.when(a["c"] + x <= u * total, 1).otherwise(0)).alias("k"))
    )
    return F.least(walk["k"], F.size(logits) - 1)
