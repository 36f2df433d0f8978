"""Token sequences: packing, padding, masks, vocabulary maps. Token arrays stay narrow and are exploded late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.select import running_total


def pack_offsets(df: DataFrame, order: str, n_tokens: str, capacity: int) -> DataFrame:
    """df with start (tokens and separators before the row), first_chunk and last_chunk: the rows' sequences, one
    separator behind each, lie end to end and are cut every capacity tokens. Sums are put together from partitions."""
    rows = running_total(df.withColumn("_len", F.col(n_tokens) + 1), order, "_len", "start").drop("_len")
    return rows.withColumns({"first_chunk": F.floor(F.col("start") / capacity), "last_chunk": F.floor((F.col("start") + F.col(n_tokens)) / capacity)})


def pack_sequences(df: DataFrame, order: str, ids: str, capacity: int, sep_id: int, pad_id: int) -> DataFrame:
    """(chunk_id, n_tokens, input_ids): chunks of capacity ids, the last one padded. Null and empty sequences are their
    separator only. A chunk gathers capacity ids at most, whatever the input."""
    rows = df.select(order, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    placed = pack_offsets(rows.withColumn("n", F.size("ids")), order, "n", capacity).withColumn("ids", F.concat("ids", F.array(F.lit(sep_id))))
    each = placed.withColumn("chunk_id", F.explode(F.sequence("first_chunk", "last_chunk")))
    from_ = F.greatest(F.col("chunk_id") * capacity - F.col("start"), F.lit(0))
    to = F.least((F.col("chunk_id") + 1) * capacity - F.col("start"), F.col("n") + 1)
    piece = F.slice("ids", (from_ + 1).cast("int"), (to - from_).cast("int"))
    got = each.select("chunk_id", F.struct("start", piece.alias("p")).alias("s")).groupBy("chunk_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    flat = F.flatten(F.transform("s", lambda x: x["p"]))
    padded = F.concat(F.col("f"), F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("f")))
    return got.select("chunk_id", flat.alias("f")).select("chunk_id", F.size("f").alias("n_tokens"), padded.alias("input_ids"))


def pad_batch(df: DataFrame, batch: str, ids: str, multiple: int = 1) -> DataFrame:
    """df with ids padded by zeros to the longest of the batch, rounded up to a multiple."""
    top = F.max(F.size(ids)).over(Window.partitionBy(batch))
    n = (F.ceil(top / multiple) * multiple).cast("int")
    return df.withColumn("_n", n).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(0), F.col("_n") - F.size(ids)))).drop("_n")


def truncate_and_zero_last(ids: Column, mask: Column, n: int) -> tuple[Column, Column]:
    """Both cut to n; the last place of the mask is 0."""
    m = F.slice(mask, 1, n)
    return F.slice(ids, 1, n), F.transform(m, lambda x, i: F.when(i == F.size(m) - 1, 0).otherwise(x))


def overlap_chunk(ids: Column, rank: int, world: int, overlap: int) -> Column:
    """The rank's share of a sequence, ceil(n / world) and overlap more, zeros behind its end."""
    share = F.ceil(F.size(ids) / world).cast("int")
    got = F.slice(ids, share * rank + 1, share + overlap)
    return F.concat(got, F.array_repeat(F.lit(0), F.greatest(share + overlap - F.size(got), F.lit(0))))


def assistant_mask(conversation: Column, last_only: bool = False) -> tuple[Column, Column]:
    """(tokens, mask) of a conversation with the plain tokenizer: 1 on what assistants say, 0 elsewhere."""
    last = F.coalesce(F.array_max(F.transform(conversation, lambda m, i: F.when(m["role"] == "assistant", i).otherwise(-1))), F.lit(-1))
    toks = F.flatten(F.transform(conversation, lambda m: text.words(m["content"])))

    def mask(m: Column, i: Column) -> Column:
        on = (m["role"] == "assistant") & ((i == last) if last_only else F.lit(True))
        return F.transform(text.words(m["content"]), lambda _: F.when(on, 1).otherwise(0))

    return toks, F.flatten(F.transform(conversation, mask))


def mask_by_spans(starts: Column, ends: Column, span_from: Column, span_to: Column, inclusive: bool = True) -> Column:
    """1 for tokens that touch a span (inclusive: a token that begins at the span's end counts), else those inside it."""
    spans = F.arrays_zip(span_from.alias("a"), span_to.alias("b"))
    if inclusive:
        hit = lambda s, e: F.exists(spans, lambda z: ~((e <= z["a"]) | (s > z["b"])))
    else:
        hit = lambda s, e: F.exists(spans, lambda z: (s >= z["a"]) & (e <= z["b"]))
    return F.zip_with(starts, ends, lambda s, e: F.when(hit(s, e), 1).otherwise(0))


def vocab_counts(df: DataFrame, ids: str, mask: str | None = None) -> DataFrame:
    """(id, cnt) of token ids, where the mask is 1 if there is one; counted before the shuffle."""
    if mask is None:
        return df.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("cnt"))
    z = df.select(F.explode(F.arrays_zip(F.col(ids).alias("t"), F.col(mask).alias("m"))).alias("z"))
    return z.filter("z.m = 1").groupBy(F.col("z.t").alias("id")).agg(F.count(F.lit(1)).alias("cnt"))


def draft_vocabulary(counts: DataFrame, draft: int) -> DataFrame:
    """(id, cnt): the draft most frequent ids, ties to the lower id; too few are filled by unseen ids from 0 at count 0."""
    unseen = counts.sparkSession.range(draft).select(F.col("id").cast("int").alias("id")).join(counts, "id", "left_anti").withColumn("cnt", F.lit(0).cast("long"))
    return counts.select("id", "cnt").unionByName(unseen).orderBy(F.desc("cnt"), "id").limit(draft)


def vocab_mapping(counts: DataFrame, draft: int, target: int) -> tuple[DataFrame, DataFrame]:
    """(draft_id, offset) with draft_id + offset the target id, and (target_id, kept), from token counts."""
    used = draft_vocabulary(counts, draft)
    d2t = used.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("draft_id")).select("draft_id", (F.col("id") - F.col("draft_id")).alias("offset"))
    all_ids = counts.sparkSession.range(target).select(F.col("id").cast("int").alias("target_id"))
    t2d = all_ids.join(F.broadcast(used.select(F.col("id").alias("target_id"), F.lit(True).alias("k"))), "target_id", "left").select("target_id", F.coalesce("k", F.lit(False)).alias("kept"))
    return d2t, t2d


def mapping_faults(d2t: DataFrame, t2d: DataFrame) -> DataFrame:
    """Target ids on one side of the mapping only; none if it is sound."""
    a = d2t.select((F.col("draft_id") + F.col("offset")).alias("target_id"))
    b = t2d.filter("kept").select("target_id")
    return a.join(b, "target_id", "left_anti").unionByName(b.join(a, "target_id", "left_anti"))


def coverage(counts: DataFrame, draft: int) -> DataFrame:
    """One row: share of all counted tokens that the draft vocabulary has, 0 if nothing was counted."""
    kept = draft_vocabulary(counts, draft).agg(F.sum("cnt").alias("kept"))
    return counts.agg(F.sum("cnt").alias("total")).crossJoin(kept).select(F.coalesce(F.col("kept") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("coverage"))


def accept_length(pred: Column, target: Column) -> Column:
    """Length of the matching prefix of two arrays."""
    bad = F.array_position(F.transform(F.arrays_zip(pred.alias("p"), target.alias("t")), lambda z: z["p"].eqNullSafe(z["t"])), False)
    return F.when(bad > 0, bad - 1).otherwise(F.least(F.size(pred), F.size(target)).cast("long")).cast("int")


def shift_left(a: Column) -> Column:
    return F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.lit(0)))


def shift_right(a: Column) -> Column:
    return F.concat(F.array(F.lit(0)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))


def gather(a: Column, index: Column) -> Column:
    """a at a 0-based index, clamped to its ends; null of an empty array."""
    return F.get(a, F.greatest(F.least(index, F.size(a) - 1), F.lit(0)))


def spread_layers(total: int, n: int) -> Column:
    """n layer ids spread over 1..total - 3, halves to even; a single one is total // 2."""
    if n == 1:
        return F.array(F.lit(total // 2))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(F.lit(1.0) + i * F.lit(float(total - 4)) / F.lit(float(n - 1))).cast("int"))


def anchors(lo: Column, hi: Column, k: int) -> Column:
    """Up to k anchors from lo to hi - 1, evenly spread, halves to even; none where hi <= lo."""
    n = F.least(F.lit(k), hi - lo)
    step = lambda i: F.bround(lo + (hi - 1 - lo) * i.cast("double") / F.greatest(n - 1, F.lit(1))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), step)).otherwise(F.array().cast("array<int>"))
