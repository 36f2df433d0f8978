"""Selecting rows: deduplication, exclusion, quotas, splits, orders and samples, all by hashes instead of generators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import runtime

ID_LIST_BYTES = 64 << 20  # estimated bytes of an id list that may be broadcast; longer lists are joined by shuffle


def distinct_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """The distinct ids of a column as strings, stripped, blanks and nulls left out."""
    v = F.regexp_replace(F.col(col).cast("string"), r"(?U)^\s+|\s+$", "")
    return df.select(v.alias(col)).filter(F.col(col) != "").distinct()


def union_ids(frames: list[DataFrame], col: str = "id") -> DataFrame:
    out = frames[0].select(F.col(col).cast("string").alias(col))
    for f in frames[1:]:
        out = out.unionByName(f.select(F.col(col).cast("string").alias(col)))
    return out.filter(F.col(col).isNotNull()).distinct()


def without(df: DataFrame, ids: DataFrame, col: str = "id") -> DataFrame:
    """Rows whose id isn't listed; rows with a null id stay, as nothing says that they were drawn."""
    return df.join(runtime.small_or_shuffled(ids.select(col).filter(F.col(col).isNotNull()).distinct(), ID_LIST_BYTES), col, "left_anti")


def within(df: DataFrame, ids: DataFrame, col: str = "id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(runtime.small_or_shuffled(ids.select(col).filter(F.col(col).isNotNull()).distinct(), ID_LIST_BYTES), col, "left_semi")


def missing_ids(wanted: DataFrame, have: DataFrame, col: str = "id") -> DataFrame:
    """Wanted ids that no row has."""
    return wanted.select(col).filter(F.col(col).isNotNull()).distinct().join(have.select(col), col, "left_anti")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null keys form one group. Partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in order and c != key]
    first = F.min_by(F.struct(*rest, *order), F.struct(*order)).alias("r")
    out = df.groupBy(key).agg(first)
    return out.select(key, *(F.col(f"r.{c}").alias(c) for c in [*rest, *order]))


def representatives(df: DataFrame, group: Column, text: Column, id_col: str) -> DataFrame:
    """(grp, text_md5, id): per group and text the id of lowest md5; ids break ties. Null groups and ids don't count."""
    rows = df.select(group.alias("grp"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"), F.col(id_col).cast("string").alias("id")).filter("grp IS NOT NULL AND id IS NOT NULL")
    best = F.min(F.struct(F.md5("id").alias("h"), F.col("id").alias("id")))
    return rows.groupBy("grp", "text_md5").agg(best.getField("id").alias("id"))


def rank_by_hash(df: DataFrame, by: list[str], id_col: str, seed: str = "") -> DataFrame:
    """df with rank, from 1 in each group, by md5 of the id. A filter rank <= n becomes a group limit before the shuffle."""
    h = F.md5(F.concat(F.lit(seed + ":" if seed else ""), F.col(id_col).cast("string")))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(h, id_col)))


def quota(df: DataFrame, by: str, id_col: str, want: Column | int) -> DataFrame:
    """Up to want rows per group, by md5 rank; filter rows before, so that a rejected row frees its place."""
    return rank_by_hash(df, [by], id_col).filter(F.col("rank") <= want)


def corpus_draw(prompts: DataFrame, exclude: DataFrame, want: int, oversample: float = 1.0) -> DataFrame:
    """(category, rank, id): the corpus draw. Ids drawn before are excluded, equal user texts of a category keep the
    id of lowest md5, and each category gives its want lowest ranks. Keys only travel: texts are hashed in the scan."""
    from quillspark.functions import chat, text

    rows = prompts.select(
        runtime.canonical_uuid(F.col("id")).alias("id"), runtime.canonical_label(F.col("category")).alias("category"), chat.normal_roles(F.col("conversations")).alias("c")
    )
    rows = rows.filter(F.exists("c", lambda m: m["role"] == "user") & ~text.is_blank(chat.user_text(F.col("c"))))
    drawn = exclude.select(runtime.canonical_uuid(F.col("id")).alias("id"))
    rep = representatives(without(rows.filter("id IS NOT NULL"), drawn), F.col("category"), chat.user_text(F.col("c")), "id")
    rep = rep.select(F.col("grp").alias("category"), "id").distinct()
    return quota(rep, "category", "id", int(want * oversample)).select("category", "rank", "id")


def priority_order(df: DataFrame, category: str, first: list[str], position: str) -> DataFrame:
    """Listed categories first in their order, all else after them, input order within."""
    p = F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col(category)), F.lit(0))
    return df.withColumn("priority", F.coalesce(p, F.lit(len(first) + 1)).cast("int")).orderBy("priority", position)


def train_val(df: DataFrame, id_col: str, ratio: float, seed: str = "0") -> DataFrame:
    """df with split: the int(n * ratio) rows of lowest seeded hash are val, all else train. Ids must be distinct.

    The border is found by counts of hash prefixes, so no task ranks the whole table.
    """
    h = F.concat(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))), F.col(id_col).cast("string"))
    rows = df.withColumn("_h", h)
    cut = runtime.kth_smallest(rows, "_h", int(df.count() * ratio))
    is_val = F.col("_h") <= F.lit(cut) if cut is not None else F.lit(False)
    return rows.withColumn("split", F.when(is_val, "val").otherwise("train")).drop("_h")


def sample_limit(df: DataFrame, id_col: str, n: int, seed: str = "0") -> DataFrame:
    """The n rows of lowest seeded hash, or all if there are fewer: a feature that takes a limit."""
    h = F.concat(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))), F.col(id_col).cast("string"))
    rows = df.withColumn("_h", h)
    cut = runtime.kth_smallest(rows, "_h", n)
    return (rows.filter(F.col("_h") <= cut) if cut is not None else rows.limit(0)).drop("_h")


def cycle(pool: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    """n rows, i being row (offset + i) mod size of the ordered pool; a warm-up takes the places behind the measured ones by its
    offset. The pool is joined by place, not sent: it may be of any size."""
    numbered = global_position(pool, order).withColumnRenamed("position", "_k")
    size = numbered.count()
    if size == 0:
        return pool.withColumn("i", F.lit(0).cast("long")).limit(0)
    i = pool.sparkSession.range(n).select(F.col("id").alias("i"), F.pmod(F.col("id") + offset, F.lit(size)).cast("long").alias("_k"))
    return i.join(numbered, "_k").drop("_k")


def shard(df: DataFrame, order: str, world: int, drop_last: bool = False) -> DataFrame:
    """df with shard: row i of the order goes to shard i mod world; drop_last drops the rows that fill no whole round.

    Positions come from counts per range partition, so they are exact without a global window.
    """
    rows = global_position(df, order).withColumn("shard", F.pmod(F.col("position"), F.lit(world)).cast("int"))
    if drop_last:
        rows = rows.filter(F.col("position") < (df.count() // world) * world)
    return rows


def _numbered(df: DataFrame, order: str, value: str | None) -> DataFrame:
    """df in range partitions of a column, with _p, the partition, and _r, what lies before each row in it: rows, or the sum of a value.

    The partition's own task counts, in order, while it writes, so rows are shuffled once. Nulls of the value count 0.
    """
    fields, names = df.schema.fields, df.columns
    at = None if value is None else names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.ones(b.num_rows, dtype=np.int64) if at is None else np.array([x or 0 for x in b.column(at).to_pylist()], dtype=np.int64)
            upto = np.cumsum(n) + before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, p, dtype=np.int32)), pa.array(upto - n)], names=[*names, "_p", "_r"])
            before = int(upto[-1]) if len(upto) else before

    schema = T.StructType([*fields, T.StructField("_p", T.IntegerType()), T.StructField("_r", T.LongType())])
    return runtime.materialize(df.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, schema), "numbered")


def _carried(rows: DataFrame, sizes: DataFrame, out: str) -> DataFrame:
    """_r and the totals of the partitions before, one number for each partition."""
    offsets = sizes.withColumn("_before", F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).drop("_s")
    return rows.join(F.broadcast(offsets), "_p").withColumn(out, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def global_position(df: DataFrame, order: str) -> DataFrame:
    """df with position, from 0, in the order of a column: range partitions are numbered within and offset by the
    counts of the partitions before (one number per partition). Ties get some order."""
    rows = _numbered(df, order, None)
    return _carried(rows, rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_s")), "position")


def running_total(df: DataFrame, order: str, value: str, out: str = "before") -> DataFrame:
    """df with the sum of value over all rows before each in the order of a column of distinct values, the same way."""
    rows = _numbered(df, order, value)
    return _carried(rows, rows.groupBy("_p").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_s")), out)


def drawn_rows(prompts: DataFrame, draw: DataFrame) -> DataFrame:
    """(category, rank, id, conversations, reasoning) of a draw's ids, in a second pass over the prompts: of the rows with a drawn
    id, the first by line_no that makes a prompt. Texts are read for drawn ids only."""
    from quillspark.functions import chat

    rows = prompts.select(runtime.canonical_uuid(F.col("id")).alias("id"), "line_no", "conversations", "reasoning")
    rows = within(rows, draw).withColumn("conversations", chat.to_prompt(chat.normal_roles(F.col("conversations")))).filter("conversations IS NOT NULL")
    return draw.join(first_per_key(rows, "id", ["line_no"]), "id").select("category", "rank", "id", "conversations", "reasoning")


def head(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows of an order, a feature that takes a limit; all where there is none."""
    return df if n is None else df.orderBy(*order).limit(n)


def fraction(df: DataFrame, by: list[str], id_col: str, share: float | int) -> DataFrame:
    """Of each group a share of the rows (below 1) or a number of them, those of lowest hash."""
    ranked = rank_by_hash(df, by, id_col)
    if share >= 1:
        return ranked.filter(F.col("rank") <= int(share)).drop("rank")
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * share).alias("_n"))
    return ranked.join(sizes, by).filter(F.col("rank") <= F.col("_n")).drop("rank", "_n")


def tasks_subset(tasks: DataFrame, csv: str | None, name: str = "task", key: str = "key") -> DataFrame:
    """Tasks whose name or key is in a comma-separated list; all without a list. It is an error if none is."""
    if not csv:
        return tasks
    wanted = [x.strip() for x in csv.split(",") if x.strip()]
    out = tasks.filter(F.col(name).isin(wanted) | F.col(key).isin(wanted))
    if out.isEmpty():
        raise ValueError(f"no task is named {csv!r}")
    return out


def concat_splits(parts: list[DataFrame]) -> DataFrame:
    """The ranks' lists as one, with the rank each row comes from."""
    out = parts[0].withColumn("rank", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("rank", F.lit(k)))
    return out


def dual_views(df: DataFrame, content: Column, mode: str = "both") -> DataFrame:
    """df with view (think, no_think) and text, one row for each view of the mode: the content as it is, and without reasoning
    blocks; a trace that never closes takes the rest with it."""
    from quillspark.functions import text

    views = {"think": content, "no_think": text.strip_think_blocks(content)}
    names = list(views) if mode == "both" else [mode]
    v = F.array(*(F.struct(F.lit(k).alias("view"), views[k].alias("text")) for k in names))
    return df.withColumn("_v", F.explode(v)).select(*df.columns, "_v.view", "_v.text")
