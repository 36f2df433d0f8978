"""Problem 8: sources mixed to target weights by weighted fair queueing over shuffled documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.llm import tokens

CHUNK = 100_000  # documents summed in one window group at most, on average


def sized(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, size): tokens of each document; null texts have size 0, blank sources are null."""
    src = F.when(F.trim("source") != "", F.trim("source"))
    return tokens.with_tokens(docs.select("doc_id", src.alias("source"), "text"), "text", vocabulary, out="size")


def _level(budget: float, w: dict[str, float], most: dict[str, float]) -> float:
    """Virtual time at which sources served at rate w, each until most is used up, have supplied budget."""
    v, left = 0.0, budget
    for c in sorted((c for c in w if w[c] > 0 and most[c] > 0), key=lambda c: most[c] / w[c]):
        active = [s for s in w if w[s] > 0 and most[s] > 0 and most[s] / w[s] >= most[c] / w[c]]
        rate = sum(w[s] for s in active)
        end = most[c] / w[c]
        if (end - v) * rate >= left:
            return v + left / rate
        left -= (end - v) * rate
        v = end
    return v


def _first_beyond(tail: DataFrame, left: int, low: float, high: float, leaf: int = 20_000) -> tuple[float, int, int] | None:
    """(virtual_finish, doc_id, repeat) of the first document of the tail that exceeds left tokens; None if all fit.

    Sums over a thousand bins of the finish time lead to the bin that holds it, and on into that bin, until it holds leaf
    documents or fewer; only these are put in order by one task. Documents without tokens can't exceed anything.
    """
    rows = tail.filter("size > 0").select("virtual_finish", "doc_id", "repeat", "size")
    at = F.col("virtual_finish")
    while True:
        step = (high - low) / 1000
        part = rows.filter((at >= low) & (at <= high))
        bins = part.groupBy((F.floor((at - low) / step) if step > 0 else F.lit(0)).alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("z")).collect()
        for r in sorted(bins, key=lambda r: r["b"]):
            if r["s"] > left:
                break
            left -= r["s"]
        else:
            return None
        low, high = r["a"], r["z"]
        if r["n"] <= leaf or low == high:
            order = ["virtual_finish", "doc_id", "repeat"]
            run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            got = rows.filter((at >= low) & (at <= high)).withColumn("run", run).filter(F.col("run") > left).orderBy(*order).first()
            return got["virtual_finish"], got["doc_id"], got["repeat"]


def mix(docs: DataFrame, weights: DataFrame, budget: int | None = None, vocabulary: str = tokens.VOCABULARY, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mixed, report) for weights (source, target_share, max_repeats) and a budget in tokens, by default all documents'.

    mixed: (doc_id, source, repeat, size, virtual_finish) in the order of the mix, documents with no source or one
    without a weight left out. Each source's documents are shuffled by hash; a document's virtual finish time is the
    source's tokens up to it, repeats before it included, divided by the source's weight; the mix is sorted by it
    (a range sort) and ends where the next document would exceed the budget. A source with less than its share runs
    out after max_repeats rounds and the others go on at their rates. report: one row per weight with available,
    drawn, n_records, actual_share of what was drawn, last_finish (the virtual time at which the source's last copy within
    reach ends), and short, true where that time lies before the budget, at which a source with enough text has supplied its
    target_share of it. Null shares and repeats count as 0.

    Running sums are taken within chunks of the shuffle and put together from chunk totals, so no task holds a source.
    """
    spark = docs.sparkSession
    rows = runtime.materialize(sized(docs, vocabulary), "mix-sizes")
    want = [(r[0], float(r[1]), int(r[2])) for r in weights.select(F.trim("source"), F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))).filter("source IS NOT NULL").collect()]
    names = [r[0] for r in want]
    have = {c: 0 for c in names}
    total = n = longest = 0
    for r in rows.groupBy(F.when(F.col("source").isin(names), F.col("source")).alias("source")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).collect():
        total, n, longest = total + r["s"], n + r["n"], max(longest, r["m"])
        if r["source"] is not None:
            have[r["source"]] = r["s"]
    budget = total if budget is None else budget
    w = {c: s for c, s, _ in want}
    level = _level(budget, w, {c: have[c] * k for c, _, k in want})
    slack = longest / min([x for x in w.values() if x > 0], default=1.0)
    param = spark.createDataFrame([(c, s, k, have[c]) for c, s, k in want if s > 0 and k > 0 and have[c] > 0], "source STRING, w DOUBLE, k INT, all_size BIGINT")

    chunks = max(1, math.ceil(n / CHUNK))
    own = rows.join(F.broadcast(param), "source").withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**31)))
    own = own.withColumn("chunk", F.floor(F.col("place") * chunks / 2**31))
    sums = own.groupBy("source", "chunk").agg(F.sum("size").alias("s"))
    sums = sums.select("source", "chunk", (F.sum("s").over(Window.partitionBy("source").orderBy("chunk")) - F.col("s")).alias("before"))
    in_chunk = Window.partitionBy("source", "chunk").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = own.withColumn("own", F.sum("size").over(in_chunk)).join(sums, ["source", "chunk"]).withColumn("cum", F.col("own") + F.col("before"))
    reach = max(level, float(budget)) + slack  # a source with enough text has a document that ends between the level, or the budget, and this
    rounds = F.least(F.col("k") - 1, F.floor(F.lit(reach) * F.col("w") / F.col("all_size")).cast("int"))
    finish = (F.col("cum") + F.col("repeat") * F.col("all_size")) / F.col("w")
    timed = cum.withColumn("repeat", F.explode(F.sequence(F.lit(0), rounds))).select("doc_id", "source", "repeat", "size", finish.alias("virtual_finish"))
    timed = runtime.materialize(timed.filter(F.col("virtual_finish") <= reach), "mix-times")

    inside, tail = timed.filter(F.col("virtual_finish") <= level), timed.filter(F.col("virtual_finish") > level)
    left = budget - (inside.agg(F.sum("size")).first()[0] or 0)
    end = _first_beyond(tail, left, level, reach)
    if end is not None:
        tail = tail.filter(F.struct("virtual_finish", "doc_id", "repeat") < F.struct(F.lit(end[0]).alias("virtual_finish"), F.lit(end[1]).cast("long").alias("doc_id"), F.lit(end[2]).cast("int").alias("repeat")))
    mixed = inside.unionByName(tail)

    got = mixed.groupBy("source").agg(F.sum("size").alias("drawn"), F.count(F.lit(1)).alias("n_records"))
    ends = timed.groupBy("source").agg(F.max("virtual_finish").alias("last_finish"))
    base = spark.createDataFrame([(c, s, k, have[c]) for c, s, k in want], "source STRING, target_share DOUBLE, max_repeats INT, available BIGINT")
    report = base.join(ends, "source", "left").join(got, "source", "left").fillna(0, ["drawn", "n_records"])
    share = F.col("drawn") / F.nullif(F.sum("drawn").over(Window.partitionBy()), F.lit(0))
    dry = (F.col("target_share") > 0) & (F.coalesce("last_finish", F.lit(0.0)) < float(budget))
    report = report.withColumns({"actual_share": F.coalesce(share, F.lit(0.0)), "short": dry})
    return mixed.orderBy("virtual_finish", "doc_id", "repeat"), report
