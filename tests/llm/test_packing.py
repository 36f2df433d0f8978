from __future__ import annotations

from collections import Counter, defaultdict
from itertools import product

import numpy as np
from llm_rows import REGEN, msgs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import packing


def bins_of(plan):
    out = defaultdict(list)
    for w, start, per, first, n in plan.segments:
        for k in range(n):
            out[first + k] += [w] * per
    return out


def optimum(items, cap):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                k = rooms.index(r)
                go(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, cap - items[i]])

    go(0, [])
    return best


@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
@settings(max_examples=300, deadline=None)
def test_plans_hold_every_item_once(case):
    cap, items = case
    plan = packing.solve(dict(Counter(items)), cap)
    bins = bins_of(plan)
    assert sorted(w for b in bins.values() for w in b) == sorted(items)
    assert all(sum(b) <= cap for b in bins.values()) and len(bins) == plan.n_bins
    for w, segs in ((w, [s for s in plan.segments if s[0] == w]) for w in set(items)):
        assert sorted(s[1] for s in segs) == np.cumsum([0, *(s[2] * s[4] for s in sorted(segs, key=lambda s: s[1]))])[:-1].tolist()


@given(st.lists(st.integers(1, 12), max_size=8))
@settings(max_examples=150, deadline=None)
def test_reduction_keeps_the_optimum(items):
    """What the reduction fixes, with the best packing of the rest, is a best packing of all."""
    counts = np.zeros(13, dtype=np.int64)
    for w in items:
        counts[w] += 1
    plan = packing.Plan(12)
    packing.reduce_dominated(counts, plan)
    rest = [w for w in range(13) for _ in range(counts[w])]
    assert plan.n_bins + optimum(rest, 12) == optimum(items, 12)


def test_pack(spark):
    text = lambda n: "ä" * n
    rows = [
        (1, msgs(("user", text(25)), ("assistant", None), ("assistant", "")), None), (2, None, None), (3, [], None), (4, msgs(("user", text(10)), ("user", text(11))), None),
        *[(5 + i, msgs(("user", text(n))), None) for i, n in product(range(4), (4, 6))], (1, msgs(("user", text(25))), None),
    ]
    df = spark.createDataFrame(rows, REGEN).withColumn("bin", F.lit("clash")).withColumn("length", F.lit(0))
    got = packing.pack(df, 10)
    assert {(r["resp_id"], r["turn"]) for r in got.filter("n_parts > 1").collect()} == {(1, 0), (4, 1)}
    used = {r["bin"]: r["s"] for r in got.groupBy("bin").agg(F.sum("part_length").alias("s")).collect()}
    assert max(used.values()) == 10 and sum(used.values()) == 25 * 2 + 21 + 40
    assert got.groupBy("resp_id", "turn", "length").agg(F.sum("part_length").alias("s"), F.first("length").alias("l")).filter("l > 0 AND try_mod(s, l) <> 0").count() == 0
    s = packing.summary(got, 10).first()
    assert s["n_bins"] == s["least_bins"] == 12
    assert packing.pack(df.limit(0), 10).count() == 0


def test_hot_length_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 20)
    df = spark.range(500).select(F.col("id").alias("resp_id"), F.expr("array(named_struct('role', 'user', 'content', repeat('x', if(id % 3 = 0, 7, 3))))").alias("conversations"))
    got = packing.pack(df, 10)
    used = got.groupBy("bin").agg(F.sum("part_length").alias("s"))
    assert got.count() == 500 and used.filter("s > 10").count() == 0 and used.count() == 223
