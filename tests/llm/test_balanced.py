from __future__ import annotations

import math

import numpy as np
import pytest
from llm_rows import PROMPT, prompt
from pyspark.sql import functions as F

from quillspark.llm import balanced

TARGET = "category STRING, target_share DOUBLE, min_rows INT"


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_its_sum(seed):
    rng = np.random.default_rng(seed)
    pi = rng.random(501)
    out = balanced._flight(pi, rng)
    assert abs(out.sum() - pi.sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1


def test_odds_stay():
    """Over many flights each unit is drawn as often as its odds say."""
    pi = np.array([0.2, 0.5, 0.7, 0.6])
    got = np.mean([balanced._flight(pi, np.random.default_rng(s)) > 0.999 for s in range(6000)], axis=0)
    assert np.abs(got - pi).max() < 0.03


def test_allocate():
    a = balanced.allocate([("x", 0.5, 0), ("y", 0.4, 0), ("z", 0.1, 30)], {"x": 1000, "y": 20, "z": 40}, 100)
    assert abs(sum(a.values()) - 100) < 1e-6 and a["y"] == 20 and abs(a["z"] - 30) < 1e-6
    assert balanced.allocate([("x", 1.0, 0)], {}, 10) == {"x": 0.0}


def test_draw(spark):
    rows = [prompt(i, id=f"{i:032x}", category=("a", "B ", '"b"', "tiny")[0 if i % 10 < 6 else 1 + i % 2 if i % 50 else 3]) for i in range(3000)]
    rows += [prompt(9000, id=None), prompt(9001, id=f"{1:032x}", category="b"), prompt(9002, id="n", category=None)]
    df = spark.createDataFrame(rows, PROMPT).withColumn("label", F.lit("clash")).withColumn("pi", F.lit(1))
    t = spark.createDataFrame([("a", 0.3, 0), ("b", 0.6, 0), ("tiny", 0.1, 70), ("none", 0.0, 5), (None, 0.1, 1)], TARGET)
    sample, report = balanced.draw(df, t)
    rep = {r["category"]: r for r in report.collect()}
    assert {c for c, r in rep.items() if r["short"]} == {"tiny", "none"}
    assert all(abs(r["imbalance"]) < 1 for r in rep.values())
    assert sum(r["drawn"] for r in rep.values()) == 600 == sample.select("id").distinct().count()
    assert rep["b"]["supply"] == 1201
    again, _ = balanced.draw(df.repartition(13), t)
    assert {r["id"] for r in sample.collect()} == {r["id"] for r in again.collect()}


def test_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(balanced, "CHUNK", 50)
    monkeypatch.setattr(balanced, "ONE_TASK", 4)
    df = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    n = {"a": 667, "b": 1333}
    got = {r["label"]: r["count"] for r in balanced.cube_sample(df, {"a": 100.5, "b": 299.5}, n).groupBy("label").count().collect()}
    assert got["a"] in (100, 101) and sum(got.values()) == 400


def test_empty(spark):
    df = spark.createDataFrame([], PROMPT)
    sample, report = balanced.draw(df, spark.createDataFrame([("a", 0.3, 2)], TARGET))
    r = report.first()
    assert sample.count() == 0 and (r["supply"], r["wanted"], r["drawn"], r["short"]) == (0, 2, 0, True)
    assert math.isclose(r["expected"], 0)
