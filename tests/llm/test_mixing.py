from __future__ import annotations

from llm_rows import DOC
from pyspark.sql import functions as F

from quillspark.llm import mixing

WEIGHT = "source STRING, target_share DOUBLE, max_repeats INT"


def docs(spark, n=600):
    c = F.col("id")
    src = F.when(c % 3 > 0, "big").when(c % 2 == 0, "small").when(c % 9 == 3, F.lit(None).cast("string")).otherwise("other")
    return spark.range(n).select(c.alias("doc_id"), F.expr("repeat('word ', 1 + id % 7)").alias("text"), F.lit("en").alias("lang"), src.alias("source"), F.lit("d").alias("doc_domain"), F.lit(1).alias("size"))


def test_shares(spark, monkeypatch):
    w = spark.createDataFrame([("big", 0.3, 1), ("small", 0.5, 2), ("other", 0.2, 10), ("gone", 0.0, 3), (None, 0.5, 1)], WEIGHT)
    mixed, report = mixing.mix(docs(spark), w, budget=800)
    rep = {r["source"]: r for r in report.collect()}
    total = sum(r["drawn"] for r in rep.values())
    assert 780 <= total <= 800 and set(rep) == {"big", "small", "other", "gone"}
    for s, share in (("big", 0.3), ("small", 0.5), ("other", 0.2)):
        assert abs(rep[s]["actual_share"] - share) < 0.03
    rows = mixed.collect()
    assert [r["virtual_finish"] for r in rows] == sorted(r["virtual_finish"] for r in rows)
    assert mixed.groupBy("doc_id").count().join(mixed.select("doc_id", "source"), "doc_id").filter("source = 'big' AND count > 1 OR source = 'small' AND count > 2").count() == 0
    monkeypatch.setattr(mixing, "CHUNK", 25)
    again, _ = mixing.mix(docs(spark).repartition(9), w, budget=800)
    assert {(r["doc_id"], r["repeat"]) for r in again.collect()} == {(r["doc_id"], r["repeat"]) for r in rows}


def test_short_sources(spark):
    w = spark.createDataFrame([("small", 0.9, 2), ("big", 0.1, 1), ("gone", 0.1, 1)], WEIGHT)
    mixed, report = mixing.mix(docs(spark), w)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["small"]["short"] and rep["gone"]["short"] and not rep["big"]["short"]
    assert rep["small"]["drawn"] == 2 * rep["small"]["available"]


def test_empty(spark):
    w = spark.createDataFrame([("big", 0.5, 1)], WEIGHT)
    for d in (spark.createDataFrame([], DOC), spark.createDataFrame([(1, None, None, "big", None), (None, "", None, " ", None)], DOC)):
        mixed, report = mixing.mix(d, w)
        assert mixed.count() == 0 and report.first()["actual_share"] == 0
    mixed, report = mixing.mix(docs(spark), w.limit(0))
    assert mixed.count() == 0 and report.count() == 0
