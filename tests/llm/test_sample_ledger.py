from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.llm.sample_ledger import SelectionLedger, stable_sample


def ids(spark, n, batches=4):
    return spark.range(n).select(F.md5(F.col("id").cast("string")).alias("id"), (F.col("id") % batches).cast("int").alias("batch_no"))


def keys(df):
    return {r["id"] for r in df.collect()}


def test_same_in_every_layout_and_growing(spark):
    df = ids(spark, 2000)
    all_ = keys(stable_sample(df))
    assert len(all_) == 200
    assert keys(stable_sample(df.repartition(7).unionByName(df.limit(300)))) == all_
    upto = [keys(stable_sample(df.filter(F.col("batch_no") <= k))) for k in range(4)]
    assert upto[0] < upto[1] < upto[2] < upto[3] == all_


def test_goes_on_in_a_new_session(spark, tmp_path):
    """The same folder with grown data, late rows of a known delivery among them, and in another session."""
    df = ids(spark, 900, 3)
    third, path = Fraction(1, 3), str(tmp_path)
    first = keys(stable_sample(df.filter("batch_no = 0 AND id < 'c'"), third, path))
    n = df.filter("batch_no = 0 AND id < 'c'").count()
    assert len(first) == n // 3 and keys(stable_sample(df.filter("batch_no = 0 AND id < 'c'"), third, path)) == first
    late = keys(stable_sample(df.filter("batch_no = 0"), third, path))
    assert first < late and len(late) == 100
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "7")
    grown = stable_sample(ids(other, 900, 3), third, path)
    assert late < keys(grown) and len(keys(grown)) == 300
    SelectionLedger(other, path, third).update(ids(other, 900, 3).withColumnRenamed("batch_no", "delivery").limit(0), [7])
    assert keys(SelectionLedger(spark, path, third).selected()) == keys(grown)


def test_failed_round_is_written_over(spark, tmp_path):
    df, path = ids(spark, 600, 2), str(tmp_path)
    stable_sample(df.filter("batch_no = 0"), path=path)
    a = SelectionLedger(spark, path)
    a.store.write(df.selectExpr("concat(id, 'x') AS id", "id AS priority", "batch_no AS delivery"), len(a.rounds))  # keys, but no entry
    assert keys(stable_sample(df, path=path)) == keys(stable_sample(df)) and len(keys(SelectionLedger(spark, path).selected())) == 60


def test_keys_of_earlier_rounds_stay_in_their_buckets(spark, tmp_path):
    df = ids(spark, 300, 2)
    stable_sample(df, path=str(tmp_path))
    a = SelectionLedger(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = a.store.aligned(df.groupBy("id").count()).join(a._keys().select("id"), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_cases(spark):
    u = "0123456789abcdef0123456789ABCDEF"
    rows = [(None, 0), ("", 0), (u, 0), (f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}".lower(), None), (" other ", 1), ("other", 1)]
    df = spark.createDataFrame(rows, "id STRING, batch_no INT").withColumn("priority", F.lit(1)).withColumn("delivery", F.lit(9))
    got = {(r["id"], r["delivery"]) for r in stable_sample(df, Fraction(1)).collect()}
    assert got == {(u.lower(), -1), ("other", 1)}
    assert stable_sample(df, Fraction(0)).count() == 0 and stable_sample(df.limit(0)).count() == 0


def drawn(deliveries, share=Fraction(1, 10)):
    """Brute force: what is drawn from the new keys of each delivery, one after the other."""
    seen, out = set(), set()
    for keys_ in deliveries:
        new = sorted({*keys_} - seen, key=lambda k: hashlib.md5(k.encode()).hexdigest() + k)
        seen |= {*new}
        out |= {*new[: int(share * len(seen)) - len(out)]}
    return out


def test_jobs_do_not_grow_with_the_deliveries(spark):
    def run(batches):
        spark.sparkContext.setJobGroup(f"ledger-{batches}", "")
        got = keys(stable_sample(ids(spark, 900, batches)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ledger-{batches}"))

    md5 = [hashlib.md5(str(k).encode()).hexdigest() for k in range(900)]
    (few, a), (many, b) = run(3), run(60)
    assert few == drawn([md5[k::3] for k in range(3)]) and many == drawn([md5[k::60] for k in range(60)])
    assert 0 < b <= a + 2


def test_late_and_fresh_deliveries_in_one_update(spark, tmp_path):
    """A key of a known and a new delivery belongs to the round of the known ones, even where their number is higher."""
    hexes = [hashlib.md5(str(k).encode()).hexdigest() for k in range(700)]
    old = {4: hexes[:100], 7: hexes[100:200]}
    new = {2: hexes[150:400], 4: hexes[90:130] + hexes[390:430], 7: hexes[380:500], 9: hexes[450:700], -5: hexes[:50]}
    df = lambda x: spark.createDataFrame([(k, d) for d, ks in x.items() for k in ks], "id STRING, batch_no INT")
    assert keys(stable_sample(df(old), path=str(tmp_path))) == drawn([old[4], old[7]])
    got = stable_sample(df(new), path=str(tmp_path)).collect()
    assert {r["id"] for r in got} == drawn([old[4], old[7], new[4] + new[7], new[-5], new[2], new[9]])
    first = {k: d for d in (9, 2, 7, 4) for k in new[d]} | {k: d for d in (7, 4) for k in old[d]}
    assert all(first[r["id"]] == r["delivery"] for r in got)
    a = SelectionLedger(spark, str(tmp_path))
    assert a.deliveries == {-5, 2, 4, 7, 9} and len(a.rounds) == 2
    assert {*map(tuple, stable_sample(df(new), path=str(tmp_path)).collect())} == {*map(tuple, got)} and len(SelectionLedger(spark, str(tmp_path)).rounds) == 2


def test_kth_smallest_by(spark):
    rows = [(g, hashlib.md5(f"{g} {k}".encode()).hexdigest()) for g, n in ((-1, 1), (3, 40), (5, 900)) for k in range(n)]
    want = {g: sorted(h for x, h in rows if x == g) for g in (-1, 3, 5)}
    df, sizes = spark.createDataFrame(rows, "g INT, h STRING"), {g: len(x) for g, x in want.items()}
    for leaf in (1, 10, 30, 2000):
        for ks in ({-1: 1, 3: 40, 5: 1}, {-1: 0, 3: 17, 5: 333, 8: 4}, {5: 9999}):
            got = runtime.kth_smallest_by(df, "g", "h", ks, sizes, leaf)
            assert got == {g: want[g][min(k, sizes[g]) - 1] for g, k in ks.items() if k and g in sizes}
    assert runtime.kth_smallest_by(df, "g", "h", {3: 0}, sizes) == {}
