from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import losses, numeric, schedules
from quillspark.operators import blocks


def brute_gptq(w, x, size, damp=0.01):
    """Column by column in plain loops."""
    w, d = w.copy(), w.shape[1]
    h = np.eye(d) if x is None else sum(2.0 / len(x) * np.outer(r, r) for r in x)
    for i in range(d):
        if h[i, i] == 0:
            h[i, i], w[:, i] = 1, 0
    h = h + np.eye(d) * damp * max(np.mean(np.diag(h)), 1e-8)
    u = np.linalg.cholesky(np.linalg.inv(h)).T
    codes = np.zeros(w.shape, dtype=int)
    for k in range(len(w)):
        row = w[k].copy()
        for i in range(d):
            if i % size == 0:
                s = max(np.abs(row[i : i + size]).max() / 7, 1e-9)
            codes[k, i] = np.clip(np.rint(row[i] / s), -8, 7)
            e = (row[i] - codes[k, i] * s) / u[i, i]
            for j in range(i + 1, d):
                row[j] -= e * u[i, j]
    return codes


def test_gptq_against_loops(spark):
    rng = np.random.default_rng(5)
    w = {m: rng.normal(size=(6, 12)) for m in "abc"}
    x = {"a": rng.normal(size=(40, 12)) @ rng.normal(size=(12, 12)), "b": rng.normal(size=(30, 12))}
    x["b"][:, 4] = 0
    df = spark.createDataFrame([(m, i, list(map(float, v[i]))) for m, v in w.items() for i in range(6)], "module STRING, row_idx INT, v ARRAY<DOUBLE>")
    inputs = spark.createDataFrame([(m, list(map(float, r))) for m, v in x.items() for r in v], "module STRING, x ARRAY<DOUBLE>")
    got = {(r["module"], r["row_idx"]): list(r["codes"]) for r in numeric.gptq(df, inputs, 4).collect()}
    for m in w:
        want = brute_gptq(w[m], x.get(m), 4)
        assert all(got[m, i] == want[i].tolist() for i in range(6))
    assert numeric.gptq(df.limit(0), inputs.limit(0), 4).count() == 0 and numeric.gptq(df, None, 4).count() == 18


def test_merges_are_stable(spark):
    v = [[1000.0, 999.0], [-1000.0, 1001.0], [0.0]]
    df = spark.createDataFrame([(1, c) for c in v] + [(2, [-1000.0, -1001.0]), (2, [-1002.0])], "k INT, c ARRAY<DOUBLE>")
    got = {r["k"]: r["lse"] for r in losses.merged_lse(df.select("k", losses.lse_parts(F.col("c")).alias("p")), "k", "p").collect()}
    assert got[1] == pytest.approx(1001 + np.log(1 + np.exp(-1) + np.exp(-2))) and got[2] == pytest.approx(-1000 + np.log(1 + np.exp(-1) + np.exp(-2)))
    one = spark.createDataFrame([([1.0, 2.0], 900.0, [3.0, 5.0], 900.0)], "a ARRAY<DOUBLE>, x DOUBLE, b ARRAY<DOUBLE>, y DOUBLE")
    m = one.select(losses.merge_attention(F.col("a"), F.col("x"), F.col("b"), F.col("y")).alias("m")).first()["m"]
    assert list(m["out"]) == pytest.approx([2.0, 3.5]) and m["lse"] == pytest.approx(900 + np.log(2))


def test_sampling_with_large_logits(spark):
    """exp(1000) is infinite; the right token is the one of the largest logit."""
    df = spark.createDataFrame([([1.0, 10.0, 3.0], 0.5), ([5.0, 5.0], 0.75), ([5.0, 5.0], 0.25)], "v ARRAY<DOUBLE>, u DOUBLE")
    assert [r[0] for r in df.select(blocks.sampled_token(F.col("v"), 0.01, F.col("u"))).collect()] == [1, 1, 0]


def test_schedules(spark):
    t = F.col("id")
    r = spark.range(100).select(schedules.warmup_cosine(t, 1.0, 100, 10, 5).alias("a"), schedules.warmup_cosine(t, 1.0, 100, 0).alias("b")).collect()
    assert r[0]["a"] == pytest.approx(0.1) and r[9]["a"] == r[14]["a"] == r[15]["a"] == 1.0 and r[16]["a"] < 1.0 and r[0]["b"] == 1.0 and r[99]["b"] < 0.001


def test_targets_of_odd_rows(spark):
    df = spark.createDataFrame([([900.0, -900.0, 0.0, 1.0], True), ([0.0, 0.0, 0.0, 0.0], False)], "v ARRAY<DOUBLE>, m BOOLEAN")
    a, b = (r["t"] for r in df.select(losses.target_p(F.col("v"), (1, 3), F.col("m")).alias("t")).collect())
    assert list(a["p"]) == pytest.approx([0, 1]) and a["token"] == 0 and a["mask"] == 0 and list(b["p_full"]) == pytest.approx([0.25, 0.25]) and b["mask"] == 0
