"""Queries of targets, losses and accuracies over pairs of neighbouring vectors as logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import losses
from quillspark.functions import numeric as N
from quillspark.plans.numeric_queries import _E, _LSE, _PP, emb, pairs, r
from quillspark.plans.registry import query
from quillspark.runtime import table

_KEPT = tuple(range(0, 64, 3))
_KL = ",".join(map(str, _KEPT))


@query(f"""WITH p AS (SELECT vec_id, v, {_LSE.format(x='v')} AS z, list_transform([{_KL}], lambda k: v[k + 1]) AS d, list_position(v, list_max(v)) - 1 AS t FROM ({_E})), q AS (SELECT *, {_LSE.format(x='d')} AS zd FROM p)
SELECT vec_id, CAST(t AS INTEGER) AS token, CAST(t % 3 = 0 AND vec_id % 2 = 0 AS INTEGER) AS mask, round(list_sum(list_transform(range(1, len(d) + 1), lambda i: i * exp(d[i] - zd))), 6) AS p, round(list_sum(list_transform(d, lambda x: exp(x - z))), 6) AS p_full FROM q""")
def target_p(spark: SparkSession, sf: str) -> DataFrame:
    t = emb(spark, sf).select("vec_id", losses.target_p(F.col("v"), _KEPT, F.col("vec_id") % 2 == 0).alias("t"))
    p = N.total(F.transform(F.col("t.p"), lambda x, i: x * (i + 1)))
    return t.select("vec_id", "t.token", "t.mask", r(p).alias("p"), r(N.total(F.col("t.p_full"))).alias("p_full"))


@query(f"""WITH h AS (SELECT vec_id, list_transform(range(0, 32), lambda i: v[i + 1] + 2 * v[i + 33]) AS v FROM ({_E})), p AS (SELECT vec_id, {_LSE.format(x='v')} AS z, list_transform([0, 5, 10, 15, 20, 25, 30], lambda k: v[k + 1]) AS d, list_position(v, list_max(v)) - 1 AS t FROM h), q AS (SELECT *, {_LSE.format(x='d')} AS zd FROM p)
SELECT vec_id, CAST(t AS INTEGER) AS token, CAST(t % 5 = 0 AS INTEGER) AS mask, round(list_sum(list_transform(range(1, len(d) + 1), lambda i: i * exp(d[i] - zd))), 6) AS p, round(list_sum(list_transform(d, lambda x: exp(x - z))), 6) AS p_full FROM q""")
def target_p_compact(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    head = np.hstack([np.eye(32), 2 * np.eye(32)])
    t = emb(spark, sf).select("vec_id", losses.target_from_hidden(F.col("v"), head, (0, 5, 10, 15, 20, 25, 30), F.lit(True), chunk=100).alias("t"))
    p = N.total(F.transform(F.col("t.p"), lambda x, i: x * (i + 1)))
    return t.select("vec_id", "t.token", "t.mask", r(p).alias("p"), r(N.total(F.col("t.p_full"))).alias("p_full"))


_CE = "(z{k} - {k}[vec_id % 64 + 1])"


@query(f"""WITH x AS (SELECT vec_id, {_CE.format(k='a')} AS f, {_CE.format(k='b')} AS s, vec_id % 3 AS w, (list_position(a, list_max(a)) - 1) % 4 = vec_id % 4 AS ok, vec_id % 5 = 0 AS valid FROM ({_PP}))
SELECT round(sum(f * w) / (sum(w) + 1e-6), 6) AS final_loss, round(sum(s * w) / (sum(w) + 1e-6), 6) AS base_loss, round(0.7 * sum(f * w) / (sum(w) + 1e-6) + 0.3 * sum(s * w) / (sum(w) + 1e-6), 6) AS loss,
 round(sum(CASE WHEN ok THEN w ELSE 0 END) / (sum(w) + 1e-6), 6) AS accuracy, round(sum(CASE WHEN ok THEN w ELSE 0 END) / greatest(sum(w), 1e-6), 6) AS accuracy_clamped, round(sum(CASE WHEN valid THEN w + 1.0 ELSE 0 END) / (count(*) FILTER (valid) + 1e-6), 6) AS accept_len FROM x""")
def domino_mix(spark: SparkSession, sf: str) -> DataFrame:
    target = (F.col("vec_id") % 64).cast("int")
    x = pairs(spark, sf).select("vec_id", losses.cross_entropy(F.col("a"), target).alias("f"), losses.cross_entropy(F.col("b"), target).alias("s"), N.argmax(F.col("a")).alias("best"))
    w, ok = F.col("vec_id") % 3, F.col("best") % 4 == F.col("vec_id") % 4
    fl, bl = losses.weighted_mean_loss(F.col("f"), w), losses.weighted_mean_loss(F.col("s"), w)
    return x.agg(
        r(fl).alias("final_loss"), r(bl).alias("base_loss"), r(losses.domino_mix(fl, bl, 0.3)).alias("loss"), r(losses.masked_accuracy(ok, w)).alias("accuracy"),
        r(losses.masked_accuracy(ok, w, clamp=True)).alias("accuracy_clamped"), r(losses.mean_accept_length(w, F.col("vec_id") % 5 == 0)).alias("accept_len"),
    )


@query("SELECT round(sum(user_id % 2 * CAST(event_id % 3 > 0 AS INTEGER)) / (sum(user_id % 2) + 1e-6), 6) AS accuracy, event_type FROM events GROUP BY 2")
def masked_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(r(losses.masked_accuracy(F.col("event_id") % 3 > 0, F.col("user_id") % 2)).alias("accuracy"))


@query(f"""WITH x AS (SELECT vec_id, list_sum(list_transform(range(1, len(a) + 1), lambda i: exp(a[i] - za) * (ln(greatest(exp(a[i] - za), 1e-12)) - (b[i] - zb)))) AS kl, -list_sum(list_transform(range(1, len(a) + 1), lambda i: exp(a[i] - za) * (b[i] - zb))) AS ce FROM ({_PP}))
SELECT round(avg(kl + CASE WHEN vec_id % 2 = 0 THEN 0.1 * ce ELSE 0 END), 6) AS loss, round(sum(ce * (vec_id % 2)) / count(*), 6) AS soft_ce FROM x""")
def composite_kd(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf).select("vec_id", N.softmax(F.col("a")).alias("t"), N.log_softmax(F.col("b")).alias("s"))
    mtp = F.when(F.col("vec_id") % 2 == 0, N.soft_cross_entropy(F.col("t"), F.col("s")))
    return p.agg(r(F.avg(losses.composite_kd(N.kl_divergence(F.col("t"), F.col("s")), mtp, 0.1))).alias("loss"), r(losses.masked_soft_cross_entropy(F.col("t"), F.col("s"), F.col("vec_id") % 2)).alias("soft_ce"))


@query(f"""SELECT vec_id, round(500 + greatest(a[1], b[1]) + ln(exp(a[1] - greatest(a[1], b[1])) + exp(b[1] - greatest(a[1], b[1]))), 6) AS lse, round(list_sum(list_transform(range(1, 65), lambda i: i * (a[i] * exp(a[1] - b[1]) + b[i]) / (exp(a[1] - b[1]) + 1))), 5) AS merged FROM ({_PP})""")
def attention_lse_merge(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c: F.get(c, F.lit(0)) + 500
    m = pairs(spark, sf).select("vec_id", losses.merge_attention(F.col("a"), at("a"), F.col("b"), at("b")).alias("m"))
    return m.select("vec_id", r(F.col("m.lse")).alias("lse"), F.round(N.total(F.transform(F.col("m.out"), lambda x, i: x * (i + 1))), 5).alias("merged"))


@query(f"""WITH s AS (SELECT vec_id, list_transform(v, lambda x: 0.9 * abs(x) + 0.1) AS s FROM ({_E})), p AS (SELECT vec_id, list_transform(range(1, 65), lambda i: list_product(s[1:i])) AS p FROM s)
SELECT vec_id, round(list_sum(p[1:64]) / p[1], 6) AS first_ratio, round(p[1], 6) AS first_prefix, round(list_sum(p), 6) AS first_suffix FROM p""")
def dpace_variants(spark: SparkSession, sf: str) -> DataFrame:
    h = emb(spark, sf).select("vec_id", F.transform("v", F.abs).alias("p"), F.transform("v", lambda _: F.lit(1)).alias("m"))
    h = h.select("vec_id", "m", N.prefix_products(F.col("p"), F.col("m"), 0.1).alias("x")).withColumn("y", N.suffix_sums(F.col("x"), F.col("m")))
    first = lambda kind: r(F.get(losses.dpace_weights(F.col("x"), F.col("y"), kind), F.lit(0)))
    return h.select("vec_id", first("dpace-continuation-value-only").alias("first_ratio"), first("dpace-cumulative-confidence-only").alias("first_prefix"), first("dpace").alias("first_suffix"))
