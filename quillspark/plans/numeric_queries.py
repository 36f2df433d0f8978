"""Queries of numeric kernels over the embeddings table; sums are rounded alike on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import losses, schedules
from quillspark.functions import numeric as N
from quillspark.operators import blocks
from quillspark.plans.registry import query
from quillspark.runtime import table

_E = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_G = "list_transform(range(0, len(v), 32), lambda g: v[g + 1 : g + 32])"
_SC = "greatest(list_max(list_transform({g}, lambda x: abs(x))) / 7, 1e-30)"


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", N.doubles(F.col("embedding")).alias("v"))


def r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


@query(f"SELECT vec_id, g.i AS grp, round({_SC.format(g='g.g')}, 9) AS scale FROM (SELECT vec_id, unnest(list_transform(range(0, len(v) // 32), lambda i: {{'i': i, 'g': v[i * 32 + 1 : i * 32 + 32]}})) AS g FROM ({_E}))")
def group_absmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = emb(spark, sf).select("vec_id", F.posexplode(N.int4_scales(F.col("v"), 32)).alias("grp", "scale"))
    return s.select("vec_id", F.col("grp").cast("long").alias("grp"), r(F.col("scale"), 9).alias("scale"))


_CODES = f"flatten(list_transform({_G}, lambda g: list_transform(g, lambda x: CAST(greatest(least(round_even(x / {_SC.format(g='g')}, 0), 7), -8) AS INTEGER))))"


@query(f"SELECT vec_id, array_to_string({_CODES}, ',') AS codes FROM ({_E})")
def quantize_int4_amax(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("vec_id", F.array_join(N.int4_codes(F.col("v"), 32).cast("array<string>"), ",").alias("codes"))


@query(f"""WITH c AS (SELECT vec_id, {_CODES} AS c FROM ({_E})) SELECT vec_id, CAST(w AS INTEGER) AS w, CAST(CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END AS INTEGER) AS word
FROM (SELECT vec_id, w, list_sum(list_transform(range(0, 8), lambda j: (c[w * 8 + j + 1] + 8)::BIGINT * CAST(pow(16, j) AS BIGINT))) AS s FROM (SELECT vec_id, c, unnest(range(0, len(c) // 8)) AS w FROM c))""")
def pack_int4(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("vec_id", F.posexplode(N.pack_int4(N.int4_codes(F.col("v"), 32))).alias("w", "word"))


@query(f"SELECT vec_id, array_to_string({_CODES}, ',') AS codes FROM ({_E})")
def unpack_int4(spark: SparkSession, sf: str) -> DataFrame:
    p = emb(spark, sf).select("vec_id", F.size("v").alias("n"), N.pack_int4(N.int4_codes(F.col("v"), 32)).alias("p"))
    return p.select("vec_id", F.array_join(N.unpack_int4(F.col("p"), F.col("n")).cast("array<string>"), ",").alias("codes"))


_BF = "CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / pow(2.0, floor(log2(abs({x}))) - 7), 0) * pow(2.0, floor(log2(abs({x}))) - 7) END"


@query(f"""WITH c AS (SELECT vec_id, {_CODES} AS c, list_transform({_G}, lambda g: {_SC.format(g='g')}) AS s FROM ({_E}))
SELECT vec_id, round(list_sum(list_transform(range(1, len(c) + 1), lambda i: abs(c[i] * ({_BF.format(x='s[(i - 1) // 32 + 1]')})))), 6) AS l1 FROM c""")
def dequant_block(spark: SparkSession, sf: str) -> DataFrame:
    d = N.dequantize(N.int4_codes(F.col("v"), 32), N.int4_scales(F.col("v"), 32), 32)
    return emb(spark, sf).select("vec_id", r(N.total(F.transform(d, F.abs))).alias("l1"))


@query(f"SELECT count(*) FILTER (m > 0.5000001) AS off_grid, count(*) AS n FROM (SELECT list_max(flatten(list_transform({_G}, lambda g: list_transform(g, lambda x: abs(x / {_SC.format(g='g')} - round_even(x / {_SC.format(g='g')}, 0)))))) AS m FROM ({_E}))")
def grid_check(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf).select("v", N.int4_codes(F.col("v"), 32).alias("q"), N.int4_scales(F.col("v"), 32).alias("s"))
    cell = e.select(F.posexplode(F.arrays_zip("v", "q")).alias("i", "z"), "s")
    off = F.abs(F.col("z.v") / F.element_at("s", (F.floor(F.col("i") / 32) + 1).cast("int")) - F.col("z.q"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    m = cell.select(off.alias("m")).agg(F.count_if(F.col("m") > 0.5000001).alias("off_grid")).crossJoin(F.broadcast(n))
    return m.select("off_grid", "n")


_PAIR = f"SELECT a.vec_id, a.v AS a, b.v AS b FROM ({_E}) a JOIN ({_E}) b ON b.vec_id = a.vec_id + 1"
_LSE = "(list_max({x}) + ln(list_sum(list_transform({x}, lambda y: exp(y - list_max({x}))))))"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf)
    return e.select("vec_id", F.col("v").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


_PP = f"SELECT vec_id, a, b, {_LSE.format(x='a')} AS za, {_LSE.format(x='b')} AS zb FROM ({_PAIR})"


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: exp(a[i] - za) * (ln(greatest(exp(a[i] - za), 1e-12)) - (b[i] - zb)))), 6) AS kl, round(-list_sum(list_transform(range(1, len(a) + 1), lambda i: exp(a[i] - za) * (b[i] - zb))), 6) AS ce FROM ({_PP})")
def kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf).select("vec_id", N.softmax(F.col("a")).alias("t"), N.log_softmax(F.col("b")).alias("s"))
    return p.select("vec_id", r(N.kl_divergence(F.col("t"), F.col("s"))).alias("kl"), r(N.soft_cross_entropy(F.col("t"), F.col("s"))).alias("ce"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: least(exp(a[i] - za), exp(b[i] - zb)))), 6) AS acceptance FROM ({_PP})")
def acceptance_rate(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("vec_id", r(N.acceptance(N.softmax(F.col("a")), N.softmax(F.col("b")))).alias("acceptance"))


@query(f"""WITH x AS (SELECT vec_id, list_sum(list_transform(range(1, len(a) + 1), lambda i: least(exp(a[i] - za), exp(b[i] - zb)))) AS acc FROM ({_PP})) SELECT round(avg(acc), 6) AS mean_acc, round(-avg(ln(acc)), 6) AS alpha_loss, round(avg(exp(-2 * acc)), 6) AS lambda_weight FROM x""")
def lk_loss(spark: SparkSession, sf: str) -> DataFrame:
    x = pairs(spark, sf).select(N.acceptance(N.softmax(F.col("a")), N.softmax(F.col("b"))).alias("acc"))
    return x.agg(r(F.avg("acc")).alias("mean_acc"), r(-F.avg(F.log("acc"))).alias("alpha_loss"), r(F.avg(F.exp(-2 * F.col("acc")))).alias("lambda_weight"))


@query(f"SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best FROM ({_E})")
def argmax(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("vec_id", N.argmax(F.col("v")).alias("best"))


@query(f"SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(0, len(v)), lambda i: {{'x': -v[i + 1], 'i': i}}))[1:4], lambda s: s.i), ',') AS experts FROM ({_E})")
def topk_experts(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("vec_id", F.array_join(N.top_k(F.col("v"), 4).cast("array<string>"), ",").alias("experts"))


@query(f"""WITH p AS (SELECT list_transform(v, lambda x: exp(x - z)) AS p, list_transform(list_sort(list_transform(range(0, len(v)), lambda i: {{'x': -v[i + 1], 'i': i}}))[1:4], lambda s: s.i) AS k FROM (SELECT v, {_LSE.format(x='v')} AS z FROM ({_E}))),
e AS (SELECT unnest(range(0, 64)) AS e), n AS (SELECT count(*) AS n FROM p), f AS (SELECT k AS e, count(*) AS c FROM (SELECT unnest(k) AS k FROM p) GROUP BY 1), m AS (SELECT i AS e, sum(x) AS s FROM (SELECT unnest(p) AS x, unnest(range(0, 64)) AS i FROM p) GROUP BY 1)
SELECT round(64 * sum(coalesce(f.c, 0) / n.n * m.s / n.n), 6) AS balance FROM e JOIN m USING (e) LEFT JOIN f USING (e) CROSS JOIN n""")
def moe_load_balance(spark: SparkSession, sf: str) -> DataFrame:
    p = emb(spark, sf).select(N.softmax(F.col("v")).alias("p"), N.top_k(F.col("v"), 4).alias("k"))
    n = p.agg(F.count(F.lit(1)).alias("n"))
    used = p.select(F.explode("k").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    mean = p.select(F.posexplode("p").alias("e", "x")).groupBy("e").agg(F.sum("x").alias("s"))
    j = mean.join(used, "e", "left").crossJoin(F.broadcast(n))
    return j.agg(r(64 * F.sum(F.coalesce("c", F.lit(0)) / F.col("n") * F.col("s") / F.col("n"))).alias("balance"))


@query(f"WITH c AS (SELECT vec_id, unnest([0, 16, 32, 48]) AS o, v FROM ({_E})), q AS (SELECT vec_id, list_max(v[o + 1 : o + 16]) AS m, list_sum(list_transform(v[o + 1 : o + 16], lambda x: exp(x - list_max(v[o + 1 : o + 16])))) AS s FROM c), g AS (SELECT vec_id, max(m) AS mm FROM q GROUP BY 1) SELECT vec_id, round(mm + ln(sum(s * exp(m - mm))), 6) AS lse FROM q JOIN g USING (vec_id) GROUP BY vec_id, mm")
def logsumexp_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = emb(spark, sf).select("vec_id", F.explode(N.groups(F.col("v"), 16)).alias("c"))
    parts = c.select("vec_id", losses.lse_parts(F.col("c")).alias("p"))
    return losses.merged_lse(parts, "vec_id", "p").select("vec_id", r(F.col("lse")).alias("lse"))


@query("SELECT CAST(k AS INTEGER) AS k, round(exp(-greatest(k - 1, 0) / 4.0), 9) AS w FROM range(16) x(k)")
def position_decay_weight(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(N.decay_weights(16, 1, 4.0)).alias("k", "w")).select("k", F.round("w", 9).alias("w"))


_SM = f"SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > -0.1 THEN 0.9 * abs(x) + 0.1 ELSE 1.0 END) AS s, list_transform(v, lambda x: CASE WHEN x > -0.1 THEN 1 ELSE 0 END) AS m FROM ({_E})"
_PX = f"SELECT vec_id, m, list_transform(range(1, 65), lambda i: list_product(s[1:i])) AS p FROM ({_SM})"


@query(f"SELECT vec_id, round(p[64], 9) AS last_prefix, round(list_sum(list_transform(range(1, 65), lambda i: p[i] * m[i])), 9) AS first_suffix FROM ({_PX})")
def dpace_weight(spark: SparkSession, sf: str) -> DataFrame:
    h = emb(spark, sf).select("vec_id", F.transform("v", F.abs).alias("p"), F.transform("v", lambda x: F.when(x > -0.1, 1).otherwise(0)).alias("m"))
    h = h.select("vec_id", "m", N.prefix_products(F.col("p"), F.col("m"), 0.1).alias("x"))
    return h.select("vec_id", F.round(F.get("x", F.lit(63)), 9).alias("last_prefix"), F.round(F.get(N.suffix_sums(F.col("x"), F.col("m")), F.lit(0)), 9).alias("first_suffix"))


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 1e-6)))), 6) AS l1, round(-v[33], 6) AS turned FROM ({_E})")
def rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("vec_id", r(N.total(F.transform(N.rms_norm(F.col("v")), F.abs))).alias("l1"), r(F.get(N.rotate_half(F.col("v")), F.lit(0))).alias("turned"))


@query(f"SELECT i, j, round(2.0 / n * sum(v[i + 1] * v[j + 1]), 6) AS h FROM ({_E}), (SELECT count(*) AS n FROM embeddings), (SELECT CAST(unnest(range(64)) AS INTEGER) AS i), (SELECT CAST(unnest(range(64)) AS INTEGER) AS j) GROUP BY i, j, n")
def hessian_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    return N.hessian(emb(spark, sf), "v").select("i", "j", r(F.col("h")).alias("h"))


@query()
def gptq_quantize(spark: SparkSession, sf: str) -> DataFrame:
    """Modules of 64 rows, each with the 256 vectors behind its own as calibration inputs; brute force in tests/test_losses.py."""
    e = emb(spark, sf).withColumn("m", F.floor(F.col("vec_id") / 64))
    w = e.select(F.concat(F.lit("m"), "m").alias("module"), (F.col("vec_id") % 64).cast("int").alias("row_idx"), "v")
    x = e.select(F.explode(F.sequence(F.greatest(F.col("m") - 4, F.lit(0)), F.greatest(F.col("m") - 1, F.lit(0)))).alias("of"), F.col("v").alias("x")).select(F.concat(F.lit("m"), "of").alias("module"), "x")
    g = N.gptq(w, x, 32)
    return g.select("module", "row_idx", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), r(F.col("err"), 9).alias("err"))


@query("SELECT e.vec_id, e.label, len(list_filter(range(0, 64), lambda k: abs(k - e.vec_id % 64) <= 7)) AS visible, 64::BIGINT AS whole FROM embeddings e")
def swa_predicate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 64).alias("q"))
    seen = lambda longest: F.size(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda k: N.window_visible(F.col("q"), k, 8, longest))).cast("long")
    return e.select("vec_id", "label", seen(64).alias("visible"), seen(8).alias("whole"))


@query("SELECT vec_id, len(list_filter(range(0, 96), lambda k: (vec_id % 32 >= k AND k < 20 AND vec_id % 32 < 20) OR (k >= 32 AND (k - vec_id % 32) % 32 = 0 AND k % 32 < 20))) AS visible FROM embeddings")
def eagle_mask_predicate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 32).alias("q"))
    seen = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(95).cast("long")), lambda k: N.suffix_visible(F.col("q"), k, F.lit(20), 32))
    return e.select("vec_id", F.size(seen).cast("long").alias("visible"))


_COS = "0.1 * (1 + cos(pi() * ({s}) / {n})) / 2"


@query(f"""SELECT CAST(t AS INTEGER) AS step, round(CASE WHEN t < 10 THEN (t + 1) / 10.0 * 0.1 ELSE {_COS.format(s='t - 10', n='90.0')} END, 9) AS lr,
 round(CASE WHEN t < 10 THEN (t + 1) / 10.0 * 0.1 WHEN t < 25 THEN 0.1 ELSE {_COS.format(s='t - 25', n='75.0')} END, 9) AS lr_warm_delayed, round(CASE WHEN t < 20 THEN 0.1 ELSE {_COS.format(s='t - 20', n='80.0')} END, 9) AS lr_delayed,
 count(*) AS n FROM (SELECT event_id % 100 AS t FROM events) GROUP BY t""")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    steps = table(spark, sf, "events").groupBy((F.col("event_id") % 100).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    late = schedules.delayed(t, 0.1, 20, lambda s: schedules.cosine(s, 0.1, 80))
    rates = {"lr": schedules.warmup_cosine(t, 0.1, 100, 10), "lr_warm_delayed": schedules.warmup_cosine(t, 0.1, 100, 10, 15), "lr_delayed": late}
    return steps.select(t.cast("int").alias("step"), *(F.round(c, 9).alias(k) for k, c in rates.items()), "n")


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 129), lambda i: v[(i - 1) // 2 + 1] * i)), 6) AS repeated, round(list_sum(list_transform(range(1, 17), lambda i: v[16 + i] * i)), 6) AS chunk, round(list_sum(list_transform(range(1, 17), lambda i: (CASE WHEN i <= 8 THEN v[8 + i] ELSE v[40 + i - 8] END) * i)), 6) AS merged, round(list_sum(v[17:32]) + 2 * list_sum(v[49:64]), 6) AS layers FROM ({_E})")
def chunk_shard(spark: SparkSession, sf: str) -> DataFrame:
    """repeat_kv, rank chunks plain and merged, and the states of two layers end to end."""
    v = F.col("v")
    weigh = lambda a: r(N.total(F.transform(a, lambda x, i: x * (i + 1))))
    states = N.groups(v, 16)
    both = N.concat_layers(states, (0, 2))
    layers = r(N.total(F.slice(both, 1, 16)) + 2 * N.total(F.slice(both, 17, 16)))
    return emb(spark, sf).select("vec_id", weigh(N.repeat_groups(v, 2)).alias("repeated"), weigh(N.rank_chunk(v, 1, 4)).alias("chunk"), weigh(N.merged_chunk(v, (32, 32), 1, 4)).alias("merged"), layers.alias("layers"))


@query(f"WITH s AS (SELECT label, [round(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 7, 9)] AS scale FROM embeddings WHERE label % 2 = 0 GROUP BY 1) SELECT e.vec_id, CASE WHEN e.vec_id % 7 > 0 THEN round(s.scale[1] * 7, 6) END AS amax, CASE WHEN s.scale IS NULL THEN 'no_scale' WHEN e.vec_id % 7 = 0 THEN 'shape' ELSE 'written' END AS outcome FROM embeddings e LEFT JOIN s USING (label)")
def inject_amax(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("l"), "label").alias("layer"), "label", N.absmax(N.doubles(F.col("embedding"))).alias("a"))
    s = e.filter("label % 2 = 0").groupBy("layer").agg(F.array(F.round(F.max("a") / 7, 9)).alias("scale")).withColumnRenamed("layer", "name")
    m = e.select("vec_id", F.concat(F.when(F.col("vec_id") % 3 == 0, F.lit("_student.")).otherwise(""), "layer").alias("name"), F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1).alias("n"))
    return blocks.inject_scales(m, s).select("vec_id", r(F.get("amax", F.lit(0))).alias("amax"), "outcome")


@query(f"SELECT w.label, s.scale, count(*) AS n FROM embeddings w LEFT JOIN (SELECT label, round(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 7, 9) AS scale FROM embeddings WHERE label % 2 = 0 GROUP BY 1) s USING (label) GROUP BY ALL")
def lookup_scale_by_module(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", N.absmax(N.doubles(F.col("embedding"))).alias("a"))
    s = e.filter("label % 2 = 0").groupBy("label").agg(F.round(F.max("a") / 7, 9).alias("scale"))
    return e.join(s, "label", "left").groupBy("label", "scale").agg(F.count(F.lit(1)).alias("n"))
