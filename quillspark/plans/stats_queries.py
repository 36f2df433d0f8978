"""Queries of lengths, latencies, gates, counters and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import losses, text
from quillspark.operators import stats, training
from quillspark.plans.chat_queries import _R, convs, s_blank
from quillspark.plans.registry import query
from quillspark.runtime import table

_PCT = "list_sort(list(n_chars))[CAST(least(floor({p} * count(n_chars)), count(n_chars) - 1) AS BIGINT) + 1]"


@query(f"SELECT source, {_PCT.format(p=0.5)} AS p50, {_PCT.format(p=0.95)} AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def pct_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_percentiles(table(spark, sf, "documents"), ["source"], "n_chars", {"p50": 0.5, "p95": 0.95})


@query(f"""SELECT doc_domain, count(n_chars) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most, {_PCT.format(p=0.5)} AS p50, {_PCT.format(p=0.95)} AS p95, {_PCT.format(p=0.99)} AS p99
 FROM documents WHERE doc_domain IS NOT NULL GROUP BY 1""")
def pct_index_upper(spark: SparkSession, sf: str) -> DataFrame:
    return stats.length_stats(table(spark, sf, "documents").filter("doc_domain IS NOT NULL"), ["doc_domain"], "n_chars")


@query("SELECT event_type AS category, count(value) AS num_runs, round(quantile_cont(value, 0.5), 2) AS median FROM events WHERE value IS NOT NULL GROUP BY 1")
def median_interp(spark: SparkSession, sf: str) -> DataFrame:
    return stats.medians(table(spark, sf, "events").select(F.col("event_type").alias("category"), "value"), "category", "value")


@query("SELECT round(avg(m), 2) AS average FROM (SELECT round(quantile_cont(value, 0.5), 2) AS m FROM events GROUP BY event_type)")
def mean_of_medians(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.medians(table(spark, sf, "events"), "event_type", "value")
    return m.agg(F.round(F.avg("median"), 2).alias("average"))


@query("""WITH b AS (SELECT 'click' AS category, 30.0::DOUBLE AS baseline_ms UNION ALL SELECT 'view', 20.0 UNION ALL SELECT 'absent', 9.0), m AS (SELECT event_type AS category, round(quantile_cont(value, 0.5), 2) AS median FROM events GROUP BY 1)
SELECT category, baseline_ms, median, baseline_ms / nullif(median, 0) AS speedup FROM b LEFT JOIN m USING (category)""")
def latency_speedup(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.createDataFrame([("click", 30.0), ("view", 20.0), ("absent", 9.0)], "category STRING, baseline_ms DOUBLE")
    m = stats.medians(table(spark, sf, "events").select(F.col("event_type").alias("category"), "value"), "category", "value")
    return stats.speedup(m.select("category", "median"), base, "category")


@query("SELECT round(avg(m), 4) AS macro_mean FROM (SELECT source, avg(n_chars) AS m FROM documents WHERE source IS NOT NULL GROUP BY 1)")
def macro_subtask_mean(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mean_of_means(table(spark, sf, "documents").filter("source IS NOT NULL"), "source", "n_chars").select(F.round("macro_mean", 4).alias("macro_mean"))


_GATE = """WITH s AS (SELECT source AS task, round(avg(n_chars), 4) AS score FROM documents GROUP BY 1), t AS (SELECT source AS task, target_share * 8000 AS threshold FROM source_weights)
SELECT t.task, s.score, round(t.threshold, 4) AS threshold, coalesce(s.score >= t.threshold, false) AS passed FROM t LEFT JOIN s USING (task)"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").groupBy(F.col("source").alias("task")).agg(F.round(F.avg("n_chars"), 4).alias("score"))
    t = table(spark, sf, "source_weights").select(F.col("source").alias("task"), (F.col("target_share") * 8000).alias("threshold"))
    return stats.gates(s, t).withColumn("threshold", F.round("threshold", 4))


@query(_GATE)
def gate_pass(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf)


@query(f"SELECT coalesce(bool_and(passed), true) AS all_passed, count(*) AS n_tasks FROM ({_GATE})")
def gate_all(spark: SparkSession, sf: str) -> DataFrame:
    return stats.all_passed(_gated(spark, sf))


@query("""WITH h AS (SELECT len(conversations) AS v FROM regen), n AS (SELECT count(*) AS n FROM h) SELECT b.b, coalesce(c.c, 0) / n.n AS share FROM (SELECT unnest(range(0, 9)) AS b) b CROSS JOIN n LEFT JOIN (SELECT v, count(*) AS c FROM h GROUP BY 1) c ON c.v = b.b""")
def accept_hist_micro(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(table(spark, sf, "regen").select(F.size("conversations").cast("long").alias("v")), "v", 8)


@query("SELECT round(avg(m), 6) AS macro_mean FROM (SELECT gen_model, avg(len(conversations)) AS m FROM regen GROUP BY 1)")
def mean_accept_macro(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "regen").select("gen_model", F.size("conversations").alias("v"))
    return stats.mean_of_means(r, "gen_model", "v").select(F.round("macro_mean", 6).alias("macro_mean"))


@query("""WITH e AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS snapshot, user_id AS drafts, user_id * 2 AS accepted FROM events)
SELECT CAST(d AS BIGINT) AS drafts, CAST(a AS BIGINT) AS accepted, CASE WHEN d > 0 THEN round((a + d) / d, 6) END AS mal FROM (SELECT sum(CASE WHEN snapshot = 'after' THEN drafts ELSE -drafts END) AS d, sum(CASE WHEN snapshot = 'after' THEN accepted ELSE -accepted END) AS a FROM e)""")
def mal_from_counters(spark: SparkSession, sf: str) -> DataFrame:
    snap = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), "before").otherwise("after")
    e = table(spark, sf, "events").select(snap.alias("snapshot"), F.col("user_id").alias("drafts"), (F.col("user_id") * 2).alias("accepted"))
    return stats.acceptance_from_counters(e).withColumn("mal", F.round("mal", 6))


@query("SELECT event_type, round(avg(value), 6) AS mean_tpot, round(1 / avg(value), 6) AS throughput, round(sum(user_id) / greatest(sum(value), 1e-6), 4) AS tokens_per_second FROM events GROUP BY 1")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    r = training.decode_rates(table(spark, sf, "events"), ["event_type"], "value", "user_id", "value")
    return r.select("event_type", F.round("mean_tpot", 6).alias("mean_tpot"), F.round("throughput", 6).alias("throughput"), F.round("tokens_per_second", 4).alias("tokens_per_second"))


@query("SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0) / nullif(avg(value) FILTER (user_id % 2 = 1), 0), 6) AS speedup FROM events GROUP BY 1")
def decode_speedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("kind", F.when(F.col("user_id") % 2 == 0, "base").otherwise("block"))
    return training.decode_speedup(e, ["event_type"], "kind", "value", "base", "block").select("event_type", F.round("speedup", 6).alias("speedup"))


@query("SELECT event_type, round(sum(value * (user_id % 2)) / greatest(sum(user_id % 2), 1e-8), 6) AS masked, round(sum(value * user_id) / (sum(user_id) + 1e-6), 6) AS weighted FROM events GROUP BY 1")
def masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    v, m = F.col("value"), F.col("user_id") % 2
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(stats.masked_mean(v, m), 6).alias("masked"), F.round(losses.weighted_mean_loss(v, F.col("user_id")), 6).alias("weighted"))


@query("SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def counter_delta(spark: SparkSession, sf: str) -> DataFrame:
    return stats.counter_delta(table(spark, sf, "events").select("event_id", "user_id"), "user_id", ["event_id"], "event_id")


@query(f"""WITH r AS (SELECT finish_reason = 'length' AS cut, c[len(c)].role AS role, c[len(c)].content AS content FROM ({_R.replace('SELECT resp_id', 'SELECT finish_reason')})),
s AS (SELECT coalesce(cut, false) AS cut, coalesce(role, '') <> 'assistant' OR {s_blank('content')} AS empty FROM r)
SELECT count(*) AS seen, count(*) FILTER (NOT cut AND NOT empty) AS done, count(*) FILTER (cut) AS truncated, count(*) FILTER (NOT cut AND empty) AS empty FROM s""")
def pair_count_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.generator_counters(table(spark, sf, "regen"))


@query("SELECT resp_id FROM regen WHERE finish_reason IS DISTINCT FROM 'length'")
def filter_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "regen").filter(~F.col("finish_reason").eqNullSafe("length")).select("resp_id")


@query(f"SELECT resp_id FROM ({_R}) WHERE len(c) > 0 AND c[len(c)].role = 'assistant' AND NOT {s_blank('c[len(c)].content')}")
def filter_empty(spark: SparkSession, sf: str) -> DataFrame:
    last = F.get("c", F.size("c") - 1)
    return convs(spark, sf, "regen", "resp_id").filter((F.size("c") > 0) & (last["role"] == "assistant") & ~text.is_blank(last["content"])).select("resp_id")


_LEN = "len(regexp_extract_all(coalesce(text, ''), '\\S+'))"


@query(f"SELECT doc_id, CAST({_LEN} AS INTEGER) AS n_tokens FROM documents WHERE {_LEN} < 100")
def filter_prompt_len(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("n_tokens")).filter("n_tokens < 100")


@query(f"SELECT doc_id, CAST({_LEN} AS INTEGER) AS n_tokens FROM documents WHERE {_LEN} >= 300")
def filter_min_context(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("n_tokens")).filter("n_tokens >= 300")


@query("SELECT status, CASE WHEN status IS NULL THEN 'transient' WHEN status < 400 THEN 'ok' WHEN status < 500 AND status <> 429 THEN 'permanent' ELSE 'transient' END AS kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 > 0 THEN CAST([200, 204, 301, 400, 404, 422, 429, 500, 503][event_id % 9 + 1] AS INTEGER) END AS status FROM events) GROUP BY ALL")
def http_permanent_vs_transient(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 204, 301, 400, 404, 422, 429, 500, 503))), (F.col("event_id") % 9 + 1).cast("int"))
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 11 > 0, code).alias("status"))
    return e.groupBy("status", text.status_kind(F.col("status")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_LW = "regexp_extract_all(coalesce(text, ''), '\\S+')"


@query(f"""WITH d AS (SELECT doc_id, {_LW} AS w FROM documents WHERE len({_LW}) >= 256 ORDER BY doc_id LIMIT 60)
SELECT doc_id, c.category, md5(array_to_string(w[1:c.n], ' ')) AS digest FROM d CROSS JOIN (VALUES ('short', 8), ('medium', 64), ('long', 256)) c(category, n)""")
def longbench_latency_pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = training.latency_pool(table(spark, sf, "documents"), "doc_id", "text", {"short": 8, "medium": 64, "long": 256}, 60)
    return pool.select("doc_id", "category", F.md5("prompt").alias("digest"))


@query("SELECT len(conversations) AS turns, repeat('filler ', CAST(greatest(1, len(conversations) // 2) AS INTEGER)) AS filler, count(*) AS n FROM regen GROUP BY 1, 2")
def filler_repeat(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size("conversations")
    return table(spark, sf, "regen").groupBy(n.cast("long").alias("turns"), training.filler("filler ", F.floor(n / 2)).alias("filler")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT category, count(*) AS n FROM prompts GROUP BY 1) SELECT category, n, n / sum(n) OVER () AS share FROM t""")
def category_share(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "prompts").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
