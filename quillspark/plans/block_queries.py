"""Queries of blocks, audits, mappings and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import blocks, select, tokens, training
from quillspark.plans.registry import query
from quillspark.plans.token_queries import _D, _DV, V, docs
from quillspark.runtime import table


@query("SELECT e.doc_id, k.k, least(e.doc_id % 40 + k.k, 39)::BIGINT AS label_at, e.doc_id % 40 + k.k < 40 AS valid FROM documents e CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS k) k")
def block_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 40).alias("anchor"), F.lit(40).cast("long").alias("n"))
    return blocks.block_labels(d, "anchor", "n", 8).select("doc_id", "k", "label_at", "valid")


@query("SELECT doc_id, (doc_id % 100) || ',9,9,9' AS block FROM documents")
def noise_block(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks.noise_block(F.col("doc_id") % 100, 4, 9)
    return table(spark, sf, "documents").select("doc_id", F.array_join(b.cast("array<string>"), ",").alias("block"))


@query(f"""WITH s AS (SELECT doc_id, ids, coalesce(list_min(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] % 3 > 0 AND ids[i] % 7 <> ids[i] % 14 THEN i - 1 END)), len(ids)) AS k FROM ({_D}))
SELECT doc_id, CAST(len(list_filter(ids[1:k], lambda x: x % 3 > 0)) AS INTEGER) AS n FROM s""")
def accept_len_masked(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.transform("ids", lambda x: x % 7).alias("p"), F.transform("ids", lambda x: x % 14).alias("t"), F.transform("ids", lambda x: F.when(x % 3 > 0, 1).otherwise(0)).alias("v"))
    return d.select("doc_id", blocks.masked_accept_length(F.col("p"), F.col("t"), F.col("v")).alias("n"))


@query("""SELECT count(*) FILTER (kv < 24 AND kv < (q // 4) * 5 + 3 OR kv >= 24 AND (kv - 24) // 4 = q // 4) AS visible, count(*) FILTER (q >= kv AND kv < 20) AS causal FROM range(16) a(q), range(40) b(kv)""")
def attention_mask_predicate(spark: SparkSession, sf: str) -> DataFrame:
    q, kv = F.col("q"), F.col("kv")
    block = F.floor(q / 4)
    grid = spark.range(16 * 40).select(F.floor(F.col("id") / 40).alias("q"), (F.col("id") % 40).alias("kv"))
    return grid.agg(F.count_if(blocks.draft_visible(block, block * 5 + 3, kv, F.floor((kv - 24) / 4), 24)).alias("visible"), F.count_if(blocks.causal_visible(q, kv, F.lit(20))).alias("causal"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS draft, id AS target_id FROM ({_DV})")
def map_draft_to_target(spark: SparkSession, sf: str) -> DataFrame:
    d2t = tokens.vocab_mapping(tokens.vocab_counts(docs(spark, sf), "ids"), 1000, V)[0]
    return blocks.draft_to_target(spark.range(1000).select(F.col("id").cast("int").alias("draft")), d2t, "draft")


_T = "SELECT 'm' || (vec_id // 3) AS module, CASE vec_id % 3 WHEN 0 THEN 'weight_packed' WHEN 1 THEN 'weight_scale' ELSE 'weight_shape' END AS suffix, CAST(label AS VARCHAR) AS value FROM embeddings WHERE vec_id <> 7"


@query(f"SELECT module, max(value) FILTER (suffix = 'weight_packed') AS weight_packed, max(value) FILTER (suffix = 'weight_scale') AS weight_scale, max(value) FILTER (suffix = 'weight_shape') AS weight_shape FROM ({_T}) GROUP BY 1 HAVING count(*) = 3")
def group_triplet(spark: SparkSession, sf: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, ("weight_packed", "weight_scale", "weight_shape"))), (F.col("vec_id") % 3 + 1).cast("int"))
    t = table(spark, sf, "embeddings").filter("vec_id <> 7").select(F.concat(F.lit("m"), F.floor(F.col("vec_id") / 3)).alias("module"), s.alias("suffix"), F.col("label").cast("string").alias("value"))
    return blocks.triplets(t)


@query("SELECT key FROM (SELECT 'mtp.' || (vec_id // 2) AS key FROM embeddings WHERE vec_id % 2 = 0) WHERE true UNION SELECT 'mtp.' || vec_id FROM embeddings")
def stitch_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    base = e.filter("vec_id % 2 = 0").select(F.concat(F.lit("mtp."), F.floor(F.col("vec_id") / 2)).alias("key"))
    extra = e.select(F.concat(F.lit("mtp."), "vec_id").alias("key")).unionByName(e.select(F.concat(F.lit("x."), "vec_id").alias("key")))
    return blocks.stitched(base, extra, "key", "mtp")


@query("SELECT doc_id, CAST(CASE WHEN p < 100 THEN 0 WHEN p < 350 THEN 1 ELSE 2 END AS INTEGER) AS index FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p < 1000000")
def split_by_lengths(spark: SparkSession, sf: str) -> DataFrame:
    flat = select.global_position(table(spark, sf, "documents").select("doc_id"), "doc_id")
    rest = max(0, flat.count() - 350)  # the last piece takes all other rows
    lengths = spark.createDataFrame([(0, 100), (1, 250), (2, rest)], "index INT, n BIGINT")
    return blocks.split_by_lengths(flat, "position", lengths).select("doc_id", "index")


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("m"), "vec_id").alias("name"), (F.col("vec_id") % 3 == 0).alias("want"), (F.col("vec_id") % 6 == 0).alias("is"))


@query("SELECT count(*) FILTER (vec_id % 6 <> 0) AS n_quantized, count(*) FILTER (vec_id % 6 = 0) AS n_skipped, count(*) FILTER ((vec_id % 3 = 0) <> (vec_id % 6 = 0)) AS n_mismatched, false AS ok FROM embeddings")
def mask_audit(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.audit(_modules(spark, sf), "want", "is")


@query("SELECT 'm' || vec_id AS name FROM embeddings WHERE (vec_id % 3 = 0) <> (vec_id % 6 = 0)")
def mask_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.mismatches(_modules(spark, sf), "want", "is", "name")


@query("""SELECT event_type, arg_min(value, (event_id % 4 <> 0)::INTEGER * 10000000000 + event_id) AS value FROM events WHERE event_id % 4 < 2 AND value IS NOT NULL GROUP BY 1""")
def metric_fallback(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("acc", "acc,none", "f1", "loss"))), (F.col("event_id") % 4 + 1).cast("int"))
    m = table(spark, sf, "events").select("event_type", F.col("event_id").alias("position"), name.alias("metric"), "value")
    return blocks.metric_or_like(m, "event_type", "acc")


@query("""WITH h AS (SELECT doc_domain, doc_id FROM (SELECT doc_domain, doc_id, row_number() OVER (PARTITION BY doc_domain ORDER BY doc_id) AS k FROM documents) WHERE k <= 60)
SELECT doc_domain, doc_id, CAST(k AS INTEGER) AS rank FROM (SELECT doc_domain, doc_id, row_number() OVER (PARTITION BY doc_domain ORDER BY md5('0:' || doc_id), doc_id) AS k FROM h) WHERE k <= 20""")
def bucket_quota(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.bucket_quota(table(spark, sf, "documents").select("doc_domain", "doc_id"), "doc_domain", "doc_id", "doc_id", 20)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 1000) AS v, (vec_id % 97 + 0.5) / 97 AS u FROM embeddings),
w AS (SELECT vec_id, u, v, list_transform(v, lambda x: exp((x - list_max(v)) / 50)) AS w FROM e),
c AS (SELECT vec_id, v, u * list_sum(w) AS lim, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])) AS c FROM w)
SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS token, CAST(least(len(list_filter(c, lambda x: x <= lim)), len(v) - 1) AS INTEGER) AS drawn FROM c""")
def sample_token(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * 1000)
    u = (F.col("vec_id") % 97 + 0.5) / 97
    return table(spark, sf, "embeddings").select("vec_id", blocks.sampled_token(v, 0.0, F.lit(0.5)).alias("token"), blocks.sampled_token(v, 50.0, u).cast("int").alias("drawn"))


@query(f"SELECT i.t AS id, e.vec_id, e.label FROM (SELECT DISTINCT unnest(ids) AS t FROM ({_D})) i LEFT JOIN (SELECT * FROM embeddings WHERE vec_id >= 100 AND vec_id < 400) e ON e.vec_id = i.t")
def embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = docs(spark, sf).select(F.explode("ids").alias("id")).select(F.col("id").cast("long").alias("id")).distinct()
    v = table(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("found"), "label")
    return blocks.embedding_rows(ids, v, "id", "vec_id", 100, 400).select(F.col("id").cast("int").alias("id"), F.col("found").alias("vec_id"), "label")


@query(f"SELECT doc_id, CAST(count(*) FILTER (t >= 1000 AND t < 2000) AS BIGINT) AS inside FROM (SELECT doc_id, unnest(ids) AS t FROM ({_D})) GROUP BY 1")
def predicate_vocab_range(spark: SparkSession, sf: str) -> DataFrame:
    t = docs(spark, sf).select("doc_id", F.explode("ids").alias("t"))
    return t.groupBy("doc_id").agg(F.count_if(training.in_vocabulary_range(F.col("t"), 1000, 2000)).alias("inside"))


@query(f"""WITH s AS (SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x % 2 = 0 THEN 1 ELSE 0 END) AS m FROM ({_D})),
a AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || i), i) AS k FROM (SELECT doc_id, m, unnest(range(0, greatest(len(m) - 8, 0) + 1)) AS i FROM s) WHERE m[i + 1] = 1)
SELECT s.doc_id, coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM a WHERE a.doc_id = s.doc_id AND k <= 4), '') AS anchors FROM s""")
def anchor_random(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform("ids", lambda x: F.when(x % 2 == 0, 1).otherwise(0))
    a = docs(spark, sf).select("doc_id", blocks.random_anchors(mask, F.col("doc_id"), 8, 4).alias("a"))
    kept = F.filter(F.arrays_zip(F.col("a.anchors").alias("x"), F.col("a.keep").alias("k")), lambda z: z["k"] == 1)
    return a.select("doc_id", F.array_join(F.transform(kept, lambda z: z["x"].cast("string")), ",").alias("anchors"))


@query("SELECT line_no FROM prompts WHERE id IS NULL OR id NOT IN (SELECT id FROM regen WHERE id IS NOT NULL) ORDER BY line_no LIMIT 50")
def limit_pending(spark: SparkSession, sf: str) -> DataFrame:
    return select.without(table(spark, sf, "prompts").select("line_no", "id"), table(spark, sf, "regen")).orderBy("line_no").limit(50).select("line_no")


@query("SELECT count(*) AS n, avg(n_chars) AS mean, min(n_chars) AS least, max(n_chars) AS most, (SELECT list_sort(list(n_chars))[count(*) // 2 + 1] FROM documents) AS median FROM documents")
def prefix_len_avg(spark: SparkSession, sf: str) -> DataFrame:
    from quillspark.operators import stats

    d = table(spark, sf, "documents").select(F.lit(1).alias("g"), "n_chars")
    a = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return a.join(stats.index_percentiles(d, ["g"], "n_chars", {"median": 0.5}), "g").drop("g")
