"""Queries of token sequences with the plain tokenizer: masks, packing, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import blocks, tokens
from quillspark.plans.chat_queries import _R, convs
from quillspark.plans.registry import query
from quillspark.runtime import table

V = 5000
_W = "regexp_extract_all(coalesce({t}, ''), '\\S+')"
_ID = "CAST(('0x' || substr(md5({w}), 1, 7))::BIGINT % 5000 AS INTEGER)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.transform("w", lambda x: text.word_id(x, V)).alias("ids"))


_D = f"SELECT doc_id, list_transform({_W.format(t='text')}, lambda w: {_ID.format(w='w')}) AS ids FROM documents"


@query(f"SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, coalesce(CAST(list_sum(ids) AS BIGINT), 0) AS checksum FROM ({_D})")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query(f"""SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(s // 512 AS BIGINT) AS first_chunk, CAST((s + n) // 512 AS BIGINT) AS last_chunk FROM (SELECT doc_id, n, coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT doc_id, len(ids) AS n FROM ({_D})))""")
def pack_offsets(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.size("ids").alias("n"))
    return tokens.pack_offsets(d, "doc_id", "n", 512).select("doc_id", "start", "first_chunk", "last_chunk")


@query(f"""WITH f AS (SELECT doc_id, unnest(list_concat(ids, [7])) AS t, unnest(range(len(ids) + 1)) AS i FROM ({_D})), g AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM f)
SELECT CAST(g // 512 AS BIGINT) AS chunk_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum(t * (g % 512 + 1)) AS BIGINT) AS checksum FROM g GROUP BY 1""")
def pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    c = tokens.pack_sequences(docs(spark, sf), "doc_id", "ids", 512, sep_id=7, pad_id=0)
    s = F.aggregate(F.transform("input_ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("chunk_id", "n_tokens", s.alias("checksum"))


@query(f"SELECT count(*) AS n, CAST(sum(len(ids) + 1) AS BIGINT) AS total, CAST(ceil(sum(len(ids) + 1) / 512) AS BIGINT) AS chunks FROM ({_D})")
def pack_report(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size("ids") + 1
    return docs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.ceil(F.sum(n) / 512).alias("chunks"))


@query(f"SELECT t AS id, count(*) AS cnt FROM (SELECT unnest(ids) AS t FROM ({_D})) GROUP BY 1")
def vocab_freq(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.vocab_counts(docs(spark, sf), "ids")


_VC = f"SELECT t AS id, count(*) AS cnt FROM (SELECT unnest(ids) AS t FROM ({_D})) GROUP BY 1"
_DV = f"SELECT id, cnt FROM (SELECT id, cnt FROM ({_VC}) UNION ALL SELECT CAST(r AS INTEGER), 0 FROM range(1000) x(r) WHERE r NOT IN (SELECT id FROM ({_VC}))) ORDER BY cnt DESC, id LIMIT 1000"


@query(_DV)
def topk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.draft_vocabulary(tokens.vocab_counts(docs(spark, sf), "ids"), 1000)


@query(f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS draft_id, CAST(id - (row_number() OVER (ORDER BY id) - 1) AS INTEGER) AS offset FROM ({_DV})")
def vocab_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.vocab_mapping(tokens.vocab_counts(docs(spark, sf), "ids"), 1000, V)[0]


@query(f"SELECT CAST(r AS INTEGER) AS target_id, r IN (SELECT id FROM ({_DV})) AS kept FROM range({V}) x(r)")
def vocab_kept(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.vocab_mapping(tokens.vocab_counts(docs(spark, sf), "ids"), 1000, V)[1]


@query(f"SELECT CAST(id AS INTEGER) AS target_id FROM ({_DV}) WHERE id % 10 = 3 UNION ALL SELECT CAST(r AS INTEGER) FROM range({V}) x(r) WHERE r % 50 = 1 AND r NOT IN (SELECT id FROM ({_DV}))")
def vocab_mapping_validate(spark: SparkSession, sf: str) -> DataFrame:
    """A sound mapping that is then spoilt: some kept ids are marked as dropped, and some dropped ones as kept."""
    d2t, t2d = tokens.vocab_mapping(tokens.vocab_counts(docs(spark, sf), "ids"), 1000, V)
    kept = F.when(F.col("target_id") % 10 == 3, False).when(F.col("target_id") % 50 == 1, True).otherwise(F.col("kept"))
    return tokens.mapping_faults(d2t, t2d.withColumn("kept", kept)).select(F.col("target_id").cast("int").alias("target_id"))


@query(f"SELECT round((SELECT sum(cnt) FROM ({_DV})) / (SELECT sum(cnt) FROM ({_VC})), 9) AS coverage")
def vocab_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.coverage(tokens.vocab_counts(docs(spark, sf), "ids"), 1000).select(F.round("coverage", 9).alias("coverage"))


_MS = f"flatten(list_transform(c, lambda m: list_transform({_W.format(t='m.content')}, lambda w: CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END)))"


@query(f"SELECT resp_id, CAST(len(m) AS INTEGER) AS n, coalesce(CAST(list_sum(m) AS BIGINT), 0) AS on_tokens FROM (SELECT resp_id, {_MS} AS m FROM ({_R}))")
def loss_mask_prefix(spark: SparkSession, sf: str) -> DataFrame:
    m = convs(spark, sf, "regen", "resp_id").select("resp_id", tokens.assistant_mask(F.col("c"))[1].alias("m"))
    return m.select("resp_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("on_tokens"))


@query(f"SELECT resp_id FROM (SELECT resp_id, {_MS} AS m FROM ({_R})) WHERE coalesce(list_sum(m), 0) >= 64")
def filter_min_loss_tokens(spark: SparkSession, sf: str) -> DataFrame:
    m = convs(spark, sf, "regen", "resp_id").select("resp_id", tokens.assistant_mask(F.col("c"))[1].alias("m"))
    return m.filter(F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x) >= 64).select("resp_id")


@query("""WITH t AS (SELECT resp_id, range(0, 40, 4) AS s, list_transform(range(0, 40, 4), lambda x: x + 3) AS e, resp_id % 20 AS a, resp_id % 20 + 8 AS b FROM regen)
SELECT resp_id, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN NOT (e[i] <= a OR s[i] > b) THEN 1 ELSE 0 END))::BIGINT AS overlap, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN s[i] >= a AND e[i] <= b THEN 1 ELSE 0 END))::BIGINT AS inside FROM t""")
def loss_mask_offsets(spark: SparkSession, sf: str) -> DataFrame:
    s = F.sequence(F.lit(0), F.lit(36), F.lit(4))
    t = table(spark, sf, "regen").select("resp_id", s.alias("s"), F.transform(s, lambda x: x + 3).alias("e"), F.array(F.col("resp_id") % 20).alias("a"), F.array(F.col("resp_id") % 20 + 8).alias("b"))
    n = lambda inc: F.aggregate(tokens.mask_by_spans(F.col("s"), F.col("e"), F.col("a"), F.col("b"), inc), F.lit(0).cast("long"), lambda x, y: x + y)
    return t.select("resp_id", n(True).alias("overlap"), n(False).alias("inside"))


@query(f"""SELECT doc_id, CAST((max(len(ids)) OVER (PARTITION BY doc_id // 16) + 7) // 8 * 8 AS INTEGER) AS n FROM ({_D})""")
def pad_batch(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 16))
    return tokens.pad_batch(d, "batch", "ids", 8).select("doc_id", F.size("ids").alias("n"))


@query(f"SELECT doc_id, CAST(least(len(ids), 64) AS INTEGER) AS n, greatest(least(len(ids), 64) - 1, 0)::BIGINT AS on_tokens FROM ({_D})")
def truncate_and_zero_last(spark: SparkSession, sf: str) -> DataFrame:
    a, m = tokens.truncate_and_zero_last(F.col("ids"), F.transform("ids", lambda _: F.lit(1)), 64)
    return docs(spark, sf).select("doc_id", F.size(a).alias("n"), F.aggregate(m, F.lit(0).cast("long"), lambda x, y: x + y).alias("on_tokens"))


@query(f"""WITH s AS (SELECT doc_id, ids, CAST(ceil(len(ids) / 4) AS BIGINT) AS k FROM ({_D})) SELECT doc_id, CAST(k + 5 AS INTEGER) AS n, coalesce(CAST(list_sum(ids[k + 1 : k + k + 5]) AS BIGINT), 0) AS checksum FROM s""")
def overlap_chunk(spark: SparkSession, sf: str) -> DataFrame:
    c = tokens.overlap_chunk(F.col("ids"), 1, 4, 5)
    return docs(spark, sf).select("doc_id", c.alias("c")).select("doc_id", F.size("c").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query(f"""SELECT doc_id, CAST(coalesce(list_min(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] % 7 <> ids[i] % 14 THEN i - 1 END)), len(ids)) AS INTEGER) AS n FROM ({_D})""")
def acceptance_length(spark: SparkSession, sf: str) -> DataFrame:
    a = docs(spark, sf).select("doc_id", F.transform("ids", lambda x: x % 7).alias("p"), F.transform("ids", lambda x: x % 14).alias("t"))
    return a.select("doc_id", tokens.accept_length(F.col("p"), F.col("t")).alias("n"))


@query(f"""SELECT doc_id, CAST(coalesce(ids[2], CASE WHEN len(ids) = 1 THEN 0 END) AS INTEGER) AS left_first, CAST(CASE WHEN len(ids) > 0 THEN 0 END AS INTEGER) AS right_first, CAST(ids[greatest(least(doc_id % 50, len(ids) - 1), 0) + 1] AS INTEGER) AS gathered FROM ({_D})""")
def shift_and_gather(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("ids")
    some = F.size(i) > 0
    return docs(spark, sf).select(
        "doc_id", F.when(some, F.get(tokens.shift_left(i), F.lit(0))).alias("left_first"), F.when(some, F.get(tokens.shift_right(i), F.lit(0))).alias("right_first"), tokens.gather(i, (F.col("doc_id") % 50).cast("int")).alias("gathered")
    )


@query("SELECT unnest([1, 8, 15, 22, 29]) AS layer, unnest([0, 1, 2, 3, 4]) AS i")
def layer_id_spread(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(tokens.spread_layers(32, 5)).alias("i", "layer"))


@query("""SELECT doc_id, array_to_string(list_transform(range(0, CAST(least(5, n_chars) AS BIGINT)), lambda i: CAST(CAST(round_even((n_chars - 1) * i / greatest(least(5, n_chars) - 1, 1), 0) AS BIGINT) AS VARCHAR)), ',') AS anchors FROM documents WHERE n_chars IS NOT NULL""")
def anchor_linspace(spark: SparkSession, sf: str) -> DataFrame:
    a = tokens.anchors(F.lit(0).cast("long"), F.col("n_chars"), 5)
    return table(spark, sf, "documents").filter("n_chars IS NOT NULL").select("doc_id", F.array_join(a.cast("array<string>"), ",").alias("anchors"))


@query("""WITH p AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, p % 4 = 0 AS by_size, coalesce(event_type <> before, true) AS by_block FROM p""")
def block_start_flags(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    a = blocks.block_starts(e, "user_id", "event_id", size=4).withColumnRenamed("starts", "by_size").drop("position")
    b = blocks.block_starts(a, "user_id", "event_id", block="event_type")
    return b.select("event_id", "by_size", F.col("starts").alias("by_block"))
