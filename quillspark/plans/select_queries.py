"""Queries that select rows: draws, deduplication, exclusion, orders and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.functions import chat, text
from quillspark.operators import select
from quillspark.plans.chat_queries import WS, _P, convs, s_strip, s_strip_blocks
from quillspark.plans.registry import query
from quillspark.runtime import table


def s_uuid(x: str) -> str:
    t = f"lower(regexp_replace({x}, '[\\s{{}}]', '', 'g'))"
    return f"(CASE WHEN regexp_full_match(replace({t}, '-', ''), '[0-9a-f]{{32}}') THEN replace({t}, '-', '') WHEN {t} <> '' THEN {t} END)"


def s_label(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{S}}]+', '', 'g')), '')"


_UT = "array_to_string(list_transform(list_filter(c, lambda m: m.role = 'user' AND m.content IS NOT NULL), lambda m: m.content), ' ')"
_DRAW = f"""WITH p AS (SELECT {s_uuid('id')} AS id, {s_label('category')} AS category, c FROM ({_P.replace('SELECT line_no', 'SELECT id, category')})),
r AS (SELECT id, category, md5({_UT}) AS h FROM p WHERE id IS NOT NULL AND category IS NOT NULL AND len(list_filter(c, lambda m: m.role = 'user')) > 0 AND {s_strip(_UT)} <> ''
 AND id NOT IN (SELECT {s_uuid('id')} FROM manifest WHERE {s_uuid('id')} IS NOT NULL)),
d AS (SELECT DISTINCT category, id FROM (SELECT category, h, arg_min(id, md5(id) || id) AS id FROM r GROUP BY 1, 2))
SELECT category, CAST(k AS INTEGER) AS rank, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY md5(id), id) AS k FROM d) WHERE k <= WANT"""


@query(_DRAW.replace("WANT", "40"))
def entry_corpus_draw(spark: SparkSession, sf: str) -> DataFrame:
    return select.corpus_draw(table(spark, sf, "prompts"), table(spark, sf, "manifest"), 40)


@query(_DRAW.replace("WANT", "300"))
def quota_after_filter(spark: SparkSession, sf: str) -> DataFrame:
    return select.corpus_draw(table(spark, sf, "prompts"), table(spark, sf, "manifest"), 200, 1.5)


@query(f"""WITH r AS (SELECT {s_label('category')} AS grp, md5(coalesce({_UT}, '')) AS text_md5, id FROM ({_P.replace('SELECT line_no', 'SELECT id, category')}) WHERE id IS NOT NULL)
SELECT grp, text_md5, arg_min(id, md5(id) || id) AS id FROM r WHERE grp IS NOT NULL GROUP BY 1, 2""")
def dedup_md5_representative(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "prompts").filter("conversations IS NOT NULL").withColumn("c", chat.normal_roles(F.col("conversations")))
    return select.representatives(p, runtime.canonical_label(F.col("category")), chat.user_text(F.col("c")), "id")


_NU = f"md5(regexp_replace(lower({_UT}), '{WS}+', ' ', 'g'))"


@query(f"SELECT h AS text_md5, min(line_no) AS line_no FROM (SELECT line_no, {_NU} AS h FROM ({_P})) GROUP BY 1")
def dedup_normalized_user(spark: SparkSession, sf: str) -> DataFrame:
    p = convs(spark, sf).select("line_no", F.md5(text.collapse_space(chat.user_text(F.col("c")))).alias("text_md5"))
    return p.groupBy("text_md5").agg(F.min("line_no").alias("line_no"))


@query("SELECT id, line_no, batch_no FROM (SELECT id, line_no, batch_no, row_number() OVER (PARTITION BY id ORDER BY batch_no, line_no) AS k FROM prompts) WHERE k = 1")
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return select.first_per_key(table(spark, sf, "prompts").select("id", "line_no", "batch_no"), "id", ["batch_no", "line_no"]).select("id", "line_no", "batch_no")


@query("SELECT line_no, id FROM prompts WHERE id IS NULL OR id NOT IN (SELECT id FROM manifest WHERE id IS NOT NULL)")
def anti_join_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return select.without(table(spark, sf, "prompts").select("line_no", "id"), table(spark, sf, "manifest"))


@query("SELECT line_no, id FROM prompts WHERE id IS NULL OR id NOT IN (SELECT id FROM regen WHERE id IS NOT NULL)")
def anti_join_resume(spark: SparkSession, sf: str) -> DataFrame:
    return select.without(table(spark, sf, "prompts").select("line_no", "id"), table(spark, sf, "regen"))


@query("SELECT id, min(line_no) AS line_no FROM prompts WHERE id IN (SELECT id FROM manifest) GROUP BY 1")
def semi_join_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return select.within(table(spark, sf, "prompts").select("line_no", "id"), table(spark, sf, "manifest")).groupBy("id").agg(F.min("line_no").alias("line_no"))


@query("SELECT DISTINCT id FROM manifest WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM prompts WHERE id IS NOT NULL)")
def manifest_missing(spark: SparkSession, sf: str) -> DataFrame:
    return select.missing_ids(table(spark, sf, "manifest"), table(spark, sf, "prompts"))


@query("SELECT DISTINCT id FROM (SELECT id FROM manifest UNION ALL SELECT id FROM regen) WHERE id IS NOT NULL")
def union_ids(spark: SparkSession, sf: str) -> DataFrame:
    return select.union_ids([table(spark, sf, "manifest"), table(spark, sf, "regen")])


@query("SELECT DISTINCT id FROM regen WHERE id IS NOT NULL EXCEPT SELECT id FROM prompts")
def except_ids(spark: SparkSession, sf: str) -> DataFrame:
    return select.missing_ids(table(spark, sf, "regen"), table(spark, sf, "prompts"))


@query(f"SELECT m.category, p.n FROM mix_targets m JOIN (SELECT {s_label('category')} AS label, count(*) AS n FROM prompts GROUP BY 1) p ON p.label = m.category")
def intersect_allocation(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "prompts").groupBy(runtime.canonical_label(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(table(spark, sf, "mix_targets").select("category")), "category")


@query("SELECT lang, CAST(k AS INTEGER) AS rank, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 25")
def rank_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return select.quota(table(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 25).select("lang", "rank", "doc_id")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS BIGINT) AS position FROM documents")
def shuffle_seeded(spark: SparkSession, sf: str) -> DataFrame:
    h = F.concat(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), F.col("doc_id").cast("string"))
    return select.global_position(table(spark, sf, "documents").select("doc_id", h.alias("h")), "h").select("doc_id", "position")


@query("SELECT doc_id, CASE WHEN k <= CAST(floor(n * 0.05) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id) || doc_id) AS k, count(*) OVER () AS n FROM documents)")
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return select.train_val(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.05)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id) || doc_id) AS k FROM documents) WHERE k <= 500")
def sample_limit(spark: SparkSession, sf: str) -> DataFrame:
    return select.sample_limit(table(spark, sf, "documents").select("doc_id"), "doc_id", 500)


@query("""SELECT doc_id, CAST(coalesce(nullif(list_position(['math', 'code'], doc_domain), 0), 3) AS INTEGER) AS priority FROM documents""")
def priority_sort_stable(spark: SparkSession, sf: str) -> DataFrame:
    return select.priority_order(table(spark, sf, "documents").select("doc_id", "doc_domain"), "doc_domain", ["math", "code"], "doc_id").select("doc_id", "priority")


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, item_id, turns[1] AS t FROM bench_turns), c AS (SELECT count(*) AS c FROM n)
SELECT i.i, n.item_id, md5(n.t) AS digest FROM (SELECT unnest(range(1000)) AS i) i CROSS JOIN c JOIN n ON n.k = i.i % c.c""")
def take_first_turn_cycled(spark: SparkSession, sf: str) -> DataFrame:
    pool = table(spark, sf, "bench_turns").select("item_id", F.md5(F.get("turns", F.lit(0))).alias("digest"))
    return select.cycle(pool, "item_id", 1000).select("i", "item_id", "digest")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS INTEGER) AS shard FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) // 8 * 8 FROM documents)")
def rank_stride_shard(spark: SparkSession, sf: str) -> DataFrame:
    return select.shard(table(spark, sf, "documents").select("doc_id"), "doc_id", 8, drop_last=True).select("doc_id", "shard")


@query(f"""WITH v AS (SELECT resp_id, unnest(['think', 'no_think']) AS view, coalesce(conversations[len(conversations)].content, '') AS a FROM regen WHERE len(conversations) > 0)
SELECT resp_id, view, md5(CASE WHEN view = 'think' THEN a ELSE {s_strip_blocks('a')} END) AS digest FROM v""")
def dual_view_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "regen").filter(F.size("conversations") > 0).select("resp_id", F.coalesce(F.get("conversations", F.size("conversations") - 1)["content"], F.lit("")).alias("a"))
    return select.dual_views(a, F.col("a")).select("resp_id", "view", F.md5("text").alias("digest"))


@query(_DRAW.replace("WANT", "40").replace("SELECT category, CAST(k AS INTEGER) AS rank, id FROM (", "SELECT w.category, w.rank, w.id, x.n_turns FROM (SELECT category, CAST(k AS INTEGER) AS rank, id FROM (") + f""") w JOIN (
SELECT id, arg_min(n, line_no) AS n_turns FROM (SELECT line_no, {s_uuid('id')} AS id, CAST(k - len(list_filter(c[1:k], lambda m: m.role = 'system' AND coalesce({s_strip('m.content')} = '', true))) + CASE WHEN c[1].role = 'system' AND coalesce({s_strip('c[1].content')} <> '', false) THEN 0 ELSE 1 END AS INTEGER) AS n
 FROM (SELECT line_no, id, c, coalesce(list_max(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i].role = 'user' THEN i ELSE 0 END)), 0) AS k FROM ({_P.replace('SELECT line_no', 'SELECT line_no, id')})) WHERE k > 0) GROUP BY 1) x USING (id)""")
def semi_join_selected(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "prompts")
    rows = select.drawn_rows(p, select.corpus_draw(p, table(spark, sf, "manifest"), 40))
    return rows.select("category", "rank", "id", F.size("conversations").alias("n_turns"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 700")
def max_samples_head(spark: SparkSession, sf: str) -> DataFrame:
    return select.head(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 700)


@query("""SELECT benchmark, item_id FROM (SELECT benchmark, item_id, row_number() OVER (PARTITION BY benchmark ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) AS k, count(*) OVER (PARTITION BY benchmark) AS n FROM bench_turns) WHERE k <= ceil(n * 0.3)""")
def limit_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return select.fraction(table(spark, sf, "bench_turns").select("benchmark", "item_id"), ["benchmark"], "item_id", 0.3)


@query("SELECT source AS task, target_share FROM source_weights WHERE source IN ('web', 'forum') OR max_repeats IN (2)")
def filter_task_subset(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "source_weights").select(F.col("source").alias("task"), "target_share", F.col("max_repeats").cast("string").alias("key"))
    return select.tasks_subset(t, "web, forum,2").select("task", "target_share")


@query("SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS rank FROM documents")
def concat_splits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return select.concat_splits([d.filter(F.col("doc_id") % 3 == k) for k in range(3)])


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, item_id FROM bench_turns), c AS (SELECT count(*) AS c FROM n)
SELECT i.i, n.item_id FROM (SELECT unnest(range(50)) AS i) i CROSS JOIN c JOIN n ON n.k = (i.i + 5) % c.c""")
def cycle_pool_warmup(spark: SparkSession, sf: str) -> DataFrame:
    return select.cycle(table(spark, sf, "bench_turns").select("item_id"), "item_id", 50, offset=5).select("i", "item_id")


@query(f"""WITH p AS (SELECT p.line_no, {s_label('p.category')} AS label FROM prompts p) SELECT label AS category, count(*) AS n_rows, count(DISTINCT line_no) AS n_unique, count(*) FILTER (label IS NULL) AS n_unlabelled FROM p GROUP BY 1""")
def count_per_category(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "prompts").select("line_no", runtime.canonical_label(F.col("category")).alias("category"))
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("line_no").alias("n_unique"), F.count_if(F.col("category").isNull()).alias("n_unlabelled"))


@query(f"""SELECT m.category, coalesce(p.n, 0) AS actual, greatest(1000 - coalesce(p.n, 0), 0) AS shortfall FROM mix_targets m LEFT JOIN (SELECT {s_label('category')} AS label, count(*) AS n FROM prompts GROUP BY 1) p ON p.label = m.category""")
def count_per_bucket(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "prompts").groupBy(runtime.canonical_label(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, sf, "mix_targets").select("category").join(n, "category", "left")
    return t.select("category", F.coalesce("n", F.lit(0)).alias("actual"), F.greatest(F.lit(1000) - F.coalesce("n", F.lit(0)), F.lit(0)).alias("shortfall"))
