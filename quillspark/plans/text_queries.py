"""Queries on texts, lines and other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import select
from quillspark.plans.chat_queries import WS, _R, convs, s_blank, s_last, s_strip, s_strip_blocks  # noqa: F401
from quillspark.plans.registry import query
from quillspark.runtime import table
from quillspark.sources import readers, sinks

_A = f"SELECT resp_id, coalesce(c[len(c)].content, '') AS a FROM ({_R}) WHERE len(c) > 0"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return convs(spark, sf, "regen", "resp_id").filter(F.size("c") > 0).select("resp_id", F.coalesce(F.get("c", F.size("c") - 1)["content"], F.lit("")).alias("a"))


@query("SELECT md5(text) AS md5_hex, left(sha256(text), 16) AS sha_head, doc_id FROM documents WHERE text IS NOT NULL")
def text_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select(F.md5("text").alias("md5_hex"), F.left(F.sha2("text", 256), F.lit(16)).alias("sha_head"), "doc_id")


@query(f"SELECT doc_id, md5({s_strip('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def py_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.strip(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def collapse_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.collapse_space(F.col("text"))).alias("digest"))


@query(f"SELECT resp_id, md5({s_strip_blocks('a')}) AS digest FROM ({_A})")
def strip_think_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("resp_id", F.md5(text.strip_think_blocks(F.col("a"))).alias("digest"))


_EV = s_strip("regexp_replace(a, '(?s)<think>.*?</think>\\s*', '', 'g')")


@query(f"SELECT resp_id, md5({_EV}) AS digest FROM ({_A})")
def strip_think_eval(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("resp_id", F.md5(text.strip_think_eval(F.col("a"))).alias("digest"))


def _join(r: str, a: str) -> str:
    return f"CASE WHEN {r} <> '' THEN {s_strip('(' + r + ' || chr(10) || chr(10) || ' + a + ')')} ELSE {a} END"


_B = "'(?s)<think>(.*?)</think>(.*)$'"
_FT = f"""CASE WHEN regexp_matches(a, '(?s)<think>.*?</think>') THEN {_join(s_strip(f'regexp_extract(a, {_B}, 1)'), s_strip(f'regexp_extract(a, {_B}, 2)'))}
 WHEN contains(a, '</think>') THEN {_join(s_strip("substr(a, 1, instr(a, '</think>') - 1)"), s_strip("substr(a, instr(a, '</think>') + 8)"))} ELSE {s_strip("replace(a, '<think>', '')")} END"""


@query(f"SELECT resp_id, md5({_FT}) AS digest FROM ({_A})")
def flatten_think(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("resp_id", F.md5(text.flatten_think(F.col("a"))).alias("digest"))


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def s_ascii(x: str) -> str:
    """A text in whose place ASCII word borders are those of any script: other letters, marks and numbers become x, all else a space."""
    return f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g')"


_BL = s_ascii("(coalesce(u, '') || chr(10) || coalesce(a, ''))")
_U = f"SELECT resp_id, CASE WHEN {s_last('c', 'user')} > 0 THEN c[{s_last('c', 'user')}].content END AS u, CASE WHEN {s_last('c', 'assistant')} > 0 THEN c[{s_last('c', 'assistant')}].content END AS a FROM ({_R})"


@query(f"""WITH b AS (SELECT resp_id, {_BL} AS b FROM ({_U})) SELECT bucket, count(*) AS n, sum(resp_id) AS ids FROM (SELECT resp_id, CASE
 WHEN regexp_matches(b, {_q(text.CODE_FENCE)}) OR regexp_matches(b, {_q(text.CODE_SIGN)}) THEN 'code'
 WHEN regexp_matches(b, {_q(text.MATH_LATEX)}) OR len(regexp_extract_all(lower(b), {_q(text.MATH_WORDS)})) >= 2 THEN 'math'
 WHEN regexp_matches(lower(b), {_q(text.SCIENCE)}) OR regexp_matches(b, {_q(text.CHOICE)}) THEN 'science' ELSE 'general' END AS bucket FROM b) GROUP BY 1""")
def classify_bucket(spark: SparkSession, sf: str) -> DataFrame:
    from quillspark.functions import chat

    c = F.col("c")
    at = lambda r: F.when(chat.last_index(c, r) > 0, F.get(c, chat.last_index(c, r) - 1)["content"])
    turns = convs(spark, sf, "regen", "resp_id").select("resp_id", at("user").alias("u"), at("assistant").alias("a"))
    b = turns.select("resp_id", text.classify_bucket(F.col("u"), F.col("a")).alias("bucket"))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("resp_id").alias("ids"))


@query("SELECT line_no, json_extract_string(raw_line, '$.category') AS category, CAST(json_array_length(raw_line::JSON, '$.conversations') AS INTEGER) AS n_turns FROM prompt_lines WHERE json_valid(raw_line)")
def scan_jsonl_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    got = readers.parse_lines(table(spark, sf, "prompt_lines"), "raw_line", f"category STRING, conversations {readers.CONVERSATION}", ["line_no"])
    return got.select("line_no", "category", F.size("conversations").alias("n_turns"))


@query("SELECT count(*) AS n_lines, count(*) FILTER (coalesce(trim(raw_line) = '', true)) AS n_blank, count(*) FILTER (json_valid(raw_line)) AS n_good, count(*) FILTER (trim(raw_line) <> '' AND NOT json_valid(raw_line)) AS n_broken FROM prompt_lines")
def scan_jsonl_warn(spark: SparkSession, sf: str) -> DataFrame:
    return readers.line_quality(table(spark, sf, "prompt_lines"), "raw_line")


@query("""WITH g AS (SELECT line_no, json_extract(raw_line::JSON, '$.conversations[*]') AS c FROM prompt_lines WHERE json_valid(raw_line) AND json_type(raw_line::JSON, '$.conversations') = 'ARRAY')
SELECT line_no, array_to_string(list_transform(c, lambda m: coalesce(m->>'role', '')), ',') AS roles FROM g""")
def scan_jsonl_normalize(spark: SparkSession, sf: str) -> DataFrame:
    got = readers.parse_lines(table(spark, sf, "prompt_lines"), "raw_line", "conversations array<map<string,string>>", ["line_no"]).filter("conversations IS NOT NULL")
    return got.select("line_no", F.array_join(F.transform("conversations", lambda m: F.coalesce(m["role"], F.lit(""))), ",").alias("roles"))


@query(f"SELECT DISTINCT {s_strip('id')} AS id FROM manifest WHERE {s_strip('id')} <> ''")
def scan_id_list(spark: SparkSession, sf: str) -> DataFrame:
    return select.distinct_ids(table(spark, sf, "manifest"))


@query("SELECT category, count(*) AS n_rows FROM prompts GROUP BY 1")
def scan_parquet_shards(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_columns(spark, f"{sf}/prompts.parquet", ["id", "category"]).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT event_type || '_total' AS name, CAST(sum(user_id) AS DOUBLE) AS total FROM events GROUP BY 1")
def scan_metrics_text(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.col("event_type"), F.lit('_total{id="'), F.col("event_id"), F.lit('"} '), F.col("user_id"))
    noise = spark.createDataFrame([("# HELP a_total of it",), ("a_total nothing",), ("",)], "line STRING")
    return readers.metrics(table(spark, sf, "events").select(line.alias("line")).unionByName(noise))


@query("SELECT 'epoch_' || (user_id % 13) || '_step_' || max(event_id) AS name, CAST(user_id % 13 AS INTEGER) AS epoch, CAST(max(event_id) AS INTEGER) AS step FROM events WHERE user_id % 13 = (SELECT max(user_id % 13) FROM events) GROUP BY user_id % 13")
def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "events").select(F.concat(F.lit("epoch_"), F.col("user_id") % 13, F.lit("_step_"), F.col("event_id")).alias("name"))
    return sinks.latest_checkpoint(names)


@query("""WITH n AS (SELECT 'model.layers.' || (vec_id % 40) || CASE vec_id % 6 WHEN 0 THEN '.linear_attn.in_proj_a' WHEN 1 THEN '.mlp.up_proj' WHEN 2 THEN '.linear_attn.conv1d' WHEN 3 THEN '.self_attn.q_proj' WHEN 4 THEN '.linear_attn.in_proj_b' ELSE '.mlp.down_proj' END AS name FROM embeddings)
SELECT name, regexp_extract(name, '^(.*)\\.([^.]+)$', 1) AS module, regexp_extract(name, '^(.*)\\.([^.]+)$', 2) AS suffix,
 regexp_matches(name, 'linear_attn\\.(in_proj_a|in_proj_b|conv1d)$') AS kept, count(*) AS n FROM n GROUP BY ALL""")
def filter_bf16_modules(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("linear_attn.in_proj_a", "mlp.up_proj", "linear_attn.conv1d", "self_attn.q_proj", "linear_attn.in_proj_b", "mlp.down_proj")
    name = F.concat(F.lit("model.layers."), F.col("vec_id") % 40, F.lit("."), F.element_at(F.array(*map(F.lit, kinds)), (F.col("vec_id") % 6 + 1).cast("int")))
    n = table(spark, sf, "embeddings").select(name.alias("name"))
    module, suffix = text.split_module(F.col("name"))
    return n.select("name", module.alias("module"), suffix.alias("suffix"), text.keeps_precision(F.col("name")).alias("kept")).groupBy("name", "module", "suffix", "kept").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trim(split_part(x, '=', 1)) AS category, CAST(trim(split_part(x, '=', 2)) AS INTEGER) AS want FROM (SELECT unnest(string_split('stem=4, math = 3,code=2', ',')) AS x)")
def parse_alloc(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.range(1).select(text.parse_allocation(F.lit("stem=4, math = 3,code=2")).alias("m"))
    return m.select(F.explode("m").alias("category", "want"))


@query(f"""WITH t AS (SELECT item_id, unnest(range(len(turns))) AS turn, unnest(turns) AS t FROM bench_turns), v AS (SELECT item_id, turn, unnest(['', 'step by step.' || chr(10), '  Answer: Let ' || chr(9)]) AS tail, t FROM t)
SELECT item_id, turn, count(*) FILTER (ends_with(regexp_replace(t || ' ' || tail, '{WS}+$', ''), 'step by step.') OR contains(right(regexp_replace(t || ' ' || tail, '{WS}+$', ''), 30), 'Answer: Let')) AS reasoning FROM v GROUP BY 1, 2""")
def evaluation_route(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "bench_turns").select("item_id", F.posexplode("turns").alias("turn", "t"))
    v = t.withColumn("tail", F.explode(F.array(F.lit(""), F.lit("step by step.\n"), F.lit("  Answer: Let \t"))))
    on = text.evaluation_route(F.concat("t", F.lit(" "), "tail"))
    return v.groupBy("item_id", F.col("turn").cast("long").alias("turn")).agg(F.count_if(on).alias("reasoning"))


@query("SELECT line_no, id FROM (SELECT line_no, 's' || (line_no % 7) AS id FROM prompts WHERE line_no % 3 > 0)")
def rstrip_prefix(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(F.lit("_student."), F.lit("_teacher_model."), F.lit("")), (F.col("line_no") % 3 + 1).cast("int")), F.lit("s"), F.col("line_no") % 7, F.element_at(F.array(F.lit(".weight"), F.lit("")), (F.col("line_no") % 2 + 1).cast("int")))
    return table(spark, sf, "prompts").filter("line_no % 3 > 0").select("line_no", text.strip_prefixes(name, ("_teacher_model.", "_student."), (".weight",)).alias("id"))


@query("SELECT vec_id, vec_id % 5 > 0 AND starts_with('l' || (vec_id % 12) || '.mlp', 'l1') OR vec_id % 5 = 0 AS ignored FROM embeddings")
def filter_ignore_list(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("vec_id") % 5 == 0, F.lit("visual.")).otherwise(""), F.lit("l"), F.col("vec_id") % 12, F.lit(".mlp"))
    return table(spark, sf, "embeddings").select("vec_id", text.is_ignored(name, ("l1",), (r"^visual\.",)).alias("ignored"))


@query(f"SELECT doc_id, CAST((length(text) - length(replace(text, '(a.b)*', ''))) // 6 AS INTEGER) AS n FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '(a.b)* (axb)' ELSE '' END AS text FROM documents)")
def escape_literal(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "(a.b)* (axb)").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(t, F.lit(text.escape_literal("(a.b)*"))).alias("n"))


@query("SELECT DISTINCT id FROM (SELECT id FROM manifest UNION ALL SELECT id FROM regen) WHERE id IS NOT NULL")
def scan_exclude_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of two JSONL files, written here from two tables, and a file that is missing."""
    import warnings

    from quillspark import runtime

    at = runtime.scratch(spark, "exclude")
    table(spark, sf, "manifest").select("id").write.json(f"{at}/a")
    table(spark, sf, "regen").select("id").write.json(f"{at}/b")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return readers.exclude_ids(spark, [f"{at}/a", f"{at}/none", f"{at}/b"])


@query("SELECT CAST(n AS INTEGER) AS shard, count(*) AS n_rows, min(doc_id) AS first FROM (SELECT doc_id, doc_id % 3 AS n FROM documents) GROUP BY 1")
def scan_parquet_glob(spark: SparkSession, sf: str) -> DataFrame:
    from quillspark import runtime

    at = runtime.scratch(spark, "shards")
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % 3).alias("n"))
    for k in range(3):  # one file a shard, as they are handed on
        d.filter(F.col("n") == k).coalesce(1).write.parquet(f"{at}/tmp-{k}")
        runtime.rename(spark, readers.glob_paths(spark, f"{at}/tmp-{k}/*.parquet")[0], f"{at}/part-{k}.parquet")
    return readers.read_shards(spark, f"{at}/part-*.parquet", ["doc_id"]).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first"))


@query("SELECT item_id AS position, md5(turns[1] || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{}.') AS digest FROM bench_turns")
def scan_hf_dataset(spark: SparkSession, sf: str) -> DataFrame:
    from quillspark import runtime

    source = lambda: table(spark, sf, "bench_turns").select(F.col("item_id").alias("position"), F.get("turns", F.lit(0)).alias("question"))
    return readers.benchmark_prompts(spark, "gsm8k", source, runtime.scratch(spark, "benchmarks")).select("position", F.md5("prompt").alias("digest"))
