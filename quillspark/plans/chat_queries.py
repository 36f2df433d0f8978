"""Queries on conversations: prompts and regen as chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chat, text
from quillspark.plans.registry import query
from quillspark.runtime import table

# fragments of the SQL side
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_blank(x: str) -> str:
    return f"coalesce({s_strip(x)} = '', true)"


def s_conv(name: str, key: str) -> str:
    role = "CASE lower(trim(m.role)) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE lower(trim(m.role)) END"
    return f"SELECT {key}, list_transform(conversations, lambda m: {{'role': {role}, 'content': m.content}}) AS c FROM {name} WHERE conversations IS NOT NULL"


def s_last(c: str, role: str) -> str:
    return f"coalesce(list_max(list_transform(range(1, len({c}) + 1), lambda i: CASE WHEN {c}[i].role = '{role}' THEN i ELSE 0 END)), 0)"


def s_flat(c: str) -> str:
    return f"md5(array_to_string(list_transform({c}, lambda m: coalesce(m.role, '') || '=' || coalesce(m.content, '')), chr(10)))"


def flat(c: Column) -> Column:
    return F.md5(F.array_join(F.transform(c, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit("="), F.coalesce(m["content"], F.lit("")))), "\n"))


def convs(spark: SparkSession, sf: str, name: str = "prompts", key: str = "line_no") -> DataFrame:
    return table(spark, sf, name).filter("conversations IS NOT NULL").select(key, chat.normal_roles(F.col("conversations")).alias("c"))


_P, _R = s_conv("prompts", "line_no"), s_conv("regen", "resp_id")
_DEF = chat.DEFAULT_SYSTEM


@query(f"""WITH p AS ({_P}), t AS (SELECT line_no, c[1:{s_last('c', 'user')}] AS t FROM p WHERE {s_last('c', 'user')} > 0),
o AS (SELECT line_no, CASE WHEN t[1].role = 'system' AND NOT {s_blank('t[1].content')} THEN k ELSE list_concat([{{'role': 'system', 'content': '{_DEF}'}}], k) END AS o
  FROM (SELECT line_no, t, list_filter(t, lambda m: NOT (m.role = 'system' AND {s_blank('m.content')})) AS k FROM t))
SELECT line_no, CAST(len(o) AS INTEGER) AS n_turns, {s_flat('o')} AS digest FROM o""")
def to_prompt(spark: SparkSession, sf: str) -> DataFrame:
    o = convs(spark, sf).select("line_no", chat.to_prompt(F.col("c")).alias("o")).filter("o IS NOT NULL")
    return o.select("line_no", F.size("o").alias("n_turns"), flat(F.col("o")).alias("digest"))


@query(f"""WITH p AS ({_R}), o AS (SELECT resp_id, list_filter(c, lambda m: m.role IN ('system', 'user') AND NOT {s_blank('m.content')}) AS o FROM p)
SELECT resp_id, CAST(len(o) AS INTEGER) AS n_turns, {s_flat('o')} AS digest FROM o WHERE len(list_filter(o, lambda m: m.role = 'user')) > 0""")
def seed_messages(spark: SparkSession, sf: str) -> DataFrame:
    o = convs(spark, sf, "regen", "resp_id").select("resp_id", chat.seed_messages(F.col("c")).alias("o")).filter("o IS NOT NULL")
    return o.select("resp_id", F.size("o").alias("n_turns"), flat(F.col("o")).alias("digest"))


def s_strip_blocks(x: str) -> str:
    return (
        f"CASE WHEN contains({x}, '<think>') THEN regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<think>.*?</think>\\n*', '', 'g'), '(?s)<think>.*$', ''), '^{WS}+', '')"
        f" ELSE {x} END"
    )


_BODY0 = "coalesce(m.content, '')"
_SG = f"list_transform(list_filter(c, lambda m: m.role IN ('system', 'user', 'assistant')), lambda m: {{'role': m.role, 'content': CASE WHEN m.role = 'assistant' THEN {s_strip_blocks(_BODY0)} ELSE {_BODY0} END}})"


@query(f"""WITH p AS ({_R}), o AS (SELECT resp_id, {_SG} AS o FROM p)
SELECT resp_id, CAST(len(o) AS INTEGER) AS n_turns, {s_flat('o')} AS digest FROM o
WHERE len(o) > 0 AND o[len(o)].role = 'assistant' AND len(list_filter(o, lambda m: m.role = 'assistant' AND {s_blank('m.content')})) = 0""")
def sharegpt_to_messages(spark: SparkSession, sf: str) -> DataFrame:
    o = convs(spark, sf, "regen", "resp_id").select("resp_id", chat.training_messages(F.col("c")).alias("o")).filter("o IS NOT NULL")
    return o.select("resp_id", F.size("o").alias("n_turns"), flat(F.col("o")).alias("digest"))


@query(f"""WITH p AS ({_R}) SELECT coalesce(CASE WHEN len(c) = 0 THEN 'empty'
 WHEN len(list_filter(c, lambda m: coalesce(m.role, '') NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'bad_role'
 WHEN len(list_filter(c, lambda m: m.content IS NULL)) > 0 THEN 'null_content' WHEN c[len(c)].role <> 'assistant' THEN 'not_assistant_last' END, 'kept') AS verdict, count(*) AS n FROM p GROUP BY 1""")
def validate_messages(spark: SparkSession, sf: str) -> DataFrame:
    v = F.coalesce(chat.reject_reason(F.col("c")), F.lit("kept")).alias("verdict")
    return convs(spark, sf, "regen", "resp_id").groupBy(v).agg(F.count(F.lit(1)).alias("n"))


def s_at(role: str) -> str:
    return f"CASE WHEN {s_last('c', role)} > 0 THEN c[{s_last('c', role)}].content END"


@query(f"""WITH p AS ({_R}), o AS (SELECT resp_id, {s_at('system')} AS s, {s_at('user')} AS u, {s_at('assistant')} AS a FROM p)
SELECT resp_id, CASE WHEN {s_blank('s')} THEN '{_DEF}' ELSE s END AS system, md5(u) AS user_md5, md5(a) AS assistant_md5 FROM o WHERE NOT {s_blank('u')} AND NOT {s_blank('a')}""")
def last_turn_per_role(spark: SparkSession, sf: str) -> DataFrame:
    o = convs(spark, sf, "regen", "resp_id").select("resp_id", chat.last_turns(F.col("c")).alias("o")).filter("o IS NOT NULL")
    return o.select("resp_id", F.col("o.system").alias("system"), F.md5("o.user").alias("user_md5"), F.md5("o.assistant").alias("assistant_md5"))


@query(f"""WITH p AS ({_P}), o AS (SELECT line_no, list_concat(c, [{{'role': 'assistant', 'content': 'stub:' || left(coalesce(c[len(c)].content, ''), 32)}}]) AS o FROM p WHERE len(c) > 0)
SELECT line_no, CAST(len(o) AS INTEGER) AS n_turns, {s_flat('o')} AS digest FROM o""")
def append_assistant(spark: SparkSession, sf: str) -> DataFrame:
    last = F.get("c", F.size("c") - 1)["content"]
    o = convs(spark, sf).filter(F.size("c") > 0).select("line_no", F.concat("c", F.array(chat.message("assistant", chat.stub_completion(last)))).alias("o"))
    return o.select("line_no", F.size("o").alias("n_turns"), flat(F.col("o")).alias("digest"))


@query("""WITH b AS (SELECT line_no, coalesce(conversations[1].content, '') AS t FROM prompts WHERE len(conversations) > 0) SELECT line_no, 'stub:' || left(t, 32) AS completion FROM b""")
def stub_completion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "prompts").filter(F.size("conversations") > 0).select("line_no", chat.stub_completion(F.get("conversations", F.lit(0))["content"]).alias("completion"))


_S = s_strip("reasoning")


@query(f"""WITH b AS (SELECT resp_id, CASE WHEN contains(a, '</think>') THEN split_part(a, '</think>', 1) END AS reasoning, a AS content FROM (SELECT resp_id, coalesce(conversations[len(conversations)].content, '') AS a FROM regen WHERE len(conversations) > 0))
SELECT resp_id, md5(CASE WHEN NOT {s_blank('reasoning')} THEN {s_strip("('<think>' || chr(10) || " + _S + " || chr(10) || '</think>' || chr(10) || chr(10) || content)")} ELSE content END) AS auto_md5,
 md5(CASE WHEN NOT {s_blank('reasoning')} THEN {s_strip("('<think>' || chr(10) || " + _S + " || chr(10) || '</think>' || chr(10) || chr(10) || content)")} WHEN NOT contains(content, '<think>') THEN '<think>' || chr(10) || content ELSE content END) AS on_md5,
 md5(CASE WHEN content <> '' THEN content ELSE coalesce(reasoning, '') END) AS off_md5 FROM b""")
def assistant_content(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "regen").filter(F.size("conversations") > 0).select("resp_id", F.coalesce(F.get("conversations", F.size("conversations") - 1)["content"], F.lit("")).alias("content"))
    r = r.withColumn("reasoning", F.when(F.col("content").contains("</think>"), F.split_part("content", F.lit("</think>"), F.lit(1))))
    return r.select("resp_id", *(F.md5(chat.assistant_content(F.col("content"), F.col("reasoning"), k)).alias(f"{k}_md5") for k in ("auto", "on", "off")))


@query(f"""WITH b AS (SELECT resp_id, reasoning AS a, finish_reason AS b FROM regen) SELECT resp_id, CASE WHEN NOT {s_blank('a')} THEN a WHEN NOT {s_blank('b')} THEN b END AS reasoning FROM b""")
def extract_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("reasoning"), F.col("finish_reason")
    return table(spark, sf, "regen").select("resp_id", F.when(~text.is_blank(a), a).when(~text.is_blank(b), b).alias("reasoning"))


_OK = "CASE WHEN i = 1 THEN coalesce(r[i].role = 'user', false) ELSE coalesce(NOT (r[i].role = 'tool' AND r[i-1].role NOT IN ('assistant', 'tool')) AND NOT (r[i].role = 'assistant' AND r[i-1].role NOT IN ('user', 'tool')), false) END"


@query(f"""WITH p AS ({_R}), r AS (SELECT resp_id, coalesce(c[1].role = 'system', false) AS own, CASE WHEN coalesce(c[1].role = 'system', false) THEN c[2:] ELSE c END AS r FROM p),
k AS (SELECT resp_id, own, r, coalesce(list_min(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN {_OK} THEN len(r) ELSE i - 1 END)), 0) AS k FROM r)
SELECT CAST(k + CAST(own AS INTEGER) AS INTEGER) AS n_turns, count(*) AS n FROM k GROUP BY 1""")
def role_sequence_truncate(spark: SparkSession, sf: str) -> DataFrame:
    o = convs(spark, sf, "regen", "resp_id").select(F.size(chat.valid_prefix(F.col("c"))).alias("n_turns"))
    return o.groupBy("n_turns").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS ({_P}) SELECT line_no, md5('<s>' || array_to_string(list_transform(c, lambda m: CASE m.role WHEN 'system' THEN coalesce(m.content, '') WHEN 'user' THEN 'USER: ' || coalesce(m.content, '')
 WHEN 'assistant' THEN 'ASSISTANT: ' || coalesce(m.content, '') || '</s>' ELSE '' END), '')) AS digest FROM p""")
def render_fallback(spark: SparkSession, sf: str) -> DataFrame:
    t = chat.TEMPLATES.get("plain")
    return convs(spark, sf).select("line_no", F.md5(chat.render_plain(F.col("c"), t.user, t.assistant, t.end, "<s>")).alias("digest"))


def _sql_chatml() -> str:
    body = s_strip("coalesce(m.content, '')")
    why = s_strip("list_last(string_split(regexp_replace(split_part(b.b, '</think>', 1), '\\n+$', ''), '<think>'))")
    said = "regexp_replace(list_last(string_split(b.b, '</think>')), '^\\n+', '')"
    start = "'<|im_start|>' || b.role || chr(10)"
    plain = f"CASE WHEN contains(b.b, '</think>') THEN {said} ELSE b.b END"
    whyx = f"CASE WHEN contains(b.b, '</think>') THEN {why} ELSE '' END"
    one = f"""(CASE WHEN b.role = 'assistant' THEN CASE WHEN b.i > last THEN {start} || '<think>' || chr(10) || {whyx} || chr(10) || '</think>' || chr(10) || chr(10) || {plain}
      ELSE {start} || {plain} END ELSE {start} || b.b END) || '<|im_end|>' || chr(10)"""
    return f"""WITH p AS ({_R}), b AS (SELECT resp_id, c, list_transform(range(1, len(c) + 1), lambda i: {{'i': i, 'role': c[i].role, 'b': {body.replace('m.content', 'c[i].content')}}}) AS bs FROM p),
l AS (SELECT resp_id, bs, coalesce(list_max(list_transform(bs, lambda b: CASE WHEN b.role = 'user' AND NOT (starts_with(b.b, '<tool_response>') AND ends_with(b.b, '</tool_response>')) THEN b.i ELSE 0 END)), 0) AS last FROM b)
SELECT resp_id, md5(array_to_string(list_transform(bs, lambda b: {one}), '')) AS digest FROM l WHERE last > 0 AND len(list_filter(bs, lambda b: b.i > 1 AND b.role = 'system')) = 0"""


@query(_sql_chatml())
def render_chatml_no_think(spark: SparkSession, sf: str) -> DataFrame:
    o = convs(spark, sf, "regen", "resp_id").select("resp_id", chat.render_chatml(F.col("c")).alias("o")).filter("o IS NOT NULL")
    return o.select("resp_id", F.md5("o").alias("digest"))


_HS = chat.HARMONY_SYSTEM.format("low").replace("\n", "' || chr(10) || '")


@query(f"""WITH p AS ({_R}), o AS (SELECT resp_id, {s_last('c', 'system')} AS s, list_transform(c[greatest({s_last('c', 'system')}, 1):], lambda m: CASE m.role WHEN 'system' THEN '<|start|>system<|message|>' WHEN 'user' THEN '<|start|>user<|message|>'
 ELSE '<|start|>assistant<|channel|>final<|message|>' END || coalesce(m.content, '') || '<|end|>') AS t FROM p)
SELECT resp_id, md5(CASE WHEN s > 0 THEN '' ELSE '{_HS}' END || array_to_string(t, '')) AS digest FROM o""")
def render_harmony(spark: SparkSession, sf: str) -> DataFrame:
    return convs(spark, sf, "regen", "resp_id").select("resp_id", F.md5(chat.render_harmony(F.col("c"))).alias("digest"))


@query("""WITH d AS (SELECT resp_id, '<|channel|> analysis <|message|>' || coalesce(conversations[1].content, '') || ' <|end|><|channel|>final<|message|>' || coalesce(conversations[2].content, '') || '<|end|>' AS t FROM regen),
e AS (SELECT resp_id, regexp_extract_all(t, '(?s)<\\|channel\\|>(.*?)<\\|message\\|>(.*?)<\\|end\\|>', 1) AS a FROM d)
SELECT resp_id, CAST(len(a) AS INTEGER) AS n, array_to_string(list_transform(a, lambda x: trim(x)), ',') AS channels FROM e""")
def split_harmony_channels(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: F.coalesce(F.get("conversations", F.lit(k))["content"], F.lit(""))
    t = F.concat(F.lit("<|channel|> analysis <|message|>"), at(0), F.lit(" <|end|><|channel|>final<|message|>"), at(1), F.lit("<|end|>"))
    s = table(spark, sf, "regen").select("resp_id", chat.split_channels(t).alias("s"))
    return s.select("resp_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["channel"]), ",").alias("channels"))


@query(f"""WITH p AS ({_P}) SELECT line_no, md5(array_to_string(list_transform(list_filter(c, lambda m: m.role = 'user' AND m.content IS NOT NULL), lambda m: m.content), ' ')) AS user_md5 FROM p""")
def join_user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return convs(spark, sf).select("line_no", F.md5(chat.user_text(F.col("c"))).alias("user_md5"))


@query(f"""WITH p AS ({_P}) SELECT count(*) AS n, count(*) FILTER (len(list_filter(c, lambda m: m.role = 'user')) = 0) AS no_user, count(*) FILTER (len(c) >= 2) AS two_turns,
 count(*) FILTER (len(list_filter(c, lambda m: coalesce(m.role, '') NOT IN ('system', 'user', 'assistant'))) = 0) AS roles_valid FROM p""")
def conversation_predicates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c")
    return convs(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.exists(c, lambda m: m["role"] == "user")).alias("no_user"),
        F.count_if(F.size(c) >= 2).alias("two_turns"),
        F.count_if(~F.exists(c, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)))).alias("roles_valid"),
    )


@query("""SELECT item_id, md5(turns[1] || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{}.') AS gsm8k,
 md5(left(turns[1], 32768) || chr(10) || chr(10) || answer) AS longbench FROM bench_turns""")
def dataset_format(spark: SparkSession, sf: str) -> DataFrame:
    t = F.get("turns", F.lit(0))
    return table(spark, sf, "bench_turns").select("item_id", F.md5(chat.dataset_prompt("gsm8k", question=t)).alias("gsm8k"), F.md5(chat.dataset_prompt("longbench", context=t, question=F.col("answer"))).alias("longbench"))


_BODY = """CASE line_no % 5 WHEN 0 THEN '{"prompt": "p", "max_tokens": 4}' WHEN 1 THEN '{"messages": [{"role": "user"}], "thinking": true, "stream": true}'
 WHEN 2 THEN '{"messages": [], "chat_template_kwargs": {"enable_thinking": true}}' WHEN 3 THEN '{"messages": [1], "stream": 0}' ELSE '{broken' END"""


@query("""SELECT path, thinking, stream, count(*) AS n FROM (SELECT CASE WHEN line_no % 5 IN (1, 2, 3) THEN '/v1/chat/completions' ELSE '/v1/completions' END AS path,
 CASE WHEN line_no % 5 IN (1, 2) THEN 'true' WHEN line_no % 5 = 3 THEN 'false' END AS thinking, line_no % 5 = 1 AS stream FROM prompts) GROUP BY ALL""")
def invocation_route(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "prompts").select(F.expr(_BODY).alias("body"))
    r = b.select(chat.route_request(F.col("body")).alias("r"), chat.wants_stream(F.col("body")).alias("stream"))
    return r.select("r.path", "r.thinking", "stream").groupBy("path", "thinking", "stream").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT line_no, CAST(len(j) AS INTEGER) AS n_tools FROM (SELECT line_no, CASE WHEN json_valid(raw_line) AND json_type(raw_line::JSON, '$.conversations') = 'ARRAY' THEN json_extract(raw_line::JSON, '$.conversations[*]') ELSE [] END AS j FROM prompt_lines)""")
def parse_tools(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "prompt_lines").select("line_no", F.when(F.expr("try_parse_json(raw_line) IS NOT NULL"), F.get_json_object("raw_line", "$.conversations")).alias("t"))
    return raw.select("line_no", F.size(chat.parse_tools(F.col("t"))).alias("n_tools"))


@query("""SELECT 'chatml' AS name, '<|im_end|>' || chr(10) AS end UNION ALL SELECT 'header', '<|eot_id|>' UNION ALL SELECT 'plain', '</s>' UNION ALL SELECT 'turn', '<end_of_turn>' || chr(10)""")
def template_registry(spark: SparkSession, sf: str) -> DataFrame:
    return chat.TEMPLATES.table(spark).select("name", "end")
