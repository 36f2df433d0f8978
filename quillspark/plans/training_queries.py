"""Queries from conversations to training rows, and of the calibration set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import chat, text
from quillspark.operators import training
from quillspark.plans.chat_queries import _HS, _P, _R, WS, _sql_chatml, convs, s_last
from quillspark.plans.registry import query
from quillspark.plans.token_queries import _ID
from quillspark.runtime import table

V = 5000
_WORDS = "regexp_extract_all({t}, '\\S+')"
# the SQL rendering of a conversation table (key, c) as (key, t), and the parts of each message
_CHATML = _sql_chatml().replace("md5(array_to_string(list_transform(bs, lambda b: ", "(array_to_string(list_transform(bs, lambda b: ").replace(", '')) AS digest", ", '')) AS t, list_transform(bs, lambda b: b.role) AS roles, list_transform(bs, lambda b: @ONE@) AS each")
_ONE = _sql_chatml().split("md5(array_to_string(list_transform(bs, lambda b: ", 1)[1].split("), '')) AS digest", 1)[0]
_CHATML = _CHATML.replace("@ONE@", _ONE)


def _total(c: str):  # noqa: ANN202
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def _on(each: str, roles: str, tail: str) -> str:
    """Words of what assistants say, the end mark being a part of the last of them."""
    return f"coalesce(CAST(list_sum(list_transform(range(1, len({each}) + 1), lambda i: CASE WHEN {roles}[i] = 'assistant' THEN len(regexp_extract_all({each}[i], '\\S+')) - {tail} ELSE 0 END)) AS BIGINT), 0)"


_ENC = f"SELECT resp_id, {_WORDS.format(t='t')} AS w, {_on('each', 'roles', '1')} AS on_tokens FROM ({_CHATML})"


@query(f"SELECT resp_id, CAST(len(w) AS INTEGER) AS n, on_tokens, coalesce(CAST(list_sum(list_transform(w, lambda x: {_ID.format(w='x')})) AS BIGINT), 0) AS checksum FROM ({_ENC})")
def encode_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = training.preprocess(convs(spark, sf, "regen", "resp_id"), "c", "chatml", V, keep=["resp_id"])
    return e.select("resp_id", F.size("input_ids").alias("n"), _total("loss_mask").alias("on_tokens"), _total("input_ids").alias("checksum"))


@query(f"SELECT resp_id, CAST(least(len(w), 128) AS INTEGER) AS n FROM ({_ENC})")
def preprocess_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = training.preprocess(convs(spark, sf, "regen", "resp_id"), "c", "chatml", V, longest=128, keep=["resp_id"])
    return e.select("resp_id", F.size("attention_mask").alias("n"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY md5('42:' || resp_id), CAST(resp_id AS VARCHAR)) - 1 AS BIGINT) AS position, CAST(len(w) AS INTEGER) AS n FROM ({_ENC}) WHERE on_tokens >= 64")
def build_dataset(spark: SparkSession, sf: str) -> DataFrame:
    d = training.labelled(training.build_dataset(convs(spark, sf, "regen", "resp_id"), "c", "resp_id", "chatml", V, least_loss=64))
    return d.select("position", F.size("labels").alias("n"))


@query(f"SELECT resp_id, CAST((length(t) - length(replace(t, '<|im_start|>assistant' || chr(10), ''))) // 22 AS INTEGER) AS n_spans, coalesce(CAST(list_sum(list_transform(range(1, len(each) + 1), lambda i: CASE WHEN roles[i] = 'assistant' THEN length(each[i]) - 23 ELSE 0 END)) AS BIGINT), 0) AS n_chars FROM ({_CHATML})")
def regex_spans(spark: SparkSession, sf: str) -> DataFrame:
    p = training.PARSERS["chatml"]
    o = convs(spark, sf, "regen", "resp_id").select("resp_id", p.render(F.col("c")).alias("t")).filter("t IS NOT NULL")
    s = o.select("resp_id", text.spans(F.col("t"), p.header, p.stop).alias("s"))
    return s.select("resp_id", F.size("s").alias("n_spans"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"]).alias("n_chars"))


_HARM = f"""WITH p AS ({_R}), o AS (SELECT resp_id, {s_last('c', 'system')} AS s, c[greatest({s_last('c', 'system')}, 1):] AS c FROM p),
m AS (SELECT resp_id, s, list_transform(c, lambda m: CASE m.role WHEN 'system' THEN '<|start|>system<|message|>' WHEN 'user' THEN '<|start|>user<|message|>' ELSE '<|start|>assistant<|channel|>final<|message|>' END || coalesce(m.content, '') || '<|end|>') AS e FROM o)
SELECT resp_id, CASE WHEN s > 0 THEN '' ELSE '{_HS}' END || array_to_string(e, '') AS t FROM m"""


@query(f"""WITH t AS ({_HARM}), q AS (SELECT resp_id, t, string_split(t, '<|start|>assistant') AS x FROM t), g AS (SELECT resp_id, t, list_transform(x[2:], lambda y: string_split(y, '<|start|>user<|message|>')[1]) AS g FROM q)
SELECT resp_id, CAST(len({_WORDS.format(t='t')}) AS INTEGER) AS n, CAST(len(g) AS INTEGER) AS n_spans, coalesce(CAST(list_sum(list_transform(g, lambda y: length(y))) AS BIGINT), 0) AS n_chars FROM g WHERE len(t) > 0""")
def harmony_spans(spark: SparkSession, sf: str) -> DataFrame:
    p = training.PARSERS["harmony"]
    o = convs(spark, sf, "regen", "resp_id").select("resp_id", p.render(F.col("c")).alias("t")).filter("t <> ''")
    s = o.select("resp_id", F.size(text.words(F.col("t"))).alias("n"), text.spans(F.col("t"), p.header, p.stop, p.inside).alias("s"))
    # spans that touch are one match of the pattern
    return s.select("resp_id", "n", F.size("s").alias("n_spans"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"]).alias("n_chars"))


@query()
def loss_mask_harmony(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that lie whole in a span; brute force in tests/test_training.py."""
    e = training.preprocess(convs(spark, sf, "regen", "resp_id"), "c", "harmony", V, keep=["resp_id"])
    return e.select("resp_id", F.size("input_ids").alias("n"), _total("loss_mask").alias("on_tokens"))


@query(f"""SELECT line_no, CAST(len({_WORDS.format(t='t')}) + 3 AS INTEGER) AS n_tokens FROM ({_CHATML.replace(_R, _P).replace('resp_id', 'line_no')}) WHERE len({_WORDS.format(t='t')}) + 3 < 120""")
def prompt_len(spark: SparkSession, sf: str) -> DataFrame:
    p = convs(spark, sf).select("line_no", training.prompt_length(F.col("c")).alias("n_tokens"))
    return p.filter("n_tokens < 120")


def _calls(key: str) -> str:
    """JSON text of a tool call, in all the shapes it comes in."""
    return f"""CASE {key} % 4 WHEN 0 THEN '[{{"id": "c' || {key} || '", "type": "function", "extra": 1, "function": {{"name": "look", "arguments": "{{\\\\"n\\\\": ' || {key} || '}}"}}}}]'
 WHEN 1 THEN '[{{"function": {{"name": "find", "arguments": {{"q": "x' || {key} || '", "k": "2"}}}}}}, {{"id": "z", "function": {{"name": "stop", "arguments": "broken"}}}}]' WHEN 2 THEN '[broken' END"""


@query("""SELECT resp_id, CASE resp_id % 4 WHEN 0 THEN 'c' || resp_id || '/function/look/n=' || resp_id WHEN 1 THEN '/function/find/q=x' || resp_id || ',k=2;z/function/stop/' END AS calls FROM regen""")
def sanitize_message(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "regen").select("resp_id", F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), F.expr(_calls("resp_id")).alias("tool_calls"), F.lit(1).alias("extra")).alias("m"))
    args = lambda t: F.array_join(F.transform(F.map_entries(t["arguments"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    one = lambda t: F.concat(t["id"], F.lit("/"), t["type"], F.lit("/"), t["name"], F.lit("/"), args(t))
    c = m.select("resp_id", chat.sanitize_message(F.col("m")).alias("m")).select("resp_id", F.array_join(F.transform("m.tool_calls", one), ";").alias("calls"))
    return c


_TOOL_SQL = """'<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || @WHY@ || chr(10) || '</think>' || chr(10) || chr(10) || 'Let me see.' ||
 CASE k WHEN 0 THEN chr(10) || chr(10) || '<tool_call>' || chr(10) || '<function=look>' || chr(10) || '<parameter=n>' || chr(10) || resp_id || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'
 WHEN 1 THEN chr(10) || chr(10) || '<tool_call>' || chr(10) || '<function=find>' || chr(10) || '<parameter=q>' || chr(10) || 'x' || resp_id || chr(10) || '</parameter>' || chr(10) || '<parameter=k>' || chr(10) || '2' || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>' || chr(10) || '<tool_call>' || chr(10) || '<function=stop>' || chr(10) || '</function>' || chr(10) || '</tool_call>'
 ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || 'one' || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || 'two' || chr(10) || '</tool_response>' || '<|im_end|>' || chr(10)"""


def _tool_talk(spark: SparkSession, sf: str) -> DataFrame:
    """A question, an answer that calls tools and thinks beside it, and what two tools return."""
    turn = lambda role, content, calls=None, why=None: F.struct(
        F.lit(role).alias("role"), content.alias("content"), (calls if calls is not None else F.lit(None).cast("string")).alias("tool_calls"), (why if why is not None else F.lit(None).cast("string")).alias("reasoning_content")
    )
    c = F.array(
        turn("user", F.concat(F.lit("q"), "resp_id")), turn("assistant", F.lit(" Let me see."), F.expr(_calls("resp_id")), F.concat(F.lit("why "), F.col("gen_model"))), turn("tool", F.lit("one")), turn("tool", F.lit("two"))
    )
    return table(spark, sf, "regen").select("resp_id", c.alias("c"))


@query(f"SELECT resp_id, md5(t) AS digest FROM (SELECT resp_id, {_TOOL_SQL.replace('@WHY@', chr(39) * 2)} AS t FROM (SELECT resp_id, 'q' || resp_id AS q, resp_id % 4 AS k FROM regen))")
def render_chatml_tools(spark: SparkSession, sf: str) -> DataFrame:
    return _tool_talk(spark, sf).select("resp_id", F.md5(training.PARSERS["tools"].render(F.col("c"))).alias("digest"))


@query(f"SELECT resp_id, md5(t) AS digest FROM (SELECT resp_id, {_TOOL_SQL.replace('@WHY@', 'w')} AS t FROM (SELECT resp_id, 'q' || resp_id AS q, resp_id % 4 AS k, coalesce(regexp_replace('why ' || gen_model, '^{WS}+|{WS}+$', '', 'g'), '') AS w FROM regen))")
def thinking_parser(spark: SparkSession, sf: str) -> DataFrame:
    return _tool_talk(spark, sf).select("resp_id", F.md5(training.PARSERS["thinking"].render(F.col("c"))).alias("digest"))


@query()
def build_calib(spark: SparkSession, sf: str) -> DataFrame:
    """The whole set of both mixes' targets at the cap of 12288 tokens; brute force in tests/test_training.py."""
    c = training.calibration_candidates(table(spark, sf, "regen"), "resp_id", "conversations")
    return training.calibration_set(c, "resp_id", training.mix_targets("eval"))


@query()
def calib_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = training.calibration_candidates(table(spark, sf, "regen"), "resp_id", "conversations")
    t = training.mix_targets("balanced")
    return training.calibration_summary(c, training.calibration_set(c, "resp_id", t), t)


@query(f"""WITH t AS ({_R}), k AS (SELECT resp_id, len(regexp_extract_all(coalesce(c[1].content, ''), '\\S+')) AS p, len(regexp_extract_all(coalesce(c[1].content, '') || ' ' || coalesce(c[len(c)].content, ''), '\\S+')) AS n FROM t WHERE len(c) > 0)
SELECT resp_id, CAST(n AS INTEGER) AS n FROM k WHERE n > p + 33 AND n - 32 > p""")
def filter_short_conv(spark: SparkSession, sf: str) -> DataFrame:
    w = lambda c: F.size(text.words(F.coalesce(c, F.lit(""))))
    first, last = F.get("c", F.lit(0))["content"], F.get("c", F.size("c") - 1)["content"]
    k = convs(spark, sf, "regen", "resp_id").filter(F.size("c") > 0).select("resp_id", w(first).alias("p"), w(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))).alias("n"))
    return k.filter(training.long_enough(F.col("n"), F.col("p"), 32)).select("resp_id", "n")


@query("SELECT line_no, len(conversations) >= 2 AS two FROM prompts WHERE conversations IS NOT NULL")
def predicate_len2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "prompts").filter("conversations IS NOT NULL").select("line_no", (F.size("conversations") >= 2).alias("two"))


@query("SELECT CAST(unnest([1, n // 2 - 1, n - 4]) AS INTEGER) AS layer, count(*) AS n FROM (SELECT 24 + vec_id % 3 * 8 AS n FROM embeddings) GROUP BY 1")
def aux_layer_ids(spark: SparkSession, sf: str) -> DataFrame:
    three = {n: training.aux_layers(n) for n in (24, 32, 40)}
    e = table(spark, sf, "embeddings").select((24 + F.col("vec_id") % 3 * 8).alias("n"))
    pick = F.when(F.col("n") == 24, F.array(*map(F.lit, three[24]))).when(F.col("n") == 32, F.array(*map(F.lit, three[32]))).otherwise(F.array(*map(F.lit, three[40])))
    return e.select(F.explode(pick).alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT line_no, CASE line_no % 4 WHEN 0 THEN 'a' || line_no WHEN 1 THEN 'b' || line_no ELSE '' END AS answer FROM prompts")
def response_text(spark: SparkSession, sf: str) -> DataFrame:
    body = F.expr("""CASE line_no % 4 WHEN 0 THEN '{"choices": [{"text": "a' || line_no || '"}]}' WHEN 1 THEN '{"choices": [{"message": {"content": "b' || line_no || '"}}]}' WHEN 2 THEN '{"choices": []}' ELSE '{broken' END""")
    return table(spark, sf, "prompts").select("line_no", chat.completion_text(body).alias("answer"))
