"""Queries pN_... of the training-data problems over the tables of TESTDATA.md, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import balanced, duplicates, leaks, mixing, packing, pairs, residue, sample_ledger, tokens
from quillspark.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.prompt_tokens(table(spark, sf, "prompts"))


@query
def p1_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.prompt_budget(table(spark, sf, "prompts"))


@query
def p1_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.document_budget(table(spark, sf, "documents"))


@query
def p1_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.totals(tokens.prompt_budget(table(spark, sf, "prompts")))


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_pairs(table(spark, sf, "prompts"), table(spark, sf, "prompt_lines"))


@query
def p2_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.collapse(table(spark, sf, "prompts"), table(spark, sf, "prompt_lines"))


@query
def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample_ledger.stable_sample(table(spark, sf, "prompts"))


SQL["p3_sample"] = sample_ledger.SQL_SAMPLE


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "regen"))


@query
def p4_summary(spark: SparkSession, sf: str) -> DataFrame:
    regen = table(spark, sf, "regen")
    return pairs.summary(pairs.defects(regen), regen)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_report(spark, sf).filter("short").select("category")


@query
def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.draw(table(spark, sf, "prompts"), table(spark, sf, "mix_targets"))[1]


@query
def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.draw(table(spark, sf, "prompts"), table(spark, sf, "mix_targets"))[0]


SQL["p5_found"] = """
WITH p AS (
  SELECT DISTINCT CASE WHEN regexp_full_match(replace(t, '-', ''), '[0-9a-f]{32}') THEN replace(t, '-', '') ELSE t END AS id, label
  FROM (SELECT lower(regexp_replace(id, '[\\s{}]', '', 'g')) AS t, lower(regexp_replace(category, '[^\\p{L}\\p{N}\\p{M}\\p{S}]+', '', 'g')) AS label FROM prompts)
  WHERE t IS NOT NULL AND t <> ''),
s AS (SELECT count(DISTINCT id) // 5 AS s FROM p),
c AS (SELECT label, count(DISTINCT id) AS n FROM p GROUP BY 1)
SELECT m.category FROM mix_targets m CROSS JOIN s
LEFT JOIN c ON c.label = lower(regexp_replace(m.category, '[^\\p{L}\\p{N}\\p{M}\\p{S}]+', '', 'g'))
WHERE coalesce(c.n, 0) < greatest(m.min_rows, ceil(m.target_share * s.s))
"""


def _capacity(spark: SparkSession, sf: str) -> int:
    return int(table(spark, sf, "pack_plan").filter("item_table = 'regen'").select("capacity").first()[0])


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.divided(p6_packed(spark, sf))


@query
def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "regen"), _capacity(spark, sf))


@query
def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    capacity = _capacity(spark, sf)
    return packing.summary(packing.pack(table(spark, sf, "regen"), capacity), capacity)


SQL["p6_found"] = """
SELECT resp_id, CAST(k - 1 AS INTEGER) AS turn
FROM (SELECT resp_id, unnest(range(1, len(conversations) + 1)) AS k, conversations AS c FROM regen)
WHERE length(c[k].content) > (SELECT capacity FROM pack_plan)
"""


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked(table(spark, sf, "documents"), table(spark, sf, "bench_turns"))


@query
def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.report(table(spark, sf, "documents"), table(spark, sf, "bench_turns"))


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).filter("short").select("source")


@query
def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_weights"))[1]


@query
def p8_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_weights"))[0]


# Any measure of text size gives the same list, so the check of p8_found counts characters.
SQL["p8_found"] = """
WITH t AS (SELECT sum(n_chars) AS a FROM documents), s AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1)
SELECT w.source FROM source_weights w LEFT JOIN s USING (source) CROSS JOIN t
WHERE coalesce(s.n, 0) * w.max_repeats < w.target_share * t.a
"""


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(table(spark, sf, "documents"))


@query
def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    return residue.clean(table(spark, sf, "documents")).select("doc_id", "source", "lang", "n_chars")


_CANON = "translate(replace(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{S}}]+', '', 'g')), 'ß', 'ss'), 'ςſµ', 'σsμ')"
_RECORDS = f"""WITH m AS (
  SELECT line_no, coalesce(batch_no, -1) AS delivery, category AS cat, list_transform(conversations, lambda m: {{'r': m.role, 'c': m.content}}) AS ms FROM prompts WHERE len(conversations) > 0
  UNION ALL
  SELECT line_no, 2147483647, json_extract_string(raw_line, '$.category'), list_transform(coalesce(json_extract(raw_line::JSON, '$.conversations[*]'), []), lambda j: {{'r': j->>'role', 'c': j->>'content'}})
  FROM prompt_lines WHERE json_valid(raw_line)),
k AS (SELECT line_no, delivery, coalesce('c' || {_CANON.format(x="cat")}, 'n') || chr(2) || array_to_string(list_transform(ms, lambda m: coalesce({_CANON.format(x="m.r")}, '') || chr(1) || coalesce({_CANON.format(x="m.c")}, '')), chr(3)) AS k FROM m)
"""
SQL["p2_found"] = _RECORDS + "SELECT line_a, line_b FROM (SELECT min(line_no) OVER (PARTITION BY k) AS line_a, line_no AS line_b FROM k) WHERE line_a <> line_b"
SQL["p2_collapsed"] = _RECORDS + "SELECT min(line_no) AS line_no, count(*) AS n_copies, CAST(min(delivery) AS INTEGER) AS first_delivery FROM k GROUP BY k"

_WORDS = "string_split(trim(regexp_replace(regexp_replace(lower(upper({x})), '\\p{{Cf}}', '', 'g'), '[\\s\\p{{Z}}\\p{{P}}\\p{{C}}]+', ' ', 'g')), ' ')"
_PASSAGES = f"""WITH t AS (SELECT item_id, {_WORDS.format(x="t")} AS w FROM (SELECT item_id, unnest(turns) AS t FROM bench_turns)),
a AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM t)),
d AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents WHERE text IS NOT NULL),
j AS (SELECT DISTINCT doc_id, item_id, g FROM (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)) JOIN a USING (g))
"""
SQL["p7_found"] = _PASSAGES + "SELECT DISTINCT doc_id, item_id FROM j"
SQL["p7_report"] = _PASSAGES + "SELECT item_id, benchmark, count(*) AS n_docs, max(n) AS most_passages FROM (SELECT doc_id, item_id, count(*) AS n FROM j GROUP BY 1, 2) JOIN bench_turns USING (item_id) GROUP BY 1, 2"
