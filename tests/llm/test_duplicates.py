from __future__ import annotations

import json
import unicodedata
from collections import defaultdict

from llm_rows import LINE, PROMPT, msgs, prompt
from pyspark.sql import functions as F

from quillspark.llm import duplicates
from quillspark.runtime import table


def brute(prompts, lines):
    def norm(t):
        return "".join(c for c in (t or "").casefold() if unicodedata.category(c)[0] in "LNMS")

    g = defaultdict(list)
    for r in prompts.collect():
        if r["conversations"]:
            g[None if r["category"] is None else norm(r["category"]), tuple((norm(m["role"]), norm(m["content"])) for m in r["conversations"])].append(r["line_no"])
    for r in lines.collect():
        try:
            j = json.loads(r["raw_line"])
        except (ValueError, TypeError):
            continue
        if isinstance(j, dict):
            c = j.get("category")
            g[None if c is None else norm(c), tuple((norm(m.get("role")), norm(m.get("content"))) for m in j.get("conversations") or [])].append(r["line_no"])
    return {(min(v), x) for v in g.values() for x in v if x != min(v)}, len(g)


def test_against_brute_force(spark, sf):
    p, x = table(spark, sf, "prompts"), table(spark, sf, "prompt_lines")
    want, groups = brute(p, x)
    assert {tuple(r) for r in duplicates.duplicate_pairs(p, x).collect()} == want
    c = duplicates.collapse(p, x)
    assert c.count() == groups and c.agg(F.sum("n_copies")).first()[0] == groups + len(want)


def test_cases(spark):
    rows = [
        prompt(5, "Hello, World!"), prompt(2, "hello  world​"), prompt(9, "HELLO WORLD", category="C."), prompt(7, "hello world", category=None), prompt(8, "hello-world", category=None, batch=None),
        prompt(1, None), prompt(3, ""), (4, None, "c", None, None, None, 0), (6, None, "c", [], None, None, 0), prompt(10, "Straße"), prompt(11, "STRASSE"), prompt(12, "a+b"), prompt(13, "a-b"),
    ]
    lines = [(20, '{"conversations": [{"content": "hello world", "role": "USER"}], "category": "c", "x": 1}'), (21, '{"broken'), (22, None), (23, ""), (24, '{"category": "z"}'), (25, '{"category": "z"} ')]
    p, x = spark.createDataFrame(rows, PROMPT).withColumn("key", F.lit("clash")).withColumn("delivery", F.lit(0)), spark.createDataFrame(lines, LINE)
    got = {tuple(r) for r in duplicates.duplicate_pairs(p, x).collect()}
    assert got == {(2, 5), (2, 9), (2, 20), (7, 8), (1, 3), (10, 11), (24, 25)}
    assert duplicates.duplicate_pairs(p.limit(0), x.limit(0)).count() == 0
    assert duplicates.collapse(p.limit(0), x.limit(0)).count() == 0


def counts(ledger):
    return {(bytes(r["key"]), r["n_copies"], r["first_line"]) for r in ledger.rows.collect()}


def recs(spark, n, first=0):
    rows = [prompt(i, "hot" if i % 3 else f"t{i % 7}", batch=i % 4) for i in range(first, first + n)]
    return duplicates.records(spark.createDataFrame(rows, PROMPT), spark.createDataFrame([], LINE))


def test_ledger_by_deliveries(spark):
    """Deliveries added one by one give the counts of one; a key with most of the rows is one row of each join."""
    r = recs(spark, 200)
    _, one = duplicates.build_ledger(r.withColumn("delivery", F.lit(0)))
    _, many = duplicates.build_ledger(r)
    assert counts(one) == counts(many) and sum(n for _, n, _ in counts(one)) == 200


def test_ledger_goes_on_in_a_new_session(spark, tmp_path):
    """Opened again with grown data: known deliveries are left alone, only touched buckets are written, older rows stay readable."""
    r, path = recs(spark, 200), str(tmp_path)
    duplicates.build_ledger(r.filter("delivery < 3"), path)
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "5")
    _, ledger = duplicates.build_ledger(recs(other, 200), path)
    assert ledger.deliveries == [0, 1, 2, 3] and counts(ledger) == counts(duplicates.build_ledger(r)[1])
    held, want = ledger.rows, counts(ledger)
    one = r.filter("line_no = 0").select("line_no", "key")
    ledger.update(one, 9)
    assert len(set(ledger.entries[-1]["places"].values())) == 2  # one bucket moved
    assert {(bytes(x["key"]), x["n_copies"], x["first_line"]) for x in held.collect()} == want
    ledger.update(one.limit(0), 10)
    assert sum(n for _, n, _ in counts(duplicates.DuplicateLedger(spark, path))) == 201


def test_failed_update_is_written_over(spark, tmp_path):
    path = str(tmp_path)
    duplicates.build_ledger(recs(spark, 60).filter("delivery = 0"), path)
    a = duplicates.DuplicateLedger(spark, path)
    a.store.write(a.rows.withColumn("n_copies", F.lit(99).cast("long")), len(a.entries))  # rows, but no log entry
    assert counts(duplicates.build_ledger(recs(spark, 60), path)[1]) == counts(duplicates.build_ledger(recs(spark, 60))[1])


def test_ledger_side_is_not_exchanged(spark, tmp_path):
    _, a = duplicates.build_ledger(recs(spark, 60), str(tmp_path))
    new = a.store.aligned(recs(spark, 60).groupBy("key").count())
    plan = a.rows.join(new, "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_messages_null(spark):
    df = spark.createDataFrame([(1, "i", "c", [None, None], "s", "en", 0), (2, "i", "c", msgs((None, None), ("", "")), "s", "en", 0)], PROMPT)
    assert duplicates.duplicate_pairs(df, spark.createDataFrame([], LINE)).count() == 1
