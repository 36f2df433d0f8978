from __future__ import annotations

from llm_rows import DOC
from pyspark.sql import functions as F

from quillspark.llm import leaks
from quillspark.runtime import table

ITEM = "item_id BIGINT, benchmark STRING, turns ARRAY<STRING>"


def brute(docs, items):
    known = {}
    for i in items.collect():
        for t in i["turns"] or []:
            w = leaks.words(t)
            for k in range(len(w) - 11):
                known.setdefault(" ".join(w[k : k + 12]), set()).add(i["item_id"])
    out = set()
    for d in docs.collect():
        w = leaks.words(d["text"])
        for k in range(len(w) - 11):
            out |= {(d["doc_id"], i) for i in known.get(" ".join(w[k : k + 12]), ())}
    return out


def test_against_brute_force(spark, sf):
    docs, items = table(spark, sf.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf, "bench_turns")
    want = brute(docs, items)
    assert want and {tuple(r) for r in leaks.leaked(docs, items).collect()} == want


def test_cases(spark):
    w = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, "b", [" ".join(w[:20]), None]), (2, "b", ["short one"]), (3, "b", None), (4, "b", [" ".join(w[:20])]), (5, "b", ["汉" * 3 + "语文字词句段落章节书"])], ITEM)
    rows = [
        (1, "x " + " ".join(w[3:15]).upper() + " y"), (2, " ".join(w[3:14])), (3, None), (4, ""), (5, ",\n".join(w[8:20]) + "!"), (5, ",\n".join(w[8:20]) + "!"), (6, " ".join(w[:6]) + " gap " + " ".join(w[6:14])),
        (7, "前 汉汉汉语文字词句段落章节书。"), (8, "z " * 200_000 + " ".join(w[:12])), (None, " ".join(w)),
    ]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC).withColumn("item_id", F.lit("clash"))
    assert {tuple(r) for r in leaks.leaked(docs, items).collect()} == {(1, 1), (1, 4), (5, 1), (5, 4), (7, 5), (8, 1), (8, 4)}
    assert leaks.leaked(docs.limit(0), items).count() == 0 and leaks.leaked(docs, items.limit(0)).count() == 0
    assert {r["item_id"]: r["n_docs"] for r in leaks.report(docs, items).collect()} == {1: 3, 4: 3, 5: 1}


def test_hot_passages_and_full_bit_map(spark, monkeypatch):
    """A passage that most documents hold is joined in parts, and a bit map that lets everything through changes nothing."""
    w = [f"w{i}" for i in range(14)]
    items = spark.createDataFrame([(k, "b", [" ".join(w[:13])]) for k in range(3)] + [(9, "b", [" ".join(w)])], ITEM)
    rows = [(i, f"n{i} " + " ".join(w[: 12 + i % 3]), None, None, None) for i in range(90)] + [(5, " ".join(w[1:]) + " z", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    want = {(r["doc_id"], r["item_id"], r["n_passages"]) for r in leaks.search(docs, items).collect()}
    n = {0: 1, 1: 2, 2: 3}
    assert want == {(i, k, 3 if i == 5 and k == 9 else 2 if i == 5 else min(n[i % 3], 2 if k < 9 else 3)) for i in range(90) for k in (0, 1, 2, 9)}
    monkeypatch.setattr(leaks, "SALTS", 4)
    monkeypatch.setattr(leaks, "HOT_SHARE", 50)
    monkeypatch.setattr(leaks.bits, "hits", lambda b, h: leaks.np.ones(len(h), dtype=bool))
    assert {(r["doc_id"], r["item_id"], r["n_passages"]) for r in leaks.search(docs, items).collect()} == want
