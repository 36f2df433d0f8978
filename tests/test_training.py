from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chat, text
from quillspark.operators import training
from quillspark.plans import training_queries
from quillspark.runtime import table
from quillspark.sources import readers, sinks
from quillspark.streaming import generate

JAVA_SPACE = r"[^ \t\n\x0b\f\r]+"


def test_harmony_mask_against_brute_force(spark, sf):
    p = training.PARSERS["harmony"]
    c = table(spark, sf, "regen").filter("conversations IS NOT NULL").select("resp_id", chat.normal_roles(F.col("conversations")).alias("c"))
    want = {}
    for r in c.select("resp_id", p.render(F.col("c")).alias("t")).collect():
        t = r["t"]
        at = [m.span(1) for m in re.finditer(r"<\|start\|>assistant([\s\S]*?)(?=<\|start\|>user<\|message\|>|$)", t)]
        if t:
            w = [m.span() for m in re.finditer(JAVA_SPACE, t)]
            want[r["resp_id"]] = (len(w), sum(any(a <= s and e <= b for a, b in at) for s, e in w))
    assert {r["resp_id"]: (r["n"], r["on_tokens"]) for r in training_queries.loss_mask_harmony(spark, sf).collect()} == want


def test_calibration_against_a_scan(spark, sf):
    """The order-free form gives the rows of a scan that takes the first different users of each bucket."""
    rows = table(spark, sf, "regen")
    c = training.calibration_candidates(rows, "resp_id", "conversations", cap=150, scan=120)
    got = c.collect()
    assert max(r["resp_id"] for r in got) <= sorted(r[0] for r in rows.select("resp_id").collect())[119]
    target = {"code": 2, "general": 5, "math": 2, "science": 3}
    seen, by = set(), {}
    for r in sorted(got, key=lambda r: r["resp_id"]):
        if r["kept"] and r["user_md5"] not in seen:
            seen.add(r["user_md5"])
            by.setdefault(r["bucket"], []).append(r["resp_id"])
    h = lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest()
    want = {i for k, n in target.items() for i in sorted(by.get(k, [])[: n * 3], key=h)[:n]}
    chosen = training.calibration_set(c, "resp_id", target)
    assert {r["resp_id"] for r in chosen.collect()} == want and [r["resp_id"] for r in chosen.orderBy("rank").collect()] == sorted(want, key=h)
    s = {r["bucket"]: (r["actual"], r["shortfall"]) for r in training.calibration_summary(c, chosen, target).collect()}
    assert all(a + b == target[k] for k, (a, b) in s.items())
    assert training.mix_targets("eval") == {"science": 384, "general": 384, "math": 128, "code": 128} and training.mix_targets("balanced", 100)["math"] == 128


def test_spans_and_offsets(spark):
    t = "a <H>one two<E> b <H>three"
    df = spark.createDataFrame([(t,), ("",), ("no",)], "t STRING")
    r = df.select(text.spans(F.col("t"), "<H>", "<E>").alias("in"), text.spans(F.col("t"), "<H>", "<E>", False).alias("out"), text.word_offsets("t").alias("w")).collect()
    assert [t[x["a"] : x["b"]] for x in r[0]["in"]] == ["one two<E>", "three"] and [t[x["a"] : x["b"]] for x in r[0]["out"]] == ["one two", "three"]
    assert [t[x["s"] : x["e"]] for x in r[0]["w"]] == t.split() and r[1]["in"] == [] and r[1]["w"] == []
    assert spark.range(1).select(text.first_words(F.lit(" a  b\nc d"), 3)).first()[0] == " a  b\nc"


def test_preprocessing(spark):
    msg = lambda *x: [{"role": r, "content": c} for r, c in x]
    rows = [(1, msg(("user", "q"), ("assistant", "a b"), ("user", "r"), ("assistant", "c"))), (2, []), (3, None), (4, msg(("assistant", "x"))), (5, msg(("user", None), ("assistant", None)))]
    df = spark.createDataFrame(rows, "k INT, c ARRAY<STRUCT<role: STRING, content: STRING>>").withColumn("input_ids", F.lit("clash"))
    n = lambda last: {r["k"]: (len(r["input_ids"]), sum(r["loss_mask"]), sum(r["attention_mask"])) for r in training.preprocess(df, "c", "chatml", 100, keep=["k"], last_only=last).collect()}
    assert n(False) == {1: (11, 5, 11), 5: (6, 3, 6)} and n(True)[1] == (11, 3, 11)
    cut = training.preprocess(df, "c", "chatml", 100, longest=4, keep=["k"]).collect()
    assert all(len(r["input_ids"]) <= 4 and r["loss_mask"][-1] == 0 for r in cut)
    assert training.build_dataset(df.limit(0), "c", "k", "chatml", 100).count() == 0
    with pytest.raises(ValueError):
        training.preprocess(df, "c", "nobody", 100)


def test_tools_in_the_system_turn(spark):
    c = F.array(chat.message("system", F.lit(" be kind ")), chat.message("user", F.lit("q")))
    t = spark.range(1).select(chat.render_chatml(c, tools=F.array(F.lit('{"name": "f"}'))).alias("a"), chat.render_chatml(c, tools=F.array().cast("array<string>")).alias("b"), chat.render_chatml(c).alias("c")).first()
    assert t["a"].startswith("<|im_start|>system\n# Tools") and '<tools>\n{"name": "f"}\n</tools>' in t["a"] and t["a"].endswith("</IMPORTANT>\n\nbe kind<|im_end|>\n<|im_start|>user\nq<|im_end|>\n")
    assert t["b"] == t["c"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"


def test_append_sink(spark, tmp_path):
    """Batches by number are written once, rows without an id too; a failed batch is written over."""
    at = str(tmp_path / "sink")
    df = lambda *x: spark.createDataFrame([(a, a or "-") for a in x], "id STRING, v STRING")
    assert sinks.append_new(df("a", "a", None), at, batch=0) == 2
    assert sinks.append_new(df("a", "a", None), at, batch=0) == 0
    (tmp_path / "sink" / "part=00000001").mkdir()
    (tmp_path / "sink" / "part=00000001" / "x.json").write_text('{"id": "lost"}')
    assert sinks.append_new(df("a", "b", None), at, batch=1) == 2
    assert sorted(r["id"] or "" for r in spark.read.json(at).select("id").collect()) == ["", "", "a", "b"]
    assert {r["id"] for r in sinks.AppendSink(spark, at).done().collect()} == {"a", "b"}
    assert sinks.append_new(df().limit(0), at) == 0


def test_sinks_of_a_run(spark, tmp_path):
    df = spark.range(9).withColumn("b", F.col("id") % 2)
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy(F.desc("id")).repartition(3)) != sinks.content_digest(df.filter("id > 0"))
    m = sinks.run_meta(spark, {"b": 1, "a": [2]}, df).first()
    assert m["args"] == '{"a": [2], "b": 1}' and len(m["data_sha"]) == 16 and m["pyspark"].startswith("4")
    for k in (1, 0):
        sinks.log_step(spark, str(tmp_path / "log"), k, sinks.metrics_row("train", 0.5, 0.25, 1e-3))
    assert {(r["step"], r["name"]) for r in sinks.steps(spark, str(tmp_path / "log")).collect()} == {(k, n) for k in (0, 1) for n in ("train/loss", "train/accuracy", "lr")}
    sinks.write_eval(spark.createDataFrame([("mmlu", 0.5)], "task STRING, score DOUBLE"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first()["score"] == 0.5
    counts = spark.createDataFrame([(3, 5), (7, 9)], "id INT, cnt BIGINT")
    d2t, t2d = sinks.cached_vocabulary(lambda: counts, spark, str(tmp_path / "v"), 2, 10, "x")
    again, _ = sinks.cached_vocabulary(lambda: 1 / 0, spark, str(tmp_path / "v"), 2, 10, "x")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, d2t.collect())) == [(0, 3), (1, 6)] and t2d.filter("kept").count() == 2
    meta = sinks.pack_meta(spark.createDataFrame([("train", 5), ("train", 0)], "split STRING, n_tokens INT"), 4, 1, 0, df, 3).first()
    assert (meta["n_kept"], meta["n_chunks"], meta["seed"]) == (1, 2, 3) and len(meta["input_sha256"]) == 64


def test_readers(spark, tmp_path):
    base = {"a": {"b": [1]}}
    readers.deep_merge(base, {})["a"]["b"].append(2)
    assert base == {"a": {"b": [1]}}
    (tmp_path / "t.jinja").write_text("body")
    assert readers.resolve_template("default") is None and readers.resolve_template(str(tmp_path / "t.jinja")) == "body" and readers.resolve_template("{{ x }}") == "{{ x }}"
    with pytest.warns(UserWarning):
        assert readers.exclude_ids(spark, [str(tmp_path / "none")]).count() == 0
    with pytest.raises(ValueError):
        readers.benchmark_prompts(spark, "nobody", lambda: None, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path / "*.parquet"), ["a"])


def test_generation(spark):
    p = spark.createDataFrame([("Answer: Let",), (None,), ("q",)], "prompt STRING")
    got = generate.generate_until(p, lambda x, on: [f"<think>t</think> {t}-{o}" for t, o in zip(x, on)]).collect()
    assert [r["answer"] for r in got] == ["Answer: Let-True", None, "q-False"]
    assert {r["endpoint"] for r in generate.spread(p.repartition(3), ["a", "b"]).collect()} <= {"a", "b"}


def test_stream_deduplication(spark, tmp_path):
    from pyspark.sql.streaming import StreamingQuery  # noqa: F401

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"k": "x", "t": "2024-01-01T00:00:00"}\n{"k": "x", "t": "2024-01-01T00:00:05"}\n{"k": "y", "t": "2024-01-01T00:00:01"}\n')
    stream = spark.readStream.schema("k STRING, t TIMESTAMP").json(str(src))
    q = generate.dedup_stream(stream, "k", "t", "1 minute").writeStream.format("memory").queryName("seen_once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and spark.table("seen_once").count() == 2


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from quillspark import runtime

    class Conf:
        def get(self, k, d=None):
            return {"spark.master": "spark://host:7077"}.get(k, d)

    class Sc:
        class _jsc:
            @staticmethod
            def sc():
                class X:
                    @staticmethod
                    def getCheckpointDir():
                        class N:
                            @staticmethod
                            def isDefined():
                                return False

                        return N

                return X

    fake = type("S", (), {"conf": Conf(), "sparkContext": Sc})
    with pytest.raises(RuntimeError):
        runtime.shared_dir(fake)
