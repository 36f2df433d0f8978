"""Branches that the tables never reach, on literal rows."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.functions import chat, numeric, text
from quillspark.operators import select, stats, tokens
from quillspark.sources import readers, sinks
from quillspark.streaming import generate

CONV = "array<struct<role:string,content:string>>"


def one(spark, value, kind, f):
    """f of a column that holds one value of a type."""
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


def conv(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def plain(rows):
    return None if rows is None else [(r["role"], r["content"]) for r in rows]


SYS = ("system", chat.DEFAULT_SYSTEM)


@pytest.mark.parametrize(
    "turns, want",
    [
        ([], None),
        ([("assistant", "a")], None),
        ([("system", " "), ("user", "u")], [SYS, ("user", "u")]),
        ([("user", "u"), ("system", ""), ("user", "v")], [SYS, ("user", "u"), ("user", "v")]),
        ([("user", "u")], [SYS, ("user", "u")]),
        ([("system", "s"), ("user", "u"), ("assistant", "a"), ("assistant", "b")], [("system", "s"), ("user", "u")]),
    ],
)
def test_to_prompt(spark, turns, want):
    assert plain(one(spark, conv(*turns), CONV, chat.to_prompt)) == want


def test_seed_messages(spark):
    got = one(spark, conv(("human", "q"), ("gpt", "a"), ("tool", "t"), ("system", None), ("user", " ")), CONV, chat.seed_messages)
    assert plain(got) == [("user", "q")]
    assert one(spark, conv(("gpt", "a")), CONV, chat.seed_messages) is None


def test_training_messages(spark):
    f = lambda *t: plain(one(spark, conv(*t), CONV, chat.training_messages))
    assert f(("human", "q"), ("gpt", "<think>x</think>\n\ny")) == [("user", "q"), ("assistant", "y")]
    assert f(("human", "q"), ("gpt", "<think>x</think>")) is None
    assert f(("human", "q")) is None


def test_valid_prefix(spark):
    f = lambda *t: [r for r, _ in plain(one(spark, conv(*((r, "x") for r in t)), CONV, chat.valid_prefix))]
    assert f("assistant", "user") == []
    assert f("user", "tool") == ["user"]
    assert f("user", "assistant", "assistant") == ["user", "assistant"]
    assert f("system", "user", "assistant", "tool", "tool", "assistant") == ["system", "user", "assistant", "tool", "tool", "assistant"]


def test_reject_reason(spark):
    f = lambda *t: one(spark, conv(*t), CONV, chat.reject_reason)
    assert (f(), f(("tool", "x")), f(("user", None)), f(("user", "x")), f(("assistant", "x"))) == ("empty", "bad_role", "null_content", "not_assistant_last", None)


@pytest.mark.parametrize(
    "value, flat, blocks, strict",
    [
        ("pre<think>r</think>\n a ", "r\n\na", "pre a ", "prea"),
        ("r</think> a", "r\n\na", "r</think> a", "r</think> a"),
        ("<think>r", "r", "", "<think>r"),
        ("a", "a", "a", "a"),
        ("<think> </think>a", "a", "a", "a"),
        ("</think>x<think>y", "x<think>y", "</think>x", "</think>x<think>y"),
        ("<think>1</think>a<think>2</think>\n\nb", "1\n\na<think>2</think>\n\nb", "ab", "ab"),
    ],
)
def test_think(spark, value, flat, blocks, strict):
    assert one(spark, value, "string", text.flatten_think) == flat
    assert one(spark, value, "string", text.strip_think_blocks) == blocks
    assert one(spark, value, "string", text.strip_think_eval) == strict


@pytest.mark.parametrize(
    "value, want",
    [("```py\nx```", "code"), ("def f(x)", "code"), ("\\frac{1}{2}", "math"), ("solve it", "general"), ("solve the equation", "math"), ("a cell", "science"), ("Options: a", "science"), ("def f( \\frac{", "code")],
)
def test_classify(spark, value, want):
    assert one(spark, value, "string", lambda c: text.classify_bucket(c, F.lit(None).cast("string"))) == want


def test_render_chatml(spark):
    got = one(spark, conv(("system", "s"), ("user", "q"), ("assistant", "<think>\nw\n</think>\n\na"), ("user", "r"), ("assistant", "<think>\nv\n</think>\n\nb")), CONV, chat.render_chatml)
    assert got == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nr<|im_end|>\n<|im_start|>assistant\n<think>\nv\n</think>\n\nb<|im_end|>\n"
    assert one(spark, conv(("user", "q"), ("system", "s")), CONV, chat.render_chatml) is None
    assert one(spark, conv(("assistant", "q")), CONV, chat.render_chatml) is None


def test_channels(spark):
    f = lambda v: [(x["channel"], x["message"]) for x in one(spark, v, "string", chat.split_channels)]
    assert f("no tags") == [("text", "no tags")]
    assert f("<|channel|> a <|message|> x <|end|><|channel|>b<|message|>y<|end|>") == [("a", "x"), ("b", "y")]


def test_route(spark):
    f = lambda v: tuple(one(spark, v, "string", chat.route_request))
    assert f('{"prompt": "x"}') == ("/v1/completions", None)
    assert f('{"messages": [], "thinking": true}') == ("/v1/chat/completions", "true")
    assert f('{"messages": [{}]}') == ("/v1/chat/completions", "false")
    assert f('{"messages": [], "thinking": false, "chat_template_kwargs": {"enable_thinking": true}}') == ("/v1/chat/completions", "true")
    assert f("{broken") == f("") == f("[1]") == ("/v1/completions", None)


def test_templates():
    t = chat.Templates()
    t.register(chat.Template("a", "", "", ""))
    with pytest.raises(ValueError):
        t.register(chat.Template("a", "", "", ""))
    t.register(chat.Template("a", "u", "", ""), override=True)
    assert t.get("a").user == "u"


@pytest.mark.parametrize("n, p50, p95", [(1, 0, 0), (2, 1, 1), (4, 2, 3), (20, 10, 19)])
def test_index_percentiles(spark, n, p50, p95):
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    assert tuple(stats.index_percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).first())[1:] == (p50, p95)


def test_gates(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "task STRING, threshold DOUBLE")
    s = spark.createDataFrame([("a", 1.0), ("b", None)], "task STRING, score DOUBLE")
    g = stats.gates(s, t)
    assert {r["task"]: r["passed"] for r in g.collect()} == {"a": True, "b": False, "c": False}
    assert stats.all_passed(g.limit(0)).first()["all_passed"] is True


@pytest.mark.parametrize("lengths", [[], [3], [7, 7], [1, 2, 3, 30, 0, 5]])
def test_pack(spark, lengths):
    df = spark.createDataFrame([(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate(lengths)], "k INT, ids ARRAY<INT>")
    got = sorted(tokens.pack_sequences(df, "k", "ids", 8, -1, -2).collect(), key=lambda r: r["chunk_id"])
    flat = [t for i, n in enumerate(lengths) for t in [*range(100 * i, 100 * i + n), -1]]
    assert [t for r in got for t in r["input_ids"][: r["n_tokens"]]] == flat
    assert all(len(r["input_ids"]) == 8 for r in got) and (not got or set(got[-1]["input_ids"][got[-1]["n_tokens"] :]) <= {-2})


def test_vocab(spark):
    counts = spark.createDataFrame([(5, 3), (2, 3), (9, 1)], "id INT, cnt BIGINT")
    assert [r["id"] for r in tokens.draft_vocabulary(counts, 2).collect()] == [2, 5]
    assert [r["id"] for r in tokens.draft_vocabulary(counts, 5).collect()] == [2, 5, 9, 0, 1]
    d, t = tokens.vocab_mapping(counts, 5, 12)
    assert tokens.mapping_faults(d, t).count() == 0 and t.filter("kept").count() == 5
    assert tokens.coverage(counts.limit(0), 3).first()["coverage"] == 0


def test_int4(spark):
    rng = np.random.default_rng(0)
    v = [[0.0] * 32, [*map(float, rng.normal(size=37))], [7.0, -8.0, 3.5, 2.5, 0.5, -0.5, 1.5, -7.0]]
    df = spark.createDataFrame([(x,) for x in v], "v ARRAY<DOUBLE>").withColumn("q", numeric.int4_codes(F.col("v"), 32))
    df = df.withColumn("p", numeric.pack_int4(F.col("q"))).withColumn("u", numeric.unpack_int4(F.col("p"), F.size("q")))
    for r in df.collect():
        assert list(r["q"]) == list(r["u"]) and all(-8 <= x <= 7 for x in r["q"])
    assert list(df.collect()[2]["q"]) == [6, -7, 3, 2, 0, 0, 1, -6]


def test_gptq_and_hessian(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 16))
    x[:, 3] = 0
    w = rng.normal(size=(8, 16))
    df = spark.createDataFrame([("m", i, list(map(float, w[i]))) for i in range(8)], "module STRING, row_idx INT, v ARRAY<DOUBLE>")
    inputs = spark.createDataFrame([("m", list(map(float, r))) for r in x], "module STRING, x ARRAY<DOUBLE>")
    got = numeric.gptq(df, inputs, 8).toPandas()
    q = np.stack([np.array(c) * np.repeat(s, 8) for c, s in zip(got["codes"], got["scales"])])
    assert (np.stack(got["codes"])[:, 3] == 0).all()
    rtn = np.rint(w / np.repeat(np.abs(w.reshape(8, 2, 8)).max(2) / 7, 8, axis=1)) * np.repeat(np.abs(w.reshape(8, 2, 8)).max(2) / 7, 8, axis=1)
    assert (((q - w) @ x.T) ** 2).sum() < (((rtn - w) @ x.T) ** 2).sum()
    h = {(r["i"], r["j"]): r["h"] for r in numeric.hessian(spark.createDataFrame([(list(map(float, r)),) for r in x], "v ARRAY<DOUBLE>"), "v").collect()}
    np.testing.assert_allclose([[h[i, j] for j in range(16)] for i in range(16)], 2 / 64 * x.T @ x, atol=1e-9)


def test_softmax(spark):
    v = [1.0, 2.0, 2.0]
    assert abs(sum(one(spark, v, "array<double>", numeric.softmax)) - 1) < 1e-12
    assert one(spark, v, "array<double>", numeric.argmax) == 1
    assert one(spark, None, "array<double>", numeric.softmax) is None


def test_accept_length(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 2], [9, 2]), ([1, 2, 3, 4], [1, 2, 9, 4]), ([], [])], "a ARRAY<INT>, b ARRAY<INT>")
    assert [r[0] for r in df.select(tokens.accept_length(F.col("a"), F.col("b"))).collect()] == [3, 0, 2, 0]


def test_metric_text(spark):
    lines = spark.createDataFrame([('a_total{x="1"} 2',), ("a_total 3",), ("a_total_created 9",), ("b 1",)], "line STRING")
    assert readers.metric(lines, "a_total").first()["total"] == 5
    assert readers.metric(lines, "c").first()["total"] is None


def test_counters(spark):
    c = spark.createDataFrame([("before", 1, 1), ("after", 1, 1)], "snapshot STRING, drafts BIGINT, accepted BIGINT")
    assert stats.acceptance_from_counters(c).first()["mal"] is None


def test_checkpoints(spark):
    names = spark.createDataFrame([(x,) for x in ("epoch_2", "epoch_2_step_10", "epoch_10_step_1", "junk", "epoch_x")], "name STRING")
    assert tuple(sinks.latest_checkpoint(names).first()) == ("epoch_10_step_1", 10, 1)
    assert sinks.latest_checkpoint(names.limit(0)).count() == 0


def test_kth_smallest(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("h"))
    want = sorted(r["h"] for r in df.collect())
    for k in (1, 7, 2500, 5000):
        assert runtime.kth_smallest(df, "h", k, step=1, leaf=10) == want[k - 1]
    assert runtime.kth_smallest(df, "h", 0) is None and runtime.kth_smallest(df, "h", 9999) == want[-1] and runtime.kth_smallest(df.limit(0), "h", 1) is None


def test_splits_and_positions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = select.train_val(df, "k", 0.1)
    assert s.filter("split = 'val'").count() == 100 and s.count() == 1000
    assert {(r["k"], r["position"]) for r in select.global_position(df, "k").collect()} == {(i, i) for i in range(1000)}
    assert {(r["k"], r["before"]) for r in select.running_total(df, "k", "k").collect()} == {(i, i * (i - 1) // 2) for i in range(1000)}
    assert select.shard(df.limit(10), "k", 4, drop_last=True).count() == 8
    assert select.train_val(df.limit(0), "k", 0.1).count() == 0
    a, b = ({r["k"] for r in select.sample_limit(df, "k", n).collect()} for n in (10, 20))
    assert len(a) == 10 and a < b


def test_null_ids(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "id STRING, x INT")
    ids = spark.createDataFrame([("a",), (None,)], "id STRING")
    assert {r["x"] for r in select.without(df, ids).collect()} == {1, 3}
    assert {r["x"] for r in select.within(df, ids).collect()} == {2}


def test_files_and_resume(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    rows = [{"id": str(i), "category": "c", "conversations": [{"role": "user", "content": f"q{i}"}]} for i in range(5)] + [{"id": "x", "conversations": [{"role": "assistant", "content": "a"}]}]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n\n")
    assert readers.json_lines(spark, str(src), "id STRING").count() == 6
    for _ in range(2):
        q = generate.run(spark, str(src), sink, str(tmp_path / f"cp{_}"))
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.json(sink)
    assert got.count() == 5 and got.select("id").distinct().count() == 5
    assert readers.done_ids(spark, str(tmp_path / "none")).count() == 0
    assert readers.local_files(spark, str(src), ".json").count() == 1
    sinks.write_packed(spark.createDataFrame([("val", 1), ("train", 2)], "split STRING, x INT"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("split = 'val'").count() == 1
    made = []
    for _ in range(2):
        assert sinks.cached(lambda: made.append(1) or spark.range(3), spark, str(tmp_path), "d", 1).count() == 3
    assert made == [1]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 2}}')
    assert readers.load_config({"a": {"b": 1, "c": 3}}, str(tmp_path / "c.json")) == {"a": {"b": 2, "c": 3}}
    assert readers.load_config({"a": 1}, None) == {"a": 1}
    assert readers.shard_paths("d", "x", 2)[1] == "d/x-00001-of-00002.parquet"


def test_layers_and_anchors(spark):
    f = lambda c: list(spark.range(1).select(c).first()[0])
    assert f(tokens.spread_layers(32, 5)) == [1, 8, 15, 22, 29] and f(tokens.spread_layers(32, 1)) == [16]
    assert f(tokens.anchors(F.lit(3), F.lit(3), 4)) == [] and f(tokens.anchors(F.lit(2), F.lit(3), 4)) == [2]


def test_alloc_and_modules(spark):
    assert one(spark, "a=1, b = 2", "string", text.parse_allocation) == {"a": 1, "b": 2}
    names = ["m.linear_attn.in_proj_a", "model.visual.x", "mtp.fc", "lm_head", "m.mlp.up_proj", "mtp.fc.x"]
    assert [one(spark, n, "string", text.keeps_precision) for n in names] == [True, True, True, True, False, False]


def test_split_by_lengths_covers_all_rows(spark, tmp_path):
    """Rows from position 1,000,000 on fall to the last piece."""
    from pyspark.sql import functions as F

    from quillspark.plans import registry

    spark.range(1_000_100).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["split_by_lengths"](spark, str(tmp_path)).groupBy("index").count().collect()
    assert {r["index"]: r["count"] for r in got} == {0: 100, 1: 250, 2: 999_750}
