from __future__ import annotations

import base64

import pytest
import tiktoken
from llm_rows import DOC, PROMPT, msgs, prompt
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import tokens

PATH = tokens.vocabulary_path()
RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
ENC = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_library(texts):
    assert tokens.PieceStore(PATH).count(texts).tolist() == [len(ENC.encode_ordinary(t)) for t in texts]


def test_long_and_odd_texts():
    odd = ["a" * 5000, " " * 3000 + "x", "ab" * 900, "中文" * 400, None, "", "\n\n \t x", "don't we'll 'Sx ½ ²", "<|endoftext|>"]
    assert tokens.PieceStore(PATH, limit=3).count(odd).tolist() == [len(ENC.encode_ordinary(t)) if t else 0 for t in odd]


def test_budget(spark):
    rows = [prompt(1, "hello world"), prompt(2, None), (3, None, None, None, None, "EN", None), (4, "i", "C ", msgs(("system", "a"), ("user", "b")), "s", "en_US", 1), prompt(1, "hello world")]
    df = spark.createDataFrame(rows, PROMPT).withColumn("n_tokens", F.lit("clash")).withColumn("texts", F.lit(1))
    got = {(r["source"], r["lang"], r["domain"]): (r["n_records"], r["n_tokens"]) for r in tokens.prompt_budget(df).collect()}
    n = {t: len(ENC.encode_ordinary(t)) for t in ("hello world", "a", "b")}
    assert got == {("s", "en", "c"): (4, 2 * n["hello world"] + n["a"] + n["b"]), (None, "en", None): (1, 0)}
    assert tokens.prompt_budget(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "hello world", None, None, None), (2, None, "de-AT", "w", "chat")], DOC)
    slices = tokens.document_budget(docs)
    assert slices.agg(F.sum("n_tokens")).first()[0] == n["hello world"]
    assert {(r["by"], r["label"], r["n_tokens"]) for r in tokens.totals(slices).collect() if r["by"] in ("all", "lang")} == {("all", None, n["hello world"]), ("lang", None, n["hello world"]), ("lang", "de", 0)}


@pytest.mark.parametrize("code, want", [("EN", "en"), ("en-US", "en"), (" fr_FR", "fr"), ("zh-Hans", "zh"), ("", None), (None, None)])
def test_language(spark, code, want):
    assert spark.createDataFrame([(code,)], "c STRING").select(tokens.language(F.col("c"))).first()[0] == want
