"""String operators as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of the calibration buckets.
CODE_FENCE = r"(?i)```(?:python|py|cpp|c\+\+|c|js|javascript|ts|java|go|rust|sh|bash|html|css|sql|json)?\b"
CODE_SIGN = (
    r"(?i)(?:\bdef\s+\w+\s*\(|\bclass\s+\w+\s*[\(:]|\bimport\s+\w|\bfrom\s+\w+\s+import\b|console\.log\(|printf\(|System\.out\.println|=>\s*\{|function\s*\(|std::"
    r"|\bpublic\s+(?:static\s+)?(?:void|int|String)\b)"
)
MATH_LATEX = r"\\\(|\\\[|\\frac\{|\\sum_|\\int_|\\boxed|\$\$|\\begin\{|\\sqrt\{|\\partial"
MATH_WORDS = r"\b(solve|derive|derivative|integral|integrate|equation|prove|theorem|polynomial|matrix|probability|factorize|differentiate)\b"
SCIENCE = (
    r"\b(biology|chemistry|chemical|physics|biological|molecular|molecule|enzyme|protein|cell|organism|gene|genome|quantum|thermodynam|voltage|reaction|atom|electron|velocity|acceleration"
    r"|wavelength|clinical|diagnosis|patient|disease|engineering|circuit|torque|momentum|psycholog|cognitive)\b"
)
CHOICE = r"(?i)which of the following|\(A\)|\bOptions?:"
#: Module names that keep their precision.
KEPT_MODULES = (r".*\.linear_attn\.in_proj_a$", r".*\.linear_attn\.in_proj_b$", r".*\.linear_attn\.conv1d$", r"model\.visual\..*", r"mtp\.fc$", r"lm_head$")


def strip(c: Column) -> Column:
    """White space of any kind off both ends; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)\s+", " ")


def strip_think_blocks(c: Column) -> Column:
    """Every reasoning block out with the line breaks behind it; an unclosed one takes the rest; then left-stripped.
    Text without an opener stays as it is."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>\n*", ""), r"(?s)<think>.*$", "")
    return F.when(c.contains("<think>"), F.regexp_replace(out, r"(?U)^\s+", "")).otherwise(c)


def strip_think_eval(c: Column) -> Column:
    """Closed reasoning blocks out with the white space behind them, then stripped; unclosed ones stay."""
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""))


def flatten_think(c: Column) -> Column:
    """Reasoning and answer with a blank line between, tags gone; text before the opener is lost when both tags stand."""
    both = r"(?s)<think>(.*?)</think>(.*)$"
    join = lambda a, b: F.when(a != "", strip(F.concat(a, F.lit("\n\n"), b))).otherwise(b)
    close_at = F.instr(c, "</think>")
    head = strip(F.substring(c, F.lit(1), close_at - 1))
    tail = strip(F.substring(c, close_at + F.lit(8), F.length(c)))
    return (
        F.when(c.rlike(r"(?s)<think>.*?</think>"), join(strip(F.regexp_extract(c, both, 1)), strip(F.regexp_extract(c, both, 2))))
        .when(close_at > 0, join(head, tail))
        .otherwise(strip(F.replace(c, F.lit("<think>"), F.lit(""))))
    )


def classify_bucket(user: Column, assistant: Column) -> Column:
    """code, math, science or general, in this order of priority; words and their borders are those of any script."""
    blob = F.concat_ws("\n", F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit("")))
    low = F.lower(blob)
    u = "(?U)"
    return (
        F.when((blob.contains("```") & blob.rlike(u + CODE_FENCE)) | blob.rlike(u + CODE_SIGN), "code")
        .when(blob.rlike(MATH_LATEX) | (F.regexp_count(low, F.lit(u + MATH_WORDS)) >= 2), "math")
        .when(low.rlike(u + SCIENCE) | blob.rlike(u + CHOICE), "science")
        .otherwise("general")
    )


def words(c: Column) -> Column:
    """The plain tokenizer: runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


def first_words(c: Column, n: int) -> Column:
    """The text up to its n-th word of the plain tokenizer, white space between kept; shorter texts stay whole."""
    return F.when(F.size(words(c)) <= n, c).otherwise(F.regexp_extract(c, rf"^\s*(?:\S+\s+){{{n - 1}}}\S+", 0))


WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def word_offsets(texts: pd.Series) -> pd.Series:
    """The plain tokenizer's words: 0-based places of their first character and behind their last. In Arrow batches, as an
    array that grows word by word would be copied each time in the JVM."""
    return pd.Series([[{"s": m.start(), "e": m.end()} for m in WORD.finditer(t)] if t is not None else [] for t in texts], dtype=object)


def escape_literal(s: str) -> str:
    """A pattern that matches the text as it stands."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in s)


def spans(c: Column, header: str, stop: str, inside: bool = True) -> Column:
    """ARRAY<STRUCT<a, b>>: 0-based places from behind each header to the next stop pattern or the end of the text; the stop itself
    is part of the span if inside, else it is only looked at. header is a literal, stop a pattern."""
    h = escape_literal(header)
    pattern = rf"{h}(?:[\s\S]*?)(?:{stop}|\z)" if inside else rf"{h}(?:[\s\S]*?)(?={stop}|\z)"
    n = len(header)
    step = lambda a, m: F.struct(
        (F.call_function("locate", m, c, a["at"]) + F.length(m)).alias("at"),
        F.concat(a["out"], F.array(F.struct((F.call_function("locate", m, c, a["at"]) - 1 + n).alias("a"), (F.call_function("locate", m, c, a["at"]) - 1 + F.length(m)).alias("b")))).alias("out"),
    )
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), zero, step, lambda a: a["out"])


def strip_prefixes(name: Column, prefixes: tuple[str, ...], suffixes: tuple[str, ...] = ()) -> Column:
    """A module's name without the first of the prefixes that it has, and without the first such suffix."""
    out = name
    pre = F.lit(0)
    for p in reversed(prefixes):
        pre = F.when(name.startswith(p), len(p)).otherwise(pre)
    out = F.substring(name, pre + 1, F.length(name))
    cut = F.lit(0)
    for x in reversed(suffixes):
        cut = F.when(out.endswith(x), len(x)).otherwise(cut)
    return F.substring(out, F.lit(1), F.length(out) - cut)


def is_ignored(module: Column, prefixes: tuple[str, ...] = (), patterns: tuple[str, ...] = KEPT_MODULES) -> Column:
    """Whether a module is on an ignore list: by the beginning of its name, or by a pattern."""
    out = F.lit(False)
    for p in prefixes:
        out = out | module.startswith(p)
    for p in patterns:
        out = out | module.rlike(p)
    return out


def status_kind(status: Column) -> Column:
    """ok below 400, permanent for 4xx but 429, transient for all else and for no status at all."""
    return F.when(status.isNull(), "transient").when(status < 400, "ok").when((status < 500) & (status != 429), "permanent").otherwise("transient")


def word_id(c: Column, vocabulary: int) -> Column:
    """A stable id for a word in a hashed vocabulary."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("bigint"), F.lit(vocabulary)).cast("int")


def keeps_precision(module: Column) -> Column:
    """Whether a module's name is on the list of those left unquantised."""
    out = F.lit(False)
    for p in KEPT_MODULES:
        out = out | module.rlike(p)
    return out


def split_module(name: Column) -> tuple[Column, Column]:
    """(module, suffix) at the last dot; names without one belong to _root."""
    m = F.regexp_extract(name, r"^(.*)\.([^.]+)$", 1)
    return F.when(m != "", m).otherwise("_root"), F.when(m != "", F.regexp_extract(name, r"^(.*)\.([^.]+)$", 2)).otherwise(name)


def parse_allocation(c: Column) -> Column:
    """a=1,b=2 as a map; keys and values are stripped."""
    m = F.str_to_map(c, F.lit(","), F.lit("="))
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).cast("int").alias("value"))))


def checkpoint_place(name: Column) -> tuple[Column, Column]:
    """(epoch, step) of epoch_E or epoch_E_step_S, step 0 if missing; nulls for other names."""
    p = r"^epoch_(\d+)(?:_step_(\d+))?$"
    ok = name.rlike(p)
    step = F.regexp_extract(name, p, 2)
    return F.when(ok, F.regexp_extract(name, p, 1).cast("int")), F.when(ok, F.coalesce(F.nullif(step, F.lit("")), F.lit("0")).cast("int"))


def evaluation_route(prompt: Column) -> Column:
    """Whether a prompt takes the reasoning route: it ends with 'step by step.' or its tail asks for a letter."""
    p = F.regexp_replace(prompt, r"(?U)\s+$", "")
    return p.endswith("step by step.") | F.right(p, F.lit(30)).contains("Answer: Let")
