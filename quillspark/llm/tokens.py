"""Problem 1: tokens per record under a public tokenizer, and totals per source, language and domain."""

from __future__ import annotations

import base64
import heapq
import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import runtime

#: The public pre-split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where a text is ASCII only, which the plain regex engine splits faster.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 400  # symbols from which a piece is merged with a heap
STORE = 1_000_000  # distinct pieces a task keeps counted; beyond it the store starts anew


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file: a path as given, else in the installed folder of public tokenizers."""
    if Path(name).is_file():
        return name
    spec = importlib.util.find_spec("public_tokenizers")
    at = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(at / name)


@dataclass(frozen=True)
class Merges:
    """A vocabulary as a table of merges: sorted keys left * size + right, and the joined token's rank of each."""

    size: int
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """Reads a ranks file (base64 token and rank a line) and lists every pair of tokens that joins to a token."""
    tokens = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            t, r = line.split()
            tokens[base64.b64decode(t)] = int(r)
    size = max(tokens.values()) + 1
    pairs = [
        (tokens[t[:i]] * size + tokens[t[i:]], r) for t, r in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens
    ]
    table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return Merges(size, np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int64), np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1]))


_NONE = np.int64(2**62)


def _ranks(m: Merges, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Joins adjacent pairs with the merge table; pairs without a merge get a rank above all."""
    if not len(m.keys):
        return np.full(len(left), _NONE)
    k = left * m.size + right
    j = np.minimum(np.searchsorted(m.keys, k), len(m.keys) - 1)
    return np.where(m.keys[j] == k, m.ranks[j], _NONE)


def _long_count(m: Merges, sym: np.ndarray) -> int:
    """Tokens of one long piece: the same merges in the same order, from a heap over a linked list."""
    n = len(sym)
    s = sym.tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(_ranks(m, np.array([a]), np.array([b]))[0])
        return known[a, b]

    heap = [(int(r), i, s[i], s[i + 1]) for i, r in enumerate(_ranks(m, sym[:-1], sym[1:])) if r < _NONE]
    heapq.heapify(heap)
    left = n
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i] if s[i] == a else n
        if j >= n or s[j] != b:
            continue
        s[i], s[j] = r, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        left -= 1
        for p, q in ((prv[i], i), (i, nxt[i])):
            if p >= 0 and q < n and (k := rank(s[p], s[q])) < _NONE:
                heapq.heappush(heap, (k, p, s[p], s[q]))
    return left


def count_pieces(m: Merges, pieces: list[str]) -> np.ndarray:
    """Tokens of each distinct piece: pieces as symbol arrays, adjacent pairs joined with the merge ranks, the pair of
    lowest rank of each piece merged wherever it stands, again and again until no piece has a pair to merge."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    lens = np.array([len(r) for r in raw], dtype=np.int64)
    out = lens.copy()
    flat = m.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)] if raw else np.empty(0, dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(lens)])
    for i in np.flatnonzero(lens > LONG):
        out[i] = _long_count(m, flat[start[i] : start[i + 1]])
    owner = np.repeat(np.arange(len(raw)), lens)
    keep = ((lens > 1) & (lens <= LONG))[owner] if len(raw) else np.empty(0, dtype=bool)
    sym, owner = flat[keep], owner[keep]
    while len(sym) > 1:
        r = _ranks(m, sym[:-1], sym[1:])
        r[owner[:-1] != owner[1:]] = _NONE
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        low = np.minimum.reduceat(np.append(r, _NONE), first)
        size = np.diff(np.append(first, len(sym)))
        best = np.repeat(low, size)
        go = np.append(r, _NONE) == best
        go &= best < _NONE
        at = np.flatnonzero(go)
        if not len(at):
            break
        run = np.concatenate([[True], np.diff(at) > 1])  # of overlapping pairs every other one merges, from the left
        begin = np.maximum.accumulate(np.where(run, at, 0))
        at = at[(at - begin) % 2 == 0]
        np.subtract.at(out, owner[at], 1)
        sym[at] = best[at]
        stay = low < _NONE
        keep = np.repeat(stay, size)
        keep[at + 1] = False
        sym, owner = sym[keep], owner[keep]
    return out


class PieceStore:
    """Distinct pieces already counted, kept over all batches of a task."""

    def __init__(self, merges: Merges | str, limit: int = STORE):
        self.merges, self.limit = load_merges(merges) if isinstance(merges, str) else merges, limit
        self.known: dict[str, int] = {}
        import re

        self._split, self._ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        flat: list[str] = []
        n = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                got = (self._ascii if t.isascii() else self._split).findall(t)
                n[i] = len(got)
                flat += got
        if not flat:
            return n
        codes, uniq = pd.factorize(np.array(flat, dtype=object))
        if len(self.known) + len(uniq) > self.limit:
            self.known = {}
        new = [p for p in uniq if p not in self.known]
        self.known.update(zip(new, count_pieces(self.merges, new).tolist()))
        each = np.fromiter(map(self.known.__getitem__, uniq), dtype=np.int64, count=len(uniq))[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        end = np.cumsum(n)
        return total[end] - total[end - n]


def with_tokens(df: DataFrame, texts: str, vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """df with column texts (a string, or an array of strings) replaced by the number of tokens in it.

    Nulls count 0. Texts are split and counted in Arrow batches; no text is shuffled, and totals are all that leaves.
    The vocabulary file is read by the driver only, its merges go to the executors by broadcast (a few MB, whatever the input).
    """
    sent = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary_path(vocabulary)))
    fields = [f for f in df.schema.fields if f.name != texts]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` BIGINT"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = PieceStore(sent.value)
        for b in batches:
            col = b.column(b.schema.get_field_index(texts))
            if pa.types.is_list(col.type):
                size = np.array([x or 0 for x in col.value_lengths().to_pylist()], dtype=np.int64)
                each = store.count(col.flatten().to_pylist())
                total, end = np.concatenate([[0], np.cumsum(each)]), np.cumsum(size)
                n = total[end] - total[end - size]
            else:
                n = store.count(col.to_pylist())
            rest = [b.column(b.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, type=pa.int64())], names=[*(f.name for f in fields), out])

    return df.mapInArrow(run, schema)


def language(c: Column) -> Column:
    """A language code with uneven writing and region set aside (en-US, EN and en_GB are en); blank is null."""
    t = F.regexp_extract(F.lower(F.trim(c)), r"^([\p{L}]+)", 1)
    return F.when(t != "", t)


def _slices(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "lang", "domain").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))


def prompt_tokens(prompts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(line_no, source, lang, domain, n_tokens) of each prompts row: all contents together, each split on its own."""
    return with_tokens(
        prompts.select(
            "line_no",
            F.trim("source").alias("source"),
            language(F.col("lang")).alias("lang"),
            runtime.canonical_label(F.col("category")).alias("domain"),
            F.transform("conversations", lambda m: m["content"]).alias("texts"),
        ),
        "texts",
        vocabulary,
    )


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, lang, domain, n_tokens) of each documents row."""
    cols = [F.trim("source").alias("source"), language(F.col("lang")).alias("lang"), runtime.canonical_label(F.col("doc_domain")).alias("domain"), "text"]
    return with_tokens(docs.select(*cols), "text", vocabulary)


def prompt_budget(prompts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, lang, domain, n_records, n_tokens): one row per slice, missing labels as null; no rows, no slices."""
    return _slices(prompt_tokens(prompts, vocabulary))


def document_budget(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same slices of documents, doc_domain being the domain."""
    return _slices(document_tokens(docs, vocabulary))


def totals(slices: DataFrame) -> DataFrame:
    """(by, label, n_records, n_tokens): totals by source, by lang, by domain and over all, from slices."""
    parts = [slices.select(F.lit(k).alias("by"), F.col(k).alias("label"), "n_records", "n_tokens") for k in ("source", "lang", "domain")]
    parts.append(slices.select(F.lit("all").alias("by"), F.lit(None).cast("string").alias("label"), "n_records", "n_tokens"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("by", "label").agg(F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
