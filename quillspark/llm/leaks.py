"""Problem 7: passages of held-out items inside documents, by MinHash containment over windows of one size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.llm import bits

PASSAGE = 12  # words in a row that make a leak
SHINGLE = 5  # words of a shingle
SPAN = PASSAGE - SHINGLE + 1  # shingles of a passage: the size every window is cut to
HOT_SHARE = 1000  # a passage in more than one HOT_SHARE-th of the windows that pass is hot: there are fewer than HOT_SHARE
SALTS = 64  # parts that a hot passage is joined in

_GAPS = regex.compile(r"[\s\p{P}\p{C}]+")
_JOINED = regex.compile(r"[\p{P}\p{Cf}]+")


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    """Fixed odd multipliers of the shingle hash, from a congruential rule."""
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(PASSAGE):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x | 1)
    return np.array(out, dtype=np.uint64)


def words(text: str | None) -> list[str]:
    """Words with letter case, punctuation and invisible characters set aside; null has none.

    Punctuation inside white space borders nothing: "well-known" and "well known" differ only where the text is
    compared word by word, so hyphens and the like split words, as white space does, while invisible format
    characters vanish. Texts without spaces give one word for each ideograph.
    """
    if not text:
        return []
    t = text.upper().casefold()
    if not t.isascii():
        t = regex.sub(r"\p{Cf}+", "", t)
        t = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ", t)
    return _GAPS.sub(" ", t).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    f = _factors()
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for i in range(n if len(out) else 0):
        out += h[i : len(h) - n + 1 + i] * f[i]
    return _mix(out)


def sketch(all_words: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of every window of PASSAGE words: (position of the window's first word, minimum of its shingle hashes).

    owner tells which text each word is of; windows don't cross texts.
    """
    if len(all_words) < PASSAGE:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(all_words, dtype=object), categorize=True)
    g = _grams(h, SHINGLE)
    n = len(h) - PASSAGE + 1
    low = g[:n].copy()
    for i in range(1, SPAN):
        np.minimum(low, g[i : i + n], out=low)
    at = np.flatnonzero(owner[:n] == owner[PASSAGE - 1 :])
    return at, low[at]


def _windows(id_col: str, sent: Broadcast | None = None):  # noqa: ANN202
    """(id, low, words) of every distinct window of each text; with a bit map, of those whose minimum it may hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [words(t) for t in pdf["text"]]
            flat = [w for t in texts for w in t]
            owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            at, low = sketch(flat, owner)
            if sent is not None and len(at):
                on = bits.hits(sent.value, low)
                at, low = at[on], low[on]
            ids = pdf[id_col].to_numpy()
            found = {(int(ids[owner[p]]), int(m), " ".join(flat[p : p + PASSAGE])) for p, m in zip(at, low.view(np.int64))}
            yield pd.DataFrame(list(found), columns=[id_col, "low", "words"]).astype({id_col: "int64", "low": "int64"})

    return run


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_passages): documents that hold passages of an item, with the number of distinct passages.

    A MinHash of a whole document can't find twelve words among hundreds: it would need more hash functions than the
    document has shingles. So documents are cut into windows of the one size of a passage; a window and a passage of that size
    have containment 1 or are no case, and the minimum over equal shingle sets is equal, so no passage is missed.

    The items' minima go to the executors as a bit map of bounded size (bits.MOST), whatever their number; it only prunes.
    Windows that pass are verified on their words by a join with the items' passages. A passage that more than a
    HOT_SHARE-th of these windows hold is joined in SALTS parts. Null and short texts hold nothing; copies count on their
    own, and rows that share a doc_id are one document.
    """
    turns = items.filter("item_id IS NOT NULL").select("item_id", F.explode("turns").alias("text")).filter("text IS NOT NULL")
    passages = runtime.materialize(turns.mapInPandas(_windows("item_id"), "item_id BIGINT, low BIGINT, words STRING").distinct(), "leak-passages")
    sent = docs.sparkSession.sparkContext.broadcast(bits.bit_map(passages, "low"))
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    near = runtime.materialize(texts.mapInPandas(_windows("doc_id", sent), "doc_id BIGINT, low BIGINT, words STRING"), "leak-windows")
    by = near.groupBy("low", "words").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(by.filter(F.col("n") > max(SALTS, near.count() // HOT_SHARE)).select("low", "words", F.lit(True).alias("hot")))
    near = near.distinct().join(hot, ["low", "words"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("doc_id"), F.lit(SALTS))).otherwise(0)).drop("hot")
    own = passages.join(hot, ["low", "words"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return near.join(own, ["low", "words", "salt"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_passages"))


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), one row for each document and item it holds a passage of."""
    return search(docs, items).select("doc_id", "item_id")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: item_id, benchmark, n_docs, most_passages (distinct passages in the document that holds most)."""
    per = search(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_passages").alias("most_passages"))
    return per.join(items.select("item_id", "benchmark"), "item_id")
