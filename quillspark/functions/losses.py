"""Targets, losses and accuracies over logits, and merges of partial softmax results; all stable for large logits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.numeric import _log_softmax_rows, _stacked, total


def lse_parts(a: Column) -> Column:
    """A chunk of logits as (largest value, sum of exponents below it), which merges in any order."""
    top = F.array_max(a)
    return F.struct(top.alias("m"), F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x).alias("s"))


def merged_lse(df: DataFrame, by: str, part: str) -> DataFrame:
    """(by, lse): log-sum-exp over all chunks of each group, each partial sum shifted to the group's maximum."""
    m = F.col(part)["m"]
    top = df.groupBy(by).agg(F.max(m).alias("_top"))
    got = df.join(top, by).groupBy(by, "_top").agg(F.sum(F.col(part)["s"] * F.exp(m - F.col("_top"))).alias("_z"))
    return got.select(by, (F.col("_top") + F.log("_z")).alias("lse"))


def merge_attention(out: Column, lse: Column, block_out: Column, block_lse: Column) -> Column:
    """Struct (out, lse) of two partial attention results over different keys. Weights come from the difference of the two
    log-sum-exps, so neither is exponentiated on its own."""
    top = F.greatest(lse, block_lse)
    both = top + F.log(F.exp(lse - top) + F.exp(block_lse - top))
    merged = F.zip_with(out, block_out, lambda x, y: x * F.exp(lse - both) + y * F.exp(block_lse - both))
    return F.struct(merged.alias("out"), both.alias("lse"))


def target_p(logits: Column, kept: tuple[int, ...], draft_mask: Column) -> Column:
    """Struct over a row of logits of the target vocabulary: p (softmax over the kept ids), p_full (their probabilities in the whole
    vocabulary), token (argmax, 0-based), and mask, 1 where the row counts and its token is kept."""
    ids = np.array(kept, dtype=np.int64)

    @F.pandas_udf("struct<p:array<double>,p_full:array<double>,token:int,mask:int>")
    def run(x: pd.Series, m: pd.Series) -> pd.DataFrame:
        p, full, token, mask = [], [], [], []
        for row, on in zip(x, m):
            v = np.asarray(row, dtype=float)
            full_log = v - v.max() - np.log(np.exp(v - v.max()).sum())
            d = v[ids]
            e = np.exp(d - d.max())
            p.append(e / e.sum())
            full.append(np.exp(full_log[ids]))
            token.append(int(v.argmax()))
            mask.append(int(bool(on) and token[-1] in known))
        return pd.DataFrame({"p": p, "p_full": full, "token": token, "mask": mask})

    known = frozenset(kept)
    return run(logits, draft_mask)


def target_from_hidden(hidden: Column, head: np.ndarray, kept: tuple[int, ...], draft_mask: Column, chunk: int = 4096) -> Column:
    """The same from hidden states and the head (vocabulary x width), chunk rows at a time: logits of the whole vocabulary exist for a
    chunk only. The head is a model's matrix, sent with the function."""
    ids, known = np.array(kept, dtype=np.int64), frozenset(kept)

    @F.pandas_udf("struct<p:array<double>,p_full:array<double>,token:int,mask:int>")
    def run(x: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(x), chunk):
            rows = np.stack([np.asarray(v, dtype=float) for v in x.iloc[at : at + chunk]]) @ head.T
            low = _log_softmax_rows(rows)
            p = np.exp(_log_softmax_rows(rows[:, ids]))
            token = rows.argmax(1)
            mask = [int(bool(on) and int(t) in known) for on, t in zip(m.iloc[at : at + chunk], token)]
            out.append(pd.DataFrame({"p": list(p), "p_full": list(np.exp(low[:, ids])), "token": token.astype(np.int32), "mask": mask}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"p": [], "p_full": [], "token": [], "mask": []})

    return run(hidden, draft_mask)


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits) at a 0-based target."""
    log = _stacked(_log_softmax_rows, "double")(logits)
    return -F.get(log, target)


def masked_soft_cross_entropy(target: Column, log_student: Column, mask: Column) -> Column:
    """An aggregate: -sum over masked places of t * s, divided by the number of all places."""
    return -F.sum(total(F.zip_with(target, log_student, lambda t, s: t * s)) * mask) / F.count(F.lit(1))


def masked_accuracy(correct: Column, mask: Column, eps: float = 1e-6, clamp: bool = False) -> Column:
    """An aggregate: share of the masked places that are correct, with eps added to the count or (clamp) as its least value."""
    n = F.sum(mask)
    return F.sum(F.when(correct, mask).otherwise(0)) / (F.greatest(n, F.lit(eps)) if clamp else n + eps)


def weighted_mean_loss(loss: Column, weight: Column, eps: float = 1e-6) -> Column:
    return F.sum(loss * weight) / (F.sum(weight) + eps)


def composite_kd(main: Column, mtp: Column, alpha: float) -> Column:
    """main + alpha * mtp where both stand and alpha is positive, else main."""
    return F.when(mtp.isNotNull(), main + alpha * mtp).otherwise(main) if alpha > 0 else main


def domino_mix(final_loss: Column, base_loss: Column, lam: float) -> Column:
    return (1 - lam) * final_loss + lam * base_loss


def mean_accept_length(length: Column, valid: Column, eps: float = 1e-6) -> Column:
    """An aggregate: accepted length and one more, on average over the valid blocks."""
    on = F.when(valid, 1.0).otherwise(0.0)
    return F.sum((length + 1.0) * on) / (F.sum(on) + eps)


def dpace_weights(prefix: Column, suffix: Column, kind: str = "dpace") -> Column:
    """Position weights by kind: the prefix products, the suffix sums, or their ratio."""
    if kind == "dpace-cumulative-confidence-only":
        return prefix
    if kind == "dpace":
        return suffix
    if kind == "dpace-continuation-value-only":
        return F.zip_with(suffix, prefix, lambda s, p: s / F.greatest(p, F.lit(2.2250738585072014e-308)))
    raise ValueError(f"unknown kind {kind!r}")
