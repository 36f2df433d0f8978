"""Kernels over ARRAY<DOUBLE>: quantisation to four bits, softmax, divergences, acceptance, weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def groups(a: Column, size: int) -> Column:
    """An array cut into groups of size, the last one shorter if it must be."""
    n = F.ceil(F.size(a) / size).cast("int")
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda g: F.slice(a, g * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def absmax(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def _rows(f: Callable[..., list[np.ndarray | None]], kind: str) -> Callable[..., Column]:
    """A function of numpy rows as a pandas UDF: lambdas over arrays are interpreted and would compute what a whole
    row shares once for each element. A null row gives null."""
    def one(*rows: object) -> np.ndarray | None:
        return None if any(x is None for x in rows) else f(*(np.asarray(x) for x in rows))

    @F.pandas_udf(f"array<{kind}>")
    def udf1(a: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in a], dtype=object)

    @F.pandas_udf(f"array<{kind}>")
    def udf2(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return lambda *c: (udf1 if len(c) == 1 else udf2)(*c)


def _stacked(f: Callable[[np.ndarray], np.ndarray], kind: str) -> Callable[[Column], Column]:
    """A function of matrices as a pandas UDF over rows: rows of equal length are stacked, so numpy runs once for each length
    in a batch. A null row gives null."""

    @F.pandas_udf(f"array<{kind}>")
    def run(a: pd.Series) -> pd.Series:
        out = np.empty(len(a), dtype=object)
        size = np.array([-1 if x is None else len(x) for x in a])
        rows = a.to_numpy()
        for n in np.unique(size[size >= 0]):
            at = np.flatnonzero(size == n)
            got = f(np.stack([np.asarray(rows[i]) for i in at]))
            for i, row in zip(at, got):
                out[i] = row
        return pd.Series(out)

    return run


def _np_scales(v: np.ndarray, size: int, floor: float) -> np.ndarray:
    if not v.shape[1]:
        return np.empty((len(v), 0))
    return np.maximum(np.maximum.reduceat(np.abs(v), np.arange(0, v.shape[1], size), axis=1) / 7, floor)


def _np_bf16(x: np.ndarray) -> np.ndarray:
    """x rounded to the nearest value of an 8-bit mantissa, halves to even."""
    out = np.zeros_like(x, dtype=float)
    on = x != 0
    unit = 2.0 ** (np.floor(np.log2(np.abs(x[on]))) - 7)
    out[on] = np.rint(x[on] / unit) * unit
    return out


def int4_codes(a: Column, size: int, floor: float = 1e-30) -> Column:
    """Codes -8..7 of each group by absmax / 7, halves to even; the last group may be shorter."""
    return _stacked(lambda v: np.clip(np.rint(v / np.repeat(_np_scales(v, size, floor), size, axis=1)[:, : v.shape[1]]), -8, 7).astype(np.int32), "int")(a)


def int4_scales(a: Column, size: int, floor: float = 1e-30) -> Column:
    return _stacked(lambda v: _np_scales(v, size, floor), "double")(a)


def dequantize(codes: Column, scales: Column, size: int) -> Column:
    """Codes times their group's scale, the scale rounded to eight bits of mantissa as it is stored."""
    return _rows(lambda q, s: q * np.repeat(_np_bf16(s), size)[: len(q)], "double")(codes, scales)


def _np_pack(q: np.ndarray) -> np.ndarray:
    n = -(-q.shape[1] // 8) * 8
    u = np.zeros((len(q), n), dtype=np.uint32)
    u[:, : q.shape[1]] = (q + 8).astype(np.uint32)
    return np.bitwise_or.reduce(u.reshape(len(q), -1, 8) << np.arange(0, 32, 4, dtype=np.uint32), axis=2).view(np.int32)


def pack_int4(codes: Column) -> Column:
    """Eight codes to a 32-bit integer, the first lowest; missing ones at the end are stored as -8, that is 0 bits."""
    return _stacked(_np_pack, "int")(codes)


def unpack_int4(words: Column, n: Column) -> Column:
    """The first n codes of packed words."""
    def row(w: np.ndarray, n: np.ndarray) -> np.ndarray:
        u = w.astype(np.int32).view(np.uint32)
        return (((u[:, None] >> np.arange(0, 32, 4, dtype=np.uint32)) & 15).astype(np.int32) - 8).ravel()[: int(n)]

    return _rows(row, "int")(words, n)


def _log_softmax_rows(v: np.ndarray) -> np.ndarray:
    if not v.shape[1]:
        return v.astype(float)
    low = v - v.max(1, keepdims=True)
    return low - np.log(np.exp(low).sum(1, keepdims=True))


def log_softmax(a: Column) -> Column:
    return _stacked(_log_softmax_rows, "double")(a)


def softmax(a: Column) -> Column:
    return _stacked(lambda v: np.exp(_log_softmax_rows(v)), "double")(a)


def kl_divergence(target: Column, log_student: Column) -> Column:
    """Sum of t * (log max(t, 1e-12) - s) for target probabilities and the student's log-probabilities."""
    return total(F.zip_with(target, log_student, lambda t, s: t * (F.log(F.greatest(t, F.lit(1e-12))) - s)))


def soft_cross_entropy(target: Column, log_student: Column) -> Column:
    return -total(F.zip_with(target, log_student, lambda t, s: t * s))


def acceptance(p: Column, q: Column) -> Column:
    """Sum of the smaller probabilities: the chance that a draft token is taken."""
    return total(F.zip_with(p, q, lambda a, b: F.least(a, b)))


def argmax(a: Column) -> Column:
    """0-based, the lowest index on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_k(a: Column, k: int) -> Column:
    """0-based indices of the k largest, ties to the lower index."""
    order = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def decay_weights(n: int, offset: int, gamma: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.exp(-F.greatest(k - offset, F.lit(0)) / F.lit(gamma)))


def prefix_products(p: Column, mask: Column, alpha: float) -> Column:
    """Running products of the smoothed probabilities (1 - alpha) p + alpha; places off the mask count as 1."""
    return _rows(lambda x, m: np.cumprod(np.where(m == 1, (1 - alpha) * x + alpha, 1.0)), "double")(p, mask)


def suffix_sums(prefix: Column, mask: Column) -> Column:
    return _rows(lambda x, m: np.cumsum((x * m)[::-1])[::-1], "double")(prefix, mask)


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    return _stacked(lambda v: v / np.sqrt((v * v).mean(1, keepdims=True) + eps) if v.shape[1] else v, "double")(a)


def rotate_half(a: Column) -> Column:
    h = F.floor(F.size(a) / 2).cast("int")
    return F.concat(F.transform(F.slice(a, h + 1, F.size(a) - h), lambda x: -x), F.slice(a, F.lit(1), h))


def gptq(df: DataFrame, inputs: DataFrame | None, group_size: int, damp: float = 0.01, module: str = "module") -> DataFrame:
    """(module, row_idx, codes, scales, err): error-feedback quantisation of each module's rows, one module per task.

    df: module, row_idx, v ARRAY<DOUBLE>. inputs: module, x ARRAY<DOUBLE>, one calibration input a row, grouped beside the module's
    rows and so sent once; modules without any are rounded plainly. Scales are stored with eight bits of mantissa. Columns
    whose inputs are all zero are set to zero. A module's matrix must fit a task, as its factors do.
    """

    def solve(key: object, pdf: pd.DataFrame, x: np.ndarray | None) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        w = np.stack([np.asarray(v, dtype=float) for v in pdf["v"]])
        d = w.shape[1]
        h = np.eye(d) if x is None else 2.0 / len(x) * x.T @ x
        dead = np.diag(h) == 0
        h[dead, dead] = 1
        w[:, dead] = 0
        h[np.diag_indices(d)] += damp * max(np.mean(np.diag(h)), 1e-8)
        u = np.linalg.cholesky(np.linalg.inv(h)).T
        src, q, scales = w.copy(), np.zeros_like(w), []
        codes = np.zeros(w.shape, dtype=int)
        for i in range(d):
            if i % group_size == 0:
                s = np.maximum(np.abs(src[:, i : i + group_size]).max(1) / 7, 1e-9)
                scales.append(_np_bf16(s))
            codes[:, i] = np.clip(np.rint(src[:, i] / s), -8, 7)
            q[:, i] = codes[:, i] * s
            e = (src[:, i] - q[:, i]) / u[i, i]
            src[:, i:] -= np.outer(e, u[i, i:])
        err = ((w - q) ** 2).mean(1)
        return pd.DataFrame({"module": key, "row_idx": pdf["row_idx"].to_numpy(), "codes": list(codes), "scales": list(np.stack(scales, 1)), "err": err})

    out = "module STRING, row_idx INT, codes ARRAY<INT>, scales ARRAY<DOUBLE>, err DOUBLE"
    if inputs is None:
        return df.groupBy(module).applyInPandas(lambda key, pdf: solve(key[0], pdf, None), out)

    def both(key: tuple, pdf: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"module": [], "row_idx": [], "codes": [], "scales": [], "err": []})
        return solve(key[0], pdf, np.stack([np.asarray(r, dtype=float) for r in x["x"]]) if len(x) else None)

    return df.groupBy(module).cogroup(inputs.groupBy(module)).applyInPandas(both, out)


def hessian(df: DataFrame, col: str) -> DataFrame:
    """(i, j, h): 2 / n times the sum of outer products of the rows, which have one length; null rows don't count. Each task sums its
    whole part and yields its matrix once, so what is added up has as many matrices as tasks."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = None, 0
        for pdf in batches:
            rows = [np.asarray(v, dtype=float) for v in pdf[col] if v is not None]
            if rows:
                x = np.stack(rows)
                m, n = (x.T @ x if m is None else m + x.T @ x), n + len(rows)
        if m is not None:
            yield pd.DataFrame({"i": np.arange(len(m), dtype=np.int32), "s": list(m), "n": n})

    got = df.select(col).mapInPandas(part, "i INT, s ARRAY<DOUBLE>, n BIGINT")
    each = got.select("i", "n", F.posexplode("s").alias("j", "s"))
    return each.groupBy("i", "j").agg((2.0 / F.sum("n") * F.sum("s")).alias("h"))


def window_visible(q: Column, kv: Column, window: int, longest: int) -> Column:
    """Whether a key lies in the query's window: all of them where no sequence is longer than the window, else |q - kv| < window."""
    return F.lit(True) if longest <= window else F.abs(q - kv) <= window - 1


def suffix_visible(q: Column, kv: Column, n_valid: Column, length: int) -> Column:
    """The drafter's mask: causal among valid places, and behind the sequence each further block of keys on its own diagonal."""
    causal = (q >= kv) & (kv < n_valid) & (q < n_valid)
    behind = (kv >= length) & (F.pmod(kv - q, F.lit(length)) == 0) & (F.pmod(kv, F.lit(length)) < n_valid)
    return causal | behind


def repeat_groups(a: Column, n: int) -> Column:
    """Each entry n times in a row: key heads shared by n query heads."""
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, n)))


def concat_layers(states: Column, layers: tuple[int, ...], offset: int = 1) -> Column:
    """The vectors of the chosen layers end to end; states has the embedding first, so layer k is at k + offset."""
    return F.flatten(F.array(*(F.get(states, F.lit(k + offset)) for k in layers)))


def rank_chunk(a: Column, rank: int, world: int, padded: int | None = None) -> Column:
    """The rank's share of an array, padded with zeros to a given length first if there is one; shares are equal, the last ones
    shorter or empty where the length isn't a multiple."""
    full = a if padded is None else F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(padded) - F.size(a), F.lit(0))))
    share = F.ceil(F.size(full) / world).cast("int")
    return F.slice(full, share * rank + 1, F.greatest(share, F.lit(0)))


def merged_chunk(a: Column, sizes: tuple[int, ...], rank: int, world: int) -> Column:
    """The rank's share of parts that lie end to end (gate and up, or query, key and value), each cut on its own."""
    out, at = [], 0
    for n in sizes:
        out.append(F.slice(a, at + rank * (n // world) + 1, n // world))
        at += n
    return F.concat(*out)
