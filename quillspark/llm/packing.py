"""Problem 6: items of varying length into containers of fixed capacity, by dominance reduction and best fit."""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import runtime

CHUNK = 500_000  # items ranked in one window group at most, on average


@dataclass
class Plan:
    """Where the items of each length go: of length l, ranks from start on fill n_bins containers, per_bin in each."""

    capacity: int
    n_bins: int = 0
    fixed_bins: int = 0
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, start, per_bin, first_bin, n_bins
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def put(self, length: int, per_bin: int, first: int, n: int) -> None:
        self.segments.append((length, self.used[length], per_bin, first, n))
        self.used[length] += per_bin * n

    def open(self, n: int) -> int:
        self.n_bins += n
        return self.n_bins - n


def _smallest(counts: np.ndarray, skip: int, k: int) -> list[int]:
    """The k smallest items, one item of length skip left out."""
    out: list[int] = []
    for w in np.flatnonzero(counts):
        out += [int(w)] * min(k - len(out), int(counts[w]) - (w == skip))
        if len(out) >= k:
            break
    return out


def _largest(counts: np.ndarray, skip: int, room: int) -> int:
    at = np.flatnonzero(counts[: room + 1])
    for w in at[::-1]:
        if counts[w] - (w == skip) > 0:
            return int(w)
    return 0


def _best_pair(counts: np.ndarray, skip: int, room: int) -> int:
    """Largest sum of two items up to room."""
    c = counts.copy()
    c[skip] -= 1
    at = np.flatnonzero(c[: room + 1] > 0)
    best, i, j = 0, 0, len(at) - 1
    while i <= j:
        s = int(at[i] + at[j])
        if s <= room and (i != j or c[at[i]] > 1):
            best = max(best, s)
        if s > room:
            j -= 1
        else:
            i += 1
    return best


def reduce_dominated(counts: np.ndarray, plan: Plan) -> None:
    """Martello and Toth's reduction on the counts per length; counts keeps what couldn't be fixed.

    From the longest item w down, with room r beside it: w alone is fixed if nothing fits, w with the longest
    fitting p if p fills r exactly, if no two items fit beside w, or if at most two fit and no pair fills more than p.
    Each such set dominates every other container of w, and stays dominant for as many copies as there are.
    """
    cap = plan.capacity
    again = True
    while again:
        again = False
        for w in range(cap, 0, -1):
            while counts[w] > 0:
                r = cap - w
                s = _smallest(counts, w, 3)
                k = 0
                while k < len(s) and sum(s[: k + 1]) <= r:
                    k += 1
                if k == 0:
                    n = int(counts[w])
                    plan.put(w, 1, plan.open(n), n)
                    counts[w] = 0
                    again = True
                    break
                p = _largest(counts, w, r)
                if not (p == r or k == 1 or (k == 2 and p >= _best_pair(counts, w, r))):
                    break
                n = int(counts[w]) // 2 if p == w else int(min(counts[w], counts[p]))
                first = plan.open(n)
                if p == w:
                    plan.put(w, 2, first, n)
                    counts[w] -= 2 * n
                else:
                    plan.put(w, 1, first, n)
                    plan.put(p, 1, first, n)
                    counts[w] -= n
                    counts[p] -= n
                again = True
    plan.fixed_bins = plan.n_bins


def best_fit(counts: np.ndarray, plan: Plan) -> None:
    """Best fit decreasing of what is left, all containers with equal room and all items of equal length at a time."""
    cap = plan.capacity
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def keep(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((first, n))

    for w in range(cap, 0, -1):
        n = int(counts[w])
        while n > 0:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                room, first, m = cap, None, n
            else:
                room = rooms[i]
                first, m = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            q = room // w
            full = min(m, n // q)
            part = 1 if full < m and n - full * q > 0 and (full * q + q > n) else 0
            if first is None:
                m = full + part
                first = plan.open(m)
            if full:
                plan.put(w, q, first, full)
                keep(room - q * w, first, full)
            if part:
                rest = n - full * q
                plan.put(w, rest, first + full, 1)
                keep(room - rest * w, first + full, 1)
                n -= rest
            n -= full * q
            keep(room, first + full + part, m - full - part)
        counts[w] = 0


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan for all items of length 1 to capacity, given how many there are of each. Its size depends on capacity only."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for w, n in histogram.items():
        if not 0 < w <= capacity:
            raise ValueError(f"length {w} doesn't fit a capacity of {capacity}")
        counts[w] = n
    plan = Plan(capacity)
    reduce_dominated(counts, plan)
    best_fit(counts, plan)
    return plan


def message_items(rows: DataFrame, id_col: str = "resp_id") -> DataFrame:
    """(resp_id, turn, length): one item per message with content; null contents and null lists give none."""
    e = rows.select(id_col, F.posexplode("conversations").alias("turn", "m"))
    return e.filter("m.content IS NOT NULL").select(id_col, "turn", F.length("m.content").alias("length"))


def split(items: DataFrame, capacity: int) -> DataFrame:
    """Adds part, part_length and n_parts: an item above the capacity fills containers but for its last part."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / F.lit(capacity)).cast("int"))
    return (
        items.withColumn("n_parts", n)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .withColumn("part_length", F.least(F.lit(capacity), F.col("length") - F.col("part") * capacity))
    )


def pack(rows: DataFrame, capacity: int, id_col: str = "resp_id") -> DataFrame:
    """(resp_id, turn, length, part, n_parts, part_length, bin): every message content in a container.

    No item of capacity or less is divided. Items of length 0 take no room and are put to container 0. Rows repeated
    under the same id are items of their own. The instance is the histogram of lengths, at most capacity rows whatever
    the input; items find their container by length and rank, and ranks are counted in chunks by hash of the id, so
    one length that most items share is ranked by many tasks.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    parts = runtime.materialize(split(message_items(rows, id_col), capacity), "pack-items")
    hist = {r[0]: r[1] for r in parts.filter("part_length > 0").groupBy("part_length").count().collect()}
    plan = solve(hist, capacity)
    chunks = max(1, sum(hist.values()) // CHUNK)
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64(id_col, "turn", "part"), F.lit(chunks)).cast("int"))
    offsets = parts.groupBy("part_length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("part_length").orderBy("chunk")
    offsets = offsets.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("part_length", "chunk").orderBy(id_col, "turn", "part"))
    ranked = parts.withColumn("rank", rank - 1).join(offsets, ["part_length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, start, per, first, _ in plan.segments:
        by[length].append((start, per, first))
    tables = {w: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v))) for w, v in by.items()}
    known = rows.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("long")
    def bin_of(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(length), dtype=np.int64)
        r = rank.to_numpy()
        for w, at in length.groupby(length.to_numpy()).indices.items():
            if w > 0:
                start, per, first = known.value[int(w)]
                j = np.searchsorted(start, r[at], side="right") - 1
                out[at] = first[j] + (r[at] - start[j]) // per[j]
        return pd.Series(out)

    return ranked.select(id_col, "turn", "length", "part", "n_parts", "part_length", bin_of("part_length", "rank").alias("bin"))


def divided(packed: DataFrame, id_col: str = "resp_id") -> DataFrame:
    """(resp_id, turn) of the items that the finished packing has put to more than one container, once for each id and turn."""
    bins = packed.groupBy(id_col, "turn").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.max("n_parts").alias("n_parts"))
    return bins.filter("n_parts > 1 AND first < last").select(id_col, "turn")


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_items (parts), n_bins, least_bins (all lengths over the capacity, rounded up), fill."""
    bins = packed.groupBy("bin").agg(F.sum("part_length").alias("used"), F.count(F.lit(1)).alias("k"))
    a = bins.agg(F.sum("k").alias("n_items"), F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    return a.select("n_items", "n_bins", F.ceil(F.col("used") / capacity).alias("least_bins"), "fullest", (F.col("used") / (F.col("n_bins") * capacity)).alias("fill"))
