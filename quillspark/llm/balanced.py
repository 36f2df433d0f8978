"""Problem 5: a sample whose category shares follow targets, drawn by the cube method."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import runtime

CHUNK = 50_000  # units of one flight phase at most, on average
FAN_IN = 256  # chunks whose unresolved units meet in one flight of the next level
ONE_TASK = 20_000  # unresolved units (at most one for each category and chunk) that the last flight may hold

_UNIT = "id STRING, label STRING, pi DOUBLE"


def units(prompts: DataFrame) -> DataFrame:
    """(id, label): one row for each distinct non-null id, with the category of its earliest row that has one.

    Uneven writing of ids and categories is set aside; ids without any category have a null label.
    """
    rows = prompts.select(runtime.canonical_uuid(F.col("id")).alias("id"), runtime.canonical_label(F.col("category")).alias("label"), "line_no")
    first = F.min(F.when(F.col("label").isNotNull(), F.struct("line_no", "label")))
    return rows.filter("id IS NOT NULL").groupBy("id").agg(first.getField("label").alias("label"))


def carriers(prompts: DataFrame) -> DataFrame:
    """(id, label): the distinct ids that carry each category, an id with several categories once for each."""
    rows = prompts.select(runtime.canonical_uuid(F.col("id")).alias("id"), runtime.canonical_label(F.col("category")).alias("label"))
    return rows.filter("id IS NOT NULL AND label IS NOT NULL").distinct()


def allocate(targets: list[tuple[str, float, int]], have: dict[str, int], size: int) -> dict[str, float]:
    """Real sample sizes for (label, share, min_rows): shares of size, raised to the minima, cut to what there is.

    One factor scales all shares so that the sizes add up to size where minima and supply allow it.
    """
    low = {c: float(min(m or 0, have.get(c, 0))) for c, _, m in targets}
    fit = lambda f: {c: min(max(f * (s or 0) * size, low[c]), float(have.get(c, 0))) for c, s, _ in targets}
    a, b = 0.0, 1.0
    most = sum(have.get(c, 0) for c, s, _ in targets if s)
    while sum(fit(b).values()) < min(size, most) and b < 1e12:
        b *= 2
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if sum(fit(mid).values()) < size else (a, mid)
    return fit(b)


def _flight(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase on one indicator: until less than two units are open, moves pairs along (1, -1).

    That is a direction in the kernel of the balancing matrix, so the sum of pi over the category stays, and either
    step length brings one unit of the pair to 0 or 1; the steps' odds keep each unit's expectation.
    """
    pi = pi.copy()
    live = np.flatnonzero((pi > 1e-12) & (pi < 1 - 1e-12))
    while len(live) > 1:
        n = len(live) // 2 * 2
        i, j = live[0:n:2], live[1:n:2]
        a, b = pi[i], pi[j]
        up, down = np.minimum(1 - a, b), np.minimum(a, 1 - b)
        step = np.where(rng.random(len(i)) * (up + down) < down, up, -down)
        pi[i], pi[j] = a + step, b - step
        pi[np.abs(pi) < 1e-12] = 0.0
        pi[np.abs(pi - 1) < 1e-12] = 1.0
        rest = live[n:]
        live = np.concatenate([live[:n][(pi[live[:n]] > 0) & (pi[live[:n]] < 1)], rest])
    return pi


def _flights(seed: int):  # noqa: ANN202
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        rng = np.random.default_rng([seed, int(key[0])])
        out = pdf["pi"].to_numpy(dtype=float).copy()
        for _, at in sorted(pdf.groupby("label").indices.items()):
            out[at] = _flight(out[at], rng)
        return pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "pi": out})

    return run


def _land(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Last flight over what is open, then landing: category by category given up, only the total size still holds."""
    pdf = pdf.sort_values(["label", "id"], ignore_index=True)
    rng = np.random.default_rng([seed, 2**31])
    pi = pdf["pi"].to_numpy(dtype=float).copy()
    for _, at in sorted(pdf.groupby("label").indices.items()):
        pi[at] = _flight(pi[at], rng)
    pi = _flight(pi, rng)
    pi = np.where((pi > 0) & (pi < 1), (np.abs(pi - np.round(pi)) < 1e-6) * np.round(pi) + (np.abs(pi - np.round(pi)) >= 1e-6) * (rng.random(len(pi)) < pi), pi)
    return pdf.assign(pi=pi)


def cube_sample(rows: DataFrame, sizes: dict[str, float], counts: dict[str, int], seed: int = 7) -> DataFrame:
    """(id, label) drawn from (id, label) units with expected sizes per label; ids must be distinct.

    Chunks are by hash of the id, so the draw is the same in every layout. Units of labels without a size and units
    with a null label are not drawn. Each chunk leaves at most one open unit per label; these merge FAN_IN chunks at a
    time until one task can hold them.
    """
    spark = rows.sparkSession
    n = sum(counts.get(c, 0) for c in sizes)
    pis = [(c, min(1.0, sizes[c] / counts[c])) for c in sizes if counts.get(c)]
    if not pis:
        return rows.select("id", "label").limit(0)
    chunks = max(1, math.ceil(n / CHUNK))
    prob = spark.createDataFrame(pis, "label STRING, pi DOUBLE")
    todo = rows.join(F.broadcast(prob), "label").select("id", "label", "pi")
    chunk = lambda m: F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int") / F.lit(m)
    done: list[DataFrame] = []
    merge = 1
    while True:
        out = todo.groupBy(F.floor(chunk(merge)).alias("chunk")).applyInPandas(_flights(seed + merge), _UNIT)
        out = runtime.materialize(out, "cube-flight")
        done.append(out.filter("pi = 1"))
        todo = out.filter("pi > 0 AND pi < 1")
        left = todo.count()
        if left <= ONE_TASK or merge > chunks:
            break
        merge *= FAN_IN
    if left:

        def land(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [b for b in batches if len(b)]
            if got:
                yield _land(pd.concat(got, ignore_index=True), seed)

        done.append(todo.repartition(1).mapInPandas(land, _UNIT).filter("pi = 1"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.select("id", "label")


def draw(prompts: DataFrame, targets: DataFrame, share: tuple[int, int] = (1, 5), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of prompts for mix targets (category, target_share, min_rows).

    sample: (id, category) as named in targets. report: one row per target with wanted (the larger of min_rows and the share
    of the sample, rounded up), expected (the size the draw aims at), drawn, left (ids that carry the category and that the
    finished draw hasn't taken for it), supply (drawn and left), imbalance (drawn - expected), and short: the draw has come
    out below wanted, and what it left couldn't have made up for it. A null share or minimum is 0.
    The number of targets is a parameter of the draw and is held at the driver.
    """
    spark = prompts.sparkSession
    want = targets.select("category", runtime.canonical_label(F.col("category")).alias("label"), F.coalesce("target_share", F.lit(0.0)), F.coalesce("min_rows", F.lit(0))).filter("label IS NOT NULL").collect()
    rows = runtime.materialize(units(prompts), "cube-units")
    labels = [r[1] for r in want]
    total = 0
    counts: dict[str, int] = {}
    for r in rows.groupBy(F.when(F.col("label").isin(labels), F.col("label")).alias("label")).count().collect():
        total += r["count"]
        if r["label"] is not None:
            counts[r["label"]] = r["count"]
    size = total * share[0] // share[1]
    sizes = allocate([(r[1], r[2], r[3]) for r in want], counts, size)
    got = runtime.materialize(cube_sample(rows, sizes, counts, seed), "cube-sample")
    base = spark.createDataFrame([(n, c, float(s), int(m), max(m, math.ceil(s * size)), sizes[c]) for n, c, s, m in want], "category STRING, label STRING, target_share DOUBLE, min_rows INT, wanted BIGINT, expected DOUBLE")
    # the draw beside all that it could have drawn from
    outcome = carriers(prompts).filter(F.col("label").isin(labels)).join(got.withColumn("taken", F.lit(1)), ["id", "label"], "left")
    outcome = outcome.groupBy("label").agg(F.count("taken").alias("drawn"), F.count(F.lit(1)).alias("supply"))
    report = base.join(outcome, "label", "left").fillna(0, ["drawn", "supply"])
    report = report.withColumns({"left": F.col("supply") - F.col("drawn"), "imbalance": F.col("drawn") - F.col("expected")})
    report = report.withColumn("short", (F.col("drawn") < F.col("wanted")) & (F.col("left") < F.col("wanted") - F.col("drawn")))
    sample = got.join(F.broadcast(base.select("label", "category")), "label").select("id", "category")
    return sample, report.select("category", "target_share", "min_rows", "supply", "wanted", "expected", "drawn", "left", "imbalance", "short")
