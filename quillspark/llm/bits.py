"""A set of 64-bit hashes as a bit map of bounded size, for pruning a scan before an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 23, 27  # the map has 2**LEAST to 2**MOST bits (1 to 16 MB), whatever the number of hashes


def bit_map(hashes: DataFrame, col: str) -> np.ndarray:
    """The map of a BIGINT column of hashes; nulls don't count. Tasks fold the hashes to 64-bit words first, so at most
    2**MOST / 64 rows reach the driver. A full map lets everything through: the join behind it stays exact."""
    rows = hashes.filter(F.col(col).isNotNull()).select(F.col(col).alias("h"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    size = 1 << min(MOST, max(LEAST, int(16 * n).bit_length()))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    words = rows.select(F.pmod("h", F.lit(size)).alias("at")).select(F.shiftright("at", 6).alias("w"), bit.alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (any 64-bit type) the map may hold."""
    at = hashes.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
