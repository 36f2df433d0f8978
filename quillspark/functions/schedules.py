"""Learning-rate schedules as closed forms of the step, so any step is computed on its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(t: Column, peak: float, total: int, floor: float = 0.0) -> Column:
    """From peak to floor along half a cosine over total steps."""
    return floor + (peak - floor) * (1 + F.cos(F.pi() * t / total)) / 2


def delayed(t: Column, peak: float, delay: int, after) -> Column:  # noqa: ANN001
    """Flat at peak for delay steps, then after(step since)."""
    return F.when(t < delay, F.lit(peak)).otherwise(after(t - delay))


def warmed_up(t: Column, peak: float, warmup: int, after, delay: int = 0) -> Column:  # noqa: ANN001
    """A ramp of (t + 1) / warmup for warmup steps, flat for delay more, then after(step since)."""
    later = delayed(t - warmup, peak, delay, after)
    return F.when(t < warmup, (t + 1) / warmup * peak).otherwise(later) if warmup else later


def warmup_cosine(t: Column, peak: float, total: int, warmup: int, delay: int = 0) -> Column:
    """Warm-up, an optional delay, and a cosine over what is left of total."""
    return warmed_up(t, peak, warmup, lambda s: cosine(s, peak, total - warmup - delay), delay)
