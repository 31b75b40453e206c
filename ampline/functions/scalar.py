"""Column functions of samples, features and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_id(i: str, size: int) -> Column:
    return F.expr(f"{i} div {size}")


def slot(seq: Column, slots: int) -> Column:
    return F.pmod(seq, F.lit(slots))


def offset_in_batch(i: str, arrival: str, size: int) -> Column:
    return F.col(i) - F.lit(size) * F.col(arrival)


def ln(x: Column) -> Column:
    """Natural logarithm; null for what has none, so that such a feature is no one's neighbour."""
    return F.when(x > 0, F.ln(x))


def distance(p1: Column, q1: Column, p2: Column, q2: Column) -> Column:
    dp, dq = p1 - p2, q1 - q2
    return F.sqrt(dp * dp + dq * dq)


def locality(count: Column, u: Column, v: Column) -> Column:
    return count / (v - u + 1)


def is_local(count: Column, u: Column, v: Column, least: float) -> Column:
    return count >= F.lit(least) * (v - u + 1) - F.lit(1e-9)


def event_point(start: str, end: str) -> Column:
    """The reported middle of an interval of true positions; reported positions are one more."""
    return F.expr(f"({start} + 1 + {end} + 1) div 2 + 1")


def result_json(s: Column, d: Column, event_s: Column) -> Column:
    return F.to_json(F.struct(s.cast("long").alias("s"), d.cast("int").alias("d"), F.coalesce(event_s.cast("long"), F.lit(-1).cast("long")).alias("event_s")))
