"""Joins of intervals, without expanding them.

An interval's level is that of its length, so it lies in two bins of 2^level at most. Two intervals meet at the higher of their levels: each is
put into the bins of its own level and of the other side's higher ones, and a pair counts in the first bin that both have there. Rows a side
grow with the number of levels in use, a logarithm of the longest interval, not with lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(start: Column, end: Column) -> Column:
    """The binary digits of the length less one: 0 for a single place."""
    return F.length(F.bin(end - start)) - F.when(end == start, 1).otherwise(0)


def _used(rows: DataFrame) -> list[int]:
    """The levels of a side: at most 63 numbers, whatever its size."""
    return sorted(r[0] for r in rows.select(level(F.col("start"), F.col("end")).alias("level")).distinct().collect())


def _binned(rows: DataFrame, levels: list[int]) -> DataFrame:
    own = level(F.col("start"), F.col("end"))
    at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own"))).alias("level") if levels else F.lit(0).alias("level")
    out = rows.withColumn("own", own).select("*", at)
    return out.select("*", F.explode(F.sequence(F.expr("shiftright(start, level)"), F.expr("shiftright(end, level)"))).alias("bin"))


def overlaps(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of left(*on, start, end, ...) and right(*on, start, end, ...) that share a place: left's columns, right's start and end as other_start and other_end.

    Bounds are integers from 0 on and belong to the interval; rows with a null bound or an end before the start meet nothing."""
    fine = "start is not null and end is not null and start <= end and start >= 0"
    left, right = left.where(fine), right.select(*on, "start", "end").where(fine)
    a, b = _used(left), _used(right)
    every = sorted({*a, *b})
    x = _binned(left, every)
    y = _binned(right, every).select(*on, "level", "bin", F.col("own").alias("other_own"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    met = x.join(y, [*on, "level", "bin"]).where("level = greatest(own, other_own) and start <= other_end and other_start <= end")
    first = F.expr("bin = greatest(shiftright(start, level), shiftright(other_start, level))")
    return met.where(first).drop("level", "bin", "own", "other_own")


def covered(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left's rows that share a place with some row of right, once each; left's rows must differ."""
    return overlaps(left, right, on).select(*left.columns).distinct()
