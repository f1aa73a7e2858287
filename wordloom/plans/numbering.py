"""Places of rows in an order, over the whole table or within groups, without one task for all rows.

Rows are cut into ranges of the order by a sample (each range a partition, sorted by itself); a row's place is its place
in its partition and the rows of the ranges before. Only a count for each partition is summed in one place. A large
group, or a run of equal rows, spreads over as many ranges as it fills.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

_AT, _PART, _FIRST, _BEFORE = "_wordloom_at", "_wordloom_part", "_wordloom_first", "_wordloom_before"


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df staged in ranges of keys, with _AT, which is a number of the range and of the row within it."""
    tied = df.withColumn(_AT, F.monotonically_increasing_id())
    rows = tied.repartitionByRange(*keys, F.col(_AT)).sortWithinPartitions(*keys, F.col(_AT))
    return staged(rows.withColumn(_AT, F.monotonically_increasing_id()), "ranged")


def _with_before(rows: DataFrame, within: tuple[str, ...], value: Column) -> DataFrame:
    """rows with _FIRST, the first _AT of the row's group in its range, _BEFORE, the sum of value over the group in the ranges before, and _all, the group's whole sum."""
    pieces = rows.groupBy(*within, F.shiftright(_AT, 33).alias(_PART)).agg(F.min(_AT).alias(_FIRST), F.sum(value).alias("_n"))
    if within:
        group = Window.partitionBy(*within)
        before = F.coalesce(F.sum("_n").over(group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pieces = pieces.withColumn(_BEFORE, before).withColumn("_all", F.sum("_n").over(group))
    else:  # one row for each range
        found = sorted((r[_PART], r[_FIRST], r["_n"]) for r in pieces.collect())
        ends = list(accumulate(n for *_, n in found))
        counted = [(part, first, end - n, ends[-1]) for (part, first, n), end in zip(found, ends, strict=True)]
        pieces = rows.sparkSession.createDataFrame(counted, f"{_PART} long, {_FIRST} long, {_BEFORE} long, _all long")
    pieces = pieces.select(*(F.col(f"`{c}`").alias(f"_of_{i}") for i, c in enumerate(within)), _PART, _FIRST, _BEFORE, "_all")
    same = F.shiftright(rows[_AT], 33) == pieces[_PART]
    for i, c in enumerate(within):
        same = same & rows[f"`{c}`"].eqNullSafe(pieces[f"_of_{i}"])
    return rows.join(pieces, same)


def _besides(df: DataFrame, *names: str | None) -> DataFrame:
    taken = {n.lower() for n in names if n}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def numbered(df: DataFrame, order: list[Column], within: tuple[str, ...] = (), index: str = "index", total: str | None = None) -> DataFrame:
    """df with a row's place in the order, from 0, and with the count of rows of its group if total names a column for it.

    within names the columns of a group; nulls in them are one group. Equal rows get consecutive places. Columns named
    like the results give way. The result reads a staged table.
    """
    df = _besides(df, index, total)
    rows = _with_before(_ranged(df, [F.col(f"`{c}`") for c in within] + order), within, F.lit(1))
    place = (F.col(_AT) - F.col(_FIRST) + F.col(_BEFORE)).alias(index)
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), place, *([F.col("_all").alias(total)] if total else []))


def summed_before(df: DataFrame, value: str, order: list[Column], within: tuple[str, ...] = (), into: str = "before", total: str | None = None) -> DataFrame:
    """df with the sum of a column over the rows before in the order, and over the whole group if total names a column for it.

    Within a range the sum is a window's, by range and group, so that a group spreads over as many tasks as it fills ranges.
    Nulls count as 0; all else is as in numbered().
    """
    df = _besides(df, into, total)
    rows = _with_before(_ranged(df, [F.col(f"`{c}`") for c in within] + order), within, F.coalesce(F.col(f"`{value}`"), F.lit(0)))
    ahead = Window.partitionBy(_FIRST).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)  # a group's rows of a range share _FIRST
    so_far = (F.coalesce(F.sum(f"`{value}`").over(ahead), F.lit(0)) + F.col(_BEFORE)).alias(into)
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), so_far, *([F.col("_all").alias(total)] if total else []))
