"""Segmented scans in two levels, for timelines of any length.

A window over a key puts all of the key's rows into one task.  Here the timeline of a key with more than ``RANGE_ROWS`` rows is dealt into
ranges of about so many; windows run within (key, range), so they spread over all tasks.  Each range gives a summary (sums, its last and first
values), the summaries of a key are combined in order, and each range finishes with what it is carried.  Keys with fewer rows are one range and
take no part in the second level, so where no key is hot the plan is the plain window's.

Ranges are cut by value along the first order column, at ``CELLS`` places for each expected range, by counted rows, so uneven
timelines are cut evenly; rows of one value stay together.  Rows without a value come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.stages import written

RANGE_ROWS, CELLS = 1_000_000, 32
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """A broadcast hint only if the counted size is below the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


@dataclass(frozen=True)
class Sum:
    """Sum of a number up to this row, itself included; with ``places`` F.lit(1) it is the row number."""

    of: Column


@dataclass(frozen=True)
class Least:
    """The smallest value up to this row, itself included."""

    of: Column


@dataclass(frozen=True)
class Last:
    """The last value that is not null before this row (with it, if inclusive)."""

    of: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Next:
    """The first value that is not null after this row (with it, if inclusive)."""

    of: Column
    inclusive: bool = False


class Ranges:
    """How the timelines of one key are dealt, from one counting job over ``rows`` (which need only have the key and the first order column)."""

    def __init__(self, rows: DataFrame, key: str, along: str, size: int | None = None):
        self.key, self.along, size = key, along, size or RANGE_ROWS
        x = F.col(along).cast("double")
        hot = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).where(F.col("n") > size)
        self.keys = written(hot.select(F.col(key).alias("_hot"), "lo", "hi", (F.ceil(F.col("n") / size) * CELLS).cast("long").alias("cells")), "hot")
        self.n, self.cells = self.keys.agg(F.count("*"), F.coalesce(F.sum("cells"), F.lit(0))).first()
        self.hot = self.n > 0
        if self.hot:
            counted = self._placed(rows.select(key, along)).where("_cell is not null").groupBy(key, "_cell").agg(F.count("*").alias("_n"))
            # All cells have a range, those without counted rows too: other rows of the key may lie there.
            every = self.keys.select(F.col("_hot").alias("_key"), F.explode(F.sequence(F.lit(-1).cast("long"), F.col("cells") - 1)).alias("_c"))
            every = every.join(counted, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_c") == F.col("_cell")), "left").select("_key", "_c", F.coalesce("_n", F.lit(0)).alias("_n"))
            before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_c")) - F.col("_n")  # at most CELLS rows for each range
            self.table = written(every.select("_key", "_c", F.floor(before / size).alias("_range")), "ranges")

    def _placed(self, df: DataFrame) -> DataFrame:
        x = F.col(self.along).cast("double")
        place = F.floor((x - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * F.col("cells")).cast("long")
        place = F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.col("cells") - 1, place)))
        at = df.join(small(self.keys, self.n), F.col(self.key).eqNullSafe(F.col("_hot")), "left")
        return at.withColumn("_cell", F.when(F.col("cells").isNotNull(), F.coalesce(place, F.lit(-1).cast("long")))).drop("_hot", "lo", "hi", "cells")

    def attach(self, df: DataFrame) -> DataFrame:
        """df with ``_range``: null where the key is one range."""
        if "_range" in df.columns:
            return df
        if not self.hot:
            return df.withColumn("_range", F.lit(None).cast("long"))
        out = self._placed(df).join(small(self.table, self.cells + self.n), F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_c")), "left")
        return out.drop("_key", "_cell", "_c")

    def scan(self, df: DataFrame, order: list[str], **results: Sum | Least | Last | Next) -> DataFrame:
        """df with one more column for each result, over the rows of a key in order (total within a key, or ties are taken in any order)."""
        key, x = self.key, self.attach(df)
        w = Window.partitionBy(key, "_range").orderBy(*order)
        total, inner, carry = [], {}, {}
        place = F.struct(*order)
        by = Window.partitionBy("_key").orderBy("_r")
        before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
        for name, r in results.items():
            if isinstance(r, Sum):
                inner[name] = F.coalesce(F.sum(r.of).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
                total.append(F.coalesce(F.sum(r.of), F.lit(0)).alias(name))
                carry[name] = F.coalesce(F.sum(name).over(before), F.lit(0))
            elif isinstance(r, Least):
                inner[name] = F.min(r.of).over(w.rowsBetween(Window.unboundedPreceding, 0))
                total.append(F.min(r.of).alias(name))
                carry[name] = F.min(name).over(before)
            elif isinstance(r, Last):
                inner[name] = F.last(r.of, True).over(w.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1))
                total.append(F.max_by(r.of, F.when(r.of.isNotNull(), place)).alias(name))
                carry[name] = F.last(name, True).over(before)
            else:
                inner[name] = F.first(r.of, True).over(w.rowsBetween(0 if r.inclusive else 1, Window.unboundedFollowing))
                total.append(F.min_by(r.of, F.when(r.of.isNotNull(), place)).alias(name))
                carry[name] = F.first(name, True).over(after)
        y = x.select("*", *[c.alias(n) for n, c in inner.items()])
        if self.hot:
            sums = x.where("_range is not null").groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(*total)
            sums = written(sums.select("_key", "_r", *[c.alias(f"_c_{n}") for n, c in carry.items()]), "carries")
            y = y.join(small(sums, sums.count(), 256), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")), "left")
            join = {Sum: lambda n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)), Least: lambda n: F.least(n, f"_c_{n}")}
            full = [join.get(type(r), lambda n: F.coalesce(n, f"_c_{n}"))(n).alias(n) for n, r in results.items()]
            y = y.select(*[F.col(f"`{c}`") for c in x.columns], *full)
        return y if "_range" in df.columns else y.drop("_range")


def row_numbers(df: DataFrame, key: str, order: list[str], name: str, ranges: Ranges | None = None) -> DataFrame:
    """Places from 1 in the order of a key."""
    return (ranges or Ranges(df, key, order[0])).scan(df, order, **{name: Sum(F.lit(1).cast("long"))})
