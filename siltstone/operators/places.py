"""Places and running sums of rows within groups of any size, and the first rows of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import written

#: monotonically_increasing_id() counts the rows of a partition in so many lower bits.
ROW_BITS = 33
#: Salts of the first of two selections.
SALTS = 32


def ranges(df: DataFrame, group: str, order: Sequence[str | Column]) -> DataFrame:
    """Written rows in ranges of (group, order), with ``_mid``, their number in order, and ``_part``, their range."""
    rows = written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_mid", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_mid", ROW_BITS))


def with_runs(rows: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Rows of ranges() with the columns of a table by (group, _part), in a shuffle of its own."""
    own = runs.withColumnRenamed(group, "_g").withColumn("_p", F.col("_part") + 0).drop("_part")
    return rows.join(own, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")


def placed(df: DataFrame, group: str, order: Sequence[str | Column], n_col: str) -> DataFrame:
    """Rows with ``at``, their place from 0 within their group by ``order``, and the group's number of rows.

    Ranges of (group, order) are sorted where they lie and counted by (group, range), so a
    group with most rows is spread over all tasks. A group has at most one count for each
    partition. Rows without a group are one.
    """
    rows = ranges(df, group, order)
    runs = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    of_group = Window.partitionBy(group)
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias(n_col))
    return with_runs(rows, runs, group).withColumn("at", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")


def running(df: DataFrame, group: str, order: Sequence[str | Column], sums: Mapping[str, Column]) -> DataFrame:
    """Rows with sums over those before them in their group by ``order``; 0 for the first.

    Sums run within ranges of (group, order), and start from what the ranges before add up to.
    """
    names = list(sums)
    rows = ranges(df, group, order)
    for i, c in enumerate(sums.values()):
        rows = rows.withColumn(f"_v{i}", F.coalesce(c.cast("long"), F.lit(0)))
    runs = rows.groupBy(group, "_part").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", *(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(names))))
    inner = Window.partitionBy(group, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    out = with_runs(rows, runs, group).select(*df.columns, *((F.col(f"_b{i}") + F.coalesce(F.sum(f"_v{i}").over(inner), F.lit(0))).alias(n) for i, n in enumerate(names)))
    return out


def first_rows(rows: DataFrame, group: str, order: Sequence[str | Column], most: int, place: str = "place") -> DataFrame:
    """The first ``most`` rows of each group with their place from 1 on, chosen in two steps so that no task sorts a group."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).filter(F.col("_r") <= most)
    return some.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(place) <= most).drop("_salt", "_r")
