"""Running sums and exact percentiles of groups of any size, in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import written


def dealt_by_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df``, written, with ``part_``: ranges of (keys, order) that hold about as many rows each, whatever the values.

    The ranges are Spark's own: splitters are quantiles of a sample of the rows.  A large group is many ranges, small ones
    share one.
    """
    return written(df.repartitionByRange(*keys, order).withColumn("part_", F.spark_partition_id()))


def running(values: DataFrame, keys: list[str], order: str, sums: list[str], split: bool = True) -> DataFrame:
    """``values`` with ``<c>_upto`` for each of ``sums``, summed up to and with the row in the order of ``order``, and ``next_``, the value of
    ``order`` that follows.  ``keys, order`` must be unique.

    With ``split`` rows are dealt into ranges of equal size (``dealt_by_order``); windows run inside a group's part of a range, and
    totals of these parts, a row for each group and range at most, are carried across.  So a group with most of all rows isn't one
    task.  Without, each group is one window, which is cheaper where groups are many and small.
    """
    inside = [*keys, "part_"] if split else keys
    w = Window.partitionBy(*inside).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt_by_order(values, keys, order) if split else values
    inner = dealt.withColumns({**{f"{c}_upto": F.sum(c).over(upto) for c in sums}, "next_": F.lead(order).over(w)})
    if not split:
        return inner
    totals = dealt.groupBy(*inside).agg(*(F.sum(c).alias(f"{c}_all") for c in sums), F.min(order).alias("first_"))
    parts = Window.partitionBy(*keys).orderBy("part_")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*inside, *(F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_before") for c in sums), F.lead("first_").over(parts).alias("after_"))
    out = inner.join(totals, inside)
    out = out.withColumns({**{f"{c}_upto": F.col(f"{c}_upto") + F.col(f"{c}_before") for c in sums}, "next_": F.coalesce("next_", "after_")})
    return out.drop("part_", "after_", *(f"{c}_before" for c in sums))


def percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], split: bool = True) -> DataFrame:
    """``keys`` and the exact percentiles with linear interpolation, under the names of ``qs``.

    Values are counted first; a percentile is the value (or lies between the value and the next) at which the running
    count passes its place.  No task holds a group's values.  Nulls and NaN are left out.
    """
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("c_"))
    sizes = counts.groupBy(*keys).agg(F.sum("c_").alias("n_"))
    rows = running(counts, keys, value, ["c_"], split).join(sizes, keys)
    found = []
    for name, q in qs.items():
        place = F.lit(q) * (F.col("n_") - 1)
        low = F.floor(place)
        here = (F.col("c__upto") > low) & (F.col("c__upto") - F.col("c_") <= low)
        upper = F.when(F.col("c__upto") > low + 1, F.col(value)).otherwise(F.coalesce("next_", value))
        found.append(F.max(F.when(here, F.col(value) + (place - low) * (upper - F.col(value)))).alias(name))
    return rows.groupBy(*keys).agg(*found)


def numbered(df: DataFrame, keys: list[str], id_: str, split: bool = True) -> DataFrame:
    """``df`` with ``at_``, the place of each row in its group from 0, in the order of the first two digits of md5(id) and then of the id.

    With ``split`` the 256 parts of a group are numbered side by side.
    """
    rows = df.withColumn("part_", F.substring(F.md5(F.col(id_).cast("string")), 1, 2))
    if not split:
        return rows.withColumn("at_", F.row_number().over(Window.partitionBy(*keys).orderBy("part_", id_)) - 1).drop("part_")
    inner = rows.withColumn("at_", F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(id_)) - 1)
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*keys, "part_").agg(F.count("*").alias("n_")).select(*keys, "part_", F.coalesce(before, F.lit(0)).alias("start_"))
    return inner.join(starts, [*keys, "part_"]).withColumn("at_", (F.col("at_") + F.col("start_")).cast("int")).drop("part_", "start_")


def overlapping_ranges(df: DataFrame, keys: list[str], order: str, before: int, after: int, rows: int = 1 << 16) -> DataFrame:
    """``df`` in blocks of ``rows`` neighbouring rows of each group (``block_``), with the rows that windows reach into on either side.

    Windows over (keys, block_) that look ``before`` rows back and ``after`` ahead are right for rows with ``own_``; the others
    are copies, to be dropped.  So one long series is many tasks.
    """
    placed = running(df.withColumn("one_", F.lit(1)), keys, order, ["one_"]).withColumn("at_", F.col("one__upto") - 1).drop("one_", "one__upto", "next_")
    lo, hi = F.floor((F.col("at_") - after) / rows), F.floor((F.col("at_") + before) / rows)
    each = placed.withColumn("block_", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)))
    return each.withColumn("own_", F.col("block_") == F.floor(F.col("at_") / rows)).drop("at_")
