"""Joins of points and intervals with intervals, as equi-joins on aligned blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def cover(i: str, j: str, top: int) -> Column:
    """The aligned blocks (level, block) of 2^level units that make up units i to j - 1: at most two of each level below ``top``, and the
    whole ones of ``top`` between."""
    piece = lambda level, block: f"named_struct('level', {level}, 'block', {block})"
    lo, hi = f"shiftright({i} + shiftleft(1L, l) - 1, l)", f"shiftright({j}, l)"
    odd = f"""flatten(transform(sequence(0, {top - 1}), l -> array(
        if({lo} < {hi} and {lo} % 2 = 1, {piece("l", lo)}, null), if({lo} < {hi} and {hi} % 2 = 1, {piece("l", f"{hi} - 1")}, null))))"""
    lo, hi = (x.replace(", l)", f", {top})") for x in (lo, hi))
    return F.expr(f"filter(concat({odd}, if({lo} < {hi}, transform(sequence({lo}, greatest({hi} - 1, {lo})), b -> {piece(top, 'b')}), array())), x -> x is not null)")


def unit_of(ts: Column, unit_s: int) -> Column:
    """Units begin in the year 1, so that none is negative."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + F.lit(62_135_596_800_000_000)) / F.lit(unit_s * 1_000_000)).cast("long")


def points_in_intervals(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, unit_s: int = 300, top: int = 12, open_start: bool = False) -> DataFrame:
    """Every point with every interval it lies in: lo <= at < hi (open_start: lo < at).

    An interval is some two blocks of each size; a point is one block of each size, so it meets an interval in one block at
    most: an equi-join whose rows are the result's but for the first and last unit.  Intervals may be of any length, overlap and
    leave gaps.  Rows with nulls, and empty intervals, meet nothing.  Columns must differ between the two.
    """
    ends = intervals.withColumns({"i_": unit_of(F.col(lo), unit_s), "j_": unit_of(F.col(hi), unit_s) + 1}).filter(F.col(lo) < F.col(hi))
    blocks = ends.select("*", F.inline(cover("i_", "j_", top))).drop("i_", "j_").withColumnsRenamed({"level": "level_", "block": "block_"})
    each = points.withColumn("u_", unit_of(F.col(at), unit_s)).withColumn("level_", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("block_", F.expr("shiftright(u_, level_)"))
    inside = (F.col(lo) < F.col(at) if open_start else F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))
    return each.drop("u_").join(blocks, ["level_", "block_"]).filter(inside).drop("level_", "block_")


def overlapping(a: DataFrame, a_lo: str, a_hi: str, b: DataFrame, b_lo: str, b_hi: str, unit_s: int = 300, top: int = 12) -> DataFrame:
    """Every two intervals [lo, hi) of ``a`` and ``b`` that overlap, once, with ``overlap_s``, for how many seconds.

    Two intervals overlap if either begins in the other; one begins strictly later or they begin together.
    """
    a, b = (df.filter(F.col(lo) < F.col(hi)) for df, lo, hi in ((a, a_lo, a_hi), (b, b_lo, b_hi)))
    in_a = points_in_intervals(b, b_lo, a, a_lo, a_hi, unit_s, top, open_start=True)
    in_b = points_in_intervals(a, a_lo, b, b_lo, b_hi, unit_s, top)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    shared = micros(F.least(a_hi, b_hi)) - micros(F.greatest(a_lo, b_lo))
    return in_b.unionByName(in_a.select(*in_b.columns)).withColumn("overlap_s", shared / F.lit(1e6))


def integrals(df: DataFrame, lo: str, hi: str, steps: DataFrame, since: str, until: str, value: str, id_: str) -> DataFrame:
    """``id_, covered_h, total``: for each interval [lo, hi) of ``df`` the hours it shares with those of ``steps``, summed over them, and the same
    with each hour times its ``value`` (null: nothing; not a finite number: NaN).  Intervals that share nothing have 0.

    No two intervals are paired.  Up to a time t all values have added up to t * sum(v) - sum(v * its time), over the begins (v) and ends (-v)
    before t: running sums over times.  An interval is the difference of its two ends.  Whole billionths of values
    are summed exactly, only what is left of them as doubles, so nothing is lost where large sums cancel.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = lambda c: F.col(c).cast("decimal(18,0)")
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    v = F.when(v.isNull() | odd, 0.0).otherwise(v)
    units = F.floor(v * 1e9).cast("long")
    held = {"n": F.lit(1).cast("long"), "v": units, "o": F.coalesce(odd, F.lit(False)).cast("long"), "r": v - units / F.lit(1e9)}
    ends = lambda a, b: F.inline(F.array(F.struct(micros(a).alias("at_"), F.lit(1).alias("turn_")), F.struct(micros(b).alias("at_"), F.lit(-1).alias("turn_"))))
    turns = steps.filter(F.col(since) < F.col(until)).select(ends(since, until), *(c.alias(f"{k}_") for k, c in held.items()))
    wide = lambda k: F.col(f"{k}_") * F.col("at_") if k == "r" else at(f"{k}_") * at("at_")
    turns = turns.select("at_", *((F.col("turn_") * F.col(f"{k}_")).alias(f"{k}_") for k in held))
    turns = turns.select("at_", *(f"{k}_" for k in held), *(wide(k).alias(f"{k}_at_") for k in held))
    points = df.filter(F.col(lo) < F.col(hi)).select(id_, ends(lo, hi))
    names = turns.columns[1:]
    times = turns.unionByName(points.select("at_"), allowMissingColumns=True).groupBy("at_").agg(*(F.coalesce(F.sum(c), F.lit(0).cast(turns.schema[c].dataType)).alias(c) for c in names))
    upto = running(times, [], "at_", names)
    now = {k: (F.col(f"{k}__upto") * F.col("at_") if k == "r" else at(f"{k}__upto") * at("at_")) - F.col(f"{k}_at__upto") for k in held}
    upto = upto.select("at_", *(c.alias(k) for k, c in now.items()))
    one = lambda k: F.sum(F.when(F.col("turn_") < 0, F.col(k)).otherwise(-F.col(k)))
    each = points.join(upto, "at_").groupBy(id_).agg(*(one(k).alias(k) for k in held))
    hours = lambda k: F.col(k).cast("double") / 3.6e9
    return each.select(id_, hours("n").alias("covered_h"), F.when(F.col("o") > 0, float("nan")).otherwise(hours("v") / 1e9 + hours("r")).alias("total"))
