"""Sessions as load over time: the hours and slots they overlap, by sweeping over where they begin and end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hour_of_day, normal
from .aggregate import present

#: A session counts in this many hours from the start of its first day; what lasts longer is lost, unless more are asked for.
HOURS = 72


def swept(edges: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``keys, bin, level, n`` for each of ``bins`` bins: a sweep over edges (keys, bin, w, c, and turns, whole rounds of the bins).

    An edge raises the level by w and the count n by c in its bin and all that follow; w and c of a key add up to nothing, so an edge
    of a later round lowers the level of all bins by its turns.  Edges are added up by bin before they are shuffled: at most
    ``bins`` rows for each key and task, however long what they bound lasts.  Where nothing is, the level is 0.
    """
    total = lambda c: F.sum(F.col(c)).alias(c)
    sums = edges.select(*keys, "bin", "w", "c", (F.col("w") * F.col("turns")).alias("wt"), (F.col("c") * F.col("turns")).alias("ct"))
    sums = sums.groupBy(*keys, "bin").agg(*map(total, ("w", "c", "wt", "ct")))
    all_, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    level = lambda c: F.sum(c).over(upto) - F.sum(f"{c}t").over(all_)
    steps = sums.select(*keys, "bin", level("w").alias("level"), level("c").alias("n"), F.coalesce(F.lead("bin").over(order), F.lit(bins)).alias("next"))
    steps = steps.withColumn("level", F.when(F.col("n") > 0, F.col("level")).otherwise(0.0))
    return steps.select(*keys, F.explode(F.sequence("bin", F.col("next") - 1)).alias("bin"), "level", "n")


def edge(bin_: Column, w: Column, c: Column, turns: Column | None = None) -> Column:
    turns = F.lit(0) if turns is None else turns
    return F.struct(bin_.cast("int").alias("bin"), w.cast("double").alias("w"), c.cast("int").alias("c"), turns.cast("int").alias("turns"))


def energy_24h(df: DataFrame, keys: list[str], power: Column | None = None, active: Column | None = None, hours: int | None = HOURS) -> DataFrame:
    """``keys, h, kwh``: energy by clock hour, past midnight wrapped; hours of a key that no session touches are left out.

    Over all hours it is the sessions' energy but for what lies beyond ``hours`` (``energy_beyond``; None: nothing is lost).
    A session is four edges: its power begins in part of its first hour and in full with the next, and ends likewise.
    """
    power = F.col("energy") / F.col("duration") if power is None else power
    end = F.col("hour") + (F.col("duration") if active is None else active)
    end = end if hours is None else F.least(end, F.lit(float(hours)))
    rows = present(df, keys).select(*keys, F.col("hour").alias("a"), end.alias("z"), power.alias("p")).filter("p > 0 and z > a")
    a, z, p = F.col("a"), F.col("z"), F.col("p")
    first, last = F.floor(a), F.floor(z)
    whole = (z == last).cast("int")
    at = lambda h, w, c: edge(F.pmod(h, F.lit(24)), w, c, F.floor(h / 24))
    parts = F.array(
        edge(F.lit(0), F.lit(0.0), F.lit(0)), at(first, p * (first + 1 - a), F.lit(1)), at(first + 1, p * (a - first), F.lit(0)),
        at(last, -p * (last + 1 - z), -whole), at(last + 1, -p * (z - last), whole - 1),
    )
    levels = swept(rows.select(*keys, F.inline(parts)), keys, 24)
    return levels.filter("n > 0").select(*keys, F.col("bin").cast("long").alias("h"), F.greatest("level", F.lit(0.0)).alias("kwh"))


def energy_beyond(df: DataFrame, keys: list[str], hours: int = HOURS) -> DataFrame:
    """Sessions, their energy, and the energy that a profile of ``hours`` loses, with the number of sessions that reach beyond."""
    end = F.col("hour") + F.col("duration")
    lost = F.col("energy") / F.col("duration") * F.greatest(end - F.greatest(F.col("hour"), F.lit(float(hours))), F.lit(0.0))
    rows = present(df, keys).filter("duration > 0 and energy > 0").withColumn("lost_", lost)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_sessions"), F.sum("energy").alias("kwh"), F.sum("lost_").alias("lost_kwh"), F.count_if(F.col("lost_") > 0).alias("n_beyond"))


def smart_profile(charged: DataFrame, keys: list[str], power_kw: float = 7.4, most_hours: float = 48.0) -> DataFrame:
    """Energy by clock hour when charging begins at the scheduled start; sessions without one are left out."""
    rows = charged.filter(F.col("scheduled_start").isNotNull()).withColumn("hour", hour_of_day("scheduled_start"))
    active = F.least(F.greatest(F.col("energy") / F.lit(power_kw), F.lit(0.0)), F.lit(most_hours))
    return energy_24h(rows, keys, F.lit(power_kw), active)


def load_profiles(df: DataFrame, keys: list[str], power: Column | None = None, active: Column | None = None, least_per_day: float = 0.0) -> DataFrame:
    """``keys, h, mw``: mean load of a day in each context (energy per observed date), every hour filled."""
    days = present(df, keys).groupBy(*keys).agg(F.count("*").alias("n_sessions"), F.count_distinct("date").alias("n_days"))
    days = days.filter(F.col("n_sessions") >= least_per_day * F.col("n_days"))
    grid = days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    out = grid.join(energy_24h(df, keys, power, active), [*keys, "h"], "left")
    return out.select(*keys, "h", (F.coalesce("kwh", F.lit(0.0)) / F.col("n_days") / 1000).alias("mw"), "n_sessions")


def annual_series(profiles: DataFrame, year: int, smart: DataFrame | None = None, noise: float = 0.0) -> DataFrame:
    """Every hour of a year from profiles by (day_of_week, season); where a profile is missing, 0.

    smart: a second set of profiles, which falls back on the first.  noise: standard deviation of a day's factor.
    """
    from ..functions.expressions import season

    hours = profiles.sparkSession.sql(
        f"select explode(sequence(timestamp_ntz'{year}-01-01 00:00:00', timestamp_ntz'{year}-12-31 23:00:00', interval 1 hour)) as ts"
    )
    hours = hours.withColumns({"day_of_week": F.weekday("ts"), "season": season(F.month("ts")), "h": F.hour("ts")})
    keys = ["day_of_week", "season", "h"]
    base = profiles.select(*keys, F.col("mw").alias("base_"))
    out = hours.join(base, keys, "left")
    mw = F.coalesce("base_", F.lit(0.0))
    if smart is not None:
        out = out.join(smart.select(*keys, F.col("mw").alias("smart_")), keys, "left")
        mw = F.coalesce("smart_", "base_", F.lit(0.0))
    if noise:
        mw = mw * F.greatest(1 + noise * normal(F.to_date("ts")), F.lit(0.0))
    return out.select("ts", mw.alias("mw"))


def load_curve(df: DataFrame, keys: tuple[str, ...] = ("date",), resolution_min: int = 30, power: str = "power_kw") -> DataFrame:
    """``keys, slot, kw``: power of all sessions in each slot of a day; cut off at midnight."""
    n, res = 24 * 60 // resolution_min, resolution_min / 60
    lo = F.floor(F.col("hour") / res)
    hi = F.floor(F.least((F.col("hour") + F.col("duration")) / res, F.lit(float(n))))
    nothing = edge(F.lit(0), F.lit(0.0), F.lit(0))  # every key has its slots, filled or not
    parts = F.when(F.col(power).isNotNull() & (hi > lo), F.array(nothing, edge(lo, F.col(power), F.lit(1)), edge(hi, -F.col(power), F.lit(-1)))).otherwise(F.array(nothing))
    edges = present(df, list(keys)).select(*keys, F.inline(parts)).filter(F.col("bin") < n)
    return swept(edges, list(keys), n).select(*keys, F.col("bin").alias("slot"), F.col("level").alias("kw"))


def shift_curves(df: DataFrame, resolution_min: int = 30, efficiency: float = 0.9, power: str = "power_kw") -> DataFrame:
    """``date, kind, slot, kw``: charging from arrival (plug) and from the scheduled start (smart), on the arrival's day."""
    n, res = 24 * 60 // resolution_min, resolution_min / 60
    slots = F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("energy") / F.lit(efficiency), F.col(power) * res)))
    since = lambda t: (F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(F.col("date").cast("timestamp"))) / F.lit(3.6e9)
    both = df.select("date", F.col(power).alias("kw"), slots.alias("k"), since("arrival_time").alias("plug"), since("scheduled_start").alias("smart"))
    long = both.unpivot(["date", "kw", "k"], ["plug", "smart"], "kind", "from_h").filter(F.col("from_h").isNotNull())
    lo = F.greatest((F.col("from_h") / res).cast("int"), F.lit(0))
    hi = F.least(lo + F.col("k"), F.lit(n))
    ends = F.array(edge(lo, F.col("kw"), F.lit(1)), edge(hi, -F.col("kw"), F.lit(-1)))
    edges = present(long, ["date"]).filter(F.col("kw").isNotNull() & (hi > lo)).select("date", "kind", F.inline(ends)).filter(F.col("bin") < n)
    return swept(edges, ["date", "kind"], n).filter("n > 0").select("date", "kind", F.col("bin").alias("slot"), F.col("level").alias("kw"))
