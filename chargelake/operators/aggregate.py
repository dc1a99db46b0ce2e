"""Aggregations by day, hour, area, scenario and period; gap filling; histograms; series summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import overlapping_ranges, percentiles

#: Percentiles of scenario tables.
BANDS = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def keys_of(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a null key, as grouping leaves those out."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def daily_energy(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """By date (scenario, extra): energy, sessions, mean duration, and the sum of power as peak_power_kw."""
    keys = ["date", *extra, *keys_of(df, "scenario")]
    power = F.coalesce(F.sum("power_kw"), F.lit(0.0)) if "power_kw" in df.columns else F.count("energy").cast("double")
    return present(df, keys).groupBy(*keys).agg(
        F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy_kwh"), F.count("energy").alias("n_sessions"), F.avg("duration").alias("mean_duration_h"), power.alias("peak_power_kw")
    )


def hourly_profile(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    if "arrival_hour" in df.columns:
        hour = F.col("arrival_hour").cast("int")
    elif "arrival_time" in df.columns:
        hour = F.hour("arrival_time")
    else:
        raise ValueError("neither arrival_hour nor arrival_time")
    keys = ["date", "slot_hour", *extra, *keys_of(df, "scenario")]
    power = F.coalesce(F.sum("power_kw"), F.lit(0.0)) if "power_kw" in df.columns else F.count("energy").cast("double")
    return present(df.withColumn("slot_hour", hour), keys).groupBy(*keys).agg(
        F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy_kwh"), F.count("energy").alias("n_sessions"), power.alias("power_kw")
    )


def scenario_bands(df: DataFrame, value: str, keys: list[str], bands: dict[str, float] = BANDS) -> DataFrame:
    """Mean and exact percentiles over scenarios for each key; a key has as many values as scenarios."""
    at = F.percentile(value, F.array(*(F.lit(q) for q in bands.values())))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), at.alias("q_")).select(*keys, "mean", *(F.col("q_")[i].alias(n) for i, n in enumerate(bands)))


def period(freq: str, date: str = "date") -> Column:
    if freq == "D":
        return F.col(date)
    if freq == "W":  # weeks end on Sunday
        return F.next_day(F.date_sub(date, 1), "SUN")
    if freq == "ME":
        return F.last_day(date)
    if freq == "QS":
        return F.trunc(date, "quarter")
    raise ValueError(f"no period {freq}")


METRICS = ("energy_kwh", "n_sessions", "mean_energy_kwh", "mean_duration_h")


def aggregate_by_department(df: DataFrame, freq: str = "D", metric: str | None = None) -> DataFrame:
    if metric is not None and metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    rows = present(df, ["department", "date"]).groupBy(period(freq).alias("date"), "department")
    out = rows.agg(F.sum("energy").alias("energy_kwh"), F.count("*").alias("n_sessions"), F.avg("energy").alias("mean_energy_kwh"), F.avg("duration").alias("mean_duration_h"))
    return out.select("date", "department", metric) if metric else out


def department_daily_energy(df: DataFrame, departments: list[str] | None = None) -> DataFrame:
    return aggregate_by_department(df if departments is None else df.filter(F.col("department").isin(*departments)), "D", "energy_kwh")


def date_spine(df: DataFrame, by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """Every day from the first to the last (of each group)."""
    ends = df.groupBy(*by).agg(F.min(date).alias("lo_"), F.max(date).alias("hi_"))
    return ends.filter(F.col("lo_").isNotNull()).select(*by, F.explode(F.sequence("lo_", "hi_")).alias(date))


def fill_days(df: DataFrame, value: str, by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    return date_spine(df, by, date).join(df, [*by, date], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def panel(df: DataFrame, freq: str = "D", metric: str = "energy_kwh", fill: float = 0.0, mode: str = "calendar") -> DataFrame:
    """Long panel date x department.  mode calendar: only dates that no department has are filled; all: every hole."""
    have = aggregate_by_department(df, freq, metric)
    dates = date_spine(have) if freq == "D" else have.select("date").distinct()
    grid = dates.crossJoin(have.select("department").distinct())  # the panel itself: every date of every department
    seen = have.select("date", F.lit(True).alias("seen_")).distinct()
    out = grid.join(have, ["date", "department"], "left").join(seen, "date", "left")
    hole = F.col(metric).isNull() & (F.col("seen_").isNull() if mode == "calendar" else F.lit(True))
    return out.withColumn(metric, F.when(hole, F.lit(fill)).otherwise(F.col(metric))).drop("seen_")


def daily_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = present(df, [*by, "date"]).groupBy(*by, "date").agg(F.count("*").alias("n_sessions"))
    return fill_days(counts, "n_sessions", by)


def summary_stats(df: DataFrame, features: tuple[str, ...] = ("duration", "energy", "power_kw")) -> DataFrame:
    long = df.select(*features).unpivot([], list(features), "feature", "value")
    q = percentiles(long, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    out = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), (100.0 * F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_pct"),
    )
    return out.join(q, "feature", "left").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "missing_pct")


def context_rates(df: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Sessions and sessions per day of each context with enough rows."""
    out = present(df, by).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("date").alias("n_dates"))
    return out.filter(F.col("n") >= least).withColumn("per_day", F.col("n") / F.col("n_dates"))


def histogram(df: DataFrame, value: str, bins: int, by: tuple[str, ...] = (), bounds: tuple[float, float] | None = None) -> DataFrame:
    """``bin`` (from 0), count and density; both ends belong to the range."""
    if bounds is None:
        ends = df.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
        df = df.join(ends, list(by)) if by else df.join(F.broadcast(ends))
    else:
        df = df.withColumns({"lo_": F.lit(bounds[0]), "hi_": F.lit(bounds[1])})
    place = F.floor((F.col(value) - F.col("lo_")) / ((F.col("hi_") - F.col("lo_")) / bins))
    inside = df.filter((F.col(value) >= F.col("lo_")) & (F.col(value) <= F.col("hi_")) & (F.col("hi_") > F.col("lo_")))
    counts = inside.groupBy(*by, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), ((F.first("hi_") - F.first("lo_")) / bins).alias("width"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else None
    if total is None:
        counts = counts.join(F.broadcast(counts.agg(F.sum("n").alias("total_"))))
        total = F.col("total_")
    return counts.withColumn("density", F.col("n") / (total * F.col("width"))).select(*by, "bin", "n", "density")


def heatmap(df: DataFrame, value: str | None = None) -> DataFrame:
    """Weekday x hour: sessions, or the sum of a value; holes are 0."""
    cell = F.count("*") if value is None else F.sum(value)
    grid = df.withColumn("h_", F.floor("hour").cast("int")).groupBy("day_of_week").pivot("h_", list(range(24)))
    return grid.agg(cell).na.fill(0).select("day_of_week", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24)))


def anchored(scenarios: DataFrame, observed: DataFrame, value: str, at: str = "date") -> DataFrame:
    """Every scenario starts at the last observed point: that row is put in, or takes the place of the one there."""
    last = observed.agg(F.max(at).alias(at), F.max_by(value, at).alias(value))
    point = scenarios.select("scenario").distinct().join(F.broadcast(last))
    others = scenarios.join(F.broadcast(last.select(F.col(at).alias("t0_"))), F.col(at) != F.col("t0_")).drop("t0_")
    return others.select("scenario", at, value).unionByName(point.select("scenario", at, value))


def tail_days(df: DataFrame, n: int, by: tuple[str, ...], date: str = "date") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(date))
    return df.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= n).drop("n_")


def pivot_scenarios(df: DataFrame, value: str, scenarios: list[int]) -> DataFrame:
    out = df.groupBy("date").pivot("scenario", scenarios).agg(F.first(value))
    return out.select("date", *(F.col(str(s)).alias(f"s{s}") for s in scenarios))


def daily_maximum_rows(df: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    """The rows that reach their day's maximum; ties are kept."""
    w = Window.partitionBy("date")
    return df.withColumn("date", F.to_date(ts)).withColumn("top_", F.max(value).over(w)).filter(F.col(value) == F.col("top_")).drop("top_")


def centred_mean(df: DataFrame, value: str, width: int, by: tuple[str, ...], ts: str = "ts") -> DataFrame:
    """Rolling mean over ``width`` rows around each row; only full windows.  A series is many tasks (``overlapping_ranges``)."""
    before, after = width // 2, width - width // 2 - 1
    near = overlapping_ranges(df, list(by), ts, before, after)
    w = Window.partitionBy(*by, "block_").orderBy(ts).rowsBetween(-before, after)
    return near.withColumn("rolling", F.when(F.count(value).over(w) == width, F.avg(value).over(w))).filter("own_").drop("own_", "block_")


def returns(df: DataFrame, value: str, by: tuple[str, ...], at: str = "date") -> DataFrame:
    near = overlapping_ranges(df, list(by), at, 1, 0)
    before = F.lag(value).over(Window.partitionBy(*by, "block_").orderBy(at))
    return near.withColumn("change", F.try_divide(F.col(value), before) - 1).filter("own_").drop("own_", "block_")


def gradient(df: DataFrame, value: str, at: str, by: tuple[str, ...]) -> DataFrame:
    """Slope by neighbours on either side; one-sided at the ends."""
    near = overlapping_ranges(df, list(by), at, 1, 1)
    w = Window.partitionBy(*by, "block_").orderBy(at)
    lo, hi = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    t_lo, t_hi = F.coalesce(F.lag(at).over(w), F.col(at)), F.coalesce(F.lead(at).over(w), F.col(at))
    return near.withColumn("slope", F.try_divide(hi - lo, t_hi - t_lo)).filter("own_").drop("own_", "block_")


def growth_ratio(df: DataFrame, value: str, by: tuple[str, ...], at: str = "date") -> DataFrame:
    """To the group's first value, which is one row of an aggregate."""
    first = df.groupBy(*by).agg(F.min_by(value, at).alias("first_"))
    return df.join(first, list(by)).withColumn("ratio", F.try_divide(F.col(value), F.col("first_"))).drop("first_")
