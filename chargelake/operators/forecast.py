"""Daily forecasts per group, same-weekday look-back, resampling of sessions, and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import count_of, growth, normal, season, uniform
from .ranks import numbered


def days_from(df: DataFrame, start: str | Column, horizon: int) -> DataFrame:
    """Each row of ``df`` for every day of the horizon; start: a day, or a column of ``df`` with one."""
    day = (start if isinstance(start, Column) else F.lit(start)).cast("date")
    return df.withColumn("date", F.explode(F.sequence(day, F.date_add(day, horizon - 1))))


def persistence_forecast(counts: DataFrame, n_weeks: int, start: str | Column, horizon: int, by: tuple[str, ...] = (), most_weeks: int = 52) -> DataFrame:
    """The count of the same weekday ``n_weeks`` before; where there is none, of the nearest week before that (up to
    ``most_weeks``); else the mean.

    An as-of join as an equi-join on group and weekday with a date range: at most a year of one weekday meets each day.
    """
    means = counts.groupBy(*by).agg(F.avg("n_sessions").alias("mean_"))
    targets = days_from(means, start, horizon)
    targets = targets.withColumns({"wd_": F.weekday("date"), "ref_": F.date_sub("date", 7 * n_weeks)})
    past = counts.select(*by, F.weekday("date").alias("wd_"), F.col("date").alias("seen_"), F.col("n_sessions").alias("n_"))
    near = targets.join(past, [*by, "wd_"], "left")
    ok = F.col("seen_").between(F.date_sub("ref_", 7 * most_weeks), F.col("ref_"))
    best = near.groupBy(*by, "date").agg(F.max_by(F.when(ok, F.col("n_")), F.when(ok, F.col("seen_"))).alias("n_"), F.first("mean_").alias("mean_"))
    return best.select(*by, "date", count_of(F.coalesce("n_", "mean_")).alias("n_sessions"))


def with_holidays(df: DataFrame, holidays: DataFrame, flag: str = "holiday") -> DataFrame:
    """``df`` with a flag 1 on the dates of ``holidays``, else 0."""
    return df.join(holidays.select("date", F.lit(1).alias(flag)).distinct(), "date", "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def normal_forecast(counts: DataFrame, start: str, horizon: int, by: tuple[str, ...] = (), z: float = 1.2816) -> DataFrame:
    """Mean of the group's counts, and the band of a normal distribution; never below 0."""
    level = counts.groupBy(*by).agg(F.avg("n_sessions").alias("mean"), F.coalesce(F.stddev_samp("n_sessions"), F.lit(0.0)).alias("std"))
    low, high = F.greatest(F.col("mean") - z * F.col("std"), F.lit(0.0)), F.col("mean") + z * F.col("std")
    return days_from(level, start, horizon).select(*by, "date", "mean", low.alias("p10"), high.alias("p90"))


def scenario_counts(forecast: DataFrame, n_scenarios: int, by: tuple[str, ...] = (), std: Column | float = 1.0, seed: int = 0, value: str = "n_sessions") -> DataFrame:
    """Reproducible scenarios around a forecast: normal noise by (group, date, scenario), rounded, never negative."""
    each = forecast.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))))
    spread = std if isinstance(std, Column) else F.lit(std)
    return each.withColumn(value, count_of(F.col(value) + spread * normal(F.lit(seed), *by, "date", "scenario")))


def normal_scenarios(counts: DataFrame, start: str, horizon: int, n_scenarios: int, by: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """Draws of the group's normal distribution for each day and scenario: ``by, date, scenario, n_sessions``."""
    level = counts.groupBy(*by).agg(F.avg("n_sessions").alias("mean_"), F.coalesce(F.stddev_samp("n_sessions"), F.lit(0.0)).alias("std_"))
    days = days_from(level, start, horizon).withColumnRenamed("mean_", "n_sessions")
    return scenario_counts(days, n_scenarios, by, F.col("std_"), seed).drop("std_").select(*by, "date", "scenario", "n_sessions")


def persistence_scenarios(counts: DataFrame, n_weeks: int, start: str, horizon: int, n_scenarios: int, by: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """Same-weekday persistence with noise of 3 % of the group's standard deviation, at least 0.1."""
    spread = counts.groupBy(*by).agg(F.greatest(0.03 * F.coalesce(F.stddev_samp("n_sessions"), F.lit(0.0)), F.lit(0.1)).alias("std_"))
    days = persistence_forecast(counts, n_weeks, start, horizon, by)
    days = days.join(spread, list(by)) if by else days.join(F.broadcast(spread))  # one row without groups
    return scenario_counts(days, n_scenarios, by, F.col("std_"), seed).select(*by, "date", "scenario", "n_sessions")


def department_forecast(daily: DataFrame, start: str, horizon: int = 30, value: str = "energy_kwh", min_obs: int = 60, z: float = 1.2816, holidays: DataFrame | None = None) -> DataFrame:
    """All departments in one job: log1p of the value as a linear trend plus a weekday effect (and a holiday effect).

    Usual is one seasonal ARIMA per department; this is another model with the same contract: median,
    p10 and p90 for each day, never below 0, the mean for a department with fewer than ``min_obs`` days.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    rows = daily.withColumns({"y_": F.log1p(value), "t_": day.cast("double"), "wd_": F.weekday("date")})
    if holidays is not None:
        rows = with_holidays(rows, holidays, "hol_")
    else:
        rows = rows.withColumn("hol_", F.lit(0))
    trend = rows.groupBy("department").agg(
        F.count("*").alias("n_"), F.regr_slope("y_", "t_").alias("b_"), F.regr_intercept("y_", "t_").alias("a_"), F.avg(value).alias("mean_"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_")
    )
    fitted = rows.join(trend, "department").withColumn("r_", F.col("y_") - (F.col("a_") + F.col("b_") * F.col("t_")))
    weekday = fitted.groupBy("department", "wd_").agg(F.avg("r_").alias("w_"))
    fitted = fitted.join(weekday, ["department", "wd_"]).withColumn("e_", F.col("r_") - F.col("w_"))
    rest = fitted.groupBy("department").agg(F.coalesce(F.avg(F.when(F.col("hol_") == 1, F.col("e_"))), F.lit(0.0)).alias("h_"))
    model = trend.join(rest, "department")
    days = days_from(model, start, horizon).withColumns({"t_": day.cast("double"), "wd_": F.weekday("date")})
    if holidays is not None:
        days = with_holidays(days, holidays, "hol_")
    else:
        days = days.withColumn("hol_", F.lit(0))
    out = days.join(weekday, ["department", "wd_"], "left")
    level = F.expm1(F.col("a_") + F.col("b_") * F.col("t_") + F.coalesce("w_", F.lit(0.0)) + F.coalesce("hol_", F.lit(0)) * F.col("h_"))
    median = F.greatest(F.when(F.col("n_") < min_obs, F.col("mean_")).otherwise(F.coalesce(level, "mean_")), F.lit(0.0))
    spread = z * F.greatest("std_", F.lit(1.0))
    return out.select("date", "department", median.alias("median"), F.greatest(median - spread, F.lit(0.0)).alias("p10"), (median + spread).alias("p90"))


#: Lags of the autoregression, in observed days.
LAGS = (1, 7)


def autoregressive_forecast(
    daily: DataFrame, start: str, horizon: int = 30, value: str = "energy_kwh", by: str = "department", min_obs: int = 60, z: float = 1.2816,
    holidays: DataFrame | None = None, ridge: float = 1e-3,
) -> DataFrame:
    """``date, by, median, p10, p90``: log1p of the value on its value one and seven observed days before, the weekday, a trend and
    holidays, for all groups in one job.

    The normal equations of every group are grouped sums, so a group is one row, whatever its length; a small ``ridge`` keeps them
    solvable where a regressor never varies.  They are solved by elimination on an array of rows, the forecast goes on from the last
    days step by step, and bands widen with the horizon as the errors of earlier steps are carried on.  Nothing is below 0 or above
    the square of the largest value.  A group with fewer than ``min_obs`` days has its mean, and bands of its standard deviation.
    """
    most = max(LAGS)
    flag = lambda df: with_holidays(df, holidays, "hol_") if holidays is not None else df.withColumn("hol_", F.lit(0))
    order = Window.partitionBy(by).orderBy("date")
    t = F.datediff("date", F.lit(start).cast("date")) / F.lit(365.0)
    rows = flag(daily.select(by, "date", F.col(value).cast("double").alias("v_"))).withColumns({"y_": F.log1p("v_"), "wd_": F.weekday("date"), "t_": t})
    rows = rows.withColumns({**{f"lag{k}_": F.lag("y_", k).over(order) for k in LAGS}, "ago_": F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date")))})
    x = [(F.col("wd_") == d).cast("double") for d in range(7)] + [F.col("t_"), F.col("hol_").cast("double")] + [F.col(f"lag{k}_") for k in LAGS]
    n = len(x)
    whole = F.col(f"lag{most}_").isNotNull()
    product = lambda a, b: F.coalesce(F.sum(F.when(whole, a * b)), F.lit(0.0))
    sums = [product(x[i], x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [product(c, F.col("y_")).alias(f"r{i}") for i, c in enumerate(x)]
    ends = F.sort_array(F.collect_list(F.when(F.col("ago_") <= most, F.struct("date", "y_"))))
    level = [F.count("*").alias("n_"), F.avg("v_").alias("mean_"), F.coalesce(F.stddev_samp("v_"), F.lit(0.0)).alias("std_"), F.max("y_").alias("top_"), F.count_if(whole).alias("k_")]
    fitted = rows.groupBy(by).agg(*sums, product(F.col("y_"), F.col("y_")).alias("yy_"), *level, F.transform(ends, lambda e: e["y_"]).alias("last_"))
    lines = [F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0) for j in range(n)), F.col(f"r{i}")) for i in range(n)]
    solved = f"""aggregate(sequence(0, {n - 1}), lines_, (m, k) -> transform(m, (row, i) ->
        if(i = k, transform(row, v -> v / m[k][k]), transform(row, (v, j) -> v - row[k] * m[k][j] / m[k][k]))))"""
    fitted = fitted.withColumn("lines_", F.array(*lines)).withColumn("b_", F.expr(f"transform({solved}, row -> row[{n}])"))
    unexplained = F.col("yy_") - sum((F.col("b_")[i] * F.col(f"r{i}") for i in range(n)), F.lit(0.0))
    model = fitted.select(by, "n_", "mean_", "std_", "b_", "last_", (2 * F.col("top_")).alias("top_"), (F.greatest(unexplained, F.lit(0.0)) / F.greatest(F.col("k_") - n, F.lit(1))).alias("var_"))

    days = flag(days_from(model.select(by, "b_"), start, horizon)).withColumn("t_", t)
    given = F.element_at("b_", F.weekday("date") + 1) + F.col("b_")[7] * F.col("t_") + F.col("b_")[8] * F.col("hol_")
    given = days.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("date", given.alias("f")))), lambda g: g["f"]).alias("given_"))
    before = lambda acc: " + ".join(f"b_[{9 + i}] * element_at({acc}, -{k})" for i, k in enumerate(LAGS))
    steps = {
        "path_": f"slice(aggregate(given_, last_, (acc, f) -> array_append(acc, least(greatest(f + {before('acc')}, 0D), top_))), {most + 1}, {horizon})",
        "carried_": f"slice(aggregate(sequence(2, {horizon + 1}), concat(array_repeat(0D, {most - 1}), array(1D)), (acc, h) -> array_append(acc, {before('acc')})), {most}, {horizon})",
    }
    out = model.join(given, by).filter((F.size("last_") == most) | (F.col("n_") < min_obs))
    out = out.withColumns({k: F.when(F.col("n_") >= min_obs, F.expr(v)) for k, v in steps.items()})
    spread = f"transform(sequence(1, {horizon}), h -> sqrt(var_ * aggregate(slice(carried_, 1, h), 0D, (a, c) -> a + c * c)))"
    out = out.withColumn("spread_", F.expr(spread)).withColumn("h_", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    at, wide, mean, flat = F.col("path_")[F.col("h_")], z * F.col("spread_")[F.col("h_")], F.col("mean_"), z * F.greatest("std_", F.lit(1.0))
    bound = lambda a, b: F.greatest(F.coalesce(F.expm1(a), b), F.lit(0.0))
    date = F.date_add(F.lit(start).cast("date"), F.col("h_"))
    return out.select(date.alias("date"), by, bound(at, mean).alias("median"), bound(at - wide, mean - flat).alias("p10"), bound(at + wide, mean + flat).alias("p90"))


def last_n_occurrences(df: DataFrame, targets: DataFrame, n: int, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Sessions of the last n days before each target day with its weekday, and how many there are.

    Days are chosen first, on the small table of distinct dates; sessions join those.
    """
    dates = df.select(F.col(date).alias("pool_date"), F.weekday(date).alias("wd_")).distinct()
    pairs = targets.select(F.col("target")).distinct().withColumn("wd_", F.weekday("target")).join(dates, "wd_").filter(F.col("pool_date") < F.col("target"))
    w = Window.partitionBy("target").orderBy(F.desc("pool_date"))
    chosen = pairs.withColumn("n_", F.dense_rank().over(w)).filter(F.col("n_") <= n).select("target", "pool_date")
    pool = df.join(chosen, F.col(date) == F.col("pool_date")).drop("pool_date")
    info = targets.select("target").distinct().join(pool.groupBy("target").agg(F.count_distinct(date).alias("n_dates"), F.count("*").alias("n_sessions")), "target", "left")
    return pool, info.na.fill(0, ["n_dates", "n_sessions"])


def bootstrap_sessions(pool: DataFrame, draws: DataFrame, keys: list[str], n_scenarios: int = 1, id_: str = "session_id", seed: int = 0, split: bool = True) -> DataFrame:
    """Resampled sessions, with replacement: ``draws`` gives ``n`` for each cell ``keys``.

    The pool's rows are numbered within their cell, draws are exploded, and each takes the row that its
    reproducible uniform number points at: one equi-join on (cell, number).  A cell without pool gives no rows.
    split: number the parts of a cell side by side (``numbered``); without where cells are many and small.
    """
    missing = [c for c in (*keys, id_) if c not in pool.columns]
    if missing:
        raise ValueError(f"the pool lacks {missing}")
    rows = numbered(pool, keys, id_, split)
    sizes = pool.groupBy(*keys).agg(F.count("*").alias("size_"))
    each = draws.join(sizes, keys).filter("n > 0").withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))))
    each = each.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    each = each.withColumn("at_", F.floor(uniform(F.lit(seed), *keys, "scenario", "draw") * F.col("size_")).cast("int"))
    return each.join(rows, [*keys, "at_"]).drop("at_", "size_", "n")


def growth_projection(baseline: DataFrame, start: str, years: float, model: str, value: str = "base", weights: dict[str, float] | None = None, energy: str | None = None, **params: float) -> DataFrame:
    """Expected sessions of each group and day: growth of its baseline times the season's weight."""
    n = max(1, round(365.25 * years))
    out = days_from(baseline, start, n)
    t = F.datediff("date", F.lit(start).cast("date")) / F.lit(365.25)
    expected = growth(value, t, model, years, **params)
    if weights:
        expected = expected * F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), season(F.month("date"))), F.lit(1.0))
    out = out.withColumn("expected", expected)
    return out.withColumn("expected_kwh", F.col("expected") * F.col(energy)) if energy else out


def capacity_table(projection: DataFrame, by: tuple[str, ...], value: str = "expected") -> DataFrame:
    ends = projection.groupBy(*by).agg(F.min_by(value, "date").alias("first_value"), F.max_by(value, "date").alias("last_value"))
    return ends.withColumn("factor", F.try_divide(F.col("last_value"), F.col("first_value")))
