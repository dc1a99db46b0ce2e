"""Rolling-origin backtests: all cells of the grid at once, without a loop on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gaussian as G
from ..operators.aggregate import fill_days
from ..functions.expressions import uniform
from ..operators.forecast import persistence_forecast
from ..operators.metrics import counts_compared, crps, forecast_metrics
from ..operators.ranks import numbered
from ..sources.readers import written

CELL = ["dataset", "origin", "h", "x"]
FEATURES = ["hour", "duration", "energy"]
#: A block of a day's sessions has this many binary digits of their places.
BLOCK = 16


def backtest_grid(df: DataFrame, x_grid: list[int], horizons: list[int], eval_window_days: int = 30, step_days: int = 1) -> DataFrame:
    """``dataset, origin, h, x, target``: origins from ``eval_window_days`` before the last day to the longest horizon before it."""
    if eval_window_days < max(horizons):
        raise ValueError("the evaluation window is shorter than the longest horizon")
    ends = df.groupBy("dataset").agg(F.max("date").alias("end_"))
    origins = F.sequence(F.date_sub("end_", eval_window_days), F.date_sub("end_", max(horizons)), F.expr(f"interval {step_days} days"))
    grid = ends.select("dataset", F.explode(origins).alias("origin"))
    grid = grid.withColumn("h", F.explode(F.lit(horizons))).withColumn("x", F.explode(F.lit(x_grid)))
    return grid.withColumn("target", F.date_add("origin", F.col("h")))


def backtest_pools(df: DataFrame, grid: DataFrame) -> DataFrame:
    """``CELL, target, pool_date``: the last x dates with the target's weekday up to the origin (and before the target).

    Pools are chosen on the small table of dates; sessions come in later by an equi-join on the date.
    """
    dates = df.select("dataset", F.col("date").alias("pool_date"), F.weekday("date").alias("wd_")).distinct()
    pairs = grid.withColumn("wd_", F.weekday("target")).join(dates, ["dataset", "wd_"])
    pairs = pairs.filter((F.col("pool_date") <= F.col("origin")) & (F.col("pool_date") < F.col("target")))
    w = Window.partitionBy(*CELL).orderBy(F.desc("pool_date"))
    return pairs.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= F.col("x")).select(*CELL, "target", "pool_date")


def backtest_status(df: DataFrame, grid: DataFrame, pools: DataFrame, min_sessions: int = 10) -> DataFrame:
    """Each cell with its pool's size, the target's count, and whether it can be scored; the first reason counts."""
    per_day = df.groupBy("dataset", "date").agg(F.count("*").alias("n_"))
    size = pools.join(per_day.withColumnRenamed("date", "pool_date"), ["dataset", "pool_date"]).groupBy(*CELL).agg(F.count("*").alias("n_dates"), F.sum("n_").alias("n_pool"))
    truth = per_day.select("dataset", F.col("date").alias("target"), F.col("n_").alias("n_target"))
    out = grid.join(size, CELL, "left").join(truth, ["dataset", "target"], "left").na.fill(0, ["n_dates", "n_pool", "n_target"])
    status = (
        F.when(F.col("n_dates") < F.col("x"), "insufficient_history")
        .when(F.col("n_pool") < min_sessions, "insufficient_volume")
        .when(F.col("n_target") == 0, "no_target_sessions")
        .otherwise("ok")
    )
    return out.withColumn("status", status)


def pool_draws(df: DataFrame, pools: DataFrame, cells: DataFrame, n_scenarios: int, id_: str = "session_id", seed: int = 0) -> DataFrame:
    """Sessions drawn with replacement from the pools: ``n`` for each scenario of each of ``cells`` (CELL, n and columns to carry).

    Pools aren't put together.  Sessions are numbered within their day once; a draw is a place in the pool's days laid end to
    end, which names a day and a number in it.  Neighbouring sessions of a day are a block (``block_``), one row; draws are dealt by
    block and stay with it, so what is counted by block isn't shuffled.
    """
    per_day = df.groupBy("dataset", F.col("date").alias("pool_date")).agg(F.count("*").alias("n_"))
    per_day = per_day.withColumn("day_", F.row_number().over(Window.orderBy("dataset", "pool_date")).cast("long"))  # a row for each date
    held = pools.select(*CELL, "pool_date").join(per_day, ["dataset", "pool_date"]).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("pool_date", "n_", "day_"))).alias("days_"))
    start = "aggregate(slice(days_, 1, i), 0L, (a, x) -> a + x.n_)"
    held = held.select(*CELL, F.expr("aggregate(days_, 0L, (a, x) -> a + x.n_)").alias("size_"), F.expr(f"transform(days_, (d, i) -> struct({start} as start_, {start} + d.n_ as end_, d.day_ as day_))").alias("days_"))
    each = cells.join(held, CELL).filter("n > 0").withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))))
    # the key's text begins alike for all draws of a scenario; a thousand of these are a row, dealt over all tasks
    each = each.withColumns({"key_": F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*CELL, "scenario"])), "n": F.col("n").cast("int")})
    each = each.withColumn("from_", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(1000)))).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "key_", "from_")
    each = each.withColumn("draw", F.explode(F.sequence("from_", F.least("n", F.col("from_") + 999)))).drop("from_")
    each = each.withColumn("at_", F.floor(uniform("key_", "draw") * F.col("size_")))
    each = each.select("*", F.inline("days_")).filter("at_ >= start_ and at_ < end_").withColumn("place_", F.shiftleft("day_", 32) + F.col("at_") - F.col("start_"))
    each = each.drop("days_", "size_", "start_", "end_", "day_", "at_", "n", "key_", "dataset")
    rows = numbered(df, ["dataset", "date"], id_, split=False).join(per_day.select("dataset", F.col("pool_date").alias("date"), "day_"), ["dataset", "date"])
    rows = rows.withColumn("place_", F.shiftleft("day_", 32) + F.col("at_"))
    columns = [c for c in df.columns if c != "date"]
    blocks = rows.groupBy(F.shiftright("place_", BLOCK).alias("block_")).agg(F.sort_array(F.collect_list(F.struct("place_", *columns))).alias("rows_"))
    # draws are many times the sessions, and needn't be sorted
    met = each.join(blocks.hint("shuffle_hash"), F.shiftright("place_", BLOCK) == F.col("block_"))
    session = F.col("rows_")[F.col("place_").bitwiseAND((1 << BLOCK) - 1).cast("int")]
    return met.select(*(c for c in each.columns if c != "place_"), "block_", *(session[c].alias(c) for c in columns))


def rolling_origin(
    df: DataFrame, x_grid: list[int], horizons: list[int], eval_window_days: int = 30, step_days: int = 1, min_sessions: int = 10,
    n_scenarios: int = 5, arms: tuple[str, ...] = ("persistence", "gmm", "gmm_recency"), seed: int = 0,
) -> DataFrame:
    """One row for each cell, scenario, arm and feature with the distribution's distances; cells that can't be scored have
    one row with their status.

    Arms: persistence resamples the pool, gmm draws from one Gaussian of the pool's log features, gmm_recency weighs
    recent days more.  Each arm draws as many sessions as the target day has.  Models are fitted to sums over days
    (``day_moments``), whatever the number of pools a day is in.

    A scenario of a cell (``group_``) is scored in one task, and few rows are sent there: its models, which draw in that task; the
    target day's values, counted once for all cells and sent once for all arms; and the pool's drawn values, counted by block.
    """
    grid = backtest_grid(df, x_grid, horizons, eval_window_days, step_days)
    pools = written(backtest_pools(df, grid))
    status = written(backtest_status(df, grid, pools, min_sessions).withColumn("cell_", F.monotonically_increasing_id()))  # a row for each cell
    ok = status.filter("status = 'ok'")
    columns = [c for c in ("session_id", "dataset", "date", "hour", "duration", "energy") if c in df.columns]
    df, cells = df.select(*columns), ok.select(*CELL, "cell_", F.col("n_target").alias("n"))
    days = G.day_moments(df, ["dataset"]).withColumnRenamed("date", "pool_date")
    of_cells = pools.join(ok.select(*CELL), CELL, "left_semi").join(days, ["dataset", "pool_date"]).withColumnRenamed("pool_date", "date")
    n_groups, n_draws = cells.agg(F.count("*") * n_scenarios, F.coalesce(F.sum("n"), F.lit(0)) * n_scenarios * len(arms)).first()
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, min(n_groups, n_draws >> 19))
    dealt = lambda rows: rows.repartition(tasks, "group_")
    group = (F.col("cell_") * n_scenarios + F.col("scenario")).alias("group_")
    scenarios = F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))).alias("scenario")

    def values(rows: DataFrame, *keys: str) -> DataFrame:
        each = F.inline(F.array(*(F.struct(F.lit(i).alias("feature_"), F.col(f).cast("double").alias("value_")) for i, f in enumerate(FEATURES))))
        return rows.select(*keys, each).filter(F.col("value_").isNotNull() & ~F.isnan("value_"))

    run = lambda arm: (arm * len(FEATURES) + F.col("feature_")).alias("run_")
    counted = values(df, "dataset", "date").groupBy("dataset", "date", "feature_", "value_").agg(F.count("*").alias("a"))
    truth = ok.select("cell_", "dataset", F.col("target").alias("date")).join(counted, ["dataset", "date"]).select("cell_", "feature_", "value_", "a", scenarios)
    truth = dealt(truth.select(group, "feature_", "value_", "a")).withColumn("arm_", F.explode(F.lit(list(range(len(arms))))))
    found = [truth.select("group_", run(F.col("arm_")), "value_", "a", F.lit(0).cast("long").alias("b"))]
    for number, arm in enumerate(arms):
        if arm == "persistence":
            drawn = values(pool_draws(df, pools, cells, n_scenarios, seed=seed).select("block_", group, *FEATURES), "block_", "group_")
            one = dealt(drawn.groupBy("block_", "group_", "feature_", "value_").agg(F.count("*").alias("b")).drop("block_"))
        else:
            params = G.strata_of_days(of_cells, CELL, recency=arm == "gmm_recency")
            each = cells.select("*", scenarios).select("*", group)
            one = values(G.gaussian_sessions(params, each, CELL, seed, carried=("cell_", "group_"), dealt=dealt), "group_").withColumn("b", F.lit(1).cast("long"))
        found.append(one.select("group_", run(F.lit(number)), "value_", F.lit(0).cast("long").alias("a"), "b"))
    scores = counts_compared(reduce(lambda a, b: a.unionByName(b), found), ["group_", "run_"])
    name = lambda names, at: F.element_at(F.lit(list(names)), at.cast("int") + 1)
    scores = scores.withColumns(
        {
            "feature": name(FEATURES, F.col("run_") % len(FEATURES)), "method": name(arms, F.floor(F.col("run_") / len(FEATURES))),
            "scenario": F.pmod("group_", F.lit(n_scenarios)).cast("int"), "cell_": F.expr(f"group_ div {n_scenarios}"),
        }
    )
    scores = scores.join(ok.select(*CELL, "cell_", "status"), "cell_")
    scores = scores.select(*CELL, "scenario", "method", "feature", "n", "m", "ks", "ks_p", "wasserstein", "kl", "status")
    return scores.unionByName(status.filter("status <> 'ok'").select(*CELL, "status"), allowMissingColumns=True)


def energy_crps(df: DataFrame, sim: DataFrame, keys: list[str]) -> DataFrame:
    """CRPS of the total energy of each cell over scenarios; sim has ``keys, scenario, energy``; df has ``keys, truth``."""
    totals = sim.groupBy(*keys, "scenario").agg(F.sum("energy").alias("total"))
    return crps(totals.join(df, keys), "total", "truth", keys)


def count_sanity(df: DataFrame, origins: list[str], horizon: int, n_weeks: int = 1) -> DataFrame:
    """Forecast against true counts for each origin and day ahead, with same-weekday persistence; and their scores by ``metrics``."""
    seen = df.groupBy("date").agg(F.count("*").alias("n_sessions")).select("*", F.explode(F.lit(origins).cast("array<date>")).alias("origin"))
    past = fill_days(seen.filter(F.col("date") <= F.col("origin")), "n_sessions", ("origin",))
    fc = persistence_forecast(past, n_weeks, F.date_add("origin", 1), horizon, ("origin",))
    truth = df.groupBy("date").agg(F.count("*").cast("double").alias("n_true"))
    return fc.join(truth, "date", "left").na.fill(0.0, ["n_true"]).withColumn("offset", F.datediff("date", "origin"))


def count_scores(sanity: DataFrame) -> DataFrame:
    return forecast_metrics(sanity, "n_true", "n_sessions", ("offset",))
