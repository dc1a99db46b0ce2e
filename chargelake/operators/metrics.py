"""Scores of forecasts and of simulated against real distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import scenario_bands
from .ranks import running

EPS = 1e-6


def forecast_metrics(df: DataFrame, y: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rmse, mae, bias, mape and smape (percent) over pairs, in one aggregation."""
    d = F.col(p) - F.col(y)
    pairs = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    return pairs.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        (100 * F.avg(F.abs(d / (F.col(y) + EPS)))).alias("mape"),
        (100 * F.avg(F.abs(d) / ((F.abs(F.col(y)) + F.abs(F.col(p))) / 2 + EPS))).alias("smape"),
    )


def sides(real: DataFrame, sim: DataFrame, features: dict[str, str], by: tuple[str, ...]) -> DataFrame:
    """Long (by, feature, value, side) of two tables; features: name in real to name in sim; absent ones are skipped."""
    have = {r: s for r, s in features.items() if r in real.columns and s in sim.columns}
    a = real.select(*by, *(F.col(r).cast("double").alias(r) for r in have)).unpivot(list(by), list(have), "feature", "value_").withColumn("side", F.lit(0))
    b = sim.select(*by, *(F.col(s).cast("double").alias(r) for r, s in have.items())).unpivot(list(by), list(have), "feature", "value_").withColumn("side", F.lit(1))
    return a.unionByName(b).filter(F.col("value_").isNotNull() & ~F.isnan("value_"))


#: Of samples whose sizes multiply to at most this the p-value is exact.
EXACT_UP_TO = 10_000


def exact_p(d: Column, n: Column, m: Column) -> Column:
    """The probability that two samples of n and m values of one distribution differ by ``d`` or more.

    All orders of the values are paths on a lattice from (0, 0) to (n, m), each as likely.  Row by row of the lattice, an
    array holds the probability of reaching each point by a path that stays under d: a point is reached from the left in
    j of i + j cases and from below in i.  What doesn't arrive at (n, m) is the p-value.
    """
    # in units of 1 / (n m), where the distance at (i, j) is |i m - j n|, a whole number; d is one such
    n, m = n.cast("long"), m.cast("long")
    limit = F.round(d * n * m).cast("long")
    inside = lambda i, j: F.abs(i * m - j * n) < limit
    places = F.sequence(F.lit(1).cast("long"), m)

    def row(before: Column, i: Column) -> Column:
        """Arrays grow by one: the chance of (i, j) from (i - 1, j), which ``before`` holds, and (i, j - 1), the last."""
        start = F.array(F.when(inside(i, F.lit(0)), F.element_at(before, 1)).otherwise(0.0))

        def point(done: Column, j: Column) -> Column:
            reached = (F.element_at(before, (j + 1).cast("int")) * i + F.element_at(done, -1) * j) / (i + j)
            return F.array_append(done, F.when(inside(i, j), reached).otherwise(0.0))

        return F.aggregate(places, start, point)

    first = F.transform(F.sequence(F.lit(0).cast("long"), m), lambda j: F.when(F.abs(j * n) < limit, F.lit(1.0)).otherwise(0.0))
    # along the bottom all points before (0, j) must be inside too; they are, as the distance grows with j
    last = F.aggregate(F.sequence(F.lit(1).cast("long"), n), first, row)
    return F.when(limit <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(1.0 - F.element_at(last, -1), F.lit(0.0)), F.lit(1.0)))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Exact for small samples (EXACT_UP_TO), asymptotic for others."""
    return F.when(n.cast("double") * m.cast("double") <= EXACT_UP_TO, exact_p(d, n, m)).otherwise(kolmogorov(d, n.cast("double"), m.cast("double")))


def kolmogorov(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic."""
    t = d * F.sqrt(n * m / (n + m))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t))
    return F.when(t < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def ks_wasserstein(long: DataFrame, by: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov D and p-value and Wasserstein-1 distance of the two sides.

    Values are first counted, so windows run over distinct values; both distances come from one running sum, of which a
    large group's is split over tasks (``running``).
    """
    values = long.groupBy(*by, "value_").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sizes = values.groupBy(*by).agg(F.sum("a").alias("n"), F.sum("b").alias("m")).filter("n > 0 and m > 0")
    gap = F.abs(F.col("a_upto") / F.col("n") - F.col("b_upto") / F.col("m"))
    steps = running(values, by, "value_", ["a", "b"]).join(sizes, by).withColumn("gap", gap)
    out = steps.groupBy(*by).agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * (F.col("next_") - F.col("value_"))), F.lit(0.0)).alias("wasserstein"), F.first("n").alias("n"), F.first("m").alias("m"))
    return out.withColumn("ks_p", ks_p_value(F.col("ks"), F.col("n"), F.col("m")))


def kl_divergence(long: DataFrame, by: list[str], bins: int = 50, eps: float = 1e-9) -> DataFrame:
    """Of the real (side 0) against the simulated histogram on shared bins; densities get ``eps`` and are normalised."""
    ends = long.groupBy(*by).agg(F.min("value_").alias("lo"), F.max("value_").alias("hi"), F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    ends = ends.filter("n > 0 and m > 0")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value_") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = long.join(ends, by).groupBy(*by, place.cast("int").alias("bin")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [*by, "bin"], "left").na.fill(0, ["a", "b"])
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    p, q = F.col("a") / F.col("n") / w + eps, F.col("b") / F.col("m") / w + eps
    dens = grid.withColumns({"p": p, "q": q})
    sums = dens.groupBy(*by).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    x, y = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return dens.join(sums, by).groupBy(*by).agg(F.sum(x * F.ln(x / y) - x + y).alias("kl"))


def small_groups_compared(long: DataFrame, by: list[str], bins: int = 50, eps: float = 1e-9) -> DataFrame:
    """``by, n, m, ks, ks_p, wasserstein, kl`` of many groups that are small: both distances and the histograms from one shuffle.

    Rows are dealt by group once; counts of values, running sums and bins all stay in their task.
    """
    values = long.repartition(*by).groupBy(*by, "value_").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return counts_compared(values, by, bins, eps)


def counts_compared(values: DataFrame, by: list[str], bins: int = 50, eps: float = 1e-9) -> DataFrame:
    """``small_groups_compared`` of counts: ``by, value_, a, b``, of each side so many; a value may have several rows.

    Rows that are dealt by some of ``by`` already stay where they are.  Bins without a value aren't rows: their part of the divergence
    is the same for each, so it is multiplied.
    """
    every, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("value_")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)  # with all rows of the value
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the same pass
    steps = values.withColumns(
        {
            "n": F.sum("a").over(whole), "m": F.sum("b").over(whole), "lo": F.min("value_").over(whole), "hi": F.max("value_").over(whole),
            "a_upto": F.sum("a").over(upto), "b_upto": F.sum("b").over(upto), "next_": F.lead("value_").over(order),
        }
    ).filter("n > 0 and m > 0")
    spread = F.col("hi") > F.col("lo")
    width = F.when(spread, F.col("hi") - F.col("lo")).otherwise(1.0) / bins
    place = F.when(spread, F.least(F.floor((F.col("value_") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    gap = F.abs(F.col("a_upto") / F.col("n") - F.col("b_upto") / F.col("m"))
    steps = steps.select(*by, place.cast("int").alias("bin"), width.alias("width"), "n", "m", "a", "b", gap.alias("gap"), (gap * (F.col("next_") - F.col("value_"))).alias("area"))
    held = steps.groupBy(*by, "bin", "n", "m", "width").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("gap").alias("gap"), F.sum("area").alias("area"))
    p, q = F.col("a") / F.col("n") / F.col("width") + eps, F.col("b") / F.col("m") / F.col("width") + eps
    empty = bins - F.count("*").over(every)
    held = held.withColumns({"p": p, "q": q, "empty": empty})
    held = held.withColumns({"sp": F.sum("p").over(every) + F.col("empty") * eps, "sq": F.sum("q").over(every) + F.col("empty") * eps})
    part = lambda x, y: x * F.ln(x / y) - x + y
    nothing = F.first(F.col("empty") * part(eps / F.col("sp"), eps / F.col("sq")))
    out = held.groupBy(*by, "n", "m").agg(F.max("gap").alias("ks"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("wasserstein"), (F.sum(part(F.col("p") / F.col("sp"), F.col("q") / F.col("sq"))) + nothing).alias("kl"))
    return out.withColumn("ks_p", ks_p_value(F.col("ks"), F.col("n"), F.col("m")))


def distribution_comparison(real: DataFrame, sim: DataFrame, features: dict[str, str] | None = None, by: tuple[str, ...] = (), bins: int = 50, split: bool = True) -> DataFrame:
    """One row for each feature (and group): ks, ks_p, wasserstein, kl.  split: groups may be large, so each is many tasks."""
    pairs = features or {f: f for f in ("hour", "duration", "energy")}
    if "hour" in pairs and "arrival_hour" in sim.columns:
        pairs = pairs | {"hour": "arrival_hour"}
    long, keys = sides(real, sim, pairs, by), [*by, "feature"]
    if not split:
        return small_groups_compared(long, keys, bins).select(*keys, "n", "m", "ks", "ks_p", "wasserstein", "kl")
    return ks_wasserstein(long, keys).join(kl_divergence(long, keys, bins), keys).select(*keys, "n", "m", "ks", "ks_p", "wasserstein", "kl")


def crps(df: DataFrame, value: str, truth: str, by: list[str]) -> DataFrame:
    """Of an ensemble: mean |s - y| less half the mean pair distance, the latter by ranks and without a self-join."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    m = F.count("*")
    half = F.sum((2 * F.col("i_")) * F.col(value)) - (m + 1) * F.sum(value)
    return rows.withColumn("i_", rank).groupBy(*by).agg((F.avg(F.abs(F.col(value) - F.col(truth))) - half / (m * m)).alias("crps"), m.alias("members"))


def median_evaluation(scenarios: DataFrame, value: str, truth: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """Days, mean absolute error of the scenarios' median, and its percentage where the truth is above 0."""
    both = scenario_bands(scenarios, value, keys).select(*keys, "median").join(truth.select(*keys, F.col(y).alias("y_")), keys)
    gap = F.abs(F.col("median") - F.col("y_"))
    return both.agg(F.count("*").alias("n_days"), F.avg(gap).alias("mae"), F.avg(F.when(F.col("y_") > 0, 100 * gap / F.col("y_"))).alias("mape"))


def profile_error(real: DataFrame, sim: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE of 24-hour profiles, also relative to the real mean power; null where that is nil."""
    pair = real.select(*keys, "h", F.col("mw").alias("y")).join(sim.select(*keys, "h", F.col("mw").alias("p")), [*keys, "h"])
    out = pair.groupBy(*keys).agg(F.sqrt(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("rmse"), F.avg("y").alias("mean_"))
    return out.withColumn("nrmse", F.when(F.col("mean_") > 1e-9, F.col("rmse") / F.col("mean_"))).drop("mean_")


def cell_coverage(res: DataFrame, cell: list[str], by: str) -> DataFrame:
    """Cells by status, and the percentage that is ok."""
    out = res.dropDuplicates([*cell]).groupBy(by).agg(F.count("*").alias("n_cells"), F.count_if(F.col("status") == "ok").alias("n_ok"))
    return out.withColumn("pct_ok", 100.0 * F.col("n_ok") / F.col("n_cells"))


def mean_by(res: DataFrame, value: str, keys: list[str], baseline: str) -> DataFrame:
    """Mean of a score by arm and keys, and its ratio to the baseline arm's."""
    m = res.groupBy(*keys, "method").agg(F.avg(value).alias("mean"))
    base = m.filter(F.col("method") == baseline).select(*keys, F.col("mean").alias("base_"))
    return m.join(base, keys, "left").withColumn("ratio", F.try_divide(F.col("mean"), F.col("base_"))).drop("base_")


def win_rates(res: DataFrame, score: str, cell: list[str], arms: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Share of cells, among those with all arms, in which each arm has the lowest mean score (to 9 places; ties: the first arm)."""
    wide = res.groupBy(*cell).pivot("method", arms).agg(F.round(F.avg(score), 9)).na.drop(subset=arms)
    least = F.least(*(F.col(a) for a in arms)) if len(arms) > 1 else F.col(arms[0])
    winner = F.coalesce(*(F.when(F.col(a) == least, F.lit(a)) for a in arms))
    wins = wide.withColumn("winner", winner)
    share = wins.groupBy(*by).agg(F.count("*").alias("n_cells"), *(F.avg((F.col("winner") == a).cast("double")).alias(a) for a in arms))
    return share.unpivot([*by, "n_cells"], arms, "method", "win_rate")


def pairwise_win_rate(res: DataFrame, score: str, cell: list[str], baseline: str) -> DataFrame:
    """Share of cells in which an arm scores lower than the baseline."""
    m = res.groupBy(*cell, "method").agg(F.avg(score).alias("s_"))
    base = m.filter(F.col("method") == baseline).select(*cell, F.col("s_").alias("base_"))
    both = m.filter(F.col("method") != baseline).join(base, cell)
    return both.groupBy("method").agg(F.count("*").alias("n_cells"), F.avg((F.col("s_") < F.col("base_")).cast("double")).alias("win_rate"))


def energy_bias(real: DataFrame, sim: DataFrame, by: list[str]) -> DataFrame:
    """Total simulated less real energy, in kWh and percent."""
    a = real.groupBy(*by).agg(F.sum("energy").alias("y_"))
    b = sim.groupBy(*by).agg(F.sum("energy").alias("p_"))
    out = a.join(b, by).withColumn("bias_kwh", F.col("p_") - F.col("y_"))
    return out.withColumn("bias_pct", 100 * F.try_divide(F.col("bias_kwh"), F.col("y_"))).drop("y_", "p_")
