"""Comparing two time series: alignment, scaling, summaries, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles


def aligned(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    """Both values at the timestamps that both have."""
    return a.select(ts, F.col("value").alias("a")).join(b.select(ts, F.col("value").alias("b")), ts)


def rescaled_to_median(df: DataFrame, value: str, target: DataFrame, target_value: str) -> DataFrame:
    """``value`` times the ratio of the medians."""
    middle = lambda t, c, name: percentiles(t.select(F.lit(1).alias("all_"), F.col(c).alias("v_")), ["all_"], "v_", {name: 0.5}).drop("all_")
    m = middle(df, value, "m_").join(F.broadcast(middle(target, target_value, "t_")))
    return df.join(F.broadcast(m)).withColumn("rescaled", F.col(value) * F.try_divide(F.col("t_"), F.col("m_"))).drop("m_", "t_")


def mean_of_means(df: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Sums by the inner keys, then their mean by the outer ones."""
    return df.groupBy(*inner).agg(F.sum(value).alias("s_")).groupBy(*outer).agg(F.avg("s_").alias("mean"))


def series_summary(df: DataFrame, by: str, value: str = "value", ts: str = "ts", reference: str | None = None) -> DataFrame:
    """Mean, median, maximum, the hour at which days peak most often (ties: the earliest), TWh a year, bias in percent."""
    out = df.groupBy(by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), (F.avg(value) * 8760 / 1e9).alias("annual_twh"))
    out = out.join(percentiles(df, [by], value, {"median": 0.5}), by, "left")
    top = df.withColumn("d_", F.to_date(ts)).groupBy(by, "d_").agg(F.max(value).alias("top_"))
    peaks = df.withColumn("d_", F.to_date(ts)).join(top, [by, "d_"]).filter(F.col(value) == F.col("top_"))
    out = out.join(peaks.groupBy(by).agg(F.mode(F.hour(ts), True).alias("peak_hour")), by)
    out = out.select(by, "mean", "median", "max", "annual_twh", "peak_hour")
    if reference is None:
        return out
    base = out.filter(F.col(by) == reference).select(F.col("mean").alias("r_"))
    return out.join(F.broadcast(base)).withColumn("bias_pct", 100 * (F.col("mean") / F.col("r_") - 1)).drop("r_")


def density(df: DataFrame, value: str, points: int = 300, pre_bins: int = 2000) -> DataFrame:
    """Gaussian kernel density on a grid over the values' range; Scott's bandwidth.

    Values are first counted in ``pre_bins`` narrow bins (each at its mean), so the work doesn't grow with their number.
    """
    ends = df.filter(F.col(value).isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))
    width = (F.col("hi") - F.col("lo")) / pre_bins
    bins = df.filter(F.col(value).isNotNull()).join(F.broadcast(ends)).filter("hi > lo")
    bins = bins.groupBy(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(pre_bins - 1)).alias("bin")).agg(F.avg(value).alias("x"), F.count("*").alias("w"))
    grid = ends.filter("hi > lo").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.select("i", "n", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("at"), (F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    each = grid.join(F.broadcast(bins))  # at most points x pre_bins rows
    z = (F.col("at") - F.col("x")) / F.col("h")
    return each.groupBy("i", "at").agg((F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.first(F.col("n") * F.col("h")) / F.sqrt(2 * F.pi())).alias("density"))
