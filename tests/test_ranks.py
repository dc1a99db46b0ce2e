"""Running sums and percentiles of large groups in equal parts."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chargelake.operators import gaussian, ranks
from chargelake.operators.metrics import exact_p, ks_p_value
from chargelake.sources import readers


@pytest.mark.parametrize("shape", ["one outlier", "uniform", "skewed", "two groups"])
def test_no_part_is_above_twice_the_mean(spark, shape):
    rows = spark.range(100_000).withColumn("k", F.lit("a"))
    value = {
        "one outlier": F.when(F.col("id") == 0, 0.0).otherwise(1000 + F.col("id") / 1000), "uniform": F.col("id") / 7, "skewed": F.exp(F.col("id") / 5000), "two groups": F.col("id") + 0.5,
    }[shape]
    rows = rows.withColumn("v", value.cast("double"))
    if shape == "two groups":
        rows = rows.withColumn("k", F.when(F.col("id") < 10, "b").otherwise("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranks.dealt_by_order(rows, ["k"], "v").groupBy("part_").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) <= 2 * 100_000 / len(sizes)


@pytest.mark.parametrize("split", [True, False])
def test_running_sums_and_next_values(spark, split):
    rnd = random.Random(4)
    rows = [(k, v, rnd.randrange(9)) for k, n in (("a", 500), ("b", 3), ("c", 1)) for v in rnd.sample(range(10_000), n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["v"]): (r["c_upto"], r["next_"]) for r in ranks.running(spark.createDataFrame(rows, "k string, v int, c int"), ["k"], "v", ["c"], split).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in "abc":
        mine = sorted((v, c) for key, v, c in rows if key == k)
        for n, (v, _) in enumerate(mine):
            assert got[k, v] == (sum(c for _, c in mine[: n + 1]), mine[n + 1][0] if n + 1 < len(mine) else None)


@pytest.mark.parametrize("split", [True, False])
def test_percentiles_leave_out_nulls_and_nan(spark, split):
    values = [1.0, 2.0, math.nan, math.inf, None, 2.0, -5.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    got = ranks.percentiles(df, ["k"], "v", {"median": 0.5, "p25": 0.25, "low": 0.0}, split).collect()
    assert [tuple(r) for r in got] == [("a", 2.0, 1.0, -5.0)]


def test_percentiles_of_a_large_group(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(5003)) / 7).alias("v"))
    want = np.percentile(df.select("v").toPandas()["v"], [5, 50, 99])
    got = ranks.percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(want))


@pytest.mark.parametrize("rows", [4, 10, 1000])
def test_windows_over_ranges_equal_windows_over_the_series(spark, rows):
    rnd = random.Random(2)
    data = [(k, t, rnd.random()) for k, n in (("a", 57), ("b", 4)) for t in rnd.sample(range(1000), n)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    near = ranks.overlapping_ranges(df, ["k"], "t", 3, 2, rows)
    inside = Window.partitionBy("k", "block_").orderBy("t").rowsBetween(-3, 2)
    got = {(r["k"], r["t"]): r["s"] for r in near.withColumn("s", F.sum("v").over(inside)).filter("own_").collect()}
    whole = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t").rowsBetween(-3, 2))).collect()
    assert len(got) == len(data) and all(got[r["k"], r["t"]] == pytest.approx(r["s"]) for r in whole)
    assert near.filter("own_").select("block_").distinct().count() == -(-57 // rows)


@pytest.mark.parametrize("cap", [0, 1, 3, 40, 10_000])
def test_capped_contexts_equal_ranking_them(spark, cap):
    df = spark.createDataFrame([(i, "a" if i % 9 else "b") for i in range(3000)] + [(7, "a")] * 3, "session_id int, k string")
    w = Window.partitionBy("k").orderBy(F.md5(F.concat_ws("|", F.lit("0"), F.col("session_id").cast("string"))), "session_id")
    want = df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).drop("r")
    assert sorted(map(tuple, gaussian.capped(df, ["k"], cap).collect())) == sorted(map(tuple, want.collect()))


def test_only_missing_cells_are_built(spark, tmp_path):
    built = []

    def build(missing):
        built.append(sorted(r["c"] for r in missing.collect()))
        return missing.filter("c <> 3").withColumn("v", F.col("c") * 10)

    cells = lambda *c: spark.createDataFrame([(x,) for x in c], "c int")
    call = lambda *c, config=1: sorted(r["v"] for r in readers.cached_cells(spark, build, cells(*c), ["c"], {"x": config}, f"file://{tmp_path}").collect())
    assert call(1, 2, 2) == [10, 20] and call(2, 3, 4) == [20, 40] and call(3) == [] and call(1, 4) == [10, 40]
    assert call(1, config=2) == [10]
    assert built == [[1, 2], [3, 4], [1]]


def test_tables_can_be_dropped(spark):
    table = readers.written(spark.range(3))
    path = table.inputFiles()[0]
    assert readers.drop_written(spark) >= 1 and readers.drop_written(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|no such file"):
        spark.read.parquet(path).count()


def test_exact_p_values_equal_counting_paths(spark):
    """All orders of two samples, by whole numbers."""

    def counted(limit, n, m):
        paths = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) < limit:
                    paths[i][j] = 1 if i == j == 0 else (paths[i - 1][j] if i else 0) + (paths[i][j - 1] if j else 0)
        return float(1 - Fraction(paths[n][m], math.comb(n + m, n)))

    cases = [(k / (n * m), n, m) for n, m in [(1, 1), (3, 5), (10, 10), (33, 20), (90, 100), (7, 300)] for k in (0, 1, n, n * m // 3, n * m // 2, n * m)]
    df = spark.createDataFrame(cases, "d double, n long, m long").withColumn("p", exact_p(F.col("d"), F.col("n"), F.col("m")))
    for r in df.collect():
        assert r["p"] == pytest.approx(counted(round(r["d"] * r["n"] * r["m"]), r["n"], r["m"]), abs=1e-12)


def test_p_values_are_asymptotic_beyond_the_limit(spark):
    df = spark.createDataFrame([(0.1, 100, 100), (0.1, 101, 100)], "d double, n long, m long")
    exact, other = (r["p"] for r in df.select(ks_p_value(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect())
    assert exact == pytest.approx(0.7021, abs=1e-3) and other == pytest.approx(0.6918, abs=5e-3)
