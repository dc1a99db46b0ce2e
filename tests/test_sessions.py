"""Properties of the session operators on small tables."""

import glob
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargelake.functions import expressions as E
from chargelake.operators import aggregate as A
from chargelake.operators import forecast as R
from chargelake.operators import gaussian as G
from chargelake.operators import loadcurve as L
from chargelake.operators import metrics as M
from chargelake.operators import ranks
from chargelake.operators import schema as S
from chargelake.operators import smart as C
from chargelake.queries import scores
from chargelake.plans import backtest as B
from chargelake.queries.adapters import event_sessions, order_sessions, price_signal, raw_events
from chargelake.sources import readers
from chargelake.streaming import validated_stream

SF = "/root/testdata/sf0.001"


def sessions_of(spark, rows):
    """(arrival, duration, energy, power)"""
    df = spark.createDataFrame([(i, a, float(d), float(e), float(p)) for i, (a, d, e, p) in enumerate(rows)], "session_id long, arrival_time string, duration double, energy double, power_kw double")
    return S.validate(df).withColumnRenamed("power", "power_kw")


def test_names_units_and_noise(spark):
    raw = spark.createDataFrame([("2024-01-01 10:30:00", 4.5, 90.0, "12.5", 1, " Bureau ")], ["Start", "Arrival", "Park.Duration", "Energy", "Day", "Site Type"])
    row = S.validate(raw).first()
    assert row["arrival_time"] == dt.datetime(2024, 1, 1, 10, 30) and row["duration"] == 1.5 and row["energy"] == 12.5
    assert row["location_type"] == "work" and row["hour"] == 10.5 and row["Arrival"] == 4.5 and "Day" not in row.asDict()


def test_missing_and_bad_columns_raise(spark):
    with pytest.raises(ValueError):
        S.validate(spark.createDataFrame([(1.0,)], ["duration"]))
    with pytest.raises(Exception, match="not a timestamp"):
        S.validate(spark.createDataFrame([("soon", 1.0, 2.0)], ["arrival_time", "duration", "energy"])).collect()
    with pytest.raises(ValueError):
        S.validate(spark.createDataFrame([("2024-01-01", 200.0, 2.0)], ["arrival_time", "duration", "energy"]), strict=True)


def test_combined_sites_warn(spark):
    df = spark.createDataFrame([("Caltech",), ("jpl",), (None,)], ["Data"])
    with pytest.warns(UserWarning):
        assert S.combined_sites(df) == ["caltech", "jpl"]
    assert S.combined_sites(spark.createDataFrame([("caltech",), ("home",)], ["data"])) == []


@pytest.mark.parametrize("arrival,duration,power", [("2024-01-01 10:00:00", 2, 7.4), ("2024-01-01 23:00:00", 3, 10), ("2024-01-01 22:00:00", 47, 5)])
def test_profile_conserves_energy(spark, arrival, duration, power):
    df = sessions_of(spark, [(arrival, duration, duration * power, power)])
    rows = L.energy_24h(df.withColumn("all", F.lit(1)), ["all"]).collect()
    assert sum(r["kwh"] for r in rows) == pytest.approx(duration * power)


def test_smart_is_never_dearer_and_keeps_rows(spark):
    s = event_sessions(spark, SF)
    out = C.smart_charge(s, price_signal(s))
    assert out.count() == s.count()
    assert out.filter("cost_smart > cost_plug + 1e-9").count() == 0
    assert C.smart_charge(out, price_signal(s)).columns == out.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    same = C.regret({"oracle": s, "copy": s}, price_signal(s)).filter("strategy = 'copy'").first()
    assert same["regret"] == pytest.approx(0) and same["regret_per_kwh"] == pytest.approx(0)


@pytest.mark.parametrize("model", ["linear", "s_curve", "bass"])
def test_growth_starts_at_base(spark, model):
    base = spark.createDataFrame([("a", 120.0)], ["department", "base"])
    rows = R.growth_projection(base, "2025-01-01", 5, model).orderBy("date").collect()
    assert rows[0]["expected"] == pytest.approx(120.0) and len(rows) == round(365.25 * 5)
    assert all(x["expected"] <= y["expected"] for x, y in zip(rows, rows[1:]))
    with pytest.raises(ValueError):
        R.growth_projection(base, "2025-01-01", 5, "none")


def test_metrics_known_values(spark):
    two = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0)], ["y", "p"])
    assert M.forecast_metrics(two, "y", "p").first()["rmse"] == 1.0
    ens = lambda values, y: M.crps(spark.createDataFrame([(1, float(v), float(y)) for v in values], ["k", "s", "y"]), "s", "y", ["k"]).first()["crps"]
    assert ens([10] * 20, 10) == 0 and ens([7], 10) == 3 and ens(range(0, 21), 10) > ens(range(9, 12), 10)
    a = spark.createDataFrame([(float(i),) for i in range(100)], ["energy"])
    same = M.distribution_comparison(a, a, {"energy": "energy"}).first()
    assert same["ks"] == 0 and same["wasserstein"] == 0 and same["kl"] == pytest.approx(0) and same["ks_p"] == 1
    shifted = M.distribution_comparison(a, a.select((F.col("energy") + 5).alias("energy")), {"energy": "energy"}).first()
    assert shifted["wasserstein"] == pytest.approx(5)


def daily(spark, days, per_day=12):
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} {6 + k % 14:02d}:00:00", 2, 5 + k, 7.4) for d in range(days) for k in range(per_day(d) if callable(per_day) else per_day)]
    return sessions_of(spark, rows).withColumn("dataset", F.lit("d"))


def test_backtest_pools_have_no_future(spark):
    df = daily(spark, 56)
    grid = B.backtest_grid(df, [1, 4], [1, 2, 8], 10)
    pools = B.backtest_pools(df, grid)
    assert pools.filter("pool_date > origin or pool_date >= target or weekday(pool_date) <> weekday(target)").count() == 0
    status = {r["status"] for r in B.backtest_status(df, grid, pools).select("status").distinct().collect()}
    assert status == {"ok"}
    thin = daily(spark, 28, 1)
    assert {r[0] for r in B.backtest_status(thin, B.backtest_grid(thin, [2], [1], 5), B.backtest_pools(thin, B.backtest_grid(thin, [2], [1], 5))).select("status").distinct().collect()} == {"insufficient_volume"}
    short = B.backtest_grid(thin, [9], [1], 5)
    assert {r[0] for r in B.backtest_status(thin, short, B.backtest_pools(thin, short)).select("status").distinct().collect()} == {"insufficient_history"}
    with pytest.raises(ValueError):
        B.backtest_grid(df, [1], [30], 10)


def test_backtest_scores_all_arms(spark):
    out = B.rolling_origin(daily(spark, 42), [2], [1], 6, 3, n_scenarios=2)
    got = {(r["method"], r["feature"]) for r in out.filter("status = 'ok'").collect()}
    assert got == {(m, f) for m in ("persistence", "gmm", "gmm_recency") for f in ("hour", "duration", "energy")}


def rows_shuffled(df):
    """By the last run of ``df``, in all exchanges of its plan."""
    seen = {}

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            seen[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    walk(plan)
    return sum(seen.values())


def test_backtest_shuffles_fewer_rows_than_it_draws(spark):
    """Few different values, many sessions: only the persistence arm's draws are dealt, once; the others and what is compared stay in their task."""
    rows = spark.range(42 * 1000).selectExpr("id as session_id", "'d' as dataset", "date_add(date'2024-01-01', cast(id div 1000 as int)) as date", "id % 20 + 1D as hour", "id % 7 + 1D as duration", "id % 11 + 2D as energy")
    for arms, dealt in ((("gmm", "gmm_recency"), 0), (("persistence",), 1), (("persistence", "gmm", "gmm_recency"), 1)):
        out = B.rolling_origin(rows, [2], [1], 6, 1, n_scenarios=5, arms=arms)
        drawn = 6 * 5 * 1000
        assert 0 <= rows_shuffled(out) - dealt * (rows.count() + drawn) < 0.3 * drawn  # sessions are numbered
        assert out.filter("n <> 1000 or m <> 1000 or status <> 'ok'").count() == 0 and out.count() == 6 * 5 * 3 * len(arms)


def test_draws_lie_in_blocks_of_a_day(spark, monkeypatch):
    """The same sessions are drawn whatever the size of a block, from days that are many blocks and days that are one."""
    df = daily(spark, 42, lambda d: 12 + 40 * (d % 2))
    grid = B.backtest_grid(df, [1, 3], [1, 2], 6)
    pools = B.backtest_pools(df, grid)
    cells = B.backtest_status(df, grid, pools).filter("status = 'ok'").select(*B.CELL, F.col("n_target").alias("n"))
    found = []
    for digits in (16, 3):
        monkeypatch.setattr(B, "BLOCK", digits)
        draws = B.pool_draws(df, pools, cells, 2)
        found.append((draws.select("block_").distinct().count(), sorted(map(tuple, draws.select(*B.CELL[1:], "scenario", "draw", "session_id").collect()))))
    assert found[0][1] == found[1][1] and len(found[0][1]) == 2 * cells.agg(F.sum("n")).first()[0] and found[1][0] > 3 * found[0][0]


def test_counts_of_a_value_may_be_several_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v), int(s)) for k in ("a", "b") for v, s in zip(rng.integers(0, 9, 400), rng.integers(0, 2, 400))]
    long = spark.createDataFrame(rows, "k string, value_ double, side int")
    split = long.selectExpr("k", "value_", "1L - side as a", "cast(side as long) as b")
    one, other = (out.orderBy("k").select("k", "n", "m", "ks", "ks_p", "wasserstein", "kl").collect() for out in (M.small_groups_compared(long, ["k"]), M.counts_compared(split, ["k"])))
    assert [list(r)[1:] for r in one] == [pytest.approx(list(r)[1:], abs=1e-12) for r in other]


def test_bootstrap_and_draws(spark):
    pool = daily(spark, 14)
    draws = spark.createDataFrame([("d", 500)], "dataset string, n long")
    out = R.bootstrap_sessions(pool, draws, ["dataset"], 2)
    assert out.count() == 1000 and out.select("session_id").distinct().count() > 100
    with pytest.raises(ValueError):
        R.bootstrap_sessions(pool.drop("dataset"), draws, ["dataset"])
    u = spark.range(4000).select(E.draw({1.0: 3, 2.0: 1}, E.uniform("id")).alias("k")).groupBy("k").count().collect()
    assert {r["k"]: r["count"] / 4000 for r in u}[1.0] == pytest.approx(0.75, abs=0.03)


def test_gaussian_draws_have_the_models_moments(spark):
    s = order_sessions(spark, SF)
    p = G.gaussian_strata(s, ["location_type"])
    drawn = S.to_features(G.gaussian_sessions(p, p.select("location_type", F.lit(3000).alias("n")), ["location_type"]))
    q = drawn.groupBy("location_type").agg(F.avg("f_energy").alias("m"), F.avg("f_duration").alias("d"))
    for r in q.join(p, "location_type").collect():
        assert r["m"] == pytest.approx(r["m2"], abs=0.1) and r["d"] == pytest.approx(r["m1"], abs=0.1)


def test_draws_of_one_context_are_dealt_to_all_tasks(spark):
    """Every draw once, from several tasks; none of 0."""
    numbers = {"m0": 12.0, "m1": 1.0, "m2": 2.0, "c00": 1.0, "c01": 0.0, "c02": 0.0, "c11": 0.1, "c12": 0.0, "c22": 0.1}
    p = spark.createDataFrame([("home", 10_500), ("work", 1), ("heavy", 0)], "location_type string, n long").withColumns({c: F.lit(v) for c, v in numbers.items()})
    drawn = G.gaussian_sessions(p, p.select("location_type", "n"), ["location_type"]).withColumn("task", F.spark_partition_id())
    rows = {r["location_type"]: r for r in drawn.groupBy("location_type").agg(F.count("*").alias("c"), F.countDistinct("draw").alias("d"), F.min("draw").alias("lo"), F.max("draw").alias("hi"), F.countDistinct("task").alias("tasks")).collect()}
    assert tuple(rows["home"])[1:5] == (10_500, 10_500, 1, 10_500) and tuple(rows["work"])[1:5] == (1, 1, 1, 1) and "heavy" not in rows
    assert rows["home"]["tasks"] > 4


def test_mixture_likelihood_rises(spark, tmp_path):
    _, trace = G.gaussian_mixtures(order_sessions(spark, SF), ["location_type"], 2, f"file://{tmp_path}", rounds=4)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))


def test_mixtures_iterate_until_they_converge(spark, tmp_path):
    _, trace = G.gaussian_mixtures(order_sessions(spark, SF), ["location_type"], 2, f"file://{tmp_path}")
    assert 8 < len(trace) < 300 and abs(trace[-1] - trace[-2]) < 1e-3


def test_json_with_a_schema_is_read_once(spark, tmp_path):
    raw = spark.range(20).selectExpr("id as session_id", "id / 2D as energy")
    readers.export(raw, f"file://{tmp_path}/a.jsonl")
    read = readers.read_table(spark, f"file://{tmp_path}/a.jsonl", schema="session_id long, energy double, note string")
    assert read.columns == ["session_id", "energy", "note"] and read.agg(F.sum("energy")).first()[0] == 95.0


def test_drawn_sessions_are_scheduled_once(spark, monkeypatch):
    """However often the backtest draws a session; and draws, many times the sessions, are joined without being sorted."""
    seen, smart_charge = [], scores.C.smart_charge
    monkeypatch.setattr(scores.C, "smart_charge", lambda df, *a, **k: seen.append(df.count()) or smart_charge(df, *a, **k))
    scores.scheduled_backtest(spark, SF)
    assert seen == [scores.event_sessions(spark, SF).count()]
    s, pools, ok = scores.scored_cells(spark, SF)
    plan = scores.drawn(s.select("session_id", "dataset", "date", "energy"), pools, ok, 2)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_equal_sessions_are_one_row_of_a_mixture(spark, tmp_path):
    """Ten copies of each session: packs hold the sessions once, and the mixture is that of single ones."""
    s = order_sessions(spark, SF).filter("location_type = 'work'").select("location_type", "hour", "duration", "energy")
    copies = s.crossJoin(spark.range(10).select(F.col("id").alias("copy"))).drop("copy")
    found = []
    for name, df in (("one", s), ("ten", copies)):
        params, trace = G.gaussian_mixtures(df, ["location_type"], 2, f"file://{tmp_path}/{name}", rounds=3)
        bytes_ = spark.read.parquet(*glob.glob(f"{tmp_path}/{name}/*/packs")).agg(F.sum(F.length("pack"))).first()[0]
        assert bytes_ == 32 * s.distinct().count()
        found.append((trace, [tuple(r)[3:] for r in params.drop("mass").orderBy("k").collect()]))
    assert found[0][0] == pytest.approx(found[1][0], abs=1e-9)
    assert [x for r in found[0][1] for x in r] == pytest.approx([x for r in found[1][1] for x in r], abs=1e-6)


def test_component_counts_up_to_ten_or_a_fifth_of_the_rows(spark, tmp_path):
    s = order_sessions(spark, SF)
    few = s.orderBy("session_id").limit(24)
    assert [r["k"] for r in sorted(G.component_count_by_bic(few, f"file://{tmp_path}", rounds=5).collect())] == [2, 3, 4]
    found = G.component_count_by_bic(s.orderBy("session_id").limit(60), f"file://{tmp_path}", rounds=5).collect()
    assert sorted(r["k"] for r in found) == list(range(2, 11))
    table, _ = G.component_counts(few.withColumn("all_", F.lit(1)), ["all_"], f"file://{tmp_path}", rounds=5)
    assert sorted(r["kk"] for r in table.collect()) == [2, 3, 4] and table.filter("best").count() == 1


def test_component_counts_differ_between_contexts(spark, tmp_path):
    """Two clouds in one context, three in the other, one session too few in a third."""
    rng, rows = np.random.default_rng(0), []
    for ctx, centres in (("two", (2.0, 4.0)), ("three", (1.0, 3.0, 5.0))):
        for i in range(300):
            c = centres[i % len(centres)]
            rows.append((f"{ctx}{i}", ctx, *map(float, (4 * c + rng.normal() * 0.3, np.expm1(0.5 + rng.normal() * 0.05), np.expm1(c + rng.normal() * 0.1)))))
    rows += [(f"few{i}", "few", 1.0, 1.0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "session_id string, ctx string, hour double, duration double, energy double").withColumn("date", F.lit("2024-01-01").cast("date"))
    table, params = G.component_counts(df, ["ctx"], f"file://{tmp_path}", most=5, rounds=60)
    best = {r["ctx"]: r["kk"] for r in table.filter("best").collect()}
    assert best == {"two": 2, "three": 3}
    means = sorted(round(r["m2"], 1) for r in params.filter("ctx = 'three'").collect())
    assert means == [1.0, 3.0, 5.0] and params.groupBy("ctx").agg(F.round(F.sum("weight"), 6).alias("w")).filter("w <> 1").count() == 0


def test_percentiles_running_sums_and_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.lognormal(0, 2, 500)] + [("b", 3.0)] * 7 + [("c", float(v)) for v in rng.integers(-5, 6, 40)] + [("d", None), ("e", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    for split in (True, False):
        got = {r["k"]: r for r in ranks.percentiles(df, ["k"], "v", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}, split).collect()}
        assert set(got) == {"a", "b", "c", "e"}
        for k in got:
            values = [v for g, v in rows if g == k]
            assert np.allclose([got[k][f"p{q}"] for q in (0, 25, 50, 99, 100)], np.percentile(values, [0, 25, 50, 99, 100]))
    ids = spark.range(1000).selectExpr("id", "id % 3 as k")
    a, b = (sorted(map(tuple, ranks.numbered(ids, ["k"], "id", split).select("id", "k", "at_").collect())) for split in (True, False))
    assert a == b and sorted(x[2] for x in a if x[1] == 0) == list(range(334))


def test_smart_charging_leaves_before_a_late_slot(spark):
    """A signal of 15 minutes under slots of 30: the slot at 10:15 begins after departure; the one at 10:05 of an odd signal counts."""
    s = spark.sql("select 1 as session_id, timestamp_ntz'2024-01-01 09:50:00' as arrival_time, 20 / 60D as duration, 50D as energy")
    signal = lambda *t: spark.createDataFrame([(x, v) for x, v in t], "t string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    fine = C.smart_charge(s, signal(("2024-01-01 09:45:00", 0.5), ("2024-01-01 10:00:00", 0.3), ("2024-01-01 10:15:00", 0.1))).first()
    assert str(fine["scheduled_start"]) == "2024-01-01 10:00:00" and fine["cost_smart"] == pytest.approx(0.3 * 7.4 * 0.5)
    odd = C.smart_charge(s, signal(("2024-01-01 10:05:00", 0.3), ("2024-01-01 10:35:00", 0.1))).first()
    assert str(odd["scheduled_start"]) == "2024-01-01 10:05:00"
    hours = s.selectExpr("session_id", "date'2024-01-01' as date", "9.5D as hour", "1D as duration", "1D as energy")
    assert str(C.smart_charge(hours, signal(("2024-01-01 09:30:00", 0.3))).first()["scheduled_start"]) == "2024-01-01 09:30:00"
    with pytest.raises(ValueError):
        C.smart_charge(hours.drop("hour"), signal(("2024-01-01 09:30:00", 0.3)))


def test_panel_fills_by_calendar_or_all(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-01", "b", 2.0), ("2024-01-03", "a", 3.0)], "date string, department string, energy double").withColumn("date", F.to_date("date")).withColumn("duration", F.lit(1.0))
    rows = {(str(r["date"]), r["department"]): r["energy_kwh"] for r in A.panel(df).collect()}
    assert rows["2024-01-02", "a"] == 0 and rows["2024-01-03", "b"] is None
    assert all(r["energy_kwh"] is not None for r in A.panel(df, mode="all").collect())


def test_files_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", 2.0, 3.0)], "session_id long, arrival_time string, duration double, energy double")
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        readers.export(df, f"file://{tmp_path}/t.{kind}")
        assert readers.load_sessions(spark, f"file://{tmp_path}/t.{kind}").count() == 1
    for bad in (lambda: readers.export(df, "x.xlsx"), lambda: readers.read_table(spark, "x.pkl")):
        with pytest.raises(ValueError):
            bad()
    calls = []
    build = lambda: calls.append(1) or df
    for force in (False, False, True):
        readers.cached_table(spark, build, {"a": 1}, ["x", "y"], f"file://{tmp_path}/c", force).count()
    assert len(calls) == 2
    assert readers.config_hash({"a": 1}, ["x", "y"]) == readers.config_hash({"a": 1}, ["y", "x"])


def test_streams_use_the_same_operators(spark, tmp_path):
    raw = raw_events(spark, SF).drop("Unnamed: 0")
    raw.write.parquet(f"{tmp_path}/in")
    stream = validated_stream(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("valid").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("valid").count() == S.validate(raw).count()
