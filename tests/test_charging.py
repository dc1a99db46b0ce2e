"""Smart charging and load curves against plain loops."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chargelake.operators import loadcurve as L
from chargelake.operators import schema as S
from chargelake.operators import smart as C
from chargelake.operators.intervals import cover, overlapping, points_in_intervals

DAY = dt.datetime(2024, 3, 1)


def schedule(session, signal, kind, minutes, efficiency=0.9):
    """cost_smart, cost_plug, start, end of one session, by looking at every slot."""
    arrival, hours, energy, power = session
    window = [(t, v) for t, v in signal if v is not None and arrival <= t < arrival + dt.timedelta(hours=hours)]
    if not window or energy is None or not power:
        return None, None, None, None
    k = min(math.ceil(energy / efficiency / (power * minutes / 60)), len(window))
    best = sorted(window, key=lambda x: (x[1] if kind == "price" else -x[1], x[0]))[:k]
    cost = lambda slots: sum(v * power * minutes / 60 for _, v in slots)
    start = min((t for t, _ in best), default=arrival)
    return cost(best), cost(window[:k]), start, start + dt.timedelta(minutes=minutes * k)


def signal_of(kind):
    rnd = random.Random(kind)
    if kind == "gaps":  # times off the grid, a day without any, repeated values, a null
        return [(DAY + dt.timedelta(minutes=7 + 30 * n + n % 3), None if n == 5 else rnd.choice([0.1, 0.2, 0.3])) for n in range(400) if rnd.random() < 0.7 and not 96 <= n < 160], 30
    if kind == "fine":
        return [(DAY + dt.timedelta(minutes=5 * n), round(rnd.random(), 3)) for n in range(2500)], 5
    return [(DAY + dt.timedelta(minutes=30 * n), round(rnd.random(), 2)) for n in range(480)], 30


@pytest.mark.parametrize("kind", ["price", "renewable"])
@pytest.mark.parametrize("grid", ["regular", "fine", "gaps"])
def test_schedule_equals_looking_at_every_slot(spark, grid, kind):
    """Windows of none to over a thousand slots, before, inside and past the signal; 0 kWh, 0 kW, missing energy."""
    signal, minutes = signal_of(grid)
    rnd = random.Random(3)
    sessions = [
        (DAY + dt.timedelta(minutes=rnd.randrange(-600, 15_000)), rnd.choice([0.2, 1.0, 3.7, 9.0, 30.0, 160.0]), rnd.choice([0.0, 1.0, 12.5, 60.0, 390.0, None]), rnd.choice([3.7, 7.4, 22.0, 0.0])) for _ in range(150)
    ]
    df = spark.createDataFrame([(n, *s) for n, s in enumerate(sessions)], "session_id int, arrival_time timestamp_ntz, duration double, energy double, power_kw double")
    prices = spark.createDataFrame(signal, "ts timestamp_ntz, value double")
    got = {r["session_id"]: r for r in C.smart_charge(df, prices, kind, minutes).collect()}
    assert len(got) == len(sessions)
    for n, s in enumerate(sessions):
        smart, plug, start, end = schedule(s, signal, kind, minutes)
        r = got[n]
        assert (r["scheduled_start"], r["scheduled_end"]) == (start, end), s
        assert r["cost_smart"] == (smart if smart is None else pytest.approx(smart, abs=1e-9)), s
        assert r["cost_plug"] == (plug if plug is None else pytest.approx(plug, abs=1e-9)), s
        assert (r["savings_pct"] is None) == (not plug)


def test_windows_in_spans_and_in_blocks(spark, monkeypatch):
    """Short and long windows by their two ways, each session once; those in spans are shuffled once, not by their ids."""
    signal, minutes = signal_of("fine")
    rnd = random.Random(5)
    sessions = [(DAY + dt.timedelta(minutes=rnd.randrange(-600, 12_000)), rnd.choice([-1.0, 0.1, 1.0, 5.4, 30.0]), rnd.choice([0.0, 12.5, 390.0, None]), rnd.choice([3.7, 22.0, 0.0])) for _ in range(80)]
    df = spark.createDataFrame([(n, *s) for n, s in enumerate(sessions)], "session_id int, arrival_time timestamp_ntz, duration double, energy double, power_kw double")
    prices = spark.createDataFrame(signal, "ts timestamp_ntz, value double")
    assert "hashpartitioning(session_id" not in C.smart_charge(df, prices, "price", minutes)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "SPAN", 6)
    got = {r["session_id"]: r for r in C.smart_charge(df, prices, "price", minutes).collect()}
    assert len(got) == len(sessions)
    for n, s in enumerate(sessions):
        smart, plug, start, end = schedule(s, signal, "price", minutes)
        assert (got[n]["scheduled_start"], got[n]["scheduled_end"]) == (start, end), s
        assert got[n]["cost_smart"] == (smart if smart is None else pytest.approx(smart, abs=1e-9)), s
        assert got[n]["cost_plug"] == (plug if plug is None else pytest.approx(plug, abs=1e-9)), s


def test_no_signal_and_no_sessions(spark):
    df = spark.createDataFrame([(1, DAY, 2.0, 5.0)], "session_id int, arrival_time timestamp_ntz, duration double, energy double")
    prices = spark.createDataFrame([(DAY, 0.2)], "ts timestamp_ntz, value double")
    assert C.smart_charge(df, prices.limit(0)).first()["cost_smart"] is None
    assert C.smart_charge(df.limit(0), prices).count() == 0
    assert C.smart_charge(df, prices).first()["cost_smart"] == pytest.approx(0.2 * 7.4 / 2)


def test_a_window_is_few_blocks(spark):
    """Two of each size at most, and whole ones of the largest."""
    rnd = random.Random(1)
    spans = [(i, i + rnd.choice([1, 2, 7, 64, 255, 300, 5000])) for i in (rnd.randrange(5000) for _ in range(200))]
    rows = spark.createDataFrame(spans, "i long, j long").select("i", "j", cover("i", "j", C.TOP).alias("blocks")).collect()
    for r in rows:
        covered = [x for b in r["blocks"] for x in range(b["block"] << b["level"], (b["block"] + 1) << b["level"])]
        assert sorted(covered) == list(range(r["i"], r["j"]))
        assert len(r["blocks"]) <= 2 * C.TOP + (r["j"] - r["i"]) // 2**C.TOP


def sessions_of(spark, seed=5, n=200):
    rnd = random.Random(seed)
    rows = [(i, str(DAY + dt.timedelta(minutes=rnd.randrange(4000))), rnd.choice([0.25, 0.5, 1.0, 5.3, 24.0, 47.9, 120.0]), rnd.choice([0.0, 3.0, 11.7, 80.0]), rnd.choice([3.7, 11.0, 0.0])) for i in range(n)]
    df = S.validate(spark.createDataFrame(rows, "session_id int, arrival_time string, duration double, energy double, power_kw double"))
    return df.withColumnRenamed("power", "power_kw")


@pytest.mark.parametrize("hours", [None, 72, 30])
def test_energy_by_hour_equals_every_hour_of_every_session(spark, hours):
    df = sessions_of(spark)
    want = defaultdict(float)
    for r in df.collect():
        power, end = r["energy"] / r["duration"], min(r["hour"] + r["duration"], hours or 1e9)
        for s in range(math.floor(r["hour"]), math.ceil(end)):
            if power > 0:
                want[r["day_of_week"], s % 24] += power * (min(end, s + 1) - max(r["hour"], s))
    got = {(r["day_of_week"], r["h"]): r["kwh"] for r in L.energy_24h(df, ["day_of_week"], hours=hours).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def test_edges_do_not_grow_with_durations(spark):
    """What is shuffled is a row for each bin, also of sessions of a hundred hours."""
    df = spark.range(10_000).select(F.lit("a").alias("k"), (F.col("id") % 24).cast("double").alias("hour"), F.lit(100.0).alias("duration"), F.lit(50.0).alias("energy"))
    profile = L.energy_24h(df, ["k"], hours=None)
    assert profile.agg(F.sum("kwh")).first()[0] == pytest.approx(500_000)
    assert "Generate explode(sequence(cast(floor" not in profile._jdf.queryExecution().toString().lower()


def test_slots_of_a_day(spark):
    df = sessions_of(spark, 6)
    want = defaultdict(float)
    for r in df.collect():
        want.setdefault((r["date"], 0), 0.0)
        for s in range(int(r["hour"] / 0.25), int(min((r["hour"] + r["duration"]) / 0.25, 96))):
            want[r["date"], s] += r["power_kw"]
    got = {(r["date"], r["slot"]): r["kw"] for r in L.load_curve(df, resolution_min=15).collect()}
    assert len(got) == 96 * len({d for d, _ in want})
    assert all(v == pytest.approx(want.get(k, 0.0), abs=1e-8) for k, v in got.items())


def test_shifted_curves(spark):
    df = sessions_of(spark, 7).withColumn("scheduled_start", F.when(F.col("session_id") % 4 > 0, F.expr("arrival_time + interval 95 minutes")))
    want = defaultdict(float)
    for r in df.collect():
        for kind, start in (("plug", r["arrival_time"]), ("smart", r["scheduled_start"])):
            if start is not None and r["power_kw"]:
                lo = int((start - dt.datetime.combine(r["date"], dt.time())).total_seconds() / 1800)
                for s in range(lo, min(lo + max(1, math.ceil(r["energy"] / 0.9 / (r["power_kw"] * 0.5))), 48)):
                    want[r["date"], kind, s] += r["power_kw"]
    got = {(r["date"], r["kind"], r["slot"]): r["kw"] for r in L.shift_curves(df).filter("kw > 0").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def intervals_of(spark, seed, n, names, longest):
    rnd = random.Random(seed)
    rows = [(i, DAY + dt.timedelta(seconds=rnd.randrange(90_000)), rnd.choice([0, 1, 299, 300, 3_600, longest])) for i in range(n)]
    rows = [(i, lo, lo + dt.timedelta(seconds=s)) for i, lo, s in rows] + [(n, None, DAY), (n + 1, DAY, None)]
    return rows, spark.createDataFrame(rows, f"{names[0]} int, {names[1]} timestamp_ntz, {names[2]} timestamp_ntz")


@pytest.mark.parametrize("top", [2, 12])
def test_overlaps_equal_comparing_all(spark, top):
    """Intervals of no length to months, that overlap, touch, begin together and leave gaps; nulls."""
    left, a = intervals_of(spark, 1, 120, ("a", "a_lo", "a_hi"), 40_000)
    right, b = intervals_of(spark, 2, 150, ("b", "b_lo", "b_hi"), 3_000_000 if top == 12 else 50_000)
    meet = lambda lo, hi, f, t: None not in (lo, hi, f, t) and lo < hi and f < t and max(lo, f) < min(hi, t)
    want = {(i, j): (min(hi, t) - max(lo, f)).total_seconds() for i, lo, hi in left for j, f, t in right if meet(lo, hi, f, t)}
    rows = overlapping(a, "a_lo", "a_hi", b, "b_lo", "b_hi", top=top).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["overlap_s"] for r in rows} == want
    inside = points_in_intervals(b.select("b", "b_lo"), "b_lo", a, "a_lo", "a_hi", top=top).collect()
    assert {(r["a"], r["b"]) for r in inside} == {(i, j) for i, lo, hi in left for j, f, _ in right if None not in (lo, hi, f) and lo <= f < hi}
    assert overlapping(a.limit(0), "a_lo", "a_hi", b, "b_lo", "b_hi").count() == 0


def test_the_overlap_join_has_no_nested_loop(spark):
    _, a = intervals_of(spark, 1, 9, ("a", "a_lo", "a_hi"), 40_000)
    _, b = intervals_of(spark, 2, 9, ("b", "b_lo", "b_hi"), 40_000)
    plan = overlapping(a, "a_lo", "a_hi", b, "b_lo", "b_hi")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_costs_under_prices_pair_no_intervals(spark):
    """Prices that overlap by hundreds, with nulls, against the sum over all pairs; the plan joins on times only."""
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, {})"
    s = spark.range(200).selectExpr("id as session_id", f"{at.format('id * 7 % 1440')} as arrival_time", "1.0 + id % 9 as duration", "id * 0.7D as energy")
    prices = spark.range(400).selectExpr(
        f"{at.format('id * 13 % 1440')} as valid_from", f"{at.format('id * 13 % 1440 + id % 31 * 30 - 60')} as valid_to", "if(id % 10 = 0, null, 0.1D + id / 997D) as value"
    )
    out = C.cost_of_validity(s, prices)
    plan = out._jdf.queryExecution().toString()
    assert "block_" not in plan and "NestedLoop" not in plan
    found = {r["session_id"]: r for r in out.collect()}
    minutes = [(i * 13 % 1440, i * 13 % 1440 + i % 31 * 30 - 60, None if i % 10 == 0 else 0.1 + i / 997) for i in range(400)]
    for i in range(200):
        a, z, power = i * 7 % 1440, i * 7 % 1440 + 60 * (1 + i % 9), i * 0.7 / (1 + i % 9)
        shared = [(max(0, min(z, t) - max(a, f)) / 60, v) for f, t, v in minutes if f < t]
        assert found[i]["covered_h"] == pytest.approx(sum(h for h, _ in shared), abs=1e-9)
        assert found[i]["cost"] == pytest.approx(sum(power * h * (v or 0) for h, v in shared), abs=1e-9)
    nan = C.cost_of_validity(s.filter("session_id = 3"), prices.withColumn("value", F.lit(float("nan")))).first()
    assert nan["cost"] != nan["cost"]
