"""The autoregressive forecast of all groups at once."""

import datetime as dt

import numpy as np
import pytest

from chargelake.operators import forecast as R

START = dt.date(2024, 1, 1)


def series(n, seed, shift=0.0):
    """A slow autocorrelated level with a weekday pattern, as logs."""
    rnd, level, out = np.random.default_rng(seed), 0.0, []
    for i in range(n):
        level = 0.9 * level + rnd.normal(0, 0.25)
        out.append(6 + shift + level + (0.4 if (START + dt.timedelta(i)).weekday() < 5 else -0.3))
    return np.expm1(np.array(out))


def table(spark, groups):
    rows = [(g, START + dt.timedelta(i), float(v)) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "department string, date date, energy_kwh double")


def test_equals_ridge_regression_and_step_by_step_forecast(spark):
    values, horizon = series(200, 1), 10
    first = START + dt.timedelta(200)
    holidays = spark.createDataFrame([(START + dt.timedelta(30),), (first + dt.timedelta(2),)], "date date")
    got = R.autoregressive_forecast(table(spark, {"a": values}), str(first), horizon, holidays=holidays).orderBy("date").collect()
    y, days = np.log1p(values), [START + dt.timedelta(i) for i in range(200 + horizon)]
    free = {30, 202}

    def given(i):
        return [float(days[i].weekday() == d) for d in range(7)] + [(i - 200) / 365, float(i in free)]

    x = np.array([given(i) + [y[i - 1], y[i - 7]] for i in range(7, 200)])
    b = np.linalg.solve(x.T @ x + 1e-3 * np.eye(11), x.T @ y[7:])
    path = list(y)
    for i in range(200, 200 + horizon):
        path.append(float(np.dot(b, [*given(i), path[-1], path[-7]])))
    var = (y[7:] @ y[7:] - b @ x.T @ y[7:]) / (193 - 11)
    carried = [0.0] * 6 + [1.0]
    for _ in range(horizon):
        carried.append(b[9] * carried[-1] + b[10] * carried[-7])
    spread = np.sqrt(var * np.cumsum(np.square(carried[6 : 6 + horizon])))
    assert [r["median"] for r in got] == pytest.approx(np.expm1(path[200:]), rel=1e-7)
    assert [r["p10"] for r in got] == pytest.approx(np.expm1(np.array(path[200:]) - 1.2816 * spread), rel=1e-6)
    assert [r["p90"] for r in got] == pytest.approx(np.expm1(np.array(path[200:]) + 1.2816 * spread), rel=1e-6)
    assert (np.diff(spread) > 0).all()  # bands widen


def test_beats_the_trend_on_days_it_has_not_seen(spark):
    groups = {f"d{k}": series(374, k, k / 10) for k in range(12)}
    first = START + dt.timedelta(360)
    daily = table(spark, {g: v[:360] for g, v in groups.items()})
    smape = {}
    for name, forecast in (("lags", R.autoregressive_forecast), ("trend", R.department_forecast)):
        got = {(r["department"], r["date"]): r["median"] for r in forecast(daily, str(first), 14).collect()}
        assert len(got) == 12 * 14
        pairs = [(groups[g][360 + i], got[g, first + dt.timedelta(i)]) for g in groups for i in range(14)]
        smape[name] = np.mean([200 * abs(p - y) / (abs(p) + abs(y)) for y, p in pairs])
    assert smape["lags"] < smape["trend"]


def test_short_constant_and_empty_groups(spark):
    daily = table(spark, {"few": [10.0, 20.0, 30.0], "flat": [5.0] * 80, "nil": [0.0] * 80})
    got = {}
    for r in R.autoregressive_forecast(daily, "2024-04-01", 3).collect():
        got.setdefault(r["department"], []).append((r["p10"], r["median"], r["p90"]))
    assert got["few"] == [(pytest.approx(20 - 12.816), 20.0, pytest.approx(20 + 12.816))] * 3
    assert [m for _, m, _ in got["flat"]] == pytest.approx([5.0] * 3, rel=1e-2) and [m for _, m, _ in got["nil"]] == pytest.approx([0.0] * 3, abs=1e-9)
    assert R.autoregressive_forecast(daily.limit(0), "2024-04-01", 3).count() == 0
