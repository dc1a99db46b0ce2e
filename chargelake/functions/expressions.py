"""Column expressions of the session model: calendar, locations, tariffs, slots, draws and growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Names of places in sources, and the codes of the national register.
LOCATIONS = {
    "work": "work", "workplace": "work", "bureau": "work", "office": "work", "en_pri": "work",
    "home": "home", "residential": "home", "domicile": "home", "re_co": "home",
    "public": "public", "street": "public", "commercial": "public", "en_opu": "public", "coll": "public",
    "heavy": "heavy", "po_lo": "heavy", "poids_lourds": "heavy",
}
DOMAINS = {"en_opu": "public", "en_pri": "work", "coll": "public", "re_co": "home", "po_lo": "heavy"}

# Charger mixes (kW: share) by place, today and as planned for 2030.
CHARGER_MIX = {
    "2024": {
        "home": {3.7: 0.30, 7.4: 0.60, 11.0: 0.10},
        "work": {7.4: 0.55, 11.0: 0.25, 22.0: 0.20},
        "public": {22.0: 0.40, 50.0: 0.35, 150.0: 0.20, 350.0: 0.05},
    },
    "2030": {
        "home": {7.4: 0.50, 11.0: 0.35, 22.0: 0.15},
        "work": {11.0: 0.30, 22.0: 0.50, 50.0: 0.20},
        "public": {22.0: 0.20, 50.0: 0.35, 150.0: 0.30, 350.0: 0.15},
    },
}


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def hour_of_day(ts: ColumnOrName) -> Column:
    """Hours with minutes; seconds don't count."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def season(month: ColumnOrName) -> Column:
    m = col(month)
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isin(9, 10, 11), "autumn")
    )


def location(raw: ColumnOrName) -> Column:
    """One of home, work, public; anything else, and null, is unknown."""
    return F.coalesce(F.try_element_at(literal_map(LOCATIONS), F.lower(F.trim(col(raw)))), F.lit("unknown"))


def hours_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def plus_hours(ts: ColumnOrName, hours: ColumnOrName) -> Column:
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (col(hours) * 3600).cast("decimal(18,6)"))


def slots_needed(energy: ColumnOrName, power: ColumnOrName, resolution_min: int, efficiency: float, window: ColumnOrName) -> Column:
    """How many slots a charge takes, at most those in the window; none for 0 kWh.  Null without a power above 0."""
    per_slot = F.when(col(power) > 0, col(power) * F.lit(resolution_min / 60))
    slots = F.ceil(F.try_divide(col(energy) / F.lit(efficiency), per_slot))
    return F.when(slots.isNotNull() & col(window).isNotNull(), F.least(slots, col(window)))


def savings_pct(plug: ColumnOrName, smart: ColumnOrName) -> Column:
    return F.when(col(plug) > 0, 100 * (col(plug) - col(smart)) / col(plug))


def recency_weight(days: ColumnOrName, half_life: ColumnOrName) -> Column:
    return F.least(F.greatest(F.pow(F.lit(0.5), col(days) / col(half_life)), F.lit(1e-300)), F.lit(1e12))


def tariff(ts: ColumnOrName, kind: str = "day_night") -> Column:
    """Price of a time of day, EUR/kWh: night and day rates with two peaks, a spot-like curve, or flat."""
    h = hour_of_day(ts)
    # fixed values: rates, hours and limits must be these for the same prices
    if kind == "flat":
        return F.lit(0.15)
    if kind == "spot_like":
        return F.least(F.greatest(F.lit(0.15) + 0.08 * F.sin(2 * F.pi() * h / 24 - F.pi() / 3), F.lit(0.02)), F.lit(0.40))
    day = F.when((h >= 7) & (h < 22), 0.20).otherwise(0.10)
    return F.when((h >= 8) & (h < 10), 0.30).when((h >= 17) & (h < 20), 0.28).otherwise(day)


def renewable_share(ts: ColumnOrName) -> Column:
    h = hour_of_day(ts)
    # fixed values: hours of sun, level and swing of wind
    solar = F.greatest(F.lit(0.0), F.cos(F.pi() * (h - 13) / 7))
    wind = 0.2 + 0.15 * F.sin(2 * F.pi() * h / 24 + 1.0)
    return F.least(F.greatest(solar + wind, F.lit(0.0)), F.lit(1.0))


def uniform(*key: ColumnOrName) -> Column:
    """A reproducible number in [0, 1) from the key's text."""
    text = F.concat_ws("|", *(col(k).cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*key: ColumnOrName) -> Column:
    """A reproducible standard normal number (Box-Muller on two uniforms)."""
    u, v = uniform(F.lit("n1"), *key), uniform(F.lit("n2"), *key)
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.pi() * v)


def normals(*key: ColumnOrName) -> list[Column]:
    """Three reproducible standard normal numbers, from one digest of the key's text."""
    digest = F.md5(F.concat_ws("|", *(col(k).cast("string") for k in key)))
    u = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in range(4)]
    radius = lambda x: F.sqrt(-2 * F.ln(F.greatest(x, F.lit(1e-12))))
    return [radius(u[0]) * F.cos(2 * F.pi() * u[1]), radius(u[0]) * F.sin(2 * F.pi() * u[1]), radius(u[2]) * F.cos(2 * F.pi() * u[3])]


def draw(mix: dict[float, float], u: ColumnOrName) -> Column:
    """The category in whose share of the unit interval ``u`` falls; shares are normalised."""
    total, upto, out = sum(mix.values()), 0.0, None
    for value, share in list(mix.items())[:-1]:
        upto += share / total
        test = col(u) < upto
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    last = F.lit(list(mix)[-1])
    return last if out is None else out.otherwise(last)


def count_of(x: ColumnOrName) -> Column:
    """A count from a real number: rounded half to even, never negative."""
    return F.greatest(F.lit(0).cast("double"), F.bround(col(x), 0))


def growth(base: ColumnOrName, t: ColumnOrName, model: str, years: float, **p: float) -> Column:
    """Growth of ``base`` after ``t`` years; every model starts at ``base``."""
    b, t = col(base), col(t)
    # fixed values: the usual parameters of each model, where none are given
    if model == "linear":
        return b * (1 + F.lit(p.get("rate", 0.15)) * t)
    if model == "s_curve":
        mid, steep = p.get("midpoint", years / 2), p.get("steepness", 6 / years)
        logistic = lambda x: 1 / (1 + F.exp(-steep * (x - mid)))
        low = logistic(F.lit(0.0))
        return b + b * (p.get("saturation", 3.0) - 1) * (logistic(t) - low) / (1 - low)
    if model == "bass":
        innovate, imitate = p.get("p", 0.03), p.get("q", 0.38)
        e = F.exp(-(innovate + imitate) * t)
        return b + b * (p.get("market", 4.0) - 1) * (1 - e) / (1 + imitate / innovate * e)
    raise ValueError(f"no growth model {model}")
