"""Bringing raw session tables to one schema: names, units, types, quality, calendar.  Projections and filters only."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import DOMAINS, hour_of_day, hours_between, literal_map, location, season

# The names under which sources carry the canonical columns; the first that is present wins.
# session_id stays what it is, as sessions are told apart by it.
ALIASES = {
    "arrival_time": ["arrival_time", "start_time", "start", "plug_in_time", "connection_time", "timestamp", "date_start", "t_start"],
    "duration": ["duration", "duration_h", "duration_hours", "session_duration", "connected_time", "charging_duration"],
    "end_time": ["end_time", "stop_time", "end", "plug_out_time", "disconnection_time", "t_end"],
    "energy": ["energy", "energy_kwh", "kwh", "total_energy", "energy_delivered", "charged_energy"],
    "power": ["power", "power_kw", "max_power", "rated_power", "charger_power"],
    "location_type": ["location_type", "site_type", "charging_type", "type", "location", "site"],
    "user_id": ["user_id", "ev_id", "vehicle_id", "driver_id"],
    "department": ["department", "dept", "departement", "code_dept", "dept_code"],
}
MINUTES = ["park_duration", "duree_min"]
NOISE = ["day", "weekend", "unnamed_0", "start_date"]
NATIONAL = {
    "debut_session_timestamp": "arrival_time", "fin_session_timestamp": "end_time", "insee_code_departement": "department",
    "insee_nom_departement": "department_name", "insee_code_region": "region_code", "insee_nom_region": "region_name",
}
COMBINED_SITES = {"caltech", "jpl", "office"}
REQUIRED = ["arrival_time", "duration", "energy"]
#: Formats tried in turn for timestamps that come as text.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm"]


def key_of(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_national(df: DataFrame) -> bool:
    return bool({"debut_session_timestamp", "energie_delivree_wh"} & set(df.columns))


def from_national(df: DataFrame, filter_failed: bool = True) -> DataFrame:
    """National register: names, Wh to kWh, minutes to hours, domain codes to places; failed sessions go."""
    have = set(df.columns)
    if filter_failed and "succes_session" in have:
        df = df.filter(F.col("succes_session") == "t")
    out = [quoted(c).alias(NATIONAL.get(c, c)) for c in df.columns if c not in {"succes_session", "energie_delivree_wh", "duree_min", "id_domaine_subvention", "nom_domaine_subvention"}]
    if "energie_delivree_wh" in have:
        out.append((F.col("energie_delivree_wh") / 1000.0).alias("energy"))
    if "duree_min" in have:
        out.append((F.col("duree_min") / 60.0).alias("duration"))
    if "id_domaine_subvention" in have:
        place = F.try_element_at(literal_map(DOMAINS), F.col("id_domaine_subvention"))
        out.append(F.coalesce(place, F.lit("unknown")).alias("location_type"))
    df = df.select(*out)
    return df.withColumn("department", F.trim(F.col("department").cast("string"))) if "department" in df.columns else df


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Canonical names for the first alias present; a raw ``Arrival`` is an hour of the day and never a timestamp."""
    keys: dict[str, str] = {}
    for c in df.columns:
        keys.setdefault(key_of(c), c)
    rename, taken = {}, set(df.columns)
    for name, aliases in ALIASES.items():
        raw = next((keys[a] for a in aliases if a in keys), None)
        if raw and raw != name and name not in taken:
            rename[raw] = name
    return df.select(*(quoted(c).alias(rename.get(c, c)) for c in df.columns))


def drop_noise(df: DataFrame) -> DataFrame:
    return df.select(*(quoted(c) for c in df.columns if key_of(c) not in NOISE))


def minutes_to_hours(df: DataFrame) -> DataFrame:
    raw = next((c for m in MINUTES for c in df.columns if key_of(c) == m), None)
    if "duration" in df.columns or raw is None:
        return df
    return df.withColumn("duration", number(quoted(raw)) / F.lit(60.0)).drop(quoted(raw))


def number(c: Column) -> Column:
    return c.try_cast("double")


def timestamp(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind != "string":
        return F.col(name).cast("timestamp_ntz")
    tries = [F.try_to_timestamp(F.col(name), F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS]
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), F.col(name))).cast("timestamp_ntz")
    return F.coalesce(*tries, F.when(F.col(name).isNotNull(), bad))


def quality_rules() -> dict[str, Column]:
    """What a session must meet; null and NaN don't."""
    within = lambda c, lo, hi: F.coalesce(lo & (F.col(c) < hi) & ~F.isnan(c), F.lit(False))
    return {
        "duration": within("duration", F.col("duration") > 0, 168),
        "energy": within("energy", F.col("energy") >= 0, 400),
        "arrival_time": F.col("arrival_time").isNotNull(),
    }


def normalised(df: DataFrame, filter_failed: bool = True) -> DataFrame:
    """Names, units and types, without the quality filter."""
    if is_national(df):
        df = from_national(df, filter_failed)
    df = minutes_to_hours(resolve_aliases(drop_noise(df)))
    if "duration" not in df.columns and {"arrival_time", "end_time"} <= set(df.columns):
        df = df.withColumn("duration", hours_between(timestamp(df, "arrival_time"), timestamp(df, "end_time")))
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    typed = {c: number(F.col(c)) for c in ("duration", "energy", "power") if c in df.columns}
    typed["arrival_time"] = timestamp(df, "arrival_time")
    return df.withColumns(typed)


def with_calendar(df: DataFrame, ts: str = "arrival_time") -> DataFrame:
    """hour, day_of_week (0: Monday), month, season, is_weekend, date."""
    t = F.col(ts)
    return df.withColumns(
        {
            "hour": hour_of_day(t),
            "day_of_week": F.weekday(t),
            "month": F.month(t),
            "season": season(F.month(t)),
            "is_weekend": (F.weekday(t) >= 5).cast("int"),
            "date": F.to_date(t),
        }
    )


def quality_report(df: DataFrame) -> DataFrame:
    """One row for each rule: rows, and rows that fail it; one pass."""
    rules = quality_rules()
    ok = rules["duration"] & rules["energy"] & rules["arrival_time"]
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(~r).alias(n) for n, r in rules.items()), F.count_if(~ok).alias("any"))
    return counts.unpivot(["n_rows"], [*rules, "any"], "rule", "n_failed")


def validate(df: DataFrame, strict: bool = False, filter_failed: bool = True) -> DataFrame:
    """Canonical sessions with calendar columns: one projection and filter, no shuffle.

    Rows that break a quality rule go; with ``strict`` they raise.  Null departments stay null.
    """
    if strict and is_national(df):
        filter_failed = False
    out, rules = normalised(df, filter_failed), quality_rules()
    ok = rules["duration"] & rules["energy"] & rules["arrival_time"]
    if strict:
        bad = out.filter(~ok).limit(1).count()
        if bad:
            raise ValueError(f"sessions break quality rules: {out.filter(~ok).count()}")
    out = with_calendar(out.filter(ok))
    place = location("location_type") if "location_type" in out.columns else F.lit("unknown")
    out = out.withColumn("location_type", place)
    return out.withColumn("department", F.trim(F.col("department").cast("string"))) if "department" in out.columns else out


def combined_sites(df: DataFrame, column: str = "data") -> list[str]:
    """The site names if a table looks like several known sites put together; warns then."""
    raw = next((c for c in df.columns if key_of(c) == column), None)
    if raw is None:
        return []
    name = F.lower(quoted(raw).cast("string"))
    others = df.filter(quoted(raw).isNotNull() & ~name.isin(*COMBINED_SITES)).limit(1).count()
    found = sorted(r[0] for r in df.filter(name.isin(*COMBINED_SITES)).select(name).distinct().collect())
    if others or len(found) < 2:
        return []
    warnings.warn(f"a table of several sites: {found}; don't add these sites' own tables to it", UserWarning, stacklevel=2)
    return found


def combined_site_check(df: DataFrame, column: str = "data") -> DataFrame:
    """As one row: the sites in a table, whether they are several of the known ones only, and how many rows name another."""
    name = F.lower(quoted(column).cast("string"))
    found = df.agg(F.count_if(quoted(column).isNotNull() & ~name.isin(*COMBINED_SITES)).alias("n_other"), F.array_join(F.sort_array(F.collect_set(F.when(name.isin(*COMBINED_SITES), name))), ",").alias("sites"))
    return found.select("sites", "n_other", ((F.col("n_other") == 0) & F.col("sites").contains(",")).alias("combined"))


def load_overview(df: DataFrame, by: list[str]) -> DataFrame:
    """Sessions and distinct departments by the columns of ``by`` that are there."""
    return df.groupBy(*stratify_columns(df, by)).agg(F.count("*").alias("n_sessions"), F.count_distinct("department").alias("n_departments"))


def stratify_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that are there; a department that never varies says nothing and goes."""
    have = [c for c in wanted if c in df.columns]
    if "department" in have and df.select("department").distinct().limit(2).count() <= 1:
        have.remove("department")
    return have


# Filters that jobs use.  The last day is a grouped maximum of one row, joined by broadcast.


def last_day(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.max(date).alias("last_"))


def exclude_last_days(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    return df.join(F.broadcast(last_day(df, date)), F.col(date) < F.date_sub("last_", n)).drop("last_")


def recent_months(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    return df.join(F.broadcast(last_day(df, date)), F.col(date) >= F.add_months("last_", -n)).drop("last_")


def full_months(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The n whole calendar months before the month of the last day."""
    first = F.trunc("last_", "MM")
    keep = (F.col(date) < first) & (F.col(date) >= F.add_months(first, -n))
    return df.join(F.broadcast(last_day(df, date)), keep).drop("last_")


def train_eval(df: DataFrame, eval_date: str, horizon: int, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows before the day, and those of the ``horizon`` days from it on."""
    day = F.lit(eval_date).cast("date")
    return df.filter(F.col(date) < day), df.filter((F.col(date) >= day) & (F.col(date) < F.date_add(day, horizon)))


def cap_energy(df: DataFrame, power: str = "power_kw") -> DataFrame:
    """No more energy than the charger can give in the time."""
    return df.withColumn("energy", F.least(F.col("energy"), F.col(power) * F.col("duration")))


def to_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"f_hour": F.col("hour"), "f_duration": F.log1p("duration"), "f_energy": F.log1p("energy")})


def from_features(df: DataFrame) -> DataFrame:
    """Back from log features, clipped to what is physically possible."""
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    return df.withColumns(
        {
            "hour": clip(F.col("f_hour"), 0.0, 23.99),
            "duration": clip(F.expm1("f_duration"), 0.08, 48.0),
            "energy": clip(F.expm1("f_energy"), 0.01, 350.0),
        }
    )


def session_power(df: DataFrame, mode: str = "mean_power", power_kw: float | None = None, mix: dict | None = None) -> DataFrame:
    """``power_used`` and ``active`` hours: mean power, a fixed power, or one drawn from the place's charger mix."""
    from ..functions.expressions import draw, uniform

    mean = F.try_divide(F.col("energy"), F.col("duration"))
    if mode == "mean_power":
        power = mean
    elif mode == "fixed_power":
        if not power_kw or power_kw <= 0:
            raise ValueError("fixed_power needs power_kw above 0")
        power = F.lit(float(power_kw))
    elif mode == "by_location":
        if not mix:
            raise ValueError("by_location needs a mix")
        power = mean
        for place, shares in mix.items():
            power = F.when(F.col("location_type") == place, draw(shares, uniform("session_id"))).otherwise(power)
    else:
        raise ValueError(f"no charging mode {mode}")
    active = F.col("duration") if mode == "mean_power" else F.least(F.try_divide(F.col("energy"), F.col("power_used")), F.col("duration"))
    return df.withColumn("power_used", power).withColumn("active", active)


def shifted_week(df: DataFrame, start: str, days: int = 7) -> DataFrame:
    """The sessions of a window, a week later."""
    day = F.lit(start).cast("date")
    last = df.filter((F.col("date") >= day) & (F.col("date") < F.date_add(day, days)))
    moved = last.withColumn("arrival_time", F.col("arrival_time") + F.make_dt_interval(F.lit(7)))
    return moved.withColumn("date", F.to_date("arrival_time"))
