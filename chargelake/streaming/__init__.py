"""Sessions as a stream: the schema operators are projections and filters, so they run on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.schema import validate


def validated_stream(raw: DataFrame) -> DataFrame:
    """Validated sessions of a streaming table; late data is no matter, as no state is kept."""
    return validate(raw)


def hourly_energy_stream(sessions: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Energy and sessions by hour of arrival, final once the watermark has passed the hour."""
    timed = sessions.withColumn("at", F.col("arrival_time").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour").alias("w")).agg(F.sum("energy").alias("energy_kwh"), F.count("*").alias("n_sessions")).select("w.start", "energy_kwh", "n_sessions")
