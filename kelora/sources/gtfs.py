"""Timetable feeds: CSV tables with explicit schemas, tolerant casts, required-file checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelora.functions.text import clock_seconds

REQUIRED = ("stops", "routes", "trips", "frequencies", "stop_times", "calendar")
OPTIONAL = ("shapes",)
TRUE = ("1", "true", "yes")
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file as strings: quoted newlines, doubled quotes, a byte-order mark; cells are trimmed, missing ones empty."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(f"{folder}/{name}.txt")
    return df.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lstrip("﻿")) for c in df.columns))


def number(c: str, kind: str = "int", default=None):
    x = F.col(c).try_cast(kind)
    return F.coalesce(x, F.lit(default)).alias(c) if default is not None else x.alias(c)


def truth(c: str):
    return F.lower(F.col(c)).isin(*TRUE)


def typed(name: str, df: DataFrame) -> DataFrame:
    if name == "stops":
        return df.select("stop_id", "stop_name", number("stop_lat", "double"), number("stop_lon", "double"), *(c for c in ("category", "route_id", "status") if c in df.columns))
    if name == "trips":
        return df.select("route_id", "service_id", "trip_id", "trip_headsign", number("direction_id", default=0), *(c for c in ("shape_id",) if c in df.columns))
    if name == "frequencies":
        return df.select("trip_id", clock_seconds(F.col("start_time")).alias("start"), clock_seconds(F.col("end_time")).alias("end"), number("headway_secs", default=0))
    if name == "stop_times":
        return df.select("trip_id", clock_seconds(F.col("arrival_time")).alias("arrival"), clock_seconds(F.col("departure_time")).alias("departure"), "stop_id", number("stop_sequence", default=0))
    if name == "calendar":
        return df.select("service_id", F.array(*(truth(d) for d in DAYS)).alias("weekdays"), "start_date", "end_date")
    if name == "shapes":
        return df.select("shape_id", number("shape_pt_lat", "double"), number("shape_pt_lon", "double"), number("shape_pt_sequence", default=0))
    return df


def feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a feed; a missing required file raises, a missing optional one is absent."""
    out = {}
    for name in REQUIRED + OPTIONAL:
        try:
            out[name] = typed(name, table(spark, folder, name))
        except AnalysisException as e:
            if name in REQUIRED or "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def connections(tables: dict[str, DataFrame], weekday: int, least: int, most: int) -> DataFrame:
    """Dated connections of one weekday (0 = Sunday) that leave in [least, most]: frequencies clipped on their own grid, then expanded."""
    runs = tables["trips"].join(tables["calendar"].where(F.element_at("weekdays", weekday + 1)).select("service_id"), "service_id")
    first = tables["stop_times"].groupBy("trip_id").agg(F.min_by("departure", "stop_sequence").alias("base"))
    st = tables["stop_times"].join(first, "trip_id").select("trip_id", "stop_id", "stop_sequence", (F.col("departure") - F.col("base")).alias("dep"), (F.col("arrival") - F.col("base")).alias("arr"))
    span = st.groupBy("trip_id").agg(F.max("arr").alias("span"))
    f = tables["frequencies"].where("headway_secs > 0").join(runs.select("trip_id"), "trip_id").join(span, "trip_id")
    low = F.col("start") + F.greatest(F.lit(0), F.ceil((F.lit(least) - F.col("span") - F.col("start")) / F.col("headway_secs"))).cast("int") * F.col("headway_secs")
    high = F.least(F.col("end") - 1, F.lit(most))
    starts = f.withColumn("low", low).withColumn("high", high).where("low <= high").select("trip_id", F.explode(F.sequence("low", "high", "headway_secs")).alias("run"))
    from pyspark.sql import Window as W

    w = W.partitionBy("trip_id").orderBy("stop_sequence")
    legs = st.select("trip_id", "stop_id", "dep", F.lead("stop_id").over(w).alias("to_stop"), F.lead("arr").over(w).alias("to_arr")).where("to_stop is not null")
    out = starts.join(legs, "trip_id").select(F.concat_ws("#", "trip_id", "run").alias("trip"), "stop_id", "to_stop", (F.col("run") + F.col("dep")).alias("departure"), (F.col("run") + F.col("to_arr")).alias("arrival"))
    return out.where(F.col("departure").between(least, most))
