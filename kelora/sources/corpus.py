"""Captured corpora, scenarios, network snapshots and plain stop lists: JSON and text with validation at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("OFFICIAL_STATEMENT", "OFFICIAL_REALTIME", "SOCIAL", "INTERNAL")  # fixed
KINDS = ("posts", "statements", "observations")  # fixed: the lists that a capture may hold
NEEDED = ("id", "text", "sourceClass", "publishedAt", "retrievedAt")  # fixed
FREE = ("url", "authorId", "authorHandle", "title", "originalAuthorId", "originalAuthorHandle", "repostOfId", "observedLineId", "observedStationId", "language")
RUN, DWELL = 120.0, 18.0  # fixed: seconds where a link states none
_RECORD = ", ".join(f"{c}:string" for c in NEEDED + FREE)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all captures under ``path``; one without a needed field or of an unknown class is left out silently."""
    df = spark.read.schema(", ".join(f"{k} array<struct<{_RECORD}>>" for k in KINDS)).json(path, multiLine=True)
    flat = df.select(F.inline(F.concat(*(F.coalesce(F.col(k), F.array().cast(df.schema[k].dataType)) for k in KINDS))))
    full = [F.coalesce(F.col(c) != "", F.lit(False)) for c in NEEDED]
    return flat.where(full[0] & full[1] & full[2] & full[3] & full[4] & F.col("sourceClass").isin(*CLASSES))


def scenario(spark: SparkSession, path: str, name: str, known: DataFrame) -> DataFrame:
    """The records of one scenario in its own order (column ``place``); an unknown scenario or record raises when read."""
    s = spark.read.schema("scenarios array<struct<id:string, now:string, sourceIds:array<string>>>").json(path, multiLine=True)
    s = s.select(F.inline("scenarios")).where((F.col("id") == name) & (F.col("now") != ""))
    if s.isEmpty():
        raise ValueError(f"unknown scenario: {name}")
    listed = s.select(F.posexplode("sourceIds").alias("place", "id"))
    out = listed.join(known.withColumn("_met", F.lit(True)), "id", "left")
    there = F.assert_true(F.col("_met").isNotNull(), F.concat(F.lit("scenario names an unknown record: "), "id"))
    return out.where(there.isNull()).drop("_met")


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lines, stations and links of network snapshots: rows without an id (links: or a line) are left out, numbers default."""
    df = spark.read.schema("""lines array<struct<id:string, shortName:string, mode:string>>, stations array<struct<id:string, name:string, lat:double, lon:double, lineIds:array<string>, isInterchange:boolean>>,
        segments array<struct<id:string, lineId:string, fromStationId:string, toStationId:string, scheduledRunSeconds:double, scheduledDwellSeconds:double>>""").json(path, multiLine=True)
    part = lambda c: df.select(F.inline(c)).where("coalesce(id, '') <> ''")
    lines = part("lines").na.fill("LRT", ["mode"]).na.fill("")
    stations = part("stations").na.fill(0.0, ["lat", "lon"]).na.fill(False, ["isInterchange"])
    links = part("segments").where("coalesce(lineId, '') <> ''").na.fill(RUN, ["scheduledRunSeconds"]).na.fill(DWELL, ["scheduledDwellSeconds"]).na.fill("")
    return {"lines": lines, "stations": stations, "segments": links}


def plain(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file line by line (no newline inside a quoted cell), cells as they stand."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return df.na.fill("")


def mapped(trips: DataFrame, routes: DataFrame, lines: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Routes with their line, and the trips of those; routes that ``lines`` doesn't know and their trips are left out."""
    table = F.create_map(*(F.lit(x) for kv in lines.items() for x in kv))
    kept = routes.withColumn("line", table[F.upper("route_id")]).where("line is not null")
    return trips.join(kept.select("route_id", "line"), "route_id"), kept


def stop_index(spark: SparkSession, path: str) -> DataFrame:
    """stop_id, name, line, key of a stop list split at every comma; the first of a repeated stop counts, nameless ones don't."""
    names = spark.read.text(path).first().value.split(",")
    missing = [c for c in ("stop_id", "stop_name", "route_id") if c not in names]
    if missing:
        raise ValueError(f"stops lack {missing}")
    cell = lambda c: F.coalesce(F.get(F.split("value", ","), F.lit(names.index(c))), F.lit(""))
    df = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at")).where(F.trim("value") != "")
    df = df.select(cell("stop_id").alias("stop_id"), cell("stop_name").alias("name"), cell("route_id").alias("line"), "at").where("stop_id not in ('', 'stop_id') and name <> ''")
    first = df.groupBy("stop_id").agg(F.min_by(F.struct("name", "line"), "at").alias("s")).select("stop_id", "s.*")
    return first.withColumn("key", F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-")))


def write_corpus(df: DataFrame, path: str) -> None:
    """Labelled rows as JSON lines, one file a partition, nulls written out."""
    df.write.option("ignoreNullFields", False).json(path)


def write_compact(stops: DataFrame, patterns: DataFrame, path: str) -> None:
    """One nested row per pattern: its stops with their attributes in order."""
    seq = patterns.select("pattern", "headway", F.posexplode("stops").alias("n", "stop_id")).join(stops, "stop_id", "left")
    row = F.struct("n", *(F.col(c) for c in stops.columns))
    seq.groupBy("pattern", "headway").agg(F.sort_array(F.collect_list(row)).alias("stops")).write.parquet(path)  # a pattern's stops


def compact_problems(patterns: DataFrame, stops: DataFrame) -> DataFrame:
    """(pattern, problem): patterns without stops or frequency, arrays of unequal length, stops that nobody knows."""
    p = patterns.select("pattern", F.filter(F.array(
        F.when(F.coalesce(F.size("stops"), F.lit(0)) < 2, "too few stops"), F.when(F.coalesce(F.col("headway"), F.lit(0)) <= 0, "no frequency"), F.when(F.size("stops") != F.size("runs") + 1, "lengths differ")),
        lambda x: x.isNotNull()).alias("all")).select("pattern", F.explode("all").alias("problem"))
    orphans = patterns.select("pattern", F.explode("stops").alias("stop_id")).join(stops.select("stop_id"), "stop_id", "left_anti").select("pattern", F.concat(F.lit("unknown stop "), "stop_id").alias("problem"))
    return p.union(orphans)
