"""The network as stored tables: written together, read back whole, refused with its first problems where it is not sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelora.operators import graph
from kelora.operators.places import flat, places
from kelora.sources import committed

VERSION = "1.0.0"
NEEDED = {"lines": ("id",), "stations": ("id", "name", "lat", "lon"), "segments": ("id", "lineId", "fromStationId", "toStationId", "scheduledRunSeconds")}
SHOWN = 5  # problems that an error names


def problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(problem): ids that are missing or repeated, places that are no numbers, links of unknown lines or stations, links to
    themselves, running times that are not positive."""
    lines, stations, links = tables["lines"], tables["stations"], tables["segments"]
    said = lambda df, what, of="id": df.select(F.concat(F.lit(f"{what} "), F.coalesce(F.col(of).cast("string"), F.lit("null"))).alias("problem"))
    found = []
    for name, df in (("line", lines), ("station", stations), ("segment", links)):
        found += [said(df.where("coalesce(id, '') = ''"), f"{name} without id"), said(df.groupBy("id").count().where("count > 1 and id <> ''"), f"repeated {name}")]
    found.append(said(stations.where("lat is null or lon is null or isnan(lat) or isnan(lon)"), "no place of station"))
    found.append(said(links.join(lines.select(F.col("id").alias("lineId")).distinct(), "lineId", "left_anti"), "unknown line of segment"))
    for end in ("fromStationId", "toStationId"):
        found.append(said(links.join(stations.select(F.col("id").alias(end)).distinct(), end, "left_anti"), f"unknown {end} of segment"))
    found.append(said(links.where("fromStationId = toStationId"), "segment to itself"))
    found.append(said(links.where("coalesce(scheduledRunSeconds, 0) <= 0"), "no running time of segment"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def save(tables: dict[str, DataFrame], root: str) -> dict:
    """Writes lines, stations and segments as one commit with the version of this layout."""
    spark = tables["lines"].sparkSession
    version = spark.createDataFrame([(VERSION,)], "version string")
    return committed.commit(root, {**{k: tables[k] for k in NEEDED}, "version": version}, committed.latest(spark, root))


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest network under ``root``; raises if it is of another version, lacks a column or has problems."""
    at = committed.latest(spark, root)
    missing = [k for k in (*NEEDED, "version") if k not in at["tables"]]
    if missing:
        raise ValueError(f"no network: {', '.join(missing)} not written")
    version = committed.table(spark, root, "version", at).first()
    if version is None or version.version != VERSION:
        raise ValueError(f"network of version {version.version if version else None}, not {VERSION}")
    tables = {k: committed.table(spark, root, k, at) for k in NEEDED}
    lacking = [f"{k}.{c}" for k, cs in NEEDED.items() for c in cs if c not in tables[k].columns]
    if lacking:
        raise ValueError(f"network lacks {', '.join(lacking)}")
    first = [r.problem for r in problems(tables).limit(SHOWN).collect()]
    if first:
        raise ValueError(f"network failed validation: {'; '.join(first)}")
    return tables


def load_compact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stops, patterns) of what ``corpus.write_compact`` wrote: patterns with their stop ids in order, each stop once.

    Raises if a pattern has under two stops, no headway, or two patterns state different attributes of one stop.
    """
    rows = spark.read.parquet(path)
    if {"pattern", "headway", "stops"} - set(rows.columns):
        raise ValueError("no compact network: pattern, headway or stops missing")
    patterns = rows.select("pattern", "headway", F.transform(F.sort_array("stops"), lambda s: s["stop_id"]).alias("stops"))
    bad = patterns.where("coalesce(size(stops), 0) < 2 or coalesce(headway, 0) <= 0").select("pattern").limit(SHOWN).collect()
    if bad:
        raise ValueError(f"compact network: patterns without stops or headway: {', '.join(str(r.pattern) for r in bad)}")
    names = [f.name for f in rows.schema["stops"].dataType.elementType if f.name != "n"]
    each = rows.select(F.inline("stops")).select(*names).distinct()
    torn = each.groupBy("stop_id").count().where("count > 1").limit(SHOWN).collect()
    if torn:
        raise ValueError(f"compact network: stops stated twice: {', '.join(str(r.stop_id) for r in torn)}")
    return each, patterns


def index(tables: dict[str, DataFrame], listed: DataFrame | None = None) -> DataFrame:
    """id, name, place, lines, interchange of every station of a network (``load`` or ``corpus.snapshot``).

    Stations of one name, of the curated list (a, b) or near each other are one place, named by its smallest id; a
    station's lines are those that its links serve anywhere in its place. Ids may be text.
    """
    s = graph.written(tables["stations"].select("id", "name", "lat", "lon"))
    none = s.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    own = graph.written(places(s.select("id", "name").join(flat(s), "id"), none if listed is None else listed))
    links = tables["segments"]
    served = links.select(F.col("fromStationId").alias("id"), "lineId").unionByName(links.select(F.col("toStationId").alias("id"), "lineId")).distinct()
    lines = served.join(own, "id").groupBy("place").agg(F.sort_array(F.collect_set("lineId")).alias("lines"))  # the lines of one place
    out = s.join(own, "id").join(lines, "place", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    return out.select("id", "name", "place", "lines", (F.size("lines") > 1).alias("interchange"))
