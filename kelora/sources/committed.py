"""Tables that change together: data files first, then one manifest file that names them all.

A reader takes the newest whole manifest, so it sees all tables of one commit or none: a writer that dies between two
tables, or while it writes the manifest, leaves the last commit readable. A manifest also holds the cursor of the source
that was read for it, so state and cursor can't come apart. Its name is its number and is created once: of two writers
that start from the same commit one fails. Everything goes through Hadoop's file systems; the driver reads manifests only.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since the tables were read."""


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _files(spark, f"{root}/_commits")
    return sorted((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []


def latest(spark: SparkSession, root: str) -> dict:
    """The newest whole manifest: number, tables (name to folder and schema) and cursor; number 0 where there is none."""
    for n in _numbers(spark, root):
        text = spark.read.text(f"{root}/_commits/{n:010d}.json", wholetext=True).first()
        try:
            return json.loads(text.value if text else "")
        except ValueError:
            continue  # its writer died while it wrote
    return {"number": 0, "tables": {}, "cursor": None}


def table(spark: SparkSession, root: str, name: str, at: dict | None = None) -> DataFrame | None:
    """A table as of a manifest (the newest by default); None where it was never committed."""
    own = (at or latest(spark, root))["tables"].get(name)
    return spark.read.schema(own["schema"]).parquet(own["path"]) if own else None


def commit(root: str, tables: dict[str, DataFrame], base: dict, cursor: str | None = None) -> dict:
    """Writes ``tables`` and then the manifest after ``base``; tables that are not given stay as they are in it."""
    spark = next(iter(tables.values())).sparkSession
    new = {"number": base["number"] + 1, "tables": dict(base["tables"]), "cursor": cursor if cursor is not None else base["cursor"]}
    new["number"] = max([new["number"], *(n + 1 for n in _numbers(spark, root) if not _whole(spark, root, n))])  # past a torn manifest
    for name, df in tables.items():
        path = f"{root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        new["tables"][name] = {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
    fs, p = _files(spark, f"{root}/_commits/{new['number']:010d}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        raise Conflict(f"commit {new['number']} exists") from e
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    return new


def _whole(spark: SparkSession, root: str, n: int) -> bool:
    text = spark.read.text(f"{root}/_commits/{n:010d}.json", wholetext=True).first()
    try:
        return bool(json.loads(text.value if text else ""))
    except ValueError:
        return False


def upsert(root: str, parent: str, rows: DataFrame, keys: list[str], order: Column, children: dict[str, DataFrame] | None = None, cursor: str | None = None) -> dict:
    """Upserts ``rows`` (newest by ``order`` per key; the new side wins ties) and replaces the child rows of their keys.

    A row older than the stored one changes nothing, nor do its children. ``children`` have the key columns and, as
    ``version``, the order of the row they belong to. Parent and children are one commit.
    """
    spark = rows.sparkSession
    base = latest(spark, root)
    rows = rows.withColumn("version", order)
    old = table(spark, root, parent, base)
    both = rows.withColumn("_side", F.lit(1))
    both = both if old is None else both.unionByName(old.withColumn("_side", F.lit(0)))
    body = F.struct(*rows.columns)
    newest = both.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(body, F.struct("version", "_side")).alias("r")).select("r.*")
    tables = {parent: newest}
    for name, own in (children or {}).items():
        kept = table(spark, root, name, base)
        every = own if kept is None else own.unionByName(kept.join(own.select(*keys, "version").distinct(), [*keys, "version"], "left_anti"))
        tables[name] = every.join(newest.select(*keys, "version"), [*keys, "version"], "left_semi")
    return commit(root, tables, base, cursor)


def synchronised(root: str, name: str, source: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Reads what ``source`` has after the stored cursor (all of it at first), applies it to the stored table by key and
    commits table and cursor; returns what changed: keys, was, now (structs of the rows), newest ``at`` of each key.

    ``at`` is a timestamp column; rows of one key and time go by all their columns. The filter on the cursor reaches the
    scan. A source without newer rows commits nothing and gives no rows.
    """
    spark = source.sparkSession
    base = latest(spark, root)
    fresh = source if base["cursor"] is None else source.where(F.col(at) > F.lit(base["cursor"]).cast(source.schema[at].dataType))
    body = F.struct(*source.columns)
    new = fresh.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(body, F.struct(at, body)).alias("r")).select("r.*")
    old = table(spark, root, name, base)
    old = spark.createDataFrame([], source.schema) if old is None else old
    n, o = new.select(*keys, F.struct(*source.columns).alias("now")), old.select(*keys, F.struct(*source.columns).alias("was"))
    both = n.join(o, keys, "full")
    made = commit(root, {f"{name}_changes": both.where("now is not null and (was is null or was <> now)"), name: both.select(F.coalesce("now", "was").alias("r")).select("r.*")}, base, _newest(fresh, at, base["cursor"]))
    return table(spark, root, f"{name}_changes", made)


def _newest(fresh: DataFrame, at: str, before: str | None) -> str | None:
    found = fresh.agg(F.max(at).cast("string")).first()[0]  # one value
    return found or before
