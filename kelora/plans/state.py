"""Sinks and synchronisation that really write: signals with child rows, segments, and a state with its cursor."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelora.operators import graph
from kelora.plans.registry import query, read
from kelora.sources import committed, snapshots

HALF = "1995-01-01"  # orders before it are the first of the two writes
_child = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query("q_snk08_committed", """WITH n AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey)
 SELECT o_custkey, n.o_orderkey, count(l_orderkey) AS children, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM n LEFT JOIN lineitem ON l_orderkey = n.o_orderkey GROUP BY ALL""")
def signals(spark, d):
    """A customer's newest order is a signal and its lines are the children. The newer half is written first, so the second
    write brings old rows for known customers, which change nothing, and new customers; read back from the commit."""
    root = graph.scratch(spark)
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    version = lambda df: F.struct("o_orderdate", "o_orderkey")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    for part in (o.where(f"o_orderdate >= timestamp_ntz'{HALF}'"), o.where(f"o_orderdate < timestamp_ntz'{HALF}'")):
        children = part.join(lines, "o_orderkey").select("o_custkey", version(part).alias("version"), "l_linenumber", "l_quantity")
        committed.upsert(root, "signals", part, ["o_custkey"], version(part), {"edges": children})
    now = committed.latest(spark, root)
    edges = committed.table(spark, root, "edges", now).groupBy("o_custkey").agg(F.count("*").alias("children"), F.sum("l_quantity").cast("long").alias("quantity"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return committed.table(spark, root, "signals", now).join(edges, "o_custkey", "left").select("o_custkey", "o_orderkey", zero("children"), zero("quantity"))


@query("q_snk09_segments", """SELECT l_partkey, m.d AS updated, m.q AS value FROM (SELECT l_partkey, max(struct_pack(d := l_shipdate, o := l_orderkey, n := l_linenumber, q := l_quantity)) AS m FROM lineitem GROUP BY l_partkey)""")
def segments(spark, d):
    """Readings of a segment in three batches, not in order of time: an older reading never replaces a newer one."""
    root = graph.scratch(spark)
    li = read(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    for flag in ("N", "R", "A"):
        committed.upsert(root, "segments", li.where(F.col("l_returnflag") == flag).drop("l_returnflag"), ["l_partkey"], F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"))
    return committed.table(spark, root, "segments").select("l_partkey", F.col("l_shipdate").alias("updated"), F.col("l_quantity").alias("value"))


STOPS = ("2024-01-11", "2024-01-21", "2100-01-01")  # what the source holds when each of three runs reads it
_k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("q_stm12_synchronised", f"""WITH e AS (SELECT {_k} AS segment, ts, event_id, event_type FROM events), r AS (SELECT *, CASE {' '.join(f"WHEN ts < TIMESTAMP '{t}' THEN {n}" for n, t in enumerate(STOPS))} END AS run FROM e),
 l AS (SELECT segment, run, max(struct_pack(ts := ts, id := event_id, kind := event_type)) AS m FROM r GROUP BY ALL) SELECT CAST(run AS INTEGER) AS run, segment, lag(m.id) OVER (PARTITION BY segment ORDER BY run) AS was, m.id AS now, m.kind AS kind FROM l""")
def synchronised(spark, d):
    """Three runs of a cached state against a growing source: each reads only rows after the stored cursor and says what changed."""
    root = graph.scratch(spark)
    e = read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("segment"), "ts", "event_id", "event_type")
    runs = []
    for n, stop in enumerate(STOPS):
        changes = committed.synchronised(root, "state", e.where(F.col("ts") < F.lit(stop).cast("timestamp_ntz")), ["segment"], "ts")
        runs.append(changes.select(F.lit(n).alias("run"), "segment", F.col("was.event_id").alias("was"), F.col("now.event_id").alias("now"), F.col("now.event_type").alias("kind")))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("q_snk06_lines", "SELECT event_id, user_id, event_type, round(value, 4) AS value, CAST(ts AS VARCHAR)[1:19] AS ts FROM events")
def lines(spark, d):
    """Rows as JSON lines, written and parsed back."""
    root = graph.scratch(spark)
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    snapshots.ndjson(e, root)
    return spark.read.text(root).select(F.from_json("value", e.schema).alias("r")).select("r.*")


@query("q_snk10_appended", f"""WITH e AS (SELECT {_k} AS segment, ts, value FROM events), s AS ({' UNION ALL '.join(f"SELECT {n} AS snapshot, segment, count(*) AS n, max(ts) AS last_ts, round(max(value), 4) AS worst FROM e WHERE ts < TIMESTAMP '{t}' GROUP BY segment" for n, t in enumerate(STOPS))})
 SELECT segment, count(*) AS snapshots, max(n) AS readings, max(last_ts) AS last_ts, max(worst) - min(worst) AS risen FROM s GROUP BY segment""")
def appended(spark, d):
    """Three risk snapshots are appended one after the other; the history of each segment is read from all of them, and the
    newest is what ``snapshots.read`` gives."""
    root = graph.scratch(spark)
    e = read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("segment"), "ts", "value")
    for n, stop in enumerate(STOPS):
        now = e.where(F.col("ts") < F.lit(stop).cast("timestamp_ntz")).groupBy("segment").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.round(F.max("value"), 4).alias("worst"))
        snapshots.write(now, root, n)
    history = spark.read.parquet(root).groupBy("segment").agg(F.count("*").alias("snapshots"), (F.max("worst") - F.min("worst")).alias("risen"))
    newest = snapshots.read(spark, root).select("segment", F.col("n").alias("readings"), "last_ts")
    return history.join(newest, "segment").select("segment", "snapshots", "readings", "last_ts", "risen")
