"""Timetable, network, routing-score and ranking queries on the star-schema tables (part = segments, orders = trips)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import risk, text
from kelora.operators import graph
from kelora.operators import relational as R
from kelora.plans.registry import query, read

_sev = "CASE p_type WHEN 'ECONOMY' THEN 'MINOR' WHEN 'SMALL' THEN 'MAJOR' WHEN 'STANDARD' THEN 'SEVERE' ELSE 'INFO' END"
_mult = "CASE p_type WHEN 'ECONOMY' THEN 1.15 WHEN 'SMALL' THEN 1.6 WHEN 'STANDARD' THEN 2.75 ELSE 1.0 END"
_iss = "CASE p_size % 4 WHEN 0 THEN 'TRACK' WHEN 1 THEN 'SIGNAL' WHEN 2 THEN 'CROWDING' ELSE 'DOOR' END"
_isw = "CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.55 ELSE 0.8 END"
_conf = "(p_size % 21) / 20.0"
_knot = f"CASE WHEN {_conf} <= 0.4 THEN {_conf} WHEN {_conf} <= 0.7 THEN 0.4 + ({_conf} - 0.4) * (0.4 / 0.3) ELSE 0.8 + ({_conf} - 0.7) * (0.55 / 0.3) END"
_pen = f"floor(({_mult} - 1) * {_isw} * ({_knot}) * (p_retailprice / 10) + 0.5)"


def segments(spark, d):
    return read(spark, d, "part").select("*", F.expr(_sev).alias("severity"), F.expr(_iss).alias("issue"), (F.expr("p_size % 21") / 20.0).alias("confidence"))


@query("q_mth05_knot_weight", f"SELECT p_partkey, round({_knot}, 6) AS weight FROM part")
def knot(spark, d):
    return segments(spark, d).select("p_partkey", F.round(risk.knot_weight(F.col("confidence")), 6).alias("weight"))


@query("q_mth07_penalty", f"SELECT p_partkey, CAST({_pen} AS DOUBLE) AS penalty_seconds FROM part")
def penalty(spark, d):
    p = risk.penalty_seconds(F.col("severity"), F.col("issue"), F.col("confidence"), F.col("p_retailprice") / 10)
    return segments(spark, d).select("p_partkey", p.alias("penalty_seconds"))


@query("q_mth08_constants", "SELECT * FROM (VALUES ('INFO', 1.0::DOUBLE), ('MINOR', 1.15), ('MAJOR', 1.6), ('SEVERE', 2.75)) t(severity, multiplier) WHERE severity IN (SELECT " + _sev + " FROM part)")
def constants(spark, d):  # the severities that the segments use, with their multipliers
    return segments(spark, d).select("severity").distinct().select("severity", risk.lookup(F.col("severity"), K.SEVERITY).alias("multiplier"))


@query("q_mth10_arrival_window", """SELECT p_partkey, round(s + mu, 4) AS mean, round(greatest(s, s + mu - 1.2816 * sigma), 4) AS p10, round(s + mu + 1.2816 * sigma, 4) AS p90 FROM
 (SELECT p_partkey, p_size * 60.0 AS s, p_retailprice / 10 AS mu, sqrt((0.5 * p_retailprice / 10) ** 2 + (25 + 10 * sqrt(p_size % 5 + 1)) ** 2) AS sigma FROM part)""")
def arrival(spark, d):
    w = risk.arrival_window(F.col("p_retailprice") / 10, F.col("p_size") % 5 + 1, F.col("p_size") * 60.0)
    return read(spark, d, "part").withColumn("w", w).select("p_partkey", *(F.round(f"w.{c}", 4).alias(c) for c in ("mean", "p10", "p90")))


_score = "1 - 0.55 * (p_size / 50.0) - 0.3 * ((p_partkey % 100) / 100.0) - 0.1 * least(1.0, (p_size % 6) / 4.0)"


@query("q_mth11_router_score", f"SELECT p_partkey, round({_score}, 6) AS score FROM part")
def router_score(spark, d):
    s = risk.router_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0, F.col("p_size") % 6)
    return read(spark, d, "part").select("p_partkey", F.round(s, 6).alias("score"))


@query("q_win05_rank", f"""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_size, p_partkey) AS rank, round(max(s) OVER (PARTITION BY p_brand) - s, 6) AS behind,
 CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.75 THEN 'B' WHEN s >= 0.55 THEN 'C' WHEN s >= 0.35 THEN 'D' ELSE 'AVOID' END AS badge FROM (SELECT *, round({_score}, 9) AS s FROM part)""")
def ranked(spark, d):
    s = F.round(risk.router_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0, F.col("p_size") % 6), 9)
    p = read(spark, d, "part").withColumn("s", s)
    w = W.partitionBy("p_brand")
    rank = F.row_number().over(w.orderBy(F.desc("s"), "p_size", "p_partkey")).cast("long")
    return p.select("p_brand", "p_partkey", rank.alias("rank"), F.round(F.max("s").over(w) - F.col("s"), 6).alias("behind"), risk.tiers(F.col("s"), K.BADGES, "AVOID").alias("badge"))


@query("q_lim07_recommend", f"SELECT p_brand, arg_min(p_partkey, (1 - s) * 1000000000 + p_partkey / 1000000.0) AS best FROM (SELECT *, round({_score}, 6) AS s FROM part) WHERE s >= 0.35 GROUP BY p_brand")
def recommend(spark, d):
    s = F.round(risk.router_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0, F.col("p_size") % 6), 6)
    return read(spark, d, "part").withColumn("s", s).where("s >= 0.35").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("s"), "p_partkey")).alias("best"))


@query("q_agg24_journey_hazard", """SELECT l_orderkey, round(1 - product(1 - l_discount) * 0.92 ** (count(DISTINCT l_suppkey) - 1), 6) AS hazard, count(*) AS legs FROM lineitem GROUP BY l_orderkey""")
def hazard(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.round(1 - F.product(1 - F.col("l_discount")) * F.pow(F.lit(0.92), F.countDistinct("l_suppkey") - 1), 6).alias("hazard"), F.count("*").alias("legs"))


@query("q_agg23_itinerary_facts", "SELECT l_orderkey, round(sum(l_quantity), 4) AS delay, max(l_discount) AS worst, count(DISTINCT l_suppkey) AS lines, count(DISTINCT l_partkey) AS segments FROM lineitem GROUP BY l_orderkey")
def itinerary_facts(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("delay"), F.max("l_discount").alias("worst"), F.countDistinct("l_suppkey").alias("lines"), F.countDistinct("l_partkey").alias("segments"))


@query("q_agg33_worst_segment", "SELECT l_orderkey, max(l_discount) AS worst, arg_max(l_partkey, l_discount * 1000000 - l_partkey / 1000000.0) AS segment FROM lineitem GROUP BY l_orderkey")
def worst_segment(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("worst"), F.max_by("l_partkey", F.struct("l_discount", (-F.col("l_partkey")).alias("o"))).alias("segment"))


@query("q_jon01_stop_times_trips", "SELECT o_orderpriority, count(*) AS stops, count(DISTINCT l_partkey) AS segments FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def stop_times(spark, d):
    li, o = read(spark, d, "lineitem").select("l_orderkey", "l_partkey"), read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("stops"), F.countDistinct("l_partkey").alias("segments"))


@query("q_jon02_served_lines", "SELECT n_nationkey, coalesce(s.n, 0) AS served, coalesce(s.first_name, n_name) AS label FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_name) AS first_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey")
def served(spark, d):
    s = read(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_name").alias("first_name"))
    return read(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("served"), F.coalesce("first_name", "n_name").alias("label"))


@query("q_jon05_without_frequency", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def without(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query("q_jon06_interchanges", "SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) ** 2 + (a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE) ** 2), 5) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE sqrt((a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) ** 2 + (a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE) ** 2) <= 0.03")
def interchanges(spark, d):
    p = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return R.near_pairs(p, 0.03).select("a", "b", F.round("d", 5).alias("d"))


@query("q_gra04_places", """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = b.label
 AND sqrt((a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) ** 2 + (a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE) ** 2) <= 0.02),
 r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.id) SELECT id, min(root) AS root FROM r GROUP BY id""")
def places(spark, d):
    e = read(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    lab = e.select("vec_id", "label")
    pairs = R.near_pairs(p, 0.02).join(lab.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(lab.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b").where("la = lb")
    return graph.components(p.select("id"), pairs.select("a", "b"))


@query("q_jon10_frequency_expansion", """SELECT o_orderkey, dep FROM (SELECT o_orderkey, unnest(generate_series(s, s + 3599, h)) AS dep FROM (SELECT o_orderkey, (o_orderkey % 18) * 3600 + 21600 AS s,
 CASE o_orderpriority WHEN '1-URGENT' THEN 300 WHEN '2-HIGH' THEN 420 WHEN '3-MEDIUM' THEN 600 ELSE 900 END AS h FROM orders))""")
def expansion(spark, d):
    o = read(spark, d, "orders")
    head = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 300L WHEN '2-HIGH' THEN 420L WHEN '3-MEDIUM' THEN 600L ELSE 900L END")
    start = F.col("o_orderkey") % 18 * 3600 + 21600
    return o.select("o_orderkey", start.alias("s"), head.alias("h")).select("o_orderkey", F.explode(F.slice(F.sequence(F.col("s"), F.col("s") + 3599, F.col("h")), 1, 2000)).alias("dep"))


@query("q_jon09_window_expansion", """SELECT o_orderkey, dep FROM (SELECT o_orderkey, unnest(generate_series(s, s + 3599, h)) AS dep FROM (SELECT o_orderkey, (o_orderkey % 18) * 3600 + 21600 AS s,
 CASE o_orderpriority WHEN '1-URGENT' THEN 300 WHEN '2-HIGH' THEN 420 WHEN '3-MEDIUM' THEN 600 ELSE 900 END AS h FROM orders)) WHERE dep BETWEEN 30000 AND 34000""")
def window_expansion(spark, d):  # the range is clipped on the departure grid before expanding: no row outside the window is made
    head = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 300L WHEN '2-HIGH' THEN 420L WHEN '3-MEDIUM' THEN 600L ELSE 900L END")
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 18 * 3600 + 21600).alias("s"), head.alias("h"))
    first = F.col("s") + F.greatest(F.lit(0), F.ceil((30000 - F.col("s")) / F.col("h"))) * F.col("h")
    last = F.least(F.col("s") + 3599, F.lit(34000))
    return o.withColumn("a", first).withColumn("z", last).where("a <= z").select("o_orderkey", F.explode(F.sequence("a", "z", "h")).alias("dep"))


@query("q_jon15_headway_lookup", """SELECT o.o_orderkey, h.headway FROM (SELECT o_orderkey, o_orderkey % 86400 AS t, CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'WE' ELSE 'WD' END AS c FROM orders) o
 LEFT JOIN (VALUES ('WD', 0, 5000, 600), ('WD', 5000, 12000, 300), ('WE', 0, 9000, 900)) h(c, a, z, headway) ON h.c = o.c AND o.t >= h.a AND o.t < h.z""")
def headway(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 86400).alias("t"), F.when(F.dayofweek("o_orderdate").isin(1, 7), "WE").otherwise("WD").alias("c"))
    h = spark.createDataFrame([("WD", 0, 5000, 600), ("WD", 5000, 12000, 300), ("WE", 0, 9000, 900)], "hc string, a int, z int, headway int")
    return o.join(F.broadcast(h), (F.col("c") == F.col("hc")) & (F.col("t") >= F.col("a")) & (F.col("t") < F.col("z")), "left").select("o_orderkey", "headway")


@query("q_jon28_parent_event", "SELECT c.n_nationkey, coalesce(p.n_nationkey, c.n_nationkey) AS event FROM nation c LEFT JOIN nation p ON p.n_nationkey = c.n_nationkey - 5 AND p.n_regionkey = c.n_regionkey")
def parent(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    p = n.select((F.col("n_nationkey") + 5).alias("k"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("parent"))
    return n.join(p, (F.col("k") == F.col("n_nationkey")) & (F.col("r") == F.col("n_regionkey")), "left").select("n_nationkey", F.coalesce("parent", "n_nationkey").alias("event"))


@query("q_jon33_segment_features", "SELECT s_suppkey, n_name, coalesce(r.n, 0) AS uses FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON l_suppkey = s_suppkey")
def features(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    r = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, s.s_suppkey == r.l_suppkey, "left").select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).alias("uses"))


_ORD = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def _per_order():
    return W.partitionBy("l_orderkey").orderBy(*_ORD.split(", "))


@query("q_win01_stop_pairs", f"""SELECT l_partkey AS a, b, count(*) AS n, CAST(sum(gap) AS BIGINT) AS days FROM (SELECT l_partkey, lead(l_partkey) OVER w AS b, date_diff('day', l_shipdate, lead(l_shipdate) OVER w) AS gap FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORD})) WHERE b IS NOT NULL GROUP BY ALL""")
def stop_pairs(spark, d):
    w = _per_order()
    p = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), F.date_diff(F.lead("l_shipdate").over(w), "l_shipdate").alias("gap"))
    return p.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("gap").alias("days"))


@query("q_win02_interpolate", f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(last_value(q IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), greatest(0, first_value(q IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 60)) AS q
 FROM (SELECT *, CASE WHEN l_quantity > 15 THEN l_quantity END AS q FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORD})""")
def interpolate(spark, d):
    w = _per_order()
    q = F.when(F.col("l_quantity") > 15, F.col("l_quantity"))
    li = read(spark, d, "lineitem").withColumn("q", q)
    back = F.greatest(F.lit(0.0), F.first("q", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)) - 60)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.last("q", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), back).alias("q"))


@query("q_win09_unsorted", f"SELECT l_orderkey, count(*) AS problems FROM (SELECT l_orderkey, l_partkey < lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) AS bad FROM lineitem) WHERE bad GROUP BY l_orderkey")
def unsorted(spark, d):
    bad = F.col("l_partkey") < F.lag("l_partkey").over(_per_order())
    return read(spark, d, "lineitem").select("l_orderkey", bad.alias("bad")).where("bad").groupBy("l_orderkey").agg(F.count("*").alias("problems"))


@query("q_agg28_earliest_instance", "SELECT o_custkey, arg_min(o_orderkey, epoch_us(o_orderdate) + o_orderkey) AS trip FROM orders GROUP BY o_custkey")
def earliest_instance(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("trip"))


@query("q_agg19_run_fallback", "SELECT a.s_nationkey, CAST(floor(coalesce(f.v, b.v, 120.0) + 0.5) AS BIGINT) AS run FROM (SELECT DISTINCT s_nationkey FROM supplier) a LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS v FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) f ON f.s_nationkey = a.s_nationkey LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON b.c_nationkey = a.s_nationkey")
def run_fallback(spark, d):
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    f = s.where("s_acctbal > 8000").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("fv"))
    b = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("bv"))
    return s.select("s_nationkey").distinct().join(f, "s_nationkey", "left").join(b, "s_nationkey", "left").select("s_nationkey", F.floor(F.coalesce("fv", "bv", F.lit(120.0)) + 0.5).alias("run"))


@query("q_agg20_worst_headway", """WITH b AS (SELECT DISTINCT t FROM (SELECT p_size * 100 AS t FROM part UNION SELECT p_size * 100 + p_partkey % 700 + 1 FROM part)), s AS (SELECT t AS a, lead(t) OVER (ORDER BY t) AS z FROM b)
 SELECT s.a, max(p_partkey % 97) AS headway FROM s JOIN part ON p_size * 100 <= s.a AND p_size * 100 + p_partkey % 700 + 1 >= s.z WHERE z IS NOT NULL GROUP BY s.a""")
def worst_headway(spark, d):
    # a part covers whole unit steps; each instant's worst is a max over the steps it covers: no inequality join
    p = read(spark, d, "part").select((F.col("p_size").cast("long") * 100).alias("a"), (F.col("p_size") * 100 + F.col("p_partkey") % 700 + 1).alias("z"), (F.col("p_partkey") % 97).alias("h"))
    marks = p.select("a").union(p.select("z")).distinct()
    covered = p.groupBy("a", "z").agg(F.max("h").alias("h")).select(F.explode(F.sequence("a", F.col("z") - 1)).alias("a"), "h").groupBy("a").agg(F.max("h").alias("headway"))
    return marks.join(covered, "a").select("a", "headway")


@query("q_agg21_polyline", f"SELECT l_orderkey, round(sum(abs(l_extendedprice - p)), 3) AS length FROM (SELECT l_orderkey, l_extendedprice, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) AS p FROM lineitem) WHERE p IS NOT NULL GROUP BY l_orderkey")
def polyline(spark, d):
    p = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", F.lag("l_extendedprice").over(_per_order()).alias("p"))
    return p.where("p is not null").groupBy("l_orderkey").agg(F.round(F.sum(F.abs(F.col("l_extendedprice") - F.col("p"))), 3).alias("length"))


@query("q_agg22_bounds", "SELECT label, min(embedding[1]) AS x0, max(embedding[1]) AS x1, min(embedding[2]) AS y0, max(embedding[2]) AS y1 FROM embeddings GROUP BY label")
def bounds(spark, d):
    x, y = F.col("embedding")[0], F.col("embedding")[1]
    return read(spark, d, "embeddings").groupBy("label").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


@query("q_mth01_haversine", "SELECT vec_id, round(2 * 6371008.8 * asin(sqrt(least(1, sin(radians(la2 - la1) / 2) ** 2 + cos(radians(la1)) * cos(radians(la2)) * sin(radians(lo2 - lo1) / 2) ** 2))), 2) AS m FROM (SELECT vec_id, embedding[1]::DOUBLE AS la1, embedding[2]::DOUBLE AS lo1, embedding[3]::DOUBLE AS la2, embedding[4]::DOUBLE AS lo2 FROM embeddings)")
def distance(spark, d):
    x = [F.col("embedding")[i].cast("double") for i in range(4)]
    return read(spark, d, "embeddings").select("vec_id", F.round(risk.haversine(*x), 2).alias("m"))


@query("q_mth03_walk", "SELECT p_partkey, floor(greatest(120, least(900, 120 + p_retailprice / 1.2)) + 0.5) AS seconds FROM part")
def walk(spark, d):
    return read(spark, d, "part").select("p_partkey", risk.walk_seconds(F.col("p_retailprice")).alias("seconds"))


_CLOCK = "lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 75 AS VARCHAR), 2, '0')"


@query("q_dat01_clock_seconds", f"SELECT p_partkey, CASE WHEN p_partkey % 75 < 60 THEN CAST((p_size % 30) * 3600 + (p_partkey % 75) * 60 AS BIGINT) END AS seconds FROM part")
def clock(spark, d):
    t = F.concat(F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("p_partkey") % 75).cast("string"), 2, "0"))
    return read(spark, d, "part").select("p_partkey", text.clock_seconds(t).cast("long").alias("seconds"))


@query("q_dat03_clock_text", "SELECT p_partkey, strftime(TIMESTAMP '2000-01-01' + to_seconds(p_partkey * 1237 - 90000), '%H:%M') AS clock FROM part")
def clock_text(spark, d):
    return read(spark, d, "part").select("p_partkey", text.clock_text(F.col("p_partkey") * 1237 - 90000).alias("clock"))


@query("q_snk03_validate", "SELECT problem, CAST(n AS BIGINT) AS n FROM (SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def validate(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    dup = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("duplicate").alias("problem"), F.count("*").alias("n"))
    orphan = li.join(o, "l_orderkey", "left_anti").agg(F.lit("orphan").alias("problem"), F.count("*").alias("n"))
    return dup.unionByName(orphan)


@query("q_snk08_upsert", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def upsert(spark, d):
    o = read(spark, d, "orders")
    both = o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus = 'O'"))
    return both.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("q_agg17_stats", "SELECT (SELECT count(*) FROM orders) AS trips, (SELECT count(*) FROM lineitem) AS stops, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS segments, (SELECT max(o_orderdate) FROM orders) AS latest")
def stats(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    one = o.agg(F.count("*").alias("trips"), F.max("o_orderdate").alias("latest"))
    return one.crossJoin(F.broadcast(li.agg(F.count("*").alias("stops"), F.countDistinct("l_partkey").alias("segments")))).select("trips", "stops", "segments", "latest")  # one row each


@query("q_lim04_station_search", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%12%' ORDER BY CASE WHEN c_name LIKE '%12' THEN 0 ELSE 1 END, c_custkey LIMIT 40")
def station_search(spark, d):
    tier = F.when(F.col("c_name").endswith("12"), 0).otherwise(1)
    return read(spark, d, "customer").where(F.col("c_name").contains("12")).orderBy(tier, "c_custkey").limit(40).select("c_custkey", "c_name")


@query("q_lim05_bounded_store", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500)")
def bounded_store(spark, d):
    o = read(spark, d, "orders")
    kept = o.where("o_orderstatus <> 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    return o.where("o_orderstatus = 'F'").select("o_orderkey").unionByName(kept.select("o_orderkey"))


@query("q_flt06_service_day", "SELECT o_orderkey FROM orders WHERE dayofweek(o_orderdate) IN (1, 2, 3, 4, 5)")
def service_day(spark, d):
    runs = F.array(*map(F.lit, (False, True, True, True, True, True, False)))  # 0 = Sunday
    return read(spark, d, "orders").where(F.element_at(runs, F.dayofweek("o_orderdate"))).select("o_orderkey")


@query("q_flt07_departure_window", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def departure_window(spark, d):
    return read(spark, d, "lineitem").where("l_shipdate between timestamp_ntz'1996-01-01' and timestamp_ntz'1996-06-30'").agg(F.count("*").alias("n"))


@query("q_flt08_banned", "SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4')")
def banned(spark, d):
    ban = read(spark, d, "part").where("p_brand = 'Brand#4'").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").join(ban, "l_partkey", "left_anti").agg(F.count("*").alias("n"))
