"""Further filters, projections, aggregates, text, time, model and array queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import risk, text
from kelora.plans.evidence import AT, EVIDENCE, evidence
from kelora.plans.registry import query, read

NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("q_flt05_changed_since_cursor", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-28 12:00:00'")
def cursor(spark, d):  # an unreadable cursor reads as no cursor
    since = F.try_to_timestamp(F.lit("2024-01-28 12:00:00")).cast("timestamp_ntz")
    return read(spark, d, "events").where(F.coalesce(F.col("ts") > since, F.lit(True))).select("event_id")


@query("q_flt11_reportable", f"SELECT event_id FROM {EVIDENCE} WHERE p >= 0.3")
def reportable(spark, d):
    return evidence(spark, d).where(F.col("p") >= K.REPORTABLE).select("event_id")


@query("q_flt13_counts_as_evidence", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
def counts_as_evidence(spark, d):
    return read(spark, d, "events").where(F.col("event_type").isin("error", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("q_flt17_considered", f"SELECT DISTINCT e.event_id FROM {EVIDENCE} e WHERE e.event_type = 'error' AND e.segment IN (SELECT p_size FROM part WHERE p_brand = 'Brand#2')")
def considered(spark, d):
    route = read(spark, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_size").alias("segment"))
    return evidence(spark, d).where("event_type = 'error'").join(route, "segment", "left_semi").select("event_id")


@query("q_flt18_fresh_within", f"SELECT count(*) AS n FROM events WHERE ts BETWEEN {NOW} - INTERVAL 45 MINUTE AND {NOW}")
def fresh_within(spark, d):
    return read(spark, d, "events").where(F.expr(f"ts between {AT} - interval 45 minutes and {AT}")).agg(F.count("*").alias("n"))


@query("q_prj01_trip_patterns", "SELECT o_custkey, min(o_orderkey) AS trip, list(k ORDER BY k) AS offsets FROM (SELECT o_custkey, o_orderkey, o_orderkey - min(o_orderkey) OVER (PARTITION BY o_custkey) AS k FROM orders) GROUP BY o_custkey")
def trip_patterns(spark, d):
    one = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("trip"), F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    return one.select("o_custkey", "trip", F.transform("a", lambda x: x - F.col("trip")).alias("offsets"))


@query("q_prj03_claims", "SELECT event_id, CASE WHEN k < 30 THEN 'SEGMENT' WHEN user_id % 3 = 0 THEN 'STATION' WHEN event_type = 'view' THEN 'LINE' ELSE 'NONE' END AS claim FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def claims(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k < 30, "SEGMENT").when(F.col("user_id") % 3 == 0, "STATION").when(F.col("event_type") == "view", "LINE").otherwise("NONE")
    return read(spark, d, "events").select("event_id", kind.alias("claim"))


@query("q_prj04_overrides", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'LOW' END, d.lang) AS kind FROM documents d LEFT JOIN labels l USING (doc_id)")
def overrides(spark, d):
    lab = read(spark, d, "labels").select("doc_id", "quality")
    return read(spark, d, "documents").select("doc_id", "lang").join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 0, "LOW"), "lang").alias("kind"))


@query("q_jon03_known_endpoints", "SELECT count(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey < 3")
def known_endpoints(spark, d):
    n = read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").agg(F.count("*").alias("n"))


@query("q_jon11_signals_on_segment", f"SELECT event_id, ts FROM {EVIDENCE} WHERE segment = 7 AND ts <= {NOW}")
def on_segment(spark, d):
    return evidence(spark, d).where(f"segment = 7 and ts <= {AT}").select("event_id", "ts")


@query("q_jon12_fan_out", "SELECT s.segment AS segment, count(*) AS n FROM (SELECT unnest([CAST(json_extract_string(props, '$.k') AS INTEGER), CAST(json_extract_string(props, '$.k') AS INTEGER) + 1]) AS segment FROM events) s GROUP BY 1")
def fan_out(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(F.explode(F.array(k, k + 1)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


@query("q_jon13_risk_lookup", f"SELECT p_partkey, coalesce(r.p, 0.0) AS probability FROM part LEFT JOIN (SELECT segment, max(p) AS p FROM {EVIDENCE} WHERE ts < TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1) r ON r.segment = p_size")
def risk_lookup(spark, d):
    r = evidence(spark, d).where("ts < timestamp_ntz'2024-01-02 00:00:00'").groupBy("segment").agg(F.max("p").alias("p"))
    return read(spark, d, "part").join(r, F.col("segment") == F.col("p_size"), "left").select("p_partkey", F.coalesce("p", F.lit(0.0)).alias("probability"))


@query("q_jon20_between_places", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, count(s.s_suppkey) AS between_n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey LEFT JOIN supplier s ON s.s_nationkey >= a.n_nationkey AND s.s_nationkey <= b.n_nationkey GROUP BY ALL")
def between_places(spark, d):
    # running counts per place turn the range join into two equi joins
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    run = n.join(c, "n_nationkey", "left").withColumn("up_to", F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy("n_nationkey")))  # one row a nation
    lo = run.select(F.col("n_nationkey").alias("a"), "n_regionkey", (F.col("up_to") - F.coalesce("c", F.lit(0))).alias("before"))
    hi = run.select(F.col("n_nationkey").alias("b"), "n_regionkey", "up_to")
    return lo.join(hi, "n_regionkey").where("a < b").select("a", "b", (F.col("up_to") - F.col("before")).alias("between_n"))


@query("q_jon31_apply_diff", f"SELECT segment, arg_max(event_id, ts) AS event_id FROM {EVIDENCE} WHERE segment NOT IN (SELECT segment FROM {EVIDENCE} WHERE event_type = 'error' AND value > 480) GROUP BY segment")
def apply_diff(spark, d):
    e = evidence(spark, d)
    cleared = e.where("event_type = 'error' and value > 480").select("segment").distinct()
    return e.join(cleared, "segment", "left_anti").groupBy("segment").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("q_jon34_first_citing", f"SELECT segment, min(event_id) AS event_id FROM {EVIDENCE} WHERE p > 0.4 GROUP BY segment")
def first_citing(spark, d):
    return evidence(spark, d).where("p > 0.4").groupBy("segment").agg(F.min("event_id").alias("event_id"))


@query("q_agg01_graph_stats", "SELECT count(*) AS trips, count(DISTINCT o_custkey) AS lines, count(DISTINCT dayofweek(o_orderdate)) AS service_days FROM orders")
def graph_stats(spark, d):
    return read(spark, d, "orders").agg(F.count("*").alias("trips"), F.countDistinct("o_custkey").alias("lines"), F.countDistinct(F.dayofweek("o_orderdate")).alias("service_days"))


@query("q_agg03_channels", "SELECT p_partkey, round(1 - (1 - p_size / 100.0) * (1 - 0.3) * (1 - least((p_partkey % 5) * 0.05, 0.15)), 6) AS p FROM part")
def channels(spark, d):
    p = risk.noisy_or(F.col("p_size") / 100.0, F.lit(0.3), F.least((F.col("p_partkey") % 5) * K.REALTIME_EACH, F.lit(K.REALTIME_CAP)))
    return read(spark, d, "part").select("p_partkey", F.round(p, 6).alias("p"))


@query("q_agg07_lines_per_stop", "SELECT l_suppkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS lines FROM lineitem GROUP BY 1")
def lines_per_stop(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("lines"))


@query("q_agg08_footprint", f"SELECT user_id, list(DISTINCT segment ORDER BY segment) AS segments FROM {EVIDENCE} WHERE event_type = 'error' GROUP BY user_id")
def footprint(spark, d):
    return evidence(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.sort_array(F.collect_set("segment")).alias("segments"))


@query("q_agg10_severity_floor", f"SELECT segment, CAST(greatest(max(severity), CASE WHEN segment % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS severity FROM {EVIDENCE} WHERE event_type <> 'error' GROUP BY segment")
def severity_floor(spark, d):
    floor = F.when(F.col("segment") % 3 == 0, 1).otherwise(0)
    return evidence(spark, d).where("event_type <> 'error'").groupBy("segment").agg(F.max("severity").alias("m")).select("segment", F.greatest("m", floor).cast("long").alias("severity"))


@query("q_agg26_merge_sources", "SELECT user_id, event_type, min(ts) AS first_ts FROM (SELECT * FROM events WHERE event_type <> 'error' UNION ALL SELECT * FROM events WHERE event_type = 'error' OR value >= 50) GROUP BY ALL")
def merge_sources(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type <> 'error'").unionByName(e.where("event_type = 'error' or value >= 50")).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))


@query("q_agg29_fastest", "SELECT p_brand, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS fastest FROM part GROUP BY p_brand")
def fastest(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("fastest"))


@query("q_win12_deltas", "SELECT p_partkey, round(p_retailprice - min(p_retailprice) OVER (PARTITION BY p_brand), 4) AS slower, round(p_retailprice - first_value(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey), 4) AS vs_top FROM part")
def deltas(spark, d):
    w = W.partitionBy("p_brand")
    return read(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") - F.min("p_retailprice").over(w), 4).alias("slower"), F.round(F.col("p_retailprice") - F.first("p_retailprice").over(w.orderBy("p_size", "p_partkey")), 4).alias("vs_top"))


@query("q_win14_line_sequence", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS seq FROM supplier")
def line_sequence(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")).cast("long").alias("seq"))


@query("q_lim01_top_itineraries", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_itineraries(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")


@query("q_set01_union_corpora", "SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'bench', item_id, text FROM benchmark")
def union_corpora(spark, d):
    a = read(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(read(spark, d, "benchmark").select(F.lit("bench").alias("kind"), F.col("item_id").alias("id"), "text"))


@query("q_set04_footprint_overlap", f"SELECT user_id, list_has_any(list(DISTINCT segment) FILTER (WHERE event_type = 'error'), list(DISTINCT segment) FILTER (WHERE event_type = 'purchase')) AS overlap FROM {EVIDENCE} GROUP BY user_id")
def footprint_overlap(spark, d):
    e = evidence(spark, d)
    side = lambda k: F.collect_set(F.when(F.col("event_type") == k, F.col("segment")))
    return e.groupBy("user_id").agg(side("error").alias("a"), side("purchase").alias("b")).select("user_id", F.arrays_overlap("a", "b").alias("overlap"))


@query("q_set05_distinct_ban_sets", f"SELECT count(*) AS n FROM (SELECT DISTINCT list(DISTINCT severity ORDER BY severity) FROM {EVIDENCE} GROUP BY user_id, segment)")
def ban_sets(spark, d):
    sets = evidence(spark, d).groupBy("user_id", "segment").agg(F.sort_array(F.collect_set("severity")).alias("s"))
    return sets.select("s").distinct().agg(F.count("*").alias("n"))


@query("q_str01_canonical_line", "SELECT p_partkey, CASE regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') WHEN 'ECONOMY' THEN 'KJ' WHEN 'SMALL' THEN 'AG' WHEN 'STANDARD' THEN 'SP' END AS line FROM part")
def canonical_line(spark, d):  # fixed alias table: route type -> line
    return read(spark, d, "part").select("p_partkey", risk.lookup(text.group_key(F.col("p_type")), {"ECONOMY": "KJ", "SMALL": "AG", "STANDARD": "SP"}).alias("line"))


@query("q_str14_segment_ids", "SELECT l_orderkey || ':' || l_partkey || '->' || l_suppkey AS segment, count(*) AS n FROM lineitem GROUP BY 1")
def segment_ids(spark, d):
    name = F.concat(F.col("l_orderkey"), F.lit(":"), F.col("l_partkey"), F.lit("->"), F.col("l_suppkey"))
    return read(spark, d, "lineitem").groupBy(name.alias("segment")).agg(F.count("*").alias("n"))


@query("q_str09_typo_budget", "SELECT item_id, CAST(CASE WHEN length(text) >= 10 THEN 2 WHEN length(text) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS budget FROM benchmark")
def typo_budget(spark, d):
    n = F.length("text")
    return read(spark, d, "benchmark").select("item_id", F.when(n >= 10, 2).when(n >= 6, 1).otherwise(0).cast("long").alias("budget"))


@query("q_str24_numeric_suffix", r"SELECT s_suppkey, CAST(regexp_extract(s_name, '(\d+)$', 1) AS BIGINT) AS number FROM supplier")
def numeric_suffix(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", F.regexp_extract("s_name", r"(\d+)$", 1).try_cast("long").alias("number"))


@query("q_dat06_staleness_struct", f"SELECT event_id, CAST(epoch_us({NOW}) - epoch_us(ts) > 300000000 AS BOOLEAN) AS stale FROM events")
def staleness_struct(spark, d):
    age = F.expr(f"unix_micros(cast({AT} as timestamp)) - unix_micros(cast(ts as timestamp))")
    return read(spark, d, "events").select("event_id", (age > 300_000_000).alias("stale"))


@query("q_dat09_service_class", "SELECT CASE dayofweek(o_orderdate) WHEN 0 THEN 'SUNDAY' WHEN 6 THEN 'SATURDAY' ELSE 'WEEKDAY' END AS class, count(*) AS n FROM orders GROUP BY 1")
def service_class(spark, d):
    day = F.dayofweek("o_orderdate")
    return read(spark, d, "orders").groupBy(F.when(day == 1, "SUNDAY").when(day == 7, "SATURDAY").otherwise("WEEKDAY").alias("class")).agg(F.count("*").alias("n"))


@query("q_mth02_equirectangular", "SELECT vec_id, round(6371000 * sqrt((radians(o2 - o1) * cos(radians((a1 + a2) / 2))) ** 2 + radians(a2 - a1) ** 2), 2) AS m FROM (SELECT vec_id, embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS o1, embedding[3]::DOUBLE AS a2, embedding[4]::DOUBLE AS o2 FROM embeddings)")
def equirectangular(spark, d):
    a1, o1, a2, o2 = (F.col("embedding")[i].cast("double") for i in range(4))
    return read(spark, d, "embeddings").select("vec_id", F.round(6371000 * F.hypot(F.radians(o2 - o1) * F.cos(F.radians((a1 + a2) / 2)), F.radians(a2 - a1)), 2).alias("m"))


@query("q_mth06_effective_confidence", "SELECT p_partkey, round(least(1.0, (p_size / 50.0) * CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 1 END * CASE WHEN p_partkey % 3 = 0 THEN 1.15 ELSE 1 END), 6) AS c FROM part")
def effective(spark, d):
    c = (F.col("p_size") / 50.0) * F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(1.0) * F.when(F.col("p_partkey") % 3 == 0, 1.15).otherwise(1.0)
    return read(spark, d, "part").select("p_partkey", F.round(F.least(F.lit(1.0), c), 6).alias("c"))


@query("q_mth09_headway_degradation", "SELECT p_partkey, round(300 * least(1 + p_size / 5.0, 6.0), 4) AS headway, round(300 * least(1 + p_size / 5.0, 6.0) / 2, 4) AS wait FROM part")
def degradation(spark, d):
    h = 300 * F.least(1 + F.col("p_size") / 5.0, F.lit(6.0))
    return read(spark, d, "part").select("p_partkey", F.round(h, 4).alias("headway"), F.round(h / 2, 4).alias("wait"))


@query("q_mth13_ui_score", "SELECT p_partkey, round(1 - 0.62 * (p_size / 50.0) - 0.3 * ((p_partkey % 100) / 100.0) - 0.04 * least(p_size % 6, 3), 4) AS score FROM part")
def ui_score(spark, d):
    s = 1 - 0.62 * (F.col("p_size") / 50.0) - 0.3 * ((F.col("p_partkey") % 100) / 100.0) - 0.04 * F.least(F.col("p_size") % 6, F.lit(3))
    return read(spark, d, "part").select("p_partkey", F.round(s, 4).alias("score"))


@query("q_mth14_social_strength", f"SELECT segment, [0, .22, .32, .45, .53, .58, .60][least(count(DISTINCT user_id), 6) + 1]::DOUBLE AS strength FROM {EVIDENCE} WHERE ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY segment")
def social(spark, d):
    one = evidence(spark, d).where("ts < timestamp_ntz'2024-01-01 12:00:00'").groupBy("segment").agg(F.countDistinct("user_id").alias("n"))
    return one.select("segment", risk.social_strength(F.col("n")).alias("strength"))


@query("q_mth15_recency", "SELECT p_partkey, round(CASE WHEN p_partkey % 500 <= 90 THEN 1 ELSE greatest(0.15, 1 - (p_partkey % 500 - 90) / 270.0 * 0.85) END, 6)::DOUBLE AS w FROM part")
def recent(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(risk.recency(F.col("p_partkey") % 500), 6).alias("w"))


@query("q_mth17_offline", f"SELECT event_id, round(p * 0.85, 6) AS p FROM {EVIDENCE} WHERE event_type = 'error'")
def offline(spark, d):
    s = F.struct(F.col("p").alias("value"), F.lit("online").alias("mode"))
    out = evidence(spark, d).where("event_type = 'error'").withColumn("c", s)
    out = out.withColumn("c", F.col("c").withField("value", F.round(F.col("c.value") * K.OFFLINE, 6)).withField("mode", F.lit("offline")))
    return out.select("event_id", F.col("c.value").alias("p"))


@query("q_mth18_ground", "SELECT p_partkey, 60 * floor((p_retailprice / 100 * 1.35 / CASE WHEN p_size < 25 THEN 22 ELSE 32 END * 3600 + 300) / 60 + 0.5) AS seconds FROM part")
def ground(spark, d):
    t = F.col("p_retailprice") / 100 * 1.35 / F.when(F.col("p_size") < 25, 22).otherwise(32) * 3600 + 300
    return read(spark, d, "part").select("p_partkey", (60 * F.floor(t / 60 + 0.5)).cast("double").alias("seconds"))


@query("q_arr01_json_column", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_column(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("q_arr02_variant_path", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def variant_path(spark, d):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return read(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("q_arr05_pattern_walk", "SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, embedding[i] AS stop, embedding[i + 32] AS arrival FROM embeddings, (SELECT unnest(range(1, 33)) AS i)")
def pattern_walk(spark, d):
    zipped = F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    out = read(spark, d, "embeddings").select("vec_id", F.posexplode(zipped).alias("pos", "z"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("z.a").alias("stop"), F.col("z.b").alias("arrival"))


@query("q_arr09_route_polyline", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) FILTER (WHERE prev IS NULL OR prev <> role) AS path FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def route_polyline(spark, d):
    one = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("p"))
    return one.select("conv_id", F.array_join(F.expr("filter(p, (x, i) -> i = 0 OR x <> p[i - 1])"), ",").alias("path"))


@query("q_snk10_risk_snapshots", f"SELECT date_trunc('day', ts) AS day, segment, round(1 - product(1 - p), 6) AS probability FROM {EVIDENCE} WHERE event_type <> 'error' GROUP BY ALL")
def risk_snapshots(spark, d):
    e = evidence(spark, d).where("event_type <> 'error'")
    return e.groupBy(F.expr("cast(date_trunc('day', ts) as timestamp_ntz)").alias("day"), "segment").agg(F.round(risk.noisy_or_agg(F.col("p")), 6).alias("probability"))
