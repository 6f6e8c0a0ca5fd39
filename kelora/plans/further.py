"""Lifecycle, ranking, transfer, text, date, sink and array queries that the other modules leave open."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import risk, text
from kelora.operators import aliases, cluster
from kelora.operators import relational as R
from kelora.plans.network import _isw, _iss, _mult, _score, _sev, segments
from kelora.plans.registry import query, read

STATUS = "CASE event_type WHEN 'error' THEN 'CONFIRMED' WHEN 'purchase' THEN 'CLEARED' WHEN 'signup' THEN 'REJECTED' ELSE CASE WHEN value >= 60 THEN 'REPORTED' ELSE 'CANDIDATE' END END"


def merge_sql(prev: str, new: str) -> str:
    strong = f"CASE WHEN {new} IN ('REPORTED', 'CONFIRMED') THEN {new} ELSE {prev} END"
    return f"CASE {prev} WHEN 'CONFIRMED' THEN CASE WHEN {new} = 'CLEARED' THEN 'CLEARED' ELSE 'CONFIRMED' END WHEN 'REJECTED' THEN CASE WHEN {new} = 'CONFIRMED' THEN {new} ELSE 'REJECTED' END ELSE {strong} END"


def status(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", "ts", F.expr(STATUS).alias("status"))


@query("q_stm09_status_merge", f"SELECT event_id, status, {merge_sql('prev', 'status')} AS merged FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM (SELECT *, {STATUS} AS status FROM events)) WHERE prev IS NOT NULL")
def status_merge(spark, d):  # a confirmation falls only to a recovery, a rejection only to a confirmation
    s = status(spark, d).withColumn("prev", F.lag("status").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return s.where("prev is not null").select("event_id", "status", F.expr(merge_sql("prev", "status")).alias("merged"))


@query("q_stm08_keyed_upsert", f"""WITH RECURSIVE e AS (SELECT user_id, ts, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT user_id, i, ts AS start, status FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, CASE WHEN epoch_us(e.ts) - epoch_us(f.start) > 10800000000 THEN e.ts ELSE f.start END, CASE WHEN epoch_us(e.ts) - epoch_us(f.start) > 10800000000 THEN e.status ELSE {merge_sql('f.status', 'e.status')} END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, start, arg_max(status, i) AS status, count(*) AS reports FROM f GROUP BY user_id, start""")
def keyed_upsert(spark, d):
    """Reports merge into their key's open incident for 180 minutes after its start; a later one supersedes it.

    No incident reaches across a gap of over 180 minutes, so the ordered fold runs in gap-bounded blocks.
    """
    b = cluster.blocks(status(spark, d).withColumnRenamed("event_id", "id"), "user_id", "ts", 180)
    rows = b.groupBy("user_id", "block").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "status"))).alias("rows"))
    kind = "array<struct<start:timestamp_ntz,status:string,reports:bigint>>"
    fold = f"""aggregate(rows, cast(array() as {kind}), (acc, x) ->
      case when size(acc) = 0 or timestampdiff(microsecond, element_at(acc, -1).start, x.ts) > 10800000000
      then concat(acc, array(struct(x.ts as start, x.status as status, 1L as reports)))
      else concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, {merge_sql('element_at(acc, -1).status', 'x.status')} as status, element_at(acc, -1).reports + 1 as reports))) end)"""
    return rows.select("user_id", F.explode(F.expr(fold)).alias("i")).select("user_id", "i.start", "i.status", "i.reports")


@query("q_stm07_late_or_future", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 90 MINUTE AND TIMESTAMP '2024-01-15 00:00:00' + INTERVAL 5 MINUTE")
def late_or_future(spark, d):
    return read(spark, d, "events").where("ts between timestamp_ntz'2024-01-15 00:00:00' - interval 90 minutes and timestamp_ntz'2024-01-15 00:00:00' + interval 5 minutes").select("event_id")


@query("q_flt15_lead_eligible", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice / 100 BETWEEN 0 AND 1440 AND o_orderstatus <> 'P'")
def lead_eligible(spark, d):  # explicit onset, latency within a day, onset not after publication
    return read(spark, d, "orders").where((F.col("o_orderpriority").startswith("1")) & (F.col("o_totalprice") / 100).between(0, 1440) & (F.col("o_orderstatus") != "P")).select("o_orderkey")


@query("q_flt16_emitted", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey")
def emitted(spark, d):
    return read(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("q_flt19_material", "SELECT p_partkey FROM part WHERE (p_size % 21) / 20.0 >= 0.4")
def material(spark, d):
    return segments(spark, d).where(F.col("confidence") >= K.MATERIAL).select("p_partkey")


@query("q_flt21_clamped_queries", """SELECT c_custkey, greatest(0, least(4, CAST(floor(c_acctbal / 1000) AS INTEGER))) AS max_transfers, c_custkey % 6 AS max_itineraries
 FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey % 6 > 0 AND c_nationkey <> c_custkey % 25""")
def clamped(spark, d):  # unknown places, same place and zero itineraries return early; limits are clamped
    known = read(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    c = read(spark, d, "customer").join(known, "c_nationkey", "left_semi").where("c_custkey % 6 > 0 and c_nationkey <> c_custkey % 25")
    return c.select("c_custkey", F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.col("c_acctbal") / 1000).cast("int"))).alias("max_transfers"), (F.col("c_custkey") % 6).alias("max_itineraries"))


@query("q_jon04_frequency_orphans", "SELECT 'joined' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'orphan', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unused', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def frequency_orphans(spark, d):
    o, c = read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(o.join(c, "k"), "joined").unionByName(n(o.join(c, "k", "left_anti"), "orphan")).unionByName(n(c.join(o, "k", "left_anti"), "unused"))


_xy = "SELECT s_suppkey AS id, s_nationkey AS line, CAST(s_suppkey * 37 % 1000 * 3 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1009 * 3 AS DOUBLE) AS y FROM supplier"
_near = f"SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.line AS al, b.line AS bl FROM ({_xy}) a JOIN ({_xy}) b ON a.id < b.id"


def near(spark, d, metres):
    p = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("line"), F.expr("cast(s_suppkey * 37 % 1000 * 3 as double)").alias("x"), F.expr("cast(s_suppkey * 91 % 1009 * 3 as double)").alias("y"))
    return R.near_points(p, metres).select("cell", "slice", F.col("l.id").alias("a"), F.col("r.id").alias("b"), "d", F.col("l.line").alias("al"), F.col("r.line").alias("bl"))


@query("q_jon07_same_place", f"SELECT a, b FROM ({_near}) WHERE d <= 250")
def same_place(spark, d):
    return near(spark, d, 250.0).select("a", "b")


@query("q_jon08_transfers", f"SELECT a, b, round(d, 4) AS metres FROM ({_near}) WHERE d <= 400 AND al <> bl")
def transfers(spark, d):
    return near(spark, d, 400.0).where("al <> bl").select("a", "b", F.round("d", 4).alias("metres"))


@query("q_srt03_nearest_first", f"SELECT a, list(b ORDER BY d, b) AS footpaths FROM ({_near}) WHERE d <= 400 GROUP BY a")
def nearest_first(spark, d):
    # all pairs of a station are in one slice of its cell, where they are sorted without another shuffle
    one = near(spark, d, 400.0).groupBy("cell", "slice", "a").agg(F.sort_array(F.collect_list(F.struct("d", "b"))).alias("f"))
    return one.select("a", F.transform("f", lambda x: x.b).alias("footpaths"))


_conf14 = "greatest((p_size % 21) / 20.0, (p_partkey % 10) / 10.0)"
_knot14 = f"CASE WHEN {_conf14} <= 0.4 THEN {_conf14} WHEN {_conf14} <= 0.7 THEN 0.4 + ({_conf14} - 0.4) * (0.4 / 0.3) ELSE 0.8 + ({_conf14} - 0.7) * (0.55 / 0.3) END"


@query("q_jon14_overlay_penalty", f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN floor(({_mult} - 1) * {_isw} * ({_knot14}) * (p_retailprice / 10) + 0.5) ELSE 0.0 END AS penalty_seconds FROM part")
def overlay_penalty(spark, d):
    """The overlay decides which segments are degraded: a missing one costs nothing, a caller only raises confidence."""
    overlay = segments(spark, d).where("p_size % 3 = 0").select("p_partkey", "severity", "issue", "confidence")
    asked = read(spark, d, "part").select("p_partkey", "p_retailprice", (F.expr("p_partkey % 10") / 10.0).alias("own"))
    p = risk.penalty_seconds(F.col("severity"), F.col("issue"), F.greatest("confidence", "own"), F.col("p_retailprice") / 10)
    return asked.join(overlay, "p_partkey", "left").select("p_partkey", F.when(F.col("confidence").isNull(), 0.0).otherwise(p).alias("penalty_seconds"))


@query("q_jon18_alias_index", """SELECT alias, list(DISTINCT kind ORDER BY kind) AS kinds, count(DISTINCT id) AS places FROM (SELECT p_brand AS alias, 'BRAND' AS kind, p_partkey AS id FROM part
 UNION ALL SELECT upper(p_name), 'NAME', p_partkey FROM part UNION ALL SELECT p_type, 'TYPE', p_partkey FROM part) GROUP BY alias""")
def alias_index(spark, d):
    p = read(spark, d, "part")
    three = [p.select(c.alias("alias"), F.lit(k).alias("kind"), F.col("p_partkey").alias("id")) for c, k in ((F.col("p_brand"), "BRAND"), (F.upper("p_name"), "NAME"), (F.col("p_type"), "TYPE"))]
    return three[0].unionByName(three[1]).unionByName(three[2]).groupBy("alias").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.countDistinct("id").alias("places"))


@query("q_jon19_segments_at", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def segments_at(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p, s = read(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("l_partkey")), read(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return li.join(p, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber").union(li.join(s, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")).distinct()


@query("q_jon32_labelled_corpus", "SELECT d.doc_id, p.url, coalesce(CASE WHEN l.toxic = 1 THEN 'OVERRIDE' END, CASE WHEN p.url IS NULL THEN 'NO_MANIFEST' ELSE d.source END) AS kind FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def labelled_corpus(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    both = docs.join(read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    kind = F.coalesce(F.when(F.col("toxic") == 1, "OVERRIDE"), F.when(F.col("url").isNull(), "NO_MANIFEST").otherwise(F.col("source")))
    return both.select("doc_id", "url", kind.alias("kind"))


@query("q_jon35_free_slots", "SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND CAST(x.ts AS DATE) = CAST(e.ts AS DATE))")
def free_slots(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return e.where("event_type = 'view'").join(e.where("event_type = 'error'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("event_id")


@query("q_agg18_max_version", "SELECT max(l_shipdate) AS version FROM lineitem")
def max_version(spark, d):
    return read(spark, d, "lineitem").agg(F.max("l_shipdate").alias("version"))


@query("q_agg27_merge_evidence", "SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS authors, count(*) AS n, min(CASE WHEN event_type = 'error' THEN ts END) AS notified FROM events GROUP BY user_id")
def merge_evidence(spark, d):
    """Two evidence states of each key (first and second half of the month) merged: set union, sum, earliest notice."""
    e = read(spark, d, "events").withColumn("half", F.col("ts") >= F.expr("timestamp_ntz'2024-01-15 00:00:00'"))
    one = e.groupBy("user_id", "half").agg(F.collect_set("event_type").alias("a"), F.count("*").alias("n"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("t"))
    side = lambda h, s: one.where(F.col("half") == h).select("user_id", *(F.col(c).alias(c + s) for c in "ant"))
    both = side(False, "1").join(side(True, "2"), "user_id", "full_outer")
    empty = F.array().cast("array<string>")
    return both.select("user_id", F.sort_array(F.array_union(F.coalesce("a1", empty), F.coalesce("a2", empty))).alias("authors"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.least("t1", "t2").alias("notified"))


@query("q_agg34_keep_most_probable", "SELECT l_partkey, arg_max(l_suppkey, l_discount * 100000000 - l_suppkey) AS best, max(l_discount) AS probability, count(*) AS sources FROM lineitem GROUP BY l_partkey")
def keep_most_probable(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_discount", -F.col("l_suppkey"))).alias("best"), F.max("l_discount").alias("probability"), F.count("*").alias("sources"))


@query("q_win06_draft_rank", f"SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY round({_score}, 9) DESC, p_retailprice, p_size % 6, p_partkey) AS rank FROM part")
def draft_rank(spark, d):
    s = F.round(risk.router_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0, F.col("p_size") % 6), 9)
    w = W.partitionBy("p_type").orderBy(F.desc("s"), "p_retailprice", F.col("p_size") % 6, "p_partkey")
    return read(spark, d, "part").withColumn("s", s).select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


_p90 = "p_size * 60.0 + p_retailprice / 10 + 1.2816 * sqrt((0.5 * p_retailprice / 10) ** 2 + (25 + 10 * sqrt(p_size % 5 + 1)) ** 2)"


@query("q_win07_shown_rank", f"SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY round({_score}, 9) DESC, round({_p90}, 6), p_retailprice, p_size % 6, p_partkey) AS rank FROM part")
def shown_rank(spark, d):
    s = F.round(risk.router_score(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 100.0, F.col("p_size") % 6), 9)
    late = F.round(risk.arrival_window(F.col("p_retailprice") / 10, F.col("p_size") % 5 + 1, F.col("p_size") * 60.0).p90, 6)
    w = W.partitionBy("p_type").orderBy(F.desc("s"), "late", "p_retailprice", F.col("p_size") % 6, "p_partkey")
    return read(spark, d, "part").withColumn("s", s).withColumn("late", late).select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("q_win13_dwell_and_run", """SELECT event_id, dwell, CASE WHEN run >= 0 THEN run END AS run FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS dwell,
 CAST(floor(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0) AS BIGINT) - CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - CAST(floor(value) AS BIGINT) AS run FROM events)""")
def dwell_and_run(spark, d):  # departure of a row = arrival + dwell; a run that would be negative is not measured
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    e = read(spark, d, "events").withColumn("dwell", F.floor("value")).withColumn("next", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    run = sec(F.col("next")) - sec(F.col("ts")) - F.col("dwell")
    return e.select("event_id", "dwell", F.when(run >= 0, run).alias("run"))


@query("q_srt01_connections", "SELECT o_orderdate, o_totalprice, o_custkey, o_orderkey FROM orders ORDER BY 1, 2, 3, 4")
def connections(spark, d):
    order = ["o_orderdate", "o_totalprice", "o_custkey", "o_orderkey"]
    return read(spark, d, "orders").select(*order).orderBy(*order)


@query("q_srt02_id_order", "SELECT c_name, c_custkey FROM customer ORDER BY c_name, c_custkey")
def id_order(spark, d):
    return read(spark, d, "customer").select("c_name", "c_custkey").orderBy("c_name", "c_custkey")


@query("q_srt04_candidate_order", "SELECT user_id, min(ts) AS first_seen, max(ts) AS published FROM events GROUP BY user_id ORDER BY 2, 3, 1")
def candidate_order(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("published")).orderBy("first_seen", "published", "user_id")


@query("q_srt05_alias_precedence", "SELECT p_name, len(string_split(p_name, ' ')) AS tokens, length(p_name) AS n FROM part GROUP BY p_name ORDER BY 2 DESC, 3 DESC, 1")
def alias_precedence(spark, d):
    return read(spark, d, "part").select("p_name").distinct().select("p_name", F.size(F.split("p_name", " ")).cast("long").alias("tokens"), F.length("p_name").cast("long").alias("n")).orderBy(F.desc("tokens"), F.desc("n"), "p_name")


@query("q_srt06_overlay_order", "SELECT p_partkey, (p_size % 21) / 20.0 AS probability FROM part ORDER BY 2 DESC, 1")
def overlay_order(spark, d):
    return segments(spark, d).select("p_partkey", F.col("confidence").cast("double").alias("probability")).orderBy(F.desc("probability"), "p_partkey")


_k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("q_set06_orphan_signals", f"SELECT {_k} AS segment, count(*) AS n FROM events WHERE {_k} NOT IN (SELECT p_size FROM part) GROUP BY 1")
def orphan_signals(spark, d):
    e = read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    return e.join(read(spark, d, "part").select(F.col("p_size").alias("segment")), "segment", "left_anti")


@query("q_set07_rejected_union", "SELECT user_id, list(DISTINCT t ORDER BY t) AS rejected FROM (SELECT user_id, event_type AS t FROM events WHERE value < 20 UNION ALL SELECT user_id, 'author' FROM events WHERE event_type = 'error') GROUP BY user_id")
def rejected_union(spark, d):
    sets = read(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_type") == "error", F.lit("author"))).alias("b"))
    return sets.select("user_id", F.sort_array(F.array_union("a", "b")).alias("rejected")).where(F.size("rejected") > 0)


# fixed acronyms that keep their capitals in displayed names
ACRONYMS = "KL KLCC KLIA PWTC UOB USJ USJ7 SS UITM UPM IOI CBP SA TBS HKL MRT LRT BRT TRX PJ GM".split()
_raw_name = "'  ' || c_mktsegment || '-' || lower(c_name) || '   usj7  klcc SunU '"
_acronyms = ", ".join(f"'{a}'" for a in ACRONYMS)


@query("q_str02_display_names", f"""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace({_raw_name}, '\\s+', ' ', 'g')), '[^ -]+|[ -]'),
 lambda t: CASE WHEN upper(t) IN ({_acronyms}) THEN upper(t) WHEN t <> upper(t) AND t <> lower(t) THEN t ELSE upper(t[1:1]) || lower(t[2:]) END), '') AS name FROM customer""")
def display_names(spark, d):
    raw = F.concat(F.lit("  "), "c_mktsegment", F.lit("-"), F.lower("c_name"), F.lit("   usj7  klcc SunU "))
    return read(spark, d, "customer").select("c_custkey", text.display_name(raw, ACRONYMS).alias("name"))


_squeezed = r"trim(regexp_replace(regexp_replace(replace(replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '‘', ''''), '’', ''''), '[^A-Z0-9''\- .!?;]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("q_str04_folded", f"SELECT doc_id, md5({_squeezed}) AS folded_md5 FROM documents")
def folded(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.folded(F.col("text")).cast("binary")).alias("folded_md5"))


@query("q_str05_compact_names", "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS compact, string_split(upper(p_name), ' ') AS tokens FROM part")
def compact_names(spark, d):
    f = text.folded(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", text.group_key(f).alias("compact"), F.split(f, " ").alias("tokens"))


@query("q_str12_position_hash", "SELECT event_id, sha256(concat_ws(chr(1), CAST(user_id AS VARCHAR), event_type, '', printf('%.6f', value), printf('%.6f', -value / 4), '', printf('%.3f', value), CAST(CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS VARCHAR))) AS content_hash FROM events")
def position_hash(spark, d):
    e = read(spark, d, "events")
    f = text.position_hash(F.col("user_id").cast("string"), F.col("event_type"), F.lit(None).cast("string"), F.col("value"), -F.col("value") / 4, F.lit(None).cast("double"), F.col("value"), F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.select("event_id", f.alias("content_hash"))


@query("q_str22_rank_explanations", f"SELECT p_partkey, printf('Option %d: %s %s at %d%% confidence', p_partkey, {_sev}, {_iss}, CAST(floor((p_size % 21) / 20.0 * 100 + 0.5) AS INTEGER)) AS label FROM part")
def rank_explanations(spark, d):
    return segments(spark, d).select("p_partkey", F.format_string("Option %d: %s %s at %d%% confidence", "p_partkey", "severity", "issue", F.floor(F.col("confidence") * 100 + 0.5).cast("int")).alias("label"))


@query("q_str23_interpolated", "SELECT event_id, replace(replace(CASE event_type WHEN 'error' THEN '{n} reports by {who}' WHEN 'view' THEN '{who} saw {n}' ELSE '{n}' END, '{n}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)), '{who}', CAST(user_id AS VARCHAR)) AS message FROM events")
def interpolated(spark, d):
    words = F.coalesce(risk.lookup(F.col("event_type"), {"error": "{n} reports by {who}", "view": "{who} saw {n}"}), F.lit("{n}"))
    return read(spark, d, "events").select("event_id", F.replace(F.replace(words, F.lit("{n}"), F.floor("value").cast("string")), F.lit("{who}"), F.col("user_id").cast("string")).alias("message"))


_clock = "CASE event_id % 4 WHEN 0 THEN '25:61' WHEN 1 THEN user_id || ':xx' WHEN 2 THEN '' ELSE user_id || ':' || right('0' || event_id % 60, 2) || ':30' END"


@query("q_dat02_lenient_clock", f"""SELECT event_id, coalesce(h * 3600 + m * 60 + s, -1) AS seconds FROM (SELECT event_id, TRY_CAST(regexp_extract(c, '^(\\d+):(\\d+)(?::(\\d+))?$', 1) AS BIGINT) AS h, TRY_CAST(regexp_extract(c, '^(\\d+):(\\d+)(?::(\\d+))?$', 2) AS BIGINT) AS m,
 CASE WHEN regexp_extract(c, '^(\\d+):(\\d+)(?::(\\d+))?$', 3) = '' THEN 0 ELSE TRY_CAST(regexp_extract(c, '^(\\d+):(\\d+)(?::(\\d+))?$', 3) AS BIGINT) END AS s FROM (SELECT event_id, {_clock} AS c FROM events))""")
def lenient_clock(spark, d):  # no range check; -1 stands for a text that is no clock time
    return read(spark, d, "events").select("event_id", F.expr(_clock).alias("c")).select("event_id", F.coalesce(text.lenient_seconds(F.col("c")), F.lit(-1)).alias("seconds"))


@query("q_dat07_staleness_tiers", """SELECT event_id, CASE WHEN event_type = 'view' AND m <= 0 THEN 'live' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min' ELSE m // 60 || ' h ' || m % 60 || ' min' END AS wording
 FROM (SELECT *, greatest(0, CAST(floor(value) AS BIGINT) - 50) AS m FROM events)""")
def staleness_tiers(spark, d):
    e = read(spark, d, "events").withColumn("m", F.greatest(F.lit(0), F.floor("value") - 50))
    hours = F.format_string("%d h %d min", F.floor(F.col("m") / 60), F.col("m") % 60)
    return e.select("event_id", F.when((F.col("event_type") == "view") & (F.col("m") <= 0), "live").when(F.col("m") < 1, "just now").when(F.col("m") < 60, F.format_string("%d min", "m")).otherwise(hours).alias("wording"))


@query("q_dat08_lead_minutes", """SELECT user_id, greatest(0, floor((epoch_us(min(CASE WHEN event_type = 'error' THEN ts END)) - epoch_us(min(ts))) / 60000000.0 * 10 + 0.5) / 10) AS lead_minutes FROM events GROUP BY user_id""")
def lead_minutes(spark, d):  # one decimal, never negative, null until notified
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    m = (us(F.min(F.when(F.col("event_type") == "error", F.col("ts")))) - us(F.min("ts"))) / 60000000.0
    lead = risk.half_up(m, 1)
    return read(spark, d, "events").groupBy("user_id").agg(F.when(lead.isNotNull(), F.greatest(F.lit(0.0), lead)).alias("lead_minutes"))


_parts = "CASE user_id % 7 WHEN 0 THEN 'tengah malam' WHEN 1 THEN 'pagi' WHEN 2 THEN 'subuh' WHEN 3 THEN 'tengah  hari' WHEN 4 THEN 'Petang' WHEN 5 THEN 'malam' END"


@query("q_dat11_meridiem", f"""SELECT event_id, CASE WHEN m IN ('tengah malam', 'pagi', 'subuh', 'malam') AND h = 12 THEN 0 WHEN m IN ('tengah hari', 'tengahari', 'petang', 'malam') AND h < 12 THEN h + 12 ELSE h END AS hour
 FROM (SELECT event_id, {_k} % 24 AS h, regexp_replace(lower({_parts}), '\\s+', ' ', 'g') AS m FROM events)""")
def meridiem(spark, d):
    e = read(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") % 24).alias("h"), F.expr(_parts).alias("m"))
    return e.select("event_id", text.hour24(F.col("h"), F.col("m")).alias("hour"))


_cut = "substr('D:' || {stamp} || '+08', 1, CAST(6 + 2 * (event_id % 6) AS INTEGER))"
_at = lambda i, low: f"CASE WHEN length(s) >= {i + 1} THEN CAST(s[{i}:{i + 1}] AS INTEGER) ELSE {low} END"


@query("q_dat14_document_dates", f"""SELECT event_id, make_timestamp(CAST(s[3:6] AS INTEGER), {_at(7, 1)}, {_at(9, 1)}, {_at(11, 0)}, {_at(13, 0)}, {_at(15, 0)}) - INTERVAL 8 HOUR AS created
 FROM (SELECT event_id, {_cut.format(stamp="strftime(ts, '%Y%m%d%H%M%S')")} AS s FROM events)""")
def document_dates(spark, d):
    stamp = read(spark, d, "events").select("event_id", F.expr(_cut.format(stamp="date_format(ts, 'yyyyMMddHHmmss')")).alias("s"))
    return stamp.select("event_id", text.document_date(F.col("s")).alias("created"))


@query("q_mth04_curated_transfer", "SELECT p_partkey, floor(CASE WHEN p_size % 10 = 0 THEN 45.0 ELSE greatest(CAST(p_size * 3 AS DOUBLE), 45 + p_retailprice / 1.1) END + p_size * 30 / 2.0 + 0.5) AS seconds FROM part")
def curated_transfer(spark, d):  # the walk (one platform: 45 s) and half a headway
    walk = F.when(F.col("p_size") % 10 == 0, 45.0).otherwise(F.greatest((F.col("p_size") * 3).cast("double"), 45 + F.col("p_retailprice") / 1.1))
    return read(spark, d, "part").select("p_partkey", risk.half_up(walk + F.col("p_size") * 30 / 2.0).alias("seconds"))


_cons = f"least(1.0, greatest(0.0, ({_mult} - 1) / 1.75 * {_isw}))"


@query("q_mth12_consequence_badge", f"""SELECT p_partkey, round({_cons}, 6) AS consequence, CASE WHEN (p_size % 21) / 20.0 >= 0.7 THEN 'AVOID' WHEN s >= 0.9 THEN 'A' WHEN s >= 0.75 THEN 'B' WHEN s >= 0.55 THEN 'C' WHEN s >= 0.35 THEN 'D' ELSE 'AVOID' END AS badge
 FROM (SELECT *, round(1 - {_cons} * ((p_size % 21) / 20.0), 6) AS s FROM part)""")
def consequence_badge(spark, d):
    weight = risk.consequence(F.col("severity"), F.col("issue"))
    s = F.round(1 - weight * F.col("confidence"), 6)
    badge = F.when(F.col("confidence") >= K.AVOID, "AVOID").otherwise(risk.tiers(s, K.BADGES, "AVOID"))
    return segments(spark, d).select("p_partkey", F.round(weight, 6).alias("consequence"), badge.alias("badge"))


@query("q_mth19_reference_confidence", """SELECT user_id, floor((0.45 * least(a, 3) / 3 + 0.2 * rt + 0.2 * loc + 0.15 * iss) * 1000 + 0.5) / 1000 AS confidence FROM (SELECT user_id, count(DISTINCT event_type) AS a,
 max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS rt, CASE WHEN max(value) > 180 THEN 1.0 WHEN max(value) > 90 THEN 0.5 ELSE 0.0 END AS loc, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS iss FROM events GROUP BY user_id)""")
def reference_confidence(spark, d):
    has = lambda t: F.max((F.col("event_type") == t).cast("int"))
    loc = F.when(F.max("value") > 180, 1.0).when(F.max("value") > 90, 0.5).otherwise(0.0)
    e = read(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("a"), has("error").alias("rt"), loc.alias("loc"), has("purchase").alias("iss"))
    return e.select("user_id", risk.half_up(0.45 * F.least("a", F.lit(3)) / 3 + 0.2 * F.col("rt") + 0.2 * F.col("loc") + 0.15 * F.col("iss"), 3).alias("confidence"))


_imul = lambda a, b: f"CAST((CAST({a} AS HUGEINT) * ({b})) % 4294967296 AS BIGINT)"


@query("q_mth20_seeded_draws", f"""WITH s AS (SELECT user_id, i, (CAST('0x' || substr(sha256('user-' || user_id), 1, 8) AS BIGINT) + (i + 1) * 1831565813) % 4294967296 AS a FROM (SELECT DISTINCT user_id FROM events), range(5) r(i)),
 t AS (SELECT *, {_imul('xor(a, a >> 15)', 'a | 1')} AS b FROM s), u AS (SELECT *, xor(b, (b + {_imul('xor(b, b >> 7)', 'b | 61')}) % 4294967296) AS c FROM t)
 SELECT user_id, i AS draw, xor(c, c >> 14) / 4294967296.0 AS u FROM u""")
def seeded_draws(spark, d):  # the n-th draw is a function of seed and n, so draws need no sequential state
    users = read(spark, d, "events").select("user_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return users.select("user_id", "draw", risk.draw(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("draw")).alias("u"))


@query("q_mth21_simple_penalty", f"""SELECT p_partkey, floor(round(120 * (m - 1), 6) + 0.5) AS penalty_seconds, floor(round(m * 10000, 4) + 0.5) / 10000 AS multiplier, CAST(least(1.0, round(0.34 + 0.075 * least(p_size % 9, 6) + CASE WHEN p_size % 4 = 0 THEN 0.18 ELSE 0 END, 3)) AS DOUBLE) AS evidence
 FROM (SELECT *, greatest(1.0, 1 + ({_mult} - 1) * ((p_size % 21) / 20.0) * {_isw} * CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.4 END) AS m FROM part)""")
def simple_penalty(spark, d):  # a cleared signal leaves 0.4 of its delay
    m = F.greatest(F.lit(1.0), 1 + (risk.lookup(F.col("severity"), K.SEVERITY, 1.0) - 1) * F.col("confidence") * risk.lookup(F.col("issue"), K.ISSUE, 0.5) * F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(0.4))
    evidence = F.least(F.lit(1.0), F.round(0.34 + 0.075 * F.least(F.col("p_size") % 9, F.lit(6)) + F.when(F.col("p_size") % 4 == 0, 0.18).otherwise(0.0), 3))
    return segments(spark, d).select("p_partkey", risk.half_up(F.round(120 * (m - 1), 6)).alias("penalty_seconds"), (risk.half_up(F.round(m * 10000, 4)) / 10000).alias("multiplier"), evidence.alias("evidence"))


_conf22 = "(p_size % 21) / 20.0 * ((p_partkey % 10) / 10.0)"
_knot22 = f"CASE WHEN {_conf22} <= 0.4 THEN {_conf22} WHEN {_conf22} <= 0.7 THEN 0.4 + ({_conf22} - 0.4) * (0.4 / 0.3) ELSE 0.8 + ({_conf22} - 0.7) * (0.55 / 0.3) END"


@query("q_mth22_priced_risk", f"SELECT p_partkey, nullif(floor(({_mult} - 1) * {_isw} * ({_knot22}) * (p_retailprice / 10) + 0.5), 0) AS penalty_seconds FROM part")
def priced_risk(spark, d):  # probability times confidence prices a segment; a healthy one has no price
    p = risk.penalty_seconds(F.col("severity"), F.col("issue"), F.col("confidence") * ((F.col("p_partkey") % 10) / 10.0), F.col("p_retailprice") / 10)
    return segments(spark, d).select("p_partkey", F.when(p > 0, p).alias("penalty_seconds"))


@query("q_arr03_not_all", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> ALL (['F', 'P'])")
def not_all(spark, d):
    return read(spark, d, "orders").where(~F.array_contains(F.array(F.lit("F"), F.lit("P")), F.col("o_orderstatus"))).select("o_orderkey")


@query("q_arr04_weekday", "SELECT o_orderkey FROM orders WHERE [false, true, true, true, false, false, true][dayofweek(o_orderdate) + 1]")
def weekday(spark, d):
    days = F.array(*map(F.lit, (False, True, True, True, False, False, True)))  # Sunday first
    return read(spark, d, "orders").where(F.element_at(days, F.dayofweek("o_orderdate"))).select("o_orderkey")


@query("q_arr06_sorted_unions", "SELECT n, list(DISTINCT v ORDER BY v) AS both FROM (SELECT c_nationkey AS n, c_mktsegment AS v FROM customer UNION ALL SELECT s_nationkey, 'S' || s_suppkey % 7 FROM supplier) GROUP BY n")
def sorted_unions(spark, d):
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.collect_set("c_mktsegment").alias("a"))
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.collect_set(F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string"))).alias("b"))
    empty = F.array().cast("array<string>")
    return c.join(s, "n", "full_outer").select("n", F.sort_array(F.array_distinct(F.concat(F.coalesce("a", empty), F.coalesce("b", empty)))).alias("both"))


_ints = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT))"


@query("q_arr07_shape_slice", f"SELECT vec_id, list_concat(list_concat([-1::BIGINT], ({_ints})[label % 20 + 1 : label % 20 + 10]), [-2::BIGINT]) AS shape FROM embeddings")
def shape_slice(spark, d):
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    return read(spark, d, "embeddings").select("vec_id", F.concat(F.array(F.lit(-1).cast("long")), F.slice(ints, (F.col("label") % 20 + 1).cast("int"), F.lit(10)), F.array(F.lit(-2).cast("long"))).alias("shape"))


@query("q_arr08_sources_sorted", "SELECT user_id, CAST(ts AS DATE) AS day, list(event_id ORDER BY event_type, ts, event_id) AS sources FROM events GROUP BY 1, 2")
def sources_sorted(spark, d):
    one = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_type", "ts", "event_id"))).alias("s"))
    return one.select("user_id", "day", F.transform("s", lambda x: x.event_id).alias("sources"))


@query("q_arr10_stations_along", "SELECT l_orderkey, flatten(list([l_partkey, l_suppkey] ORDER BY l_linenumber, l_partkey, l_suppkey)) AS stations FROM lineitem GROUP BY l_orderkey")
def stations_along(spark, d):
    legs = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("legs"))
    return legs.select("l_orderkey", F.flatten(F.transform("legs", lambda x: F.array(x.l_partkey, x.l_suppkey))).alias("stations"))


@query("q_snk06_ndjson", """SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def ndjson(spark, d):
    return read(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("line"))


@query("q_snk16_geojson", """SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_suppkey * 37 % 1000 || ',' || s_suppkey * 91 % 1009 || ']},"properties":{"id":' || s_suppkey || ',"line":' || s_nationkey || '}}' AS feature FROM supplier""")
def geojson(spark, d):
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") * 37 % 1000, F.col("s_suppkey") * 91 % 1009).alias("coordinates"))
    own = F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("line"))
    return read(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), own.alias("properties"))).alias("feature"))


@query("q_src12_feed_rows", "SELECT DISTINCT user_id, coalesce(nullif(event_type, 'view'), 'trip-' || user_id) AS vehicle, CAST(floor(coalesce(CASE WHEN value > 50 THEN value END, event_id % 1000)) AS BIGINT) AS at FROM events WHERE event_type <> 'signup'")
def feed_rows(spark, d):  # deleted entities go; ids and times fall back along their chains; equal positions are one
    e = read(spark, d, "events").where("event_type <> 'signup'")
    vehicle = F.coalesce(F.nullif("event_type", F.lit("view")), F.concat(F.lit("trip-"), F.col("user_id").cast("string")))
    at = F.floor(F.coalesce(F.when(F.col("value") > 50, F.col("value")), (F.col("event_id") % 1000).cast("double")))
    return e.select("user_id", vehicle.alias("vehicle"), at.alias("at")).dropDuplicates()


@query("q_gra06_adjacency", "SELECT e.a, e.b, e.kind, coalesce(r.p, 0.0) AS risk FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, 'RIDE' AS kind FROM lineitem UNION ALL SELECT DISTINCT s_nationkey, s_suppkey, 'WALK' FROM supplier) e LEFT JOIN (SELECT p_partkey, (p_size % 21) / 20.0 AS p FROM part WHERE p_size % 3 = 0) r ON e.a = r.p_partkey")
def adjacency(spark, d):
    ride = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("RIDE").alias("kind")).distinct()
    walk = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"), F.lit("WALK").alias("kind")).distinct()
    p = segments(spark, d).where("p_size % 3 = 0").select(F.col("p_partkey").alias("a"), F.col("confidence").cast("double").alias("p"))
    return ride.union(walk).join(p, "a", "left").select("a", "b", "kind", F.coalesce("p", F.lit(0.0)).alias("risk"))


@query("q_gra08_same_station", "SELECT c_custkey, c_nationkey AS station, 0 AS legs, 0 AS duration FROM customer WHERE c_nationkey = c_custkey % 25")
def same_station(spark, d):
    return read(spark, d, "customer").where("c_nationkey = c_custkey % 25").select("c_custkey", F.col("c_nationkey").alias("station"), F.lit(0).alias("legs"), F.lit(0).alias("duration"))


@query("q_pip05_overlay_diagnostics", f"SELECT kind, count(DISTINCT id) AS n FROM (SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'inactive' WHEN {_k} NOT IN (SELECT p_size FROM part) THEN 'orphan' ELSE 'applied' END AS kind FROM events) GROUP BY kind")
def overlay_diagnostics(spark, d):
    known = read(spark, d, "part").select(F.col("p_size").alias("k")).distinct().withColumn("known", F.lit(True))
    e = read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).join(known, "k", "left")
    kind = F.when(F.col("event_type") == "signup", "inactive").when(F.col("known").isNull(), "orphan").otherwise("applied")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("q_str08_typo_distance", """SELECT p_partkey, p_name, mention, CASE WHEN distance <= CASE WHEN length(p_name) >= 8 THEN 2 ELSE 1 END THEN distance END AS distance FROM (SELECT *, damerau_levenshtein(p_name, mention) AS distance FROM
 (SELECT p.p_partkey, p.p_name, n.p_name AS mention FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1 UNION ALL SELECT p_partkey, p_name, concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3)) FROM part))""")
def typo_distance(spark, d):  # each name against its neighbour's and against itself with two letters swapped
    p = read(spark, d, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("mention"))
    swapped = p.select("p_partkey", F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.substr("p_name", F.lit(3))).alias("mention"))
    pairs = p.join(nxt.unionByName(swapped), "p_partkey")
    budget = F.when(F.length("p_name") >= 8, 2).otherwise(1)
    return pairs.select("p_partkey", "p_name", "mention", text.typo_distance(F.col("p_name"), F.col("mention"), budget).alias("distance"))


_MENTION = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(upper(p_name), ' ', '') WHEN 2 THEN concat(substr(upper(p_name), 1, 2), substr(upper(p_name), 4)) ELSE concat(substr(upper(p_name), 2, 1), substr(upper(p_name), 1, 1), substr(upper(p_name), 3, length(p_name) - 3)) END"


@query("q_jon17_alias_lookup", f"""WITH m AS (SELECT DISTINCT {_MENTION} AS mention FROM part), a AS (SELECT DISTINCT upper(p_name) AS alias FROM part),
 h AS (SELECT mention, alias, CASE WHEN mention = alias THEN 0 WHEN replace(mention, ' ', '') = replace(alias, ' ', '') THEN 1 ELSE 2 END AS step, damerau_levenshtein(mention, alias) AS distance,
  CASE WHEN length(mention) >= 10 THEN 2 WHEN length(mention) >= 6 THEN 1 ELSE 0 END AS budget, len(string_split(mention, ' ')) = len(string_split(alias, ' ')) AS even FROM m, a),
 g AS (SELECT *, CASE WHEN step < 2 THEN 0 ELSE distance END AS d FROM h WHERE step < 2 OR (even AND distance <= budget)),
 b AS (SELECT * FROM g QUALIFY rank() OVER (PARTITION BY mention ORDER BY step, d) = 1)
 SELECT p.p_partkey, ['exact', 'compact', 'fuzzy'][min(b.step) + 1] AS how, string_agg(b.alias, '|' ORDER BY b.alias) AS aliases
 FROM (SELECT p_partkey, {_MENTION} AS mention FROM part) p LEFT JOIN b ON b.mention = p.mention GROUP BY p.p_partkey""")
def alias_lookup(spark, d):
    p = read(spark, d, "part")
    named = p.select("p_partkey", F.expr(_MENTION).alias("mention"))
    found = aliases.lookup(named, p.select(F.upper("p_name").alias("alias")))
    return named.join(found, "mention", "left").select("p_partkey", "how", F.array_join("aliases", "|").alias("aliases"))


@query("q_jon16_interchange_pair", "SELECT l.a, l.b, CASE WHEN l.a <> l.b AND x.s_nationkey = y.s_nationkey THEN x.s_nationkey END AS place FROM (SELECT DISTINCT l_suppkey AS a, l_partkey % 10 AS b FROM lineitem) l LEFT JOIN supplier x ON x.s_suppkey = l.a LEFT JOIN supplier y ON y.s_suppkey = l.b")
def interchange_pair(spark, d):  # the place that two platforms share; null where they are no pair
    s = read(spark, d, "supplier")
    pairs = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 10).alias("b")).distinct()
    of = lambda c, n: s.select(F.col("s_suppkey").alias(c), F.col("s_nationkey").alias(n))
    both = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return both.select("a", "b", F.when((F.col("a") != F.col("b")) & (F.col("x") == F.col("y")), F.col("x")).alias("place"))
