"""Whole results from many operators: ranked journeys, ban seeds, the network's patterns, statements with clock times and headlines, synchronised state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import phrases as P
from kelora.functions import risk, rulings, text
from kelora.operators import graph
from kelora.plans.network import _conf, _isw, _mult, segments
from kelora.plans.registry import dealt, query, read
from kelora.plans.reports import REPORTS, _is, _k, parsed, reports

HALF = 0.5001  # scores have six places; a hair over a half lets both engines round a half step up
MATERIAL_PENALTY, TRANSFER_HAZARD, AT_RISK = 0.3, 0.08, 0.35  # fixed: added hazard of a material risk, hazard of a transfer, least score that is safe

_prob = f"{_conf} * ((p_partkey % 10) / 10.0)"
_hazard = f"least(1.0, {_prob} * least(1.0, ({_mult} - 1) / 1.75 * {_isw}) + CASE WHEN {_conf} >= {K.MATERIAL} OR {_prob} >= {K.MATERIAL} THEN {MATERIAL_PENALTY} ELSE 0 END)"
JOURNEYS = f"""(SELECT *, score >= {AT_RISK} AND NOT avoid AS safe FROM (SELECT l_orderkey, o_custkey, floor((1 - hazard) / (1 + {TRANSFER_HAZARD} * (lines - 1)) * 1000000 + {HALF}) / 1000000 AS score, duration, lines, risky, worst, avoid
 FROM (SELECT l_orderkey, o_custkey, 1 - list_reduce(list_prepend(1.0::DOUBLE, list_sort(list({_hazard}))), lambda a, b: a * (1 - b)) AS hazard, CAST(sum(l_quantity) * 60 AS BIGINT) AS duration, count(DISTINCT l_suppkey) AS lines, count(DISTINCT l_partkey) FILTER (WHERE {_conf} >= {K.MATERIAL} OR {_prob} >= {K.MATERIAL}) AS risky,
 round(max({_prob}), 6) AS worst, max({_conf}) >= {K.AVOID} AS avoid FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)))"""
_RANK = "row_number() OVER (PARTITION BY o_custkey ORDER BY safe DESC, score DESC, duration, l_orderkey)"


def journeys(spark, d) -> DataFrame:
    """Every order is a journey over segments (parts) and lines (suppliers), with its reliability score."""
    p = F.col("confidence") * ((F.col("p_partkey") % 10) / 10.0)
    material = (F.col("confidence") >= K.MATERIAL) | (p >= K.MATERIAL)
    hazard = F.least(F.lit(1.0), p * risk.consequence(F.col("severity"), F.col("issue")) + F.when(material, MATERIAL_PENALTY).otherwise(0.0))
    seg = segments(spark, d).select(F.col("p_partkey").alias("l_partkey"), hazard.alias("hazard"), material.alias("material"), p.alias("p"), "confidence")
    trips = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(seg, "l_partkey").groupBy("l_orderkey").agg(
        # a trip's few hazards are multiplied in the order of their size, so the result does not depend on arrival
        (1 - F.aggregate(F.sort_array(F.collect_list("hazard")), F.lit(1.0), lambda a, b: a * (1 - b))).alias("h"), (F.sum("l_quantity") * 60).cast("long").alias("duration"), F.size(F.collect_set("l_suppkey")).alias("lines"),
        F.size(F.collect_set(F.when(F.col("material"), F.col("l_partkey")))).alias("risky"), F.round(F.max("p"), 6).alias("worst"), (F.max("confidence") >= K.AVOID).alias("avoid"))  # a trip's few lines and segments
    trips = trips.join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    trips = trips.withColumn("score", F.floor((1 - F.col("h")) / (1 + TRANSFER_HAZARD * (F.col("lines") - 1)) * 1000000 + HALF) / 1000000)
    return trips.withColumn("safe", ~F.col("avoid") & (F.col("score") >= AT_RISK)).drop("h")


def _choice():
    return W.partitionBy("o_custkey").orderBy(F.desc("safe"), F.desc("score"), "duration", "l_orderkey")


@query("q_pip06_ranked", f"""SELECT o_custkey, l_orderkey, rank, score, CASE WHEN avoid THEN 'AVOID' WHEN score >= 0.9 THEN 'A' WHEN score >= 0.75 THEN 'B' WHEN score >= 0.55 THEN 'C' WHEN score >= 0.35 THEN 'D' ELSE 'AVOID' END AS badge, safe, risky, worst,
 CAST(lines - 1 AS INTEGER) AS transfers, duration - min(duration) OVER (PARTITION BY o_custkey) AS slower, rank = 1 AND safe AS recommended, NOT max(safe) OVER (PARTITION BY o_custkey) AS no_safe FROM (SELECT *, {_RANK} AS rank FROM {JOURNEYS})""")
def ranked(spark, d):
    """The journeys of one traveller, safe ones first, then by score, time and id; none is recommended where none is safe."""
    j = journeys(spark, d).withColumn("rank", F.row_number().over(_choice()))
    own = W.partitionBy("o_custkey")
    badge = F.when(F.col("avoid"), "AVOID").otherwise(risk.tiers(F.col("score"), K.BADGES, "AVOID"))
    return j.select("o_custkey", "l_orderkey", "rank", "score", badge.alias("badge"), "safe", "risky", "worst", (F.col("lines") - 1).alias("transfers"), (F.col("duration") - F.min("duration").over(own)).alias("slower"),
                    ((F.col("rank") == 1) & F.col("safe")).alias("recommended"), (~F.max("safe").over(own)).alias("no_safe"))


ROAD_KMH, ROAD_LEAST = 22, 600  # fixed: road speed in the peak, least seconds of a road journey
FRAGILE = ("if the disruption on the recommended journey clears, a faster one could lead again", "if the faster journey's risk is downgraded, it leads again", "if a disruption that nobody has reported lies on this journey, the order could change")
_told = f"({_conf} >= {K.REPORTABLE})"


@query("q_pip07_advisory", f"""WITH j AS (SELECT *, {_RANK} AS rank FROM {JOURNEYS}), top AS (SELECT * FROM j WHERE rank = 1), f AS (SELECT o_custkey, arg_min(l_orderkey, struct_pack(d := duration, k := l_orderkey)) AS fastest, bool_and(avoid) AS no_safe, count(*) AS journeys FROM j GROUP BY o_custkey),
 s AS (SELECT o_custkey, l_partkey, max(round({_prob}, 6)) AS p FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE {_told} GROUP BY ALL), c AS (SELECT o_custkey, count(*) AS signals, arg_max(l_partkey, struct_pack(p := p, k := -l_partkey)) AS worst_signal FROM s GROUP BY o_custkey),
 r AS (SELECT o_custkey, 3 + o_custkey % 97 / 400.0 AS a, 101 + o_custkey % 89 / 300.0 AS b, 3 + o_custkey * 7 % 97 / 400.0 AS c, 101 + o_custkey * 5 % 89 / 300.0 AS e FROM top)
 SELECT top.o_custkey, CASE WHEN NOT no_safe THEN l_orderkey END AS recommended, no_safe, journeys, coalesce(signals, 0) AS signals, worst_signal, CASE WHEN no_safe THEN CAST(greatest({ROAD_LEAST}, floor(sqrt(((c - a) * 111.32) ** 2 + ((e - b) * 111.32 * cos(radians(a))) ** 2) / {ROAD_KMH} * 3600 + 0.5)) AS BIGINT) END AS by_road,
 CASE WHEN risky > 0 THEN '{FRAGILE[0]}' WHEN fastest <> l_orderkey THEN '{FRAGILE[1].replace("'", "''")}' ELSE '{FRAGILE[2].replace("'", "''")}' END AS could_be_wrong FROM top JOIN f USING (o_custkey) JOIN r USING (o_custkey) LEFT JOIN c USING (o_custkey)""")
def advisory(spark, d):
    """One advisory a traveller: the best journey unless all are to be avoided (then the time by road), what could turn the
    order round, and how many degraded segments were considered, the worst of them by name."""
    j = graph.written(journeys(spark, d))
    top = j.withColumn("rank", F.row_number().over(_choice())).where("rank = 1")
    f = j.groupBy("o_custkey").agg(F.min_by("l_orderkey", F.struct("duration", "l_orderkey")).alias("fastest"), F.min("avoid").alias("no_safe"), F.count("*").alias("journeys"))
    told = segments(spark, d).where(F.col("confidence") >= K.REPORTABLE).select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("confidence") * ((F.col("p_partkey") % 10) / 10.0), 6).alias("p"))
    own = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(told, "l_partkey")
    c = own.groupBy("o_custkey", "l_partkey").agg(F.max("p").alias("p")).groupBy("o_custkey").agg(F.count("*").alias("signals"), F.max_by("l_partkey", F.struct("p", -F.col("l_partkey"))).alias("worst_signal"))
    lat = lambda k: 3 + F.col("o_custkey") * k % 97 / 400.0
    lon = lambda k: 101 + F.col("o_custkey") * k % 89 / 300.0
    km = F.sqrt(F.pow((lat(7) - lat(1)) * 111.32, F.lit(2.0)) + F.pow((lon(5) - lon(1)) * 111.32 * F.cos(F.radians(lat(1))), F.lit(2.0)))
    road = F.greatest(F.lit(ROAD_LEAST), risk.half_up(km / ROAD_KMH * 3600)).cast("long")
    why = F.when(F.col("risky") > 0, FRAGILE[0]).when(F.col("fastest") != F.col("l_orderkey"), FRAGILE[1]).otherwise(FRAGILE[2])
    a = top.join(f, "o_custkey").join(c, "o_custkey", "left")
    return a.select("o_custkey", F.when(~F.col("no_safe"), F.col("l_orderkey")).alias("recommended"), "no_safe", "journeys", F.coalesce("signals", F.lit(0)).alias("signals"), "worst_signal", F.when(F.col("no_safe"), road).alias("by_road"), why.alias("could_be_wrong"))


SEEDS, BANS, UNIONS = 3, 2, 4  # fixed: journeys whose segments are banned, segments banned of each, journeys whose lines are banned together


@query("q_lim02_seeds", f"""WITH r AS (SELECT *, {_RANK} AS rank FROM {JOURNEYS}), l AS (SELECT r.o_custkey, r.rank, r.l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY r.l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM r JOIN lineitem USING (l_orderkey) WHERE rank <= {UNIONS}),
 f AS (SELECT o_custkey, l_suppkey, min(rank) AS rank FROM l GROUP BY ALL), u AS (SELECT o_custkey, rank, count(*) AS fresh FROM f GROUP BY ALL)
 SELECT b.o_custkey, b.rank, b.bans, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY b.o_custkey ORDER BY b.rank) AS BIGINT) AS banned_lines FROM (SELECT o_custkey, rank, CASE WHEN rank <= {SEEDS} THEN string_agg(l_partkey, '|' ORDER BY n) FILTER (WHERE n <= {BANS}) END AS bans FROM l GROUP BY o_custkey, rank) b LEFT JOIN u USING (o_custkey, rank)""")
def seeds(spark, d):
    """What the next rounds of a diverse search ban: the first segments of the best three journeys, and the lines of the best four together."""
    best = journeys(spark, d).withColumn("rank", F.row_number().over(_choice())).where(F.col("rank") <= UNIONS).select("o_custkey", "rank", "l_orderkey")
    legs = best.join(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    row = legs.groupBy("o_custkey", "rank").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"), F.collect_set("l_suppkey").alias("lines"))
    upto = W.partitionBy("o_custkey").orderBy("rank")  # at most four rows of a traveller
    bans = F.when(F.col("rank") <= SEEDS, F.array_join(F.transform(F.slice("s", 1, BANS), lambda x: x["l_partkey"].cast("string")), "|"))
    return row.select("o_custkey", "rank", bans.alias("bans"), F.size(F.array_distinct(F.flatten(F.collect_list("lines").over(upto)))).cast("long").alias("banned_lines"))


_metres = lambda a, b, c, e: f"2 * {K.EARTH_M} * asin(sqrt(least(1.0, sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({e} - {b}) / 2) ** 2)))"


@query("q_jon22_shape_match", f"""WITH RECURSIVE p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_tax, l_discount) - 1 AS n, l_quantity AS lat, l_tax * 100 AS lon, l_partkey % 50 AS tlat, l_discount * 100 AS tlon FROM lineitem),
 m AS (SELECT DISTINCT l_orderkey, -1::BIGINT AS stop, 0::BIGINT AS point FROM lineitem UNION ALL SELECT l_orderkey, stop, point FROM (SELECT m.l_orderkey, m.stop + 1 AS stop, p.n AS point, row_number() OVER (PARTITION BY m.l_orderkey ORDER BY round({_metres('p.lat', 'p.lon', 't.tlat', 't.tlon')}, 3), p.n) AS c
 FROM m JOIN p t ON t.l_orderkey = m.l_orderkey AND t.n = m.stop + 1 JOIN p ON p.l_orderkey = m.l_orderkey AND p.n >= m.point) WHERE c = 1) SELECT * FROM m WHERE stop >= 0""")
def shape_match(spark, d):
    """The nearest point of a trip's shape for each stop in turn, never before the point of the stop before it."""
    point = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("lat"), (F.col("l_tax") * 100).alias("lon"), (F.col("l_partkey") % 50).alias("tlat"), (F.col("l_discount") * 100).alias("tlon"))
    trips = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("p"))  # one trip's stops

    def nearest(a, stop):
        since = F.slice("p", a["at"] + 1, F.size("p"))
        return F.array_min(F.transform(since, lambda q, j: F.struct(F.round(risk.haversine(q["lat"], q["lon"], stop["tlat"], stop["tlon"]), 3).alias("d"), (a["at"] + j).alias("at"))))["at"]

    state = lambda at, all_: F.struct(at.alias("at"), all_.alias("all"))
    start = state(F.lit(0), F.array().cast("array<int>"))
    found = F.aggregate("p", start, lambda a, stop: F.transform(F.array(nearest(a, stop)), lambda at: state(at, F.concat(a["all"], F.array(at))))[0])
    return trips.select("l_orderkey", F.posexplode(found["all"]).alias("stop", "point")).select("l_orderkey", F.col("stop").cast("long"), F.col("point").cast("long"))


@query("q_pip01_patterns", """SELECT pattern, stops, count(*) AS trips, min(l_orderkey) AS first_trip, min(run) AS fastest FROM (SELECT l_orderkey, string_agg(l_suppkey, '>' ORDER BY l_linenumber, l_suppkey) AS pattern, count(*) AS stops,
 CAST(sum(l_quantity) AS BIGINT) AS run FROM lineitem GROUP BY l_orderkey) GROUP BY pattern, stops""")
def patterns(spark, d):
    """The distinct stop sequences of the timetable with their trips."""
    one = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("s"), F.sum("l_quantity").cast("long").alias("run"))
    one = one.select("l_orderkey", "run", F.array_join(F.transform("s", lambda x: x["l_suppkey"].cast("string")), ">").alias("pattern"), F.size("s").cast("long").alias("stops"))
    return one.groupBy("pattern", "stops").agg(F.count("*").alias("trips"), F.min("l_orderkey").alias("first_trip"), F.min("run").alias("fastest"))


@query("q_pip01_stations", """WITH e AS (SELECT l_orderkey, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem), s AS (SELECT a, b FROM e WHERE a <> b GROUP BY ALL)
 SELECT s_suppkey, (SELECT count(*) FROM s WHERE a = s_suppkey) AS links_out, (SELECT count(*) FROM s WHERE b = s_suppkey) AS links_in, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS trips FROM supplier""")
def stations(spark, d):
    """Every station with its links and trips; one without any is kept, with zeros."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    e = li.select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")).alias("b")).where("a <> b").distinct()
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("s_suppkey"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("s_suppkey"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    ends = ends.groupBy("s_suppkey").agg(F.sum("o").alias("links_out"), F.sum("i").alias("links_in"))
    trips = li.select("l_orderkey", "l_suppkey").distinct().groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("trips"))
    return read(spark, d, "supplier").select("s_suppkey").join(ends, "s_suppkey", "left").join(trips, "s_suppkey", "left").na.fill(0, ["links_out", "links_in", "trips"])


@query("q_pip03_ingested", "SELECT h AS hash, min(event_id) AS original, count(*) AS copies, count(DISTINCT user_id) AS authors, min(ts) AS first_seen, arg_min(class, event_id) AS class FROM (SELECT *, sha256(lower(trim(regexp_replace(regexp_replace(said, '(?i)^\\s*RT\\s+(@\\w+:?\\s*)*', ''), '\\s+', ' ', 'g')))) AS h FROM "
       + f"{REPORTS}) GROUP BY h")
def ingested(spark, d):
    """Reports with the same words (a repost mark aside) are one candidate, seen first by its earliest author."""
    r = reports(spark, d).withColumn("hash", text.content_hash(F.col("said")))
    return r.groupBy("hash").agg(F.min("event_id").alias("original"), F.count("*").alias("copies"), F.countDistinct("user_id").alias("authors"), F.min("ts").alias("first_seen"), F.min_by("class", "event_id").alias("class"))


@query("q_prj02_entity", f"SELECT event_id, ts, {_k} AS segment, event_type AS issue, round(value, 2) AS minutes, user_id AS source FROM events")
def entity(spark, d):
    """Row to nested entity, written as JSON, and back."""
    e = read(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "ts", F.struct(F.get_json_object("props", "$.k").cast("int").alias("segment")).alias("location"),
        F.col("event_type").alias("issue"), F.col("value").alias("minutes"), F.array(F.struct(F.col("user_id").alias("id"))).alias("sources")), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("j"))
    shape = "event_id long, ts timestamp_ntz, location struct<segment:int>, issue string, minutes double, sources array<struct<id:long>>"
    back = e.select(F.from_json("j", shape, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("e")).select("e.*")
    return back.select("event_id", "ts", "location.segment", "issue", F.round("minutes", 2).alias("minutes"), F.col("sources")[0]["id"].alias("source"))


CURSOR = "2024-01-25 00:00:00"


@query("q_stm12_sync", f"""SELECT segment, arg_max(event_id, ts) FILTER (WHERE ts <= TIMESTAMP '{CURSOR}') AS cached, arg_max(event_id, ts) AS current, count(*) FILTER (WHERE ts > TIMESTAMP '{CURSOR}') AS changes, max(ts) AS next_cursor
 FROM (SELECT *, {_k} AS segment FROM events) GROUP BY segment""")
def sync(spark, d):
    """A cached state brought up to date with what changed since its cursor, which moves to the last change."""
    e = read(spark, d, "events").withColumn("segment", F.get_json_object("props", "$.k").cast("int"))
    new = F.expr(f"ts > timestamp_ntz'{CURSOR}'")
    return e.groupBy("segment").agg(F.max_by(F.when(~new, F.col("event_id")), F.when(~new, F.col("ts"))).alias("cached"), F.max_by("event_id", "ts").alias("current"), F.count_if(new).alias("changes"), F.max("ts").alias("next_cursor"))


@query("q_stm10_controls", f"""SELECT segment, CASE arg_max(event_type, ts) WHEN 'signup' THEN 'CLEARED' WHEN 'click' THEN 'REJECTED' ELSE 'REPORTED' END AS status, max(ts) AS updated, max(ts) FILTER (WHERE event_type = 'signup') AS ended
 FROM (SELECT *, {_k} AS segment FROM events) GROUP BY segment HAVING count(*) FILTER (WHERE event_type NOT IN ('signup', 'click')) > 0""")
def controls(spark, d):
    """Reports and the operator's clear and reject commands as one stream; a command without a report does nothing."""
    e = read(spark, d, "events").withColumn("segment", F.get_json_object("props", "$.k").cast("int"))
    status = F.when(F.col("event_type") == "signup", "CLEARED").when(F.col("event_type") == "click", "REJECTED").otherwise("REPORTED")
    s = e.groupBy("segment").agg(F.max_by(status, "ts").alias("status"), F.max("ts").alias("updated"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("ended"), F.count_if(status == "REPORTED").alias("n"))
    return s.where("n > 0").drop("n")


LIMIT = 500  # fixed: entries that a store keeps, confirmed ones always


@query("q_stm14_compacted", f"""WITH s AS (SELECT user_id, {_k} AS segment, max(ts) AS stored, max(event_type = 'purchase') AS confirmed FROM events GROUP BY ALL)
 SELECT user_id, segment, stored, confirmed FROM s QUALIFY confirmed OR row_number() OVER (PARTITION BY confirmed ORDER BY stored DESC, user_id DESC, segment DESC) <= {LIMIT} - (SELECT count(*) FROM s WHERE confirmed)""")
def compacted(spark, d):
    """Over the limit the oldest entries go, confirmed ones never: the rest is a top-k of what room they leave."""
    s = read(spark, d, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("int").alias("segment")).agg(F.max("ts").alias("stored"), F.max(F.col("event_type") == "purchase").alias("confirmed"))
    room = max(0, LIMIT - s.where("confirmed").limit(LIMIT).count())
    return s.where("confirmed").union(s.where("not confirmed").orderBy(F.desc("stored"), F.desc("user_id"), F.desc("segment")).limit(room))


# fixed values: parts of the day, and the words before and after a clock time that tell its role
PARTS = r"(?:pagi|petang|malam|tengah\s*hari|tengahari|tengah\s*malam|subuh)"
CLOCK = rf"(?i)(?:(?:jam|pukul)\s+)?\b\d{{1,2}}[.:]\d{{2}}\s*{PARTS}|(?:jam|pukul)\s+\d{{1,2}}\s*{PARTS}\b"
RESTORE_BEFORE = r"PULIH|DIPULIHKAN|KEMBALI|DIBUKA\s+SEMULA|SELESAI|DIAKTIFKAN|BERJAYA\s+DIPULIHKAN|PEMULIHAN"
RESTORE_AFTER = r"^\s*[^.;]{0,60}?\b(?:PULIH|DIPULIHKAN|DIBUKA\s+SEMULA|SELESAI)\b"
SCHEDULE_BEFORE = r"WAKTU\s+OPERASI|OPERASI\s+STESEN|SETIAP\s+HARI|BEROPERASI|DIBUKA\s+KEPADA\s+PENUMPANG|JADUAL\s+OPERASI|WAKTU\s+PUNCAK|JAM\s+OPERASI"
ONSET_BEFORE = r"BERLAKU|DIKESAN|DILAPORKAN|TERPUTUS|TERHENTI|MULA\b|BERMULA|SEJAK|MENGALAMI|EKORAN|AKIBAT|KEJADIAN|INSIDEN|KEMALANGAN|KEBAKARAN|DITEMUI|MENYEBABKAN|TIDAK\s+BERFUNGSI|GAGAL|TERKANDAS|MENCETUS|MELETUS|DIMULAKAN|TERJEJAS"
ONSET_AFTER = r"^\s*[^.;]{0,60}?\b(?:MENYEBABKAN|MENGALAMI|TERKANDAS|TERHENTI|TERPUTUS|TIDAK\s+BERFUNGSI|TERJEJAS|GAGAL|BERGERAK\s+LEBIH\s+PERLAHAN)\b"
YESTERDAY, TODAY = r"(?i)\b(?:semalam|malam\s+tadi|malam\s+semalam)\b", r"(?i)\btadi\b"
DATELINE = r"(?i)(?:KUALA\s+LUMPUR|SUBANG\s+JAYA|PETALING\s+JAYA|SHAH\s+ALAM|PUTRAJAYA)\s*,?\s*\d{1,2}\s+(?:JANUARI|FEBRUARI|MAC|APRIL|MEI|JUN|JULAI|OGOS|SEPTEMBER|OKTOBER|NOVEMBER|DISEMBER)\b"
BANNER = r"(?i)\b(?:SIARAN\s+MEDIA|UNTUK\s+SEBARAN\s+SEGERA)\b"

# what an operator states of an event; {A} is a station, {T} and {M} the event's clock time, {N} its day
STATED = (
    r"SIARAN MEDIA\nGANGGUAN PERKHIDMATAN NATION {A}\nKuala Lumpur, {N} Januari 2024: Kejadian berlaku kira-kira jam {T} {M} tadi di stesen Nation {A}. Isyarat rosak. Perkhidmatan dipulihkan pada pukul 11.15 malam.",
    r"MAKLUMAN STESEN {A}   Hubungi kami\nShah Alam {N} Januari. Waktu operasi ialah 6.00 pagi. Orang ramai diminta bersabar, kerana pada ketika ini tren yang membawa ramai penumpang ke pusat bandar itu gagal bergerak sejak {T} {M} semalam.",
    r"Tren di Nation {A} lambat dengan tambang 1.27 juta; jam 7 pagi menyebabkan kelewatan", r"Tiada masa dinyatakan di Nation {A}.", r"Pukul 12 tengah malam kemalangan dilaporkan {T} {M}, landasan terjejas",
    r"Petaling Jaya, {P} Januari 2024. Pada {P} Jan 2024, kejadian berlaku kira-kira jam {T} {M} di Nation {A}.", r"Insiden pada {P} Januari 2024 di Nation {A}; stesen akan ditutup pada 1 April 2025.",
    r"SIARAN MEDIA UNTUK SIARAN SEGERA Putrajaya, 30 Mac: Ringkas. Tren di Nation {A} terjejas sejak awal pagi! Akhir.",
)
_hour, _min = "extract(hour FROM ts)", "lpad(CAST(extract(minute FROM ts) AS VARCHAR), 2, '0')"
_stated = "[" + ", ".join("'" + s.replace("\\n", "' || chr(10) || '") + "'" for s in STATED) + f"][event_id % {len(STATED)} + 1]"
STATEMENTS = f"""(SELECT event_id, ts, replace(replace(replace(replace(replace({_stated}, '{{A}}', CAST({_k} % 25 AS VARCHAR)), '{{T}}', CAST({_hour} % 12 + 1 AS VARCHAR) || '.' || {_min}), '{{M}}', CASE WHEN {_hour} < 11 THEN 'pagi' ELSE 'petang' END),
 '{{N}}', CAST(extract(day FROM ts) AS VARCHAR)), '{{P}}', CAST(greatest(1, extract(day FROM ts) - 2) AS VARCHAR)) AS said FROM events)"""


def statements(spark, d) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(s.replace("\\n", "\n")) for s in STATED)), (F.col("event_id") % len(STATED) + 1).cast("int"))
    clock = F.concat_ws(".", F.hour("ts") % 12 + 1, F.lpad(F.minute("ts").cast("string"), 2, "0"))
    k = F.get_json_object("props", "$.k").cast("int") % 25
    for mark, x in (("{A}", k.cast("string")), ("{T}", clock), ("{M}", F.when(F.hour("ts") < 11, "pagi").otherwise("petang")), ("{N}", F.dayofmonth("ts").cast("string")), ("{P}", F.greatest(F.lit(1), F.dayofmonth("ts") - 2).cast("string"))):
        said = F.replace(said, F.lit(mark), x)
    return dealt(read(spark, d, "events"), "event_id").select("event_id", "ts", said.alias("said"))


def clock_mentions(df: DataFrame) -> DataFrame:
    """One row per clock time with a part of the day: n, pos (offset), seconds of the local day, role, around (the text beside it).

    The text between the matches gives their offsets, so no row leaves the JVM."""
    long_ = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    df = df.withColumn("gaps", F.split("said", CLOCK)).withColumn("met", F.regexp_extract_all("said", F.lit(CLOCK), F.lit(0)))
    df = df.select("*", F.posexplode("met").alias("n", "m")).withColumn("pos", long_(F.col("gaps"), F.col("n") + 1) + long_(F.col("met"), F.col("n")))
    cut = lambda start, end: F.substring(F.col("said"), F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))
    end = F.col("pos") + F.length("m")
    b, a = F.upper(cut(F.col("pos") - 90, F.col("pos"))), F.upper(cut(end, end + 70))
    role = F.when(text.matches(b, RESTORE_BEFORE) | text.matches(a, RESTORE_AFTER), "restore").when(text.matches(b, SCHEDULE_BEFORE), "schedule").when(text.matches(b, ONSET_BEFORE) | text.matches(a, ONSET_AFTER), "onset").otherwise("unknown")
    h, minute = F.regexp_extract("m", r"(\d{1,2})", 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("m", r"[.:](\d{2})", 1), F.lit("")).cast("int"), F.lit(0))
    seconds = text.hour24(h, F.regexp_extract("m", rf"(?i)({PARTS})$", 1)) * 3600 + minute * 60
    return df.where((h <= 23) & (minute <= 59)).select("event_id", "n", "pos", seconds.cast("long").alias("seconds"), role.alias("role"), cut(F.col("pos") - 130, F.col("pos") + 90).alias("around"))


_len = lambda a, n: f"coalesce(list_sum(list_transform({a}[1:{n}], lambda x: length(x))), 0)"
_cut = lambda s, e: f"substr(said, CAST(greatest({s}, 0) AS BIGINT) + 1, CAST(greatest({e} - greatest({s}, 0), 0) AS BIGINT))"
_b, _a = f"upper({_cut('pos - 90', 'pos')})", f"upper({_cut('pos + length(m)', 'pos + length(m) + 70')})"
_h24 = "CASE WHEN regexp_matches(part, '^(tengah ?malam|pagi|subuh|malam)$') AND h = 12 THEN 0 WHEN regexp_matches(part, '^(tengah ?hari|petang|malam)$') AND h < 12 THEN h + 12 ELSE h END"
MENTIONS = f"""(SELECT event_id, ts, n, pos, CAST(({_h24}) * 3600 + mi * 60 AS BIGINT) AS seconds, CASE WHEN {_is(_b, RESTORE_BEFORE)} OR {_is(_a, RESTORE_AFTER)} THEN 'restore' WHEN {_is(_b, SCHEDULE_BEFORE)} THEN 'schedule'
 WHEN {_is(_b, ONSET_BEFORE)} OR {_is(_a, ONSET_AFTER)} THEN 'onset' ELSE 'unknown' END AS role, {_cut('pos - 130', 'pos + 90')} AS around
 FROM (SELECT *, {_len('gaps', 'n + 1')} + {_len('met', 'n')} AS pos, met[n + 1] AS m, CAST(regexp_extract(met[n + 1], '\\d{{1,2}}') AS INTEGER) AS h, coalesce(TRY_CAST(regexp_extract(met[n + 1], '[.:](\\d{{2}})', 1) AS INTEGER), 0) AS mi,
 lower(regexp_extract(met[n + 1], '(?i){PARTS}$')) AS part FROM (SELECT *, unnest(range(len(met))) AS n FROM (SELECT *, string_split_regex(said, '{CLOCK}') AS gaps, regexp_extract_all(said, '{CLOCK}') AS met FROM {STATEMENTS})) ) WHERE h <= 23 AND mi <= 59)"""


@query("q_dat12_clock_mentions", f"SELECT event_id, n, pos, seconds, role FROM {MENTIONS}")
def mentioned_times(spark, d):
    return clock_mentions(statements(spark, d)).select("event_id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "seconds", "role")


# fixed: names of months
MONTHS = {
    "januari": 1, "january": 1, "jan": 1, "februari": 2, "february": 2, "feb": 2, "mac": 3, "march": 3, "mar": 3, "april": 4, "apr": 4, "mei": 5, "may": 5, "june": 6, "jun": 6, "julai": 7, "july": 7, "jul": 7, "ogos": 8,
    "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "oktober": 10, "october": 10, "oct": 10, "okt": 10, "november": 11, "nov": 11, "disember": 12, "december": 12, "dec": 12, "dis": 12,
}
DATE = rf"(?i)\b(\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\b(?:\s+\d{{4}})?)"
AGE, REACH_BACK = 60, 220  # fixed: days that an incident may lie back, characters before a clock time in which a date is its day


def dates(df: DataFrame) -> DataFrame:
    """event_id, day (local day of publication), found (the dates of a text: pos, year as said, iso), dateline (clamped to day)."""
    gaps, met = F.split("said", DATE), F.regexp_extract_all("said", F.lit(DATE), F.lit(1))
    size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    month = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    df = df.select("event_id", "said", F.to_date(F.expr("ts + interval 8 hours")).alias("day"), gaps.alias("gaps"), met.alias("met"), F.regexp_extract("said", DATELINE + r"(?:\s+\d{4})?", 0).alias("line"))

    def one(m, i=None):
        said = F.nullif(F.regexp_extract(m, r"(\d{4})$", 1), F.lit("")).cast("int")
        named = F.lpad(F.element_at(month, F.lower(F.regexp_extract(m, r"([A-Za-z]+)", 1))).cast("string"), 2, "0")
        iso = F.concat(F.coalesce(said, F.year("day")).cast("string"), F.lit("-"), named, F.lit("-"), F.lpad(F.regexp_extract(m, r"^(\d{1,2})", 1), 2, "0"))
        at = F.lit(0) if i is None else size(F.col("gaps"), i + 1) + size(F.col("met"), i)
        return F.struct(at.alias("pos"), said.alias("year"), iso.try_cast("date").alias("iso"))

    stated = one(F.regexp_extract("line", DATE, 1))["iso"]
    return df.select("event_id", "day", F.transform("met", one).alias("found"), F.when(stated <= F.col("day"), stated).otherwise(F.col("day")).alias("dateline"))


def onsets(df: DataFrame) -> DataFrame:
    """event_id, onset (UTC), basis: the earliest clock time of an onset, on the day that the words beside it give (yesterday,
    today, a date shortly before it, else the dateline); without one, the first other date with a year; else the dateline.

    A dateline after the day of publication is the day of publication; a date counts if it is no later than that and at
    most AGE days before it.
    """
    d = dates(df)
    plausible = lambda x: F.datediff(F.col("day"), x["iso"]).between(0, AGE)
    m = clock_mentions(df).where("role = 'onset'").join(d, "event_id")
    beside = F.filter("found", lambda x: (x["pos"] < F.col("pos")) & (x["pos"] >= F.col("pos") - REACH_BACK) & plausible(x))
    day = F.when(F.col("around").rlike(YESTERDAY), F.date_sub("day", 1)).when(F.col("around").rlike(TODAY), F.col("day")).otherwise(F.coalesce(F.get(F.reverse(beside), F.lit(0))["iso"], F.col("dateline")))
    first = m.groupBy("event_id").agg(F.min(F.unix_date(day).cast("long") * 86400 + F.col("seconds")).alias("s"))
    other = F.get(F.filter("found", lambda x: x["year"].isNotNull() & (x["iso"] != F.col("dateline")) & plausible(x)), F.lit(0))["iso"]
    at = lambda s: F.timestamp_micros((s - 28800) * 1_000_000).cast("timestamp_ntz")
    midnight = F.unix_date(F.coalesce(other, F.col("dateline"))).cast("long") * 86400
    basis = F.when(F.col("s").isNotNull(), "explicit_time").when(other.isNotNull(), "date_only").otherwise("dateline_only")
    return d.join(first, "event_id", "left").select("event_id", at(F.coalesce("s", midnight)).alias("onset"), basis.alias("basis"))


_month_sql = f"{list(MONTHS.values())}[list_position({list(MONTHS)}, lower(regexp_extract(m, '[A-Za-z]+')))]"
_iso = f"TRY_CAST(coalesce(nullif(regexp_extract(m, '(\\d{{4}})$', 1), ''), CAST(year(day) AS VARCHAR)) || '-' || lpad(CAST({_month_sql} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(m, '^\\d{{1,2}}'), 2, '0') AS DATE)"
_dated = f"(SELECT *, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, regexp_extract_all(said, '{DATE}', 1) AS met, string_split_regex(said, '{DATE}') AS gaps FROM {STATEMENTS})"
_FOUND = f"""(SELECT event_id, n, pos, y, {_iso} AS iso, day FROM (SELECT event_id, day, n, met[n + 1] AS m, nullif(regexp_extract(met[n + 1], '(\\d{{4}})$', 1), '') AS y, {_len('gaps', 'n + 1')} + {_len('met', 'n')} AS pos FROM (SELECT *, unnest(range(len(met))) AS n FROM {_dated})))"""
_DATELINE = f"""(SELECT event_id, day, CASE WHEN d <= day THEN d ELSE day END AS dateline FROM (SELECT event_id, day, CASE WHEN m <> '' THEN {_iso} END AS d FROM (SELECT event_id, day, regexp_extract(regexp_extract(said, '{DATELINE}(?:\\s+\\d{{4}})?'), '{DATE}', 1) AS m FROM {_dated})))"""
_secs = lambda x: f"epoch(CAST({x} AS TIMESTAMP))::BIGINT"
ONSETS = f"""(SELECT l.event_id, make_timestamp((coalesce(s, {_secs('coalesce(x.iso, dateline)')}) - 28800) * 1000000) AS onset, CASE WHEN s IS NOT NULL THEN 'explicit_time' WHEN x.iso IS NOT NULL THEN 'date_only' ELSE 'dateline_only' END AS basis FROM {_DATELINE} l
 LEFT JOIN (SELECT m.event_id, min({_secs(f"CASE WHEN {_is('around', YESTERDAY)} THEN l.day - 1 WHEN {_is('around', TODAY)} THEN l.day ELSE coalesce(f.iso, l.dateline) END")} + m.seconds) AS s FROM {MENTIONS} m JOIN {_DATELINE} l ON l.event_id = m.event_id
 LEFT JOIN (SELECT m.event_id, m.n, max_by(f.iso, f.n) AS iso FROM {MENTIONS} m JOIN {_FOUND} f ON f.event_id = m.event_id AND f.pos < m.pos AND f.pos >= m.pos - {REACH_BACK} AND f.day - f.iso BETWEEN 0 AND {AGE} GROUP BY ALL) f ON f.event_id = m.event_id AND f.n = m.n WHERE m.role = 'onset' GROUP BY m.event_id) o ON o.event_id = l.event_id
 LEFT JOIN (SELECT f.event_id, min_by(f.iso, f.n) AS iso FROM {_FOUND} f JOIN {_DATELINE} l ON l.event_id = f.event_id WHERE y IS NOT NULL AND f.iso <> l.dateline AND f.day - f.iso BETWEEN 0 AND {AGE} GROUP BY f.event_id) x ON x.event_id = l.event_id)"""


@query("q_dat13_onsets", f"SELECT event_id, onset, basis FROM {ONSETS}")
def onset(spark, d):
    return onsets(statements(spark, d))


# fixed: phrases of nearly every statement, taken out one by one; characters read where there is no dateline, least length of a sentence
BOILERPLATE = (
    r"SIARAN\s+MEDIA", r"KENYATAAN\s+MEDIA", r"UNTUK\s+SIARAN\s+(?:SEGERA|SEGARA)", r"KUALA\s+LUMPUR,?\s*\d{1,2}\s+[A-Za-z]+\s*\d{0,4}", r"DIKELUARKAN\s+OLEH[^.]*", r"SEBARANG\s+PERTANYAAN[^.]*", r"TAMAT",
    r"PRASARANA\s+MALAYSIA\s+BERHAD", r"RAPID\s+RAIL\s+SDN\s+BHD", r"RAPID\s+BUS\s+SDN\s+BHD", r"RAPID\s+KL",
)
HEAD, SENTENCE, HEADLINE_LENGTH = 900, 20, 240


def headline(said):
    """The mostly upper-case runs before the dateline (without one: of the first HEAD characters), boilerplate aside; where
    there are none, all runs; where only boilerplate stands there, the first sentence after it of over SENTENCE characters."""
    letters = lambda w: F.greatest(F.lit(1), F.length(F.regexp_replace(w, "[^A-Za-z]", "")))
    capital = lambda w: (F.length(F.regexp_replace(w, "[^A-Z]", "")) / letters(w) > 0.6) & (F.length(w) > 6)

    def end(x):
        parts = F.split(x, DATELINE, 2)
        return text.let(parts, lambda p: F.when(F.size(p) > 1, F.length(p[0])).otherwise(F.least(F.length(x), F.lit(HEAD))))

    def runs(head):
        for phrase in BOILERPLATE:
            head = F.regexp_replace(head, phrase, " ")
        lines = F.filter(F.transform(F.split(head, r"\s{3,}"), lambda w: F.trim(w)), lambda w: w != "")
        kept = text.let(lines, lambda ls: text.let(F.filter(ls, capital), lambda caps: F.when(F.size(caps) > 0, caps).otherwise(ls)))
        return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))

    def sentence(tail):
        first = F.get(F.filter(F.split(F.regexp_replace(tail, r"([.!?])\s+", "$1\x01"), "\x01"), lambda t: F.length(F.trim(t)) > SENTENCE), F.lit(0))
        return F.trim(F.coalesce(first, tail))

    def whole(x):
        cut = lambda e: text.let(runs(F.substring(x, F.lit(1), e)), lambda j: F.when(j != "", j).otherwise(text.let(F.substring(x, e + 1, F.length(x)), sentence)))
        return text.let(end(x), cut)

    return F.substring(text.let(rulings.plain(said), whole), 1, HEADLINE_LENGTH)


_plain_said = "trim(regexp_replace(translate(strip_accents(said), '‘’‛′“”–—―', '''''''''\"\"---'), '\\s+', ' ', 'g'))"


def _headline_sql(source: str) -> str:
    """SQL of (event_id, headline) of ``source`` (event_id, said)."""
    head = "substr(x, 1, e)"
    for phrase in BOILERPLATE:
        head = f"regexp_replace({head}, '{phrase}', ' ', 'g')"
    caps = "list_filter(ls, lambda w: length(regexp_replace(w, '[^A-Z]', '', 'g')) / greatest(1, length(regexp_replace(w, '[^A-Za-z]', '', 'g'))) > 0.6 AND length(w) > 6)"
    return f"""(SELECT event_id, substr(CASE WHEN j <> '' THEN j ELSE trim(coalesce(list_filter(string_split(regexp_replace(tail, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda t: length(trim(t)) > {SENTENCE})[1], tail)) END, 1, {HEADLINE_LENGTH}) AS headline
 FROM (SELECT event_id, tail, trim(regexp_replace(array_to_string(CASE WHEN len({caps}) > 0 THEN {caps} ELSE ls END, ' '), '\\s+', ' ', 'g')) AS j FROM (SELECT event_id, substr(x, e + 1) AS tail, list_filter(list_transform(string_split_regex({head}, '\\s{{3,}}'), lambda w: trim(w)), lambda w: w <> '') AS ls
 FROM (SELECT event_id, x, CASE WHEN regexp_matches(x, '{DATELINE}') THEN length(string_split_regex(x, '{DATELINE}')[1]) ELSE least(length(x), {HEAD}) END AS e FROM (SELECT event_id, {_plain_said} AS x FROM {source})))))"""


@query("q_str21_headlines", f"SELECT event_id, headline FROM {_headline_sql(STATEMENTS)}")
def headlines(spark, d):
    return statements(spark, d).select("event_id", headline(F.col("said")).alias("headline"))


LINES_STATED = ("Laluan Kelana Jaya", "Laluan Kajang", "Laluan Putrajaya", "Laluan Monorel", "Laluan Sunway")
_line_said = f"{list(LINES_STATED)}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1]"


def labelled_statements(spark, d) -> DataFrame:
    """Statements that also name a line: event_id, ts, said."""
    k = F.get_json_object("props", "$.k").cast("int")
    line = dealt(read(spark, d, "events"), "event_id").select("event_id", F.element_at(F.array(*map(F.lit, LINES_STATED)), k % 5 + 1).alias("line"))
    return statements(spark, d).join(line, "event_id").select("event_id", "ts", F.concat("said", F.lit(" "), "line", F.lit(".")).alias("said"))


_SAID = f"""(SELECT s.event_id, s.ts, s.said || ' ' || {_line_said} || '.' AS said FROM {STATEMENTS} s JOIN events e ON e.event_id = s.event_id)"""
_up = "upper(trim(regexp_replace(strip_accents(said), '\\s+', ' ', 'g')))"
_body = {g: [n for n, r in enumerate(rulings.RULES) if r[0] == g] for g in ("line", "issue", "severity", "disruption", "planned", "strong", "weak")}
_is_rule = lambda n: f"regexp_matches(u, '{rulings.RULES[n][3].replace(chr(39), chr(39) * 2)}')"
_sum_of = lambda ns, weight: "(" + " + ".join(f"CASE WHEN {_is_rule(n)} THEN {weight(n)} ELSE 0 END" for n in ns) + ")"
_scored = {i: _sum_of([n for n in _body["issue"] if rulings.RULES[n][1] == i], lambda n: rulings.RULES[n][2]) for i in rulings.PRIORITY}
_marked = {g: _sum_of(_body[g], lambda n: 1) for g in ("disruption", "planned", "strong", "weak", "line")}
_worst = "greatest(0, " + ", ".join(f"CASE WHEN {_is_rule(n)} THEN {rulings.LEVELS.index(rulings.RULES[n][1]) * 100 + rulings.RULES[n][2]} ELSE 0 END" for n in _body["severity"]) + ")"
_LABEL = f"""(SELECT event_id, u, {', '.join(f'{x} AS s{n}' for n, x in enumerate(_scored.values()))}, {', '.join(f'{x} AS n_{g}' for g, x in _marked.items())}, {_worst} AS worst, size FROM (SELECT event_id, {_up} AS u, length(said) AS size FROM {_SAID}))"""
_causes = "greatest(" + ", ".join(f"s{n}" for n, i in enumerate(rulings.PRIORITY) if i in rulings.CAUSES) + f") >= {rulings.CAUSE_FLOOR}"
_left = [f"CASE WHEN {_causes} AND s{n} < {rulings.CROWDING_FLOOR if i == 'CROWDING' else 10 ** 6} THEN 0 ELSE s{n} END" if i in ("CROWDING", "DELAY") else f"s{n}" for n, i in enumerate(rulings.PRIORITY)]


@query("q_pip09_labelled", f"""WITH l AS MATERIALIZED {_LABEL}, f AS (SELECT *, {', '.join(f'{x} AS t{n}' for n, x in enumerate(_left))} FROM l), h AS {_headline_sql(_SAID)}
 SELECT event_id, headline, CASE WHEN size < {rulings.READABLE} THEN 'UNREADABLE' WHEN n_disruption = 0 OR n_line = 0 OR n_strong >= 1 THEN 'NON_INCIDENT' WHEN n_planned >= 2 AND n_disruption <= 2 THEN 'PLANNED_SERVICE_CHANGE' WHEN n_weak >= 2 AND n_weak >= n_disruption THEN 'NON_INCIDENT' ELSE 'INCIDENT' END AS kind,
 CASE {' '.join(f"WHEN {_is_rule(n)} THEN '{rulings.RULES[n][1]}'" for n in _body['line'])} ELSE '' END AS line, CASE {' '.join(f"WHEN t{n} > 0 AND t{n} = greatest({', '.join(f't{j}' for j in range(len(_left)))}) THEN '{i}'" for n, i in enumerate(rulings.PRIORITY))} ELSE 'UNKNOWN' END AS issue,
 {list(rulings.LEVELS)}[CAST(worst // 100 AS INTEGER) + 1] AS severity, onset, basis FROM f JOIN h USING (event_id) JOIN {ONSETS} o USING (event_id)""")
def labelled(spark, d):
    """Statements to labelled incidents: headline, kind of document, line, issue, severity, onset and its basis."""
    s = labelled_statements(spark, d)
    u = s.select("event_id", F.length("said").alias("size"), headline(F.col("said")).alias("headline"), F.upper(rulings.plain(F.col("said"))).alias("u"))
    u = u.select("event_id", "size", "headline", rulings.hits(F.col("u"), "line", "issue", "severity", "disruption", "planned", "strong", "weak").alias("met"))
    worst = F.coalesce(rulings.severity_score(F.col("met")), F.lit(0))
    # the headline is part of the text here, so issues are scored by the text alone
    best = F.get(rulings.issue_scores(F.col("met"), F.array().cast("array<int>")), F.lit(0))["issue"]
    u = u.select("event_id", "headline", rulings.kind(F.col("size"), F.col("met")).alias("kind"), F.coalesce(F.get(rulings.line_ids(F.col("met")), F.lit(0)), F.lit("")).alias("line"), F.coalesce(best, F.lit("UNKNOWN")).alias("issue"),
                 F.element_at(F.array(*map(F.lit, rulings.LEVELS)), (F.floor(worst / 100) + 1).cast("int")).alias("severity"))
    return u.join(onsets(statements(spark, d)), "event_id")


WALK = 900  # fixed: the longest walk, in seconds
_FOOT = """(SELECT s_suppkey AS a, lead(s_suppkey, 1) OVER w AS b, 60 + s_suppkey * 7 % 200 AS seconds FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)
 UNION ALL SELECT s_suppkey, lead(s_suppkey, 2) OVER w, 90 + s_suppkey * 11 % 400 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))"""


@query("q_gra07_footpaths", f"""WITH RECURSIVE e AS (SELECT * FROM {_FOOT} WHERE b IS NOT NULL), r AS (SELECT a, b, seconds FROM e UNION SELECT r.a, e.b, r.seconds + e.seconds FROM r JOIN e ON e.a = r.b WHERE r.seconds + e.seconds <= {WALK})
 SELECT a, b, min(seconds) AS seconds FROM r GROUP BY a, b""")
def footpaths(spark, d):
    """The transitive closure of walking links: the shortest walk to every station within the limit, by rounds that double the links of a walk."""
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", F.lead("s_suppkey", 1).over(w).alias("one"), F.lead("s_suppkey", 2).over(w).alias("two"))
    link = lambda b, seconds: F.struct(F.col("s_suppkey").alias("a"), F.col(b).alias("b"), seconds.alias("seconds"))
    e = s.select(F.inline(F.array(link("one", 60 + F.col("s_suppkey") * 7 % 200), link("two", 90 + F.col("s_suppkey") * 11 % 400)))).where("b is not null")
    walks, total = graph.written(e.groupBy("a", "b").agg(F.min("seconds").alias("seconds"))), None
    while True:
        on = walks.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("seconds").alias("more"))
        longer = walks.join(on, "b").select("a", F.col("c").alias("b"), (F.col("seconds") + F.col("more")).alias("seconds")).where((F.col("seconds") <= WALK) & (F.col("a") != F.col("b")))
        walks = graph.written(walks.union(longer).groupBy("a", "b").agg(F.min("seconds").alias("seconds")))
        now = walks.agg(F.count("*"), F.sum("seconds")).first()
        if now == total:
            return walks
        total = now
