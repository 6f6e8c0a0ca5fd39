"""Evidence queries on ``events``: a row is one report on a segment (props.k) by a source (user_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import risk, text
from kelora.operators import relational as R
from kelora.plans.registry import query, read

AT = "timestamp_ntz'2024-01-15 00:00:00'"
# fixed evidence model by event type: probability, severity rank, issue
P = {"error": 0.6, "purchase": 0.2, "signup": 0.1, "click": 0.05, "view": 0.02}
RANK = {"error": 2, "purchase": 1, "signup": 0, "click": 0, "view": 0}
ISSUE = {"error": "SIGNAL", "purchase": "DELAY", "signup": "UNKNOWN", "click": "CROWDING", "view": "UNKNOWN"}
_case = lambda t, q="'": "CASE event_type " + " ".join(f"WHEN '{k}' THEN {q}{v}{q}" for k, v in t.items()) + " END"
EVIDENCE = f"""(SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS segment,
 CAST({_case(P, '')} AS DOUBLE) AS p, {_case(RANK, '')} AS severity, {_case(ISSUE)} AS issue FROM events)"""


def evidence(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("segment"),
        risk.lookup(kind, P).alias("p"), risk.lookup(kind, RANK).alias("severity"), risk.lookup(kind, ISSUE).alias("issue"),
    )


def signals(spark, d) -> DataFrame:
    """Events as signals: a window of ``value`` minutes; views stay open."""
    end = F.when(F.col("event_type") != "view", F.expr("ts + make_dt_interval(0, 0, cast(floor(value) as int), 0)"))
    return evidence(spark, d).withColumn("start_ts", F.col("ts")).withColumn("end_ts", end)


SIGNALS = f"(SELECT *, ts AS start_ts, CASE WHEN event_type <> 'view' THEN ts + to_minutes(CAST(floor(value) AS BIGINT)) END AS end_ts FROM {EVIDENCE})"


@query("q_agg02_noisy_or", f"""SELECT segment, round(1 - product(1 - p), 6) AS probability, count(DISTINCT user_id) AS sources, max(ts) AS last_ts,
 CAST(max(severity) AS BIGINT) AS severity_rank, arg_max(issue, p) AS issue, round(0.5 * (1 - exp(-(count(DISTINCT user_id) - 1) / 2.0)), 6) AS bonus,
 CASE WHEN round(1 - product(1 - p), 6) >= 0.85 THEN 'VERY_HIGH' WHEN round(1 - product(1 - p), 6) >= 0.65 THEN 'HIGH' WHEN round(1 - product(1 - p), 6) >= 0.4 THEN 'MODERATE'
 WHEN round(1 - product(1 - p), 6) >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END AS band
 FROM {EVIDENCE} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-15 12:00:00' GROUP BY segment""")
def noisy_or(spark, d):
    e = evidence(spark, d).where(f"ts >= {AT} and ts < timestamp_ntz'2024-01-15 12:00:00'")
    return R.fuse_segments(e.select("segment", F.col("user_id").alias("source"), "p", "severity", "issue", F.col("p").alias("confidence"), "ts"))


@query("q_flt01_active", f"SELECT event_id, segment, start_ts, end_ts FROM {SIGNALS} WHERE start_ts <= TIMESTAMP '2024-01-15 00:00:00' AND (end_ts IS NULL OR end_ts >= TIMESTAMP '2024-01-15 00:00:00')")
def active(spark, d):
    return signals(spark, d).where(R.active_at(F.expr(AT))).select("event_id", "segment", "start_ts", "end_ts")


@query("q_flt02_active_list", f"""SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS pos FROM {SIGNALS} WHERE event_type NOT IN ('signup', 'click')
 AND start_ts <= TIMESTAMP '2024-01-15 00:00:00' AND (end_ts IS NULL OR end_ts >= TIMESTAMP '2024-01-15 00:00:00') QUALIFY pos <= 100""")
def active_list(spark, d):
    s = signals(spark, d).where(~F.col("event_type").isin("signup", "click")).where(R.active_at(F.expr(AT)))
    top = s.orderBy(F.desc("ts"), "event_id").limit(100)  # a top-k report; at most 100 rows reach the numbering
    return top.select("event_id", F.row_number().over(W.orderBy(F.desc("ts"), "event_id")).cast("long").alias("pos"))


@query("q_flt03_changed_since", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'")
def changed_since(spark, d):
    return read(spark, d, "events").where("ts > timestamp_ntz'2024-01-29 00:00:00'").select("event_id", "ts")


@query("q_flt04_point_lookup", "SELECT event_id, ts, event_type FROM events WHERE event_id = 77")
def point_lookup(spark, d):
    return read(spark, d, "events").where("event_id = 77").select("event_id", "ts", "event_type")


@query("q_flt09_staleness", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ts > TIMESTAMP '2024-01-15 00:05:00' THEN 'FUTURE'
 WHEN ts < TIMESTAMP '2024-01-14 22:30:00' THEN 'OLD' WHEN event_type = 'signup' THEN 'HISTORICAL' ELSE 'FRESH' END AS reason FROM events) GROUP BY reason""")
def staleness(spark, d):
    reason = F.when(F.expr("ts > timestamp_ntz'2024-01-15 00:05:00'"), "FUTURE").when(F.expr("ts < timestamp_ntz'2024-01-14 22:30:00'"), "OLD").when(F.col("event_type") == "signup", "HISTORICAL").otherwise("FRESH")
    return read(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("q_flt10_terminal", "SELECT event_type IN ('signup', 'click') AS terminal, count(*) AS n FROM events GROUP BY 1")
def terminal(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").isin("signup", "click").alias("terminal")).agg(F.count("*").alias("n"))


@query("q_flt12_thresholds", f"""SELECT segment, count(*) FILTER (WHERE p > 0.4) AS material, count(*) FILTER (WHERE p >= 0.7) AS avoided,
 count(*) FILTER (WHERE p >= 0.3) AS reportable, count(*) FILTER (WHERE (hour(ts) * 60 + minute(ts) BETWEEN 420 AND 569) OR (hour(ts) * 60 + minute(ts) BETWEEN 1020 AND 1169)) AS peak FROM {EVIDENCE} GROUP BY segment""")
def thresholds(spark, d):
    m = F.hour("ts") * 60 + F.minute("ts")
    return evidence(spark, d).groupBy("segment").agg(
        F.count_if(F.col("p") > 0.4).alias("material"), F.count_if(F.col("p") >= 0.7).alias("avoided"), F.count_if(F.col("p") >= 0.3).alias("reportable"),
        F.count_if(m.between(420, 569) | m.between(1020, 1169)).alias("peak"),
    )


@query("q_flt20_rejected_sources", f"SELECT e.event_id FROM {EVIDENCE} e WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.value > 480)")
def rejected_sources(spark, d):
    e = read(spark, d, "events")
    reject = e.where("event_type = 'error' and value > 480").select("user_id").distinct()
    return e.join(reject, "user_id", "left_anti").select("event_id")


@query("q_agg04_distinct_authors", f"SELECT segment, count(DISTINCT CASE WHEN user_id % 10 = 0 THEN 'anon:' || event_id ELSE CAST(user_id AS VARCHAR) END) AS authors, round(avg(value), 6) AS quality, count(*) FILTER (WHERE value < 50) AS junk FROM {EVIDENCE} GROUP BY segment")
def distinct_authors(spark, d):
    who = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("anon:"), F.col("event_id"))).otherwise(F.col("user_id").cast("string"))
    return evidence(spark, d).groupBy("segment").agg(F.countDistinct(who).alias("authors"), F.round(F.avg("value"), 6).alias("quality"), F.count_if(F.col("value") < 50).alias("junk"))


@query("q_agg06_earliest_per_author", "SELECT user_id, min(ts) AS first_ts, arg_min(event_id, ts) AS first_event FROM events GROUP BY user_id")
def earliest(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", "ts").alias("first_event"))


@query("q_agg09_weighted_vote", f"""SELECT segment, issue, w FROM (SELECT segment, issue, round(sum(p), 6) AS w FROM {EVIDENCE} GROUP BY segment, issue)
 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY w DESC, issue) = 1""")
def weighted_vote(spark, d):
    votes = evidence(spark, d).groupBy("segment", "issue").agg(F.round(F.sum("p"), 6).alias("w"))
    return R.latest_per_key(votes, ["segment"], [F.desc("w"), F.col("issue")], 1)


@query("q_agg11_majority", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def majority(spark, d):
    votes = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.latest_per_key(votes, ["user_id"], [F.desc("n"), F.col("event_type")], 1)


@query("q_agg12_median", "SELECT event_type, round(median(value), 6) AS med FROM events GROUP BY event_type")
def exact_median(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("med"))


@query("q_agg15_grouping_sets", "SELECT event_type, user_id % 4 AS lane, count(*) AS n, grouping(event_type) AS g1 FROM (SELECT event_type, user_id FROM events) GROUP BY GROUPING SETS ((event_type), (user_id % 4))")
def grouping(spark, d):
    e = read(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("lane"))
    return e.groupingSets([[F.col("event_type")], [F.col("lane")]], "event_type", "lane").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("g1"))


@query("q_agg25_status_counts", "SELECT t.s AS status, count(e.event_id) AS n FROM (VALUES ('error'), ('view'), ('cleared')) t(s) LEFT JOIN events e ON e.event_type = t.s GROUP BY t.s")
def status_counts(spark, d):
    e = read(spark, d, "events")
    one = e.agg(*(F.count_if(F.col("event_type") == s).alias(s) for s in ("error", "view", "cleared")))
    return one.unpivot([], ["error", "view", "cleared"], "status", "n")


@query("q_agg32_cluster_times", f"SELECT segment, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) FILTER (WHERE event_type = 'error') AS last_error FROM {EVIDENCE} GROUP BY segment")
def cluster_times(spark, d):
    return evidence(spark, d).groupBy("segment").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_error"))


@query("q_win03_first_wins", f"SELECT segment, event_id FROM {EVIDENCE} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY event_id) = 1")
def first_wins(spark, d):  # the first by ordinal is an aggregate: no sort of the group
    return evidence(spark, d).groupBy("segment").agg(F.min("event_id").alias("event_id"))


@query("q_win08_disambiguate", "SELECT event_id, user_id || CASE WHEN k > 0 THEN '.' || k ELSE '' END AS cluster_key FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE event_type = 'error')")
def disambiguate(spark, d):
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return read(spark, d, "events").where("event_type = 'error'").select("event_id", F.concat(F.col("user_id"), F.when(k > 0, F.concat(F.lit("."), k)).otherwise("")).alias("cluster_key"))


@query("q_lim03_latest_n", f"SELECT segment, event_id FROM {EVIDENCE} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY ts DESC, event_id DESC) <= 5")
def latest_n(spark, d):
    return R.latest_per_key(evidence(spark, d), ["segment"], [F.desc("ts"), F.desc("event_id")], 5).select("segment", "event_id")


@query("q_jon23_next_departure", """SELECT l.event_id AS lid, l.user_id, min(r.ts) AS next_ts FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.event_type = 'purchase' AND r.ts >= l.ts
 WHERE l.event_type = 'error' GROUP BY ALL""")
def next_departure(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("lid"), F.col("ts").alias("lts"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("rts"))
    return R.next_event(left, right, "user_id").select("lid", "user_id", "next_ts")


_PAIRS = """SELECT s.event_id AS lid, i.event_id AS rid, abs(epoch_us(s.ts) - epoch_us(i.ts)) AS apart_us FROM events s JOIN events i ON s.user_id = i.user_id
 WHERE s.event_type = 'error' AND i.event_type = 'purchase' AND abs(epoch_us(s.ts) - epoch_us(i.ts)) <= 21600000000"""


def _matches(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("lid"), F.col("ts").alias("lts"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("rid"), F.col("ts").alias("rts"))
    return left, right, R.interval_pairs(left, right, ["user_id"], 360)


@query("q_jon24_interval_match", _PAIRS)
def interval_match(spark, d):
    return _matches(spark, d)[2].select("lid", "rid", "apart_us")


@query("q_jon26_coverage", f"SELECT DISTINCT rid FROM ({_PAIRS})")
def coverage(spark, d):
    return _matches(spark, d)[2].select("rid").distinct()


@query("q_jon27_false_negatives", f"SELECT event_id AS rid FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT rid FROM ({_PAIRS}))")
def false_negatives(spark, d):
    _, right, pairs = _matches(spark, d)
    return right.join(pairs, "rid", "left_anti").select("rid")


@query("q_lim06_closest", f"SELECT lid, arg_min(rid, apart_us) AS rid, min(apart_us) AS apart_us FROM ({_PAIRS}) GROUP BY lid")
def closest(spark, d):
    return _matches(spark, d)[2].groupBy("lid").agg(F.min_by("rid", "apart_us").alias("rid"), F.min("apart_us").alias("apart_us"))


@query("q_jon29_lead_time", f"SELECT round(median(m), 6) AS median_minutes, count(*) AS n FROM (SELECT min(apart_us) / 60000000.0 AS m FROM ({_PAIRS}) GROUP BY lid)")
def lead_time(spark, d):
    near = _matches(spark, d)[2].groupBy("lid").agg((F.min("apart_us") / 60_000_000).alias("m"))
    return near.agg(F.round(F.median("m"), 6).alias("median_minutes"), F.count("*").alias("n"))


_OLD = f"(SELECT segment, max(p * value / 500) AS c FROM {EVIDENCE} WHERE ts < TIMESTAMP '2024-01-03 00:00:00' AND event_type = 'error' GROUP BY segment)"
_NEW = f"(SELECT segment, max(p * value / 500) AS c FROM {EVIDENCE} WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' AND event_type = 'error' GROUP BY segment)"


@query("q_jon30_reconcile", f"""SELECT coalesce(o.segment, n.segment) AS segment, CASE WHEN o.segment IS NULL THEN 'NEW' WHEN n.segment IS NULL THEN 'CLEARED' WHEN n.c - o.c > 0.05 THEN 'CONFIDENCE_UP'
 WHEN o.c - n.c > 0.05 THEN 'CONFIDENCE_DOWN' ELSE 'UNCHANGED' END AS change FROM {_OLD} o FULL JOIN {_NEW} n ON o.segment = n.segment""")
def reconcile(spark, d):
    e = evidence(spark, d).where("event_type = 'error'")
    side = lambda x: x.groupBy("segment").agg(F.max(F.col("p") * F.col("value") / 500).alias("c"))
    return R.diff(side(e.where("ts < timestamp_ntz'2024-01-03 00:00:00'")), side(e.where("ts >= timestamp_ntz'2024-01-28 00:00:00'")), "segment", "c", 0.05)


@query("q_set03_next_state", f"""SELECT segment, c FROM (SELECT segment, round(c, 6) AS c FROM {_NEW} UNION ALL SELECT segment, round(c, 6) AS c FROM {_OLD} WHERE segment % 2 = 0 AND segment NOT IN (SELECT segment FROM {_NEW}))""")
def next_state(spark, d):
    e = evidence(spark, d).where("event_type = 'error'")
    side = lambda x: x.groupBy("segment").agg(F.round(F.max(F.col("p") * F.col("value") / 500), 6).alias("c"))
    old, new = side(e.where("ts < timestamp_ntz'2024-01-03 00:00:00'")), side(e.where("ts >= timestamp_ntz'2024-01-28 00:00:00'"))
    return new.unionByName(old.where("segment % 2 = 0").join(new, "segment", "left_anti"))


@query("q_stm05_sessions", """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error')) GROUP BY user_id, s""")
def sessions(spark, d):
    e = read(spark, d, "events").where("event_type = 'error'").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "90 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "last_ts", "n")


@query("q_dat04_local_clock", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS clock, CAST(dayofweek(ts + INTERVAL 8 HOUR) AS BIGINT) AS weekday FROM events")
def local_clock(spark, d):
    local = F.expr("ts + interval 8 hours")
    return read(spark, d, "events").select("event_id", F.date_format(local, "HH:mm").alias("clock"), (F.dayofweek(local) - 1).cast("long").alias("weekday"))


@query("q_dat05_age_minutes", "SELECT event_id, CAST(greatest(0, floor((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 60000000.0)) AS BIGINT) AS minutes FROM events")
def age(spark, d):
    return read(spark, d, "events").select("event_id", text.whole_minutes(F.col("ts"), F.expr(AT)).alias("minutes"))


@query("q_mth16_calibrated", f"""SELECT segment, round(CASE WHEN u THEN least(v, 0.45) ELSE v END, 6) AS confidence FROM (SELECT segment, u,
 (1 - (1 - [0, .22, .32, .45, .53, .58, .60][least(a, 6) + 1] * q * CASE WHEN m <= 90 THEN 1 ELSE greatest(0.15, 1 - (m - 90) / 270.0 * 0.85) END) * (1 - 0.9 * o) * (1 - least(r * 0.05, 0.15)))
 * CASE WHEN u THEN 0.8 ELSE 1 END * CASE WHEN dn THEN 0.25 ELSE 1 END AS v FROM (SELECT segment, segment % 7 = 0 AS u, segment % 11 = 0 AS dn, count(DISTINCT user_id) AS a, avg(value) / 500 AS q,
 floor((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(max(ts))) / 60000000.0) AS m, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 0.3 AS o, count(*) FILTER (WHERE event_type = 'click') AS r
 FROM {EVIDENCE} WHERE ts < TIMESTAMP '2024-01-15 00:00:00' AND ts >= TIMESTAMP '2024-01-14 12:00:00' GROUP BY segment))""")
def calibrated(spark, d):
    e = evidence(spark, d).where(f"ts < {AT} and ts >= timestamp_ntz'2024-01-14 12:00:00'").groupBy("segment").agg(
        F.countDistinct("user_id").alias("a"), (F.avg("value") / 500).alias("q"), text.whole_minutes(F.max("ts"), F.expr(AT)).alias("m"),
        (F.max((F.col("event_type") == "purchase").cast("int")) * 0.3).alias("o"), F.count_if(F.col("event_type") == "click").alias("r"),
    )
    value = risk.calibrated(F.col("a"), F.col("q"), F.col("m"), F.col("o"), F.col("r"), F.col("segment") % 7 == 0, F.col("segment") % 11 == 0, F.lit(False))
    return e.select("segment", value.alias("confidence"))


@query("q_stm03_dedupe_positions", f"SELECT sha256(concat_ws(chr(1), segment, CAST(user_id AS VARCHAR), CAST(floor(value) AS BIGINT))) AS content_hash, min(event_id) AS event_id FROM {EVIDENCE} GROUP BY 1")
def dedupe_positions(spark, d):
    h = F.sha2(F.concat_ws("\x01", F.col("segment").cast("string"), F.col("user_id").cast("string"), F.floor("value").cast("string")).cast("binary"), 256)
    return evidence(spark, d).groupBy(h.alias("content_hash")).agg(F.min("event_id").alias("event_id"))
