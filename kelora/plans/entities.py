"""The network as tables (places, aliases, segments) and an evidence corpus drawn from labelled incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import risk
from kelora.functions.rulings import LEVELS
from kelora.operators import graph
from kelora.operators.places import SAME_PLACE, WALKABLE, places, walkable
from kelora.plans.composites import _metres
from kelora.plans.further import _imul
from kelora.plans.registry import ORACLES, dealt, query, read
from kelora.plans.reports import _k, incidents

_xy = "CAST(s_suppkey * 37 % 1000 * 3 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 1009 * 3 AS DOUBLE) AS y"
_P = f"(SELECT s_suppkey AS id, s_nationkey AS line, 'HUB ' || (s_suppkey * 7 % greatest(1, n * 3 // 4)) AS name, {_xy} FROM supplier, (SELECT count(*) AS n FROM supplier))"
_PLACES = f"""p AS MATERIALIZED {_P}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND (a.name = b.name OR sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {SAME_PLACE} OR (least(a.id, b.id) % 13 = 0 AND abs(a.id - b.id) = 1)) ),
 r(id, root) AS (SELECT id, id FROM p UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.id), place AS (SELECT id, min(root) AS place FROM r GROUP BY id)"""


def platforms(spark, d) -> DataFrame:
    """Every supplier is a platform of one line, with a name that others may share and a position."""
    n = read(spark, d, "supplier").count()
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("line"), F.concat(F.lit("HUB "), (F.col("s_suppkey") * 7 % max(1, n * 3 // 4)).cast("string")).alias("name"), F.expr(_xy.split(" AS x")[0]).alias("x"), F.expr(_xy.split(", ")[1].split(" AS y")[0]).alias("y"))


def located_platforms(spark, d) -> DataFrame:
    p = graph.written(platforms(spark, d))
    listed = p.where("id % 13 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(p.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return p.join(places(p, listed), "id")


@query("q_pip02_stations", f"""WITH RECURSIVE {_PLACES}, g AS (SELECT place, count(*) AS platforms, list_sort(list(DISTINCT line)) AS lines FROM p JOIN place USING (id) GROUP BY place)
 SELECT p.id, p.name, g.place, g.platforms, array_to_string(g.lines, '|') AS lines, len(g.lines) > 1 AS interchange FROM p JOIN place USING (id) JOIN g USING (place)""")
def stations(spark, d):
    """Platforms with their place and the lines that meet there."""
    s = graph.written(located_platforms(spark, d))
    g = s.groupBy("place").agg(F.count("*").alias("platforms"), F.sort_array(F.collect_set("line")).alias("lines"))  # the lines of one place
    return s.join(g, "place").select("id", "name", "place", "platforms", F.array_join(F.col("lines").cast("array<string>"), "|").alias("lines"), (F.size("lines") > 1).alias("interchange"))


@query("q_pip02_aliases", f"""WITH RECURSIVE {_PLACES}, a AS (SELECT name AS alias, 1 AS rank, place FROM p JOIN place USING (id) UNION ALL SELECT 'NATION ' || line || ' ' || name, 2, place FROM p JOIN place USING (id)
 UNION ALL SELECT 'H' || substr(name, 5), 3, place FROM p JOIN place USING (id) UNION ALL SELECT 'HUB ' || (id % 50), 4, place FROM p JOIN place USING (id)), m AS (SELECT alias, min(rank) AS rank FROM a GROUP BY alias)
 SELECT alias, rank, min(place) AS place, count(DISTINCT place) AS places FROM a JOIN m USING (alias, rank) GROUP BY ALL""")
def aliases(spark, d):
    """What a name means: of its readings (official, with the line, short, by number) the first kind that exists decides;
    a name of several places in that kind stays ambiguous."""
    s = graph.written(located_platforms(spark, d))
    told = lambda c, rank: F.struct(c.alias("alias"), F.lit(rank).alias("rank"))
    all_ = s.select("place", F.inline(F.array(
        told(F.col("name"), 1), told(F.concat(F.lit("NATION "), F.col("line").cast("string"), F.lit(" "), F.col("name")), 2),
        told(F.concat(F.lit("H"), F.expr("substr(name, 5)")), 3), told(F.concat(F.lit("HUB "), (F.col("id") % 50).cast("string")), 4))))
    each = all_.groupBy("alias", "rank").agg(F.min("place").alias("place"), F.countDistinct("place").alias("places"))
    return each.groupBy("alias").agg(F.min_by(F.struct("rank", "place", "places"), "rank").alias("m")).select("alias", "m.*")


_geo = "3 + s_suppkey * 37 % 1000 / 40000.0 AS lat, 101 + s_suppkey * 91 % 1009 / 40000.0 AS lon"


_walk_m = _metres("a.lat", "a.lon", "b.lat", "b.lon")


@query("q_jon06_walks", f"""WITH p AS (SELECT s_suppkey AS id, s_nationkey AS line, 'HUB ' || (s_suppkey * 7 % greatest(1, n * 3 // 4)) AS name, {_geo} FROM supplier, (SELECT count(*) AS n FROM supplier)),
 w AS (SELECT a.id AS a, b.id AS b, {_walk_m} AS m FROM p a JOIN p b ON a.id < b.id WHERE (a.line <> b.line AND {_walk_m} <= {WALKABLE}) OR a.name = b.name), s AS (SELECT a, b, m, CAST(floor(greatest({K.WALK_BASE}, least({K.WALK_CAP}, {K.WALK_BASE} + m / {K.WALK_SPEED})) + 0.5) AS BIGINT) AS seconds FROM w)
 SELECT a, b, round(m, 3) AS metres, seconds FROM s UNION ALL SELECT b, a, round(m, 3), seconds FROM s""")
def walks(spark, d):
    s = platforms(spark, d).select("id", "line", "name").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), *(F.expr(x.split(" AS ")[0]).alias(x.split(" AS ")[1]) for x in _geo.split(", "))), "id")
    return walkable(graph.written(s)).select("a", "b", risk.half_up(F.col("metres"), 3).alias("metres"), "seconds")


_ORD = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_calls = f"(SELECT l_orderkey AS trip, l_orderkey % 7 AS line, l_orderkey % 2 AS way, l_suppkey AS s, row_number() OVER w AS n, lead(l_suppkey) OVER w AS t, 60 + CAST(l_quantity AS BIGINT) AS run FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORD}))"


@query("q_pip02_segments", f"""WITH c AS MATERIALIZED {_calls}, f AS (SELECT line, way, min(trip) AS trip FROM c GROUP BY ALL), z AS (SELECT c.line, c.s, min(c.n) AS seq FROM c JOIN f ON f.trip = c.trip AND f.line = c.line WHERE f.way = 0 GROUP BY ALL),
 g AS (SELECT line, s, t, min(n) AS n FROM (SELECT c.* FROM c JOIN f ON f.trip = c.trip) WHERE t IS NOT NULL AND t <> s GROUP BY ALL), r AS (SELECT line, s, t, CAST(floor(avg(run) + 0.5) AS BIGINT) AS run, count(*) AS trips FROM c WHERE t IS NOT NULL GROUP BY ALL),
 pos AS (SELECT s_suppkey AS id, 3 + s_suppkey % 100 / 1000.0 AS lat, 101 + s_suppkey * 7 % 100 / 1000.0 AS lon FROM supplier)
 SELECT g.line, g.s AS a, g.t AS b, coalesce(x.seq, g.s % 1000) AS from_seq, coalesce(y.seq, g.t % 1000) AS to_seq, r.run, r.trips, CAST(round({_metres('p.lat', 'p.lon', 'q.lat', 'q.lon')}, 3) AS DOUBLE) AS metres
 FROM g JOIN r USING (line, s, t) JOIN pos p ON p.id = g.s JOIN pos q ON q.id = g.t LEFT JOIN z x ON x.line = g.line AND x.s = g.s LEFT JOIN z y ON y.line = g.line AND y.s = g.t""")
def segments(spark, d):
    """Links of each line's first trip in each direction: places along the line as direction 0 counts them, mean running
    time over all trips, and length."""
    w = W.partitionBy("l_orderkey").orderBy(*_ORD.split(", "))
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), (F.col("l_orderkey") % 7).alias("line"), (F.col("l_orderkey") % 2).alias("way"), F.col("l_suppkey").alias("s"), F.row_number().over(w).alias("n"), F.lead("l_suppkey").over(w).alias("t"), (60 + F.col("l_quantity").cast("long")).alias("run"))
    c = graph.written(c)  # read three times below
    first = c.groupBy("line", "way").agg(F.min("trip").alias("trip"))
    z = c.join(first.where("way = 0").select("line", "trip"), ["line", "trip"]).groupBy("line", "s").agg(F.min("n").alias("seq"))
    links = c.join(first.select("trip"), "trip", "left_semi").where("t is not null and t <> s").select("line", "s", "t").distinct()
    runs = c.where("t is not null").groupBy("line", "s", "t").agg(F.floor(F.avg("run") + 0.5).alias("run"), F.count("*").alias("trips"))
    at = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (3 + F.col("s_suppkey") % 100 / 1000).alias("lat"), (101 + F.col("s_suppkey") * 7 % 100 / 1000).alias("lon"))
    out = links.join(runs, ["line", "s", "t"]).join(at.toDF("s", "lat1", "lon1"), "s").join(at.toDF("t", "lat2", "lon2"), "t")
    out = out.join(z.withColumnRenamed("seq", "from_seq"), ["line", "s"], "left").join(z.toDF("line", "t", "to_seq"), ["line", "t"], "left")
    return out.select("line", F.col("s").alias("a"), F.col("t").alias("b"), F.coalesce("from_seq", F.col("s") % 1000).alias("from_seq"), F.coalesce("to_seq", F.col("t") % 1000).alias("to_seq"), "run", "trips", F.round(risk.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 3).alias("metres"))


# fixed: minutes to the first observation, follow-ups after it and how likely each is by severity, chance of a repost
DELTA, OFFSETS, REPOST = (2, 9), (4, 11, 19, 31), 0.5
FOLLOW = {"INFO": (0.4, 0.2, 0.1, 0.15), "MINOR": (0.5, 0.3, 0.15, 0.2), "MAJOR": (0.75, 0.6, 0.4, 0.4), "SEVERE": (0.9, 0.8, 0.65, 0.55)}
DECOY_MIX = ("MINOR",) * 6 + ("MAJOR",) * 4 + ("SEVERE",) * 2
COMPLAINTS, MINUTES, DRAWS, TRIES = ("lambat", "sesak", "tiada info", "penat"), (3, 25), 10, 8
TEMPLATES = ("Tren lambat di {S}, sudah {M} minit, {C}", "{S} lagi! {M} minit menunggu, {C}", "Ada apa di {S}? {C}, {M} minit")
_u = lambda seed, n: f"SELECT *, xor(c, c >> 14) / 4294967296.0 AS u FROM (SELECT *, xor(b, (b + {_imul('xor(b, b >> 7)', 'b | 61')}) % 4294967296) AS c FROM (SELECT *, {_imul('xor(a, a >> 15)', 'a | 1')} AS b FROM (SELECT *, (CAST('0x' || substr(sha256({seed}), 1, 8) AS BIGINT) + (i + 1) * 1831565813) % 4294967296 AS a FROM {n})))"
_level = f"{list(LEVELS)}[k % 4 + 1]"
_from = lambda r: f"CAST({r[0]} + floor(us[{{n}}] * {r[1] - r[0] + 1}) AS BIGINT)"


@query("q_pip08_corpus", f"""WITH e AS (SELECT event_id, ts, {_k} AS k FROM events WHERE event_type = 'error'), i AS (SELECT 'incident|' || event_id AS seed, event_id AS incident, ts AS onset, ts + to_minutes(k % 12) AS published, [k % 25, (k + 5) % 25] AS stations, {_level} AS severity FROM e),
 days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM e), tries AS ({_u("'slot|' || day", f"(SELECT day, unnest(range({TRIES})) AS i FROM days)")}), slots AS (SELECT day, min(struct_pack(i := i, s := CAST(floor(u * 25) AS BIGINT))) AS m FROM tries t
 WHERE NOT EXISTS (SELECT 1 FROM i WHERE CAST(i.onset AS DATE) = t.day AND list_contains(i.stations, CAST(floor(t.u * 25) AS BIGINT))) GROUP BY day),
 b AS (SELECT seed, incident, onset, published, stations, severity FROM i UNION ALL SELECT 'decoy|' || day || '|' || m.s, NULL, CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR, NULL, [m.s], {list(DECOY_MIX)}[epoch(CAST(day AS TIMESTAMP))::BIGINT // 86400 % 12 + 1] FROM slots),
 d AS (SELECT seed, list(u ORDER BY i) AS us FROM ({_u('seed', f'(SELECT seed, unnest(range({DRAWS})) AS i FROM b)')}) GROUP BY seed),
 c AS (SELECT b.*, us, stations[1 + CAST(floor(us[2] * len(stations)) AS BIGINT)] AS station, {_from(MINUTES).format(n=3)} AS mins, CAST(floor(us[4] * 4) AS BIGINT) AS complaint, {_from(DELTA).format(n=5)} AS delta FROM b JOIN d USING (seed) WHERE published IS NULL OR onset + to_minutes({_from(DELTA).format(n=1)}) < published),
 o AS (SELECT *, unnest([0, 1, 2, 3, 4, 90]) AS author, unnest([0, {', '.join(map(str, OFFSETS))}, 2]) AS later, unnest(list_concat([1.0::DOUBLE], CASE severity {' '.join(f"WHEN '{k}' THEN {list(v)}::DOUBLE[]" for k, v in FOLLOW.items())} END, [{REPOST}::DOUBLE])) AS chance, unnest(list_concat([0.0::DOUBLE], us[6:10])) AS got FROM c),
 k AS (SELECT *, CASE WHEN author = 90 THEN 0 ELSE author END AS a FROM o WHERE got < chance)
 SELECT seed || '#' || author AS id, incident, incident IS NULL AS decoy, CASE WHEN author = 4 THEN 'REALTIME' ELSE 'SOCIAL' END AS class, author, onset + to_minutes(delta + later) AS published,
 replace(replace(replace({list(TEMPLATES)}[a % 3 + 1], '{{S}}', 'Nation ' || station), '{{M}}', CAST(mins + a * 2 AS VARCHAR)), '{{C}}', {list(COMPLAINTS)}[(complaint + a) % 4 + 1]) AS said FROM k""")
def corpus(spark, d):
    """Evidence drawn for each incident and, once a day, for a false alarm at a station without incident that day.

    Every number is the n-th draw of its row's seed, so rows are the same whatever the partitions. An incident whose first
    observation would not come before its publication has none. A repost repeats the first text.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    e = dealt(read(spark, d, "events").where("event_type = 'error'"), "event_id").select("event_id", "ts", k.alias("k"))
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("k") % 4 + 1).cast("int"))
    i = e.select(F.concat(F.lit("incident|"), F.col("event_id").cast("string")).alias("seed"), F.col("event_id").alias("incident"), F.col("ts").alias("onset"), (F.col("ts") + minutes(F.col("k") % 12)).alias("published"), F.array(F.col("k") % 25, (F.col("k") + 5) % 25).alias("stations"), level.alias("severity"))
    day = F.to_date("onset")
    tries = i.select(day.alias("day")).distinct().withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TRIES - 1).cast("long"))))
    tries = tries.withColumn("station", F.floor(risk.draw(F.concat(F.lit("slot|"), F.col("day").cast("string")), F.col("n")) * 25))
    taken = i.select(day.alias("day"), F.explode("stations").alias("station")).distinct()
    slots = tries.join(taken, ["day", "station"], "left_anti").groupBy("day").agg(F.min_by("station", "n").alias("station"))
    mix = F.element_at(F.array(*map(F.lit, DECOY_MIX)), (F.unix_date("day") % 12 + 1).cast("int"))
    decoys = slots.select(F.concat(F.lit("decoy|"), F.col("day").cast("string"), F.lit("|"), F.col("station").cast("string")).alias("seed"), F.lit(None).cast("long").alias("incident"), (F.col("day").cast("timestamp_ntz") + F.expr("interval 4 hours")).alias("onset"), F.lit(None).cast("timestamp_ntz").alias("published"), F.array("station").alias("stations"), mix.alias("severity"))
    u = lambda n: F.get("us", F.lit(n))
    from_ = lambda r, n: r[0] + F.floor(u(n) * (r[1] - r[0] + 1))
    # one lambda for all draws: written out, their code would be too long to compile
    us = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long")), lambda n: risk.draw(F.col("seed"), n))
    b = i.unionByName(decoys).withColumn("us", us).where(F.col("published").isNull() | (F.col("onset") + minutes(from_(DELTA, 0)) < F.col("published")))
    b = b.withColumn("station", F.get("stations", F.floor(u(1) * F.size("stations")).cast("int"))).withColumn("mins", from_(MINUTES, 2)).withColumn("complaint", F.floor(u(3) * 4)).withColumn("delta", from_(DELTA, 4))
    likely = lambda n: F.coalesce(*(F.when(F.col("severity") == s, F.lit(p[n])) for s, p in FOLLOW.items()))
    post = lambda author, later, keep: F.struct(F.lit(author).alias("author"), F.lit(later).alias("later"), keep.alias("keep"))
    posts = F.array(post(0, 0, F.lit(True)), *(post(n + 1, o, u(5 + n) < likely(n)) for n, o in enumerate(OFFSETS)), post(90, 2, u(DRAWS - 1) < REPOST))
    p = b.select("*", F.inline(posts)).where("keep").withColumn("a", F.when(F.col("author") == 90, 0).otherwise(F.col("author")))
    of = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))
    said = of(TEMPLATES, F.col("a"))
    for mark, word in (("{S}", F.concat(F.lit("Nation "), F.col("station").cast("string"))), ("{M}", (F.col("mins") + F.col("a") * 2).cast("string")), ("{C}", of(COMPLAINTS, F.col("complaint") + F.col("a")))):
        said = F.replace(said, F.lit(mark), word)
    return p.select(F.concat("seed", F.lit("#"), F.col("author").cast("string")).alias("id"), "incident", F.col("incident").isNull().alias("decoy"), F.when(F.col("author") == 4, "REALTIME").otherwise("SOCIAL").alias("class"), "author", (F.col("onset") + minutes(F.col("delta") + F.col("later"))).alias("published"), said.alias("said"))


MATCH_MINUTES, CUTS = 360, (0.1, 0.22, 0.32, 0.45, 0.53)  # fixed: minutes between an incident and a statement of it; thresholds
_CORPUS = ORACLES["q_pip08_corpus"]
_strength = "[0, .22, .32, .45, .53, .58, .60]"


@query("q_pip10_matched", f"""WITH c AS MATERIALIZED (SELECT id, CAST(regexp_extract(said, 'Nation (\\d+)', 1) AS BIGINT) AS station, epoch_us(published) AS us FROM ({_CORPUS}) WHERE author <> 90),
 r AS (SELECT *, sum(CASE WHEN us - prev <= 5400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY us, id) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY station ORDER BY us, id) AS prev FROM c)),
 m AS MATERIALIZED (SELECT station % 5 AS line, min(us) // 60000000 AS minute, {_strength}[least(count(*), 6) + 1]::DOUBLE AS score FROM r GROUP BY station, run),
 t AS MATERIALIZED (SELECT event_id, {_k} % 5 AS line, epoch_us(ts) // 60000000 AS minute FROM events WHERE event_type = 'error'), k AS (SELECT unnest({list(CUTS)}::DOUBLE[]) AS cut),
 e AS (SELECT m.score, EXISTS (SELECT 1 FROM t WHERE t.line = m.line AND abs(t.minute - m.minute) <= {MATCH_MINUTES}) AS hit FROM m), s AS (SELECT t.event_id, max(m.score) AS best FROM t LEFT JOIN m ON t.line = m.line AND abs(t.minute - m.minute) <= {MATCH_MINUTES} GROUP BY t.event_id)
 SELECT k.cut AS cut, (SELECT count(*) FROM e WHERE score >= k.cut) AS emitted, (SELECT count(*) FROM e WHERE score >= k.cut AND hit) AS matched, (SELECT count(*) FROM s) AS stated, (SELECT count(*) FROM s WHERE best >= k.cut) AS found,
 round((SELECT count(*) FROM e WHERE score >= k.cut AND hit) / nullif((SELECT count(*) FROM e WHERE score >= k.cut), 0)::DOUBLE, 6) AS precision, round((SELECT count(*) FROM s WHERE best >= k.cut) / nullif((SELECT count(*) FROM s), 0)::DOUBLE, 6) AS recall FROM k""")
def matched(spark, d):
    """Incidents that the evidence tells, against the incidents stated: one counts if one of its line is within 360 minutes.

    Both sides are first summed by line and minute, so the interval join grows with time, not with reports.
    """
    c = corpus(spark, d).where("author <> 90").select(F.xxhash64("id").alias("event_id"), F.regexp_extract("said", r"Nation (\d+)", 1).alias("station"), F.unix_micros(F.col("published").cast("timestamp")).alias("us"))
    c = graph.written(c)
    run = incidents(c.select("event_id", "us", F.array("station").alias("keys"))).join(c.select("event_id", "us"), "event_id")
    run = run.groupBy("incident", F.col("key").cast("long").alias("station")).agg(F.min("us").alias("us"), F.count("*").cast("int").alias("n"))
    minute = F.floor(F.col("us") / 60_000_000)
    m = run.select((F.col("station") % 5).alias("line"), minute.alias("minute"), risk.social_strength(F.col("n")).alias("score")).groupBy("line", "minute", "score").agg(F.count("*").alias("n"))
    k = F.get_json_object("props", "$.k").cast("long")
    t = read(spark, d, "events").where("event_type = 'error'").select((k % 5).alias("line"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("minute")).groupBy("line", "minute").agg(F.count("*").alias("n"))
    m, t = graph.written(m), graph.written(t)
    span = lambda x: F.floor(x / MATCH_MINUTES)
    a = m.select("line", F.col("minute").alias("at"), "score", F.col("n").alias("emitted"), F.explode(F.sequence(span(F.col("minute")) - 1, span(F.col("minute")) + 1)).alias("span"))
    pairs = a.join(t.select("line", F.col("minute").alias("then"), F.col("n").alias("stated"), span(F.col("minute")).alias("span")), ["line", "span"]).where(F.abs(F.col("at") - F.col("then")) <= MATCH_MINUTES)
    told = pairs.select("line", F.col("at").alias("minute"), "score", "emitted").distinct()
    best = pairs.groupBy("line", "then", "stated").agg(F.max("score").alias("score"))
    sums = m.agg(*(F.coalesce(F.sum(F.when(F.col("score") >= x, F.col("n"))), F.lit(0)).alias(f"e{i}") for i, x in enumerate(CUTS)))
    hits = told.agg(*(F.coalesce(F.sum(F.when(F.col("score") >= x, F.col("emitted"))), F.lit(0)).alias(f"h{i}") for i, x in enumerate(CUTS)))
    found = best.agg(*(F.coalesce(F.sum(F.when(F.col("score") >= x, F.col("stated"))), F.lit(0)).alias(f"f{i}") for i, x in enumerate(CUTS)))
    total = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("stated"))
    one = sums.join(hits).join(found).join(total)  # four rows of one each
    rows = F.array(*(F.struct(F.lit(x).alias("cut"), F.col(f"e{i}").alias("emitted"), F.col(f"h{i}").alias("matched"), F.col("stated").alias("stated"), F.col(f"f{i}").alias("found")) for i, x in enumerate(CUTS)))
    out = one.select(F.inline(rows))
    return out.select("*", F.round(F.try_divide("matched", "emitted"), 6).alias("precision"), F.round(F.try_divide("found", "stated"), 6).alias("recall"))
