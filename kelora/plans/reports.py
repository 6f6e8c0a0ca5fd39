"""Reports in words: every event says something about a station, a link, a hub or a line; parsed, weighed, located and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import phrases as P
from kelora.functions import risk, text
from kelora.operators import graph
from kelora.plans.registry import ORACLES, dealt, query, read

# what an event says; {A} and {B} are neighbouring stations, {H} a name that several stations share, {L} a line
SAYINGS = (
    "Tren rosak di stesen {A}, masih tergendala", "Gangguan isyarat antara {A} dan {B} sejak 10 minit", "Train stuck at {A}!! MAJOR delay", "Lif rosak di stesen {H}",
    "LALUAN {L} tergendala, seluruh laluan terjejas", "Bagus lah {A}, tren lambat lagi haha", "RT @rider_7 Banjir di {A}, service disruption", "Semalam tren terkandas di {A}",
    "Perkhidmatan laluan LRT {L} kembali beroperasi", "Hujan lebat, platform penuh sesak di {A} sekarang", "Throwback 2019: ingat tak {A}, teruk", "Signal fault between {A} and {B}. Back to normal",
    "Jalan ditutup, kemalangan dekat highway", "Nothing to see here", "Pintu tren rosak di {A}, maklumat: sedikit lambat", "Tren gagal dan suis rosak, {A} dan {L}, more than an hour",
    "TAHNIAH, world class! memang bagus {A}", "Masih ingat lagi 2016, {A} masih sesak", "Track fault in {L} near hub {A}", "",
    "Komponen brek gagal, tren berasap di {A}", "Door problem at {A}, eskalator mati", "Isyarat rosak di {A}. Signalling fault", "Landasan rosak, sistem PIES, kerja-kerja baik pulih di {A}", "Crowded platform penuh di {A}, petir",
    "Perkhidmatan terjejas di {A}, jadual terjejas, shuttle train", "Tren tidak berhenti di {A}, frekuensi berkurangan", "Masalah teknikal di {A}, šesak",
)
_station = lambda k: f"'Nation ' || ({k})"
_k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_said = "['" + "', '".join(SAYINGS) + f"'][event_id % {len(SAYINGS)} + 1]"
REPORTS = f"""(SELECT event_id, ts, user_id, CASE event_type WHEN 'purchase' THEN 'OFFICIAL' WHEN 'signup' THEN 'REALTIME' ELSE 'SOCIAL' END AS class,
 replace(replace(replace(replace({_said}, '{{A}}', {_station(f"{_k} % 25")}), '{{B}}', {_station(f"({_k} + 5) % 25")}), '{{H}}', 'Hub ' || ({_k} % 7)),
 '{{L}}', ['Africa', 'America', 'Asia', 'Europe', 'Middle East'][{_k} % 5 + 1]) AS said FROM events)"""


def reports(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    station = lambda n: F.concat(F.lit("Nation "), (n % 25).cast("string"))
    said = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.col("event_id") % len(SAYINGS) + 1).cast("int"))
    lines = F.element_at(F.array(*map(F.lit, ("Africa", "America", "Asia", "Europe", "Middle East"))), k % 5 + 1)
    for mark, name in (("{A}", station(k)), ("{B}", station(k + 5)), ("{H}", F.concat(F.lit("Hub "), (k % 7).cast("string"))), ("{L}", lines)):
        said = F.replace(said, F.lit(mark), name)
    kind = F.when(F.col("event_type") == "purchase", "OFFICIAL").when(F.col("event_type") == "signup", "REALTIME").otherwise("SOCIAL")
    return dealt(read(spark, d, "events"), "event_id").select("event_id", "ts", "user_id", kind.alias("class"), said.alias("said"))


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with issue, severity, time posture and authenticity of its column ``said``."""
    df = df.withColumn("t", P.folded(F.col("said"))).withColumn("u", P.upper(F.col("said"))).withColumn("hit", P.hits(F.col("t")))
    df = df.withColumn("vote", P.issue(F.col("hit"))).withColumn("worst", P.severity(F.col("hit"))).withColumn("days_ago", P.days_ago(F.col("t"))).withColumn("recovery", P.recovered(F.col("t")))
    df = df.withColumn("historical", F.coalesce(F.col("days_ago") >= 1, F.lit(False))).withColumn("ongoing", P.ongoing(F.col("t"), F.col("historical"), F.col("recovery")))
    df = df.withColumn("sarcasm", P.marked(F.col("u"), P.SARCASM)).withColumn("joke", P.marked(F.col("u"), P.JOKE)).withColumn("repost", P.marked(F.col("u"), P.REPOST))
    df = df.withColumn("stale", P.stale(F.col("u"), F.col("ongoing"), F.col("days_ago"))).withColumn("quality", P.quality(F.col("stale"), F.col("sarcasm"), F.col("joke")))
    return df.withColumn("issue", P.issue_name(F.col("vote"))).withColumn("severity", P.severity_name(F.col("worst")))


_q = lambda r: "'" + r.replace("'", "''") + "'"
_is = lambda c, r: f"regexp_matches({c}, {_q(r)})"
_FOLD = r"trim(regexp_replace(regexp_replace(strip_accents(upper(said)), '[^A-Z0-9''\- .!?;]+', ' ', 'g'), '\s+', ' ', 'g'))"
_KIND = {k: " + ".join(f"CASE WHEN {_is('t', r)} THEN {w} ELSE 0 END" for r, i, _, w in P.ISSUES if i == k) for k in P.KINDS}
_ALL = [(r, s, w) for r, _, s, w in P.ISSUES] + list(P.SEVERITIES)
_LEVEL = {s: "greatest(0, " + ", ".join(f"CASE WHEN {_is('t', r)} THEN {w} ELSE 0 END" for r, x, w in _ALL if x == s) + ")" for s in P.LEVELS}
_marks = lambda m: "least(1.0, (" + " + ".join(f"CASE WHEN {_is('u', r)} THEN {w}::DOUBLE ELSE 0 END" for r, w in m) + ") / 3)"
_most, _sum = f"greatest({', '.join(P.KINDS)})", " + ".join(P.KINDS)
_worst = "CASE " + " ".join(f"WHEN {s} > 0 THEN {s}" for s in P.LEVELS[::-1]) + " ELSE 0 END"
_one = lambda c, f: f"CASE WHEN {c} >= 0.5 THEN {f[0]} ELSE 1 - {f[1]} * {c} END"
PARSED = f"""(SELECT *, greatest({P.QUALITY_FLOOR}, ({_one('stale', P.STALE_FACTORS)}) * ({_one('sarcasm', P.SARCASM_FACTORS)}) * ({_one('joke', P.JOKE_FACTORS)})) AS quality,
 CASE WHEN {_most} = 0 THEN 'UNKNOWN' {' '.join(f"WHEN {k} = {_most} THEN '{k}'" for k in P.KINDS)} END AS issue, CASE {' '.join(f"WHEN {s} > 0 THEN '{s}'" for s in P.LEVELS[::-1])} ELSE 'INFO' END AS severity
 FROM (SELECT *, CASE WHEN ongoing THEN least({_marks(P.STALE)}, 0.3) WHEN historical THEN greatest({_marks(P.STALE)}, 0.7, least(1.0, 0.5 + days_ago / 60)) ELSE {_marks(P.STALE)} END AS stale
 FROM (SELECT *, {_is('t', P.ONGOING)} OR ({_is('t', P.NOW)} AND NOT historical AND NOT recovery) AS ongoing
 FROM (SELECT *, coalesce(days_ago >= 1, false) AS historical FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in {**_KIND, **_LEVEL}.items())}, {_is('t', P.RECOVERY)} AS recovery,
 {_marks(P.SARCASM)} AS sarcasm, {_marks(P.JOKE)} AS joke, {_marks(P.REPOST)} AS repost,
 CASE {' '.join(f"WHEN {_is('t', r)} THEN {n}" for r, n in P.PAST)} WHEN {_is('t', P.PAST_YEAR)} THEN {P.YEAR_DAYS} WHEN {_is('t', P.NOW)} THEN 0 END AS days_ago
 FROM (SELECT *, {_FOLD} AS t, strip_accents(upper(said)) AS u FROM {REPORTS}))))))"""


@query("q_str16_phrases", f"""SELECT event_id, issue, round(CASE WHEN issue = 'UNKNOWN' THEN 0 ELSE least(1.0, {_most} / ({_sum})) END, 6) AS issue_confidence, severity,
 round(CASE WHEN {_worst} = 0 THEN 0 ELSE 0.5 + least(0.4, ({_worst}) / 10) END, 6) AS severity_confidence, ongoing, historical, recovery FROM {PARSED}""")
def phrase_parse(spark, d):
    p = parsed(reports(spark, d))
    return p.select("event_id", "issue", F.round(P.issue_confidence(F.col("vote"), F.col("hit")), 6).alias("issue_confidence"), "severity",
                    F.round(P.severity_confidence(F.col("worst")), 6).alias("severity_confidence"), "ongoing", "historical", "recovery")


@query("q_str17_authenticity", f"SELECT event_id, round(sarcasm, 6) AS sarcasm, round(joke, 6) AS joke, round(stale, 6) AS stale, round(repost, 6) AS repost, round(quality, 6) AS quality, repost >= 0.5 AS is_repost FROM {PARSED}")
def authenticity(spark, d):
    p = parsed(reports(spark, d))
    return p.select("event_id", *(F.round(c, 6).alias(c) for c in ("sarcasm", "joke", "stale", "repost", "quality")), (F.col("repost") >= 0.5).alias("is_repost"))


@query("q_dat15_days_ago", f"SELECT days_ago, count(*) AS n, min(event_id) AS first FROM {PARSED} GROUP BY days_ago")
def implied_age(spark, d):
    t = P.folded(F.col("said"))
    return reports(spark, d).groupBy(P.days_ago(t).alias("days_ago")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_stop = "['" + "', '".join(P.PLACE_STOPWORDS) + "']"
_words = lambda x: f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"


def _place(x: str) -> str:
    """SQL of the place that leads a text: drop leading stopwords, end at the next, at most four tokens."""
    begin = f"list_position(list_transform({_words(x)}, lambda w: NOT list_contains({_stop}, w)), true)"
    tail = f"{_words(x)}[coalesce(nullif({begin}, 0), 1000):]"
    return f"array_to_string(({tail})[:least(4, coalesce(nullif(list_position(list_transform({tail}, lambda w: list_contains({_stop}, w)), true), 0), 1000) - 1)], ' ')"


_pair = r"string_split_regex(string_split_regex(regexp_extract(t, '\b(?:ANTARA|BETWEEN)\s+(.+)$', 1), '[.!?;]')[1], '\s+(?:DAN|AND|HINGGA|TO)\s+')"
_named = r"regexp_extract_all(t, '\b(?:STESEN|STATION|HENTIAN)\s+([A-Z0-9][A-Z0-9''\- ]{2,60})', 1)"
PLACES = f"""(SELECT event_id, said, nullif(CASE WHEN len({_pair}) >= 2 THEN {_place(_pair + '[1]')} END, '') AS l, nullif(CASE WHEN len({_pair}) >= 2 THEN {_place(_pair + '[2]')} END, '') AS r, {_named} AS names
 FROM (SELECT event_id, said, {_FOLD} AS t FROM {REPORTS}))"""


@query("q_str07_places", f"""SELECT event_id, CASE WHEN r IS NOT NULL THEN l END AS from_place, CASE WHEN l IS NOT NULL THEN r END AS to_place,
 array_to_string(list_filter(list_transform(names, lambda x: {_place('x')}), lambda p: p <> ''), '|') AS stations FROM {PLACES}""")
def places(spark, d):
    t = P.folded(F.col("said"))
    pair, named = P.between(t), P.after(t, P.STATION_WORDS[:3])
    return reports(spark, d).withColumn("pair", pair).select("event_id", F.col("pair")[0].alias("from_place"), F.col("pair")[1].alias("to_place"), F.array_join(named, "|").alias("stations"))


# names: (alias, stations it may mean as (id, line), neighbours of its stations, line)
NAMES = """names AS (SELECT alias, list(n_nationkey ORDER BY n_nationkey) AS ids, list(n_regionkey ORDER BY n_nationkey) AS lines, NULL::INTEGER AS line FROM
 (SELECT *, replace(n_name, '_', ' ') AS alias FROM nation UNION ALL SELECT *, 'HUB ' || (n_nationkey % 7) FROM nation) GROUP BY alias UNION ALL SELECT r_name, [], [], r_regionkey FROM region)"""


def names(spark, d) -> DataFrame:
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey", F.array(F.replace("n_name", F.lit("_"), F.lit(" ")), F.concat(F.lit("HUB "), (F.col("n_nationkey") % 7).cast("string"))).alias("a"))
    stations = n.select(F.explode("a").alias("alias"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("line")).alias("s")).groupBy("alias").agg(F.sort_array(F.collect_list("s")).alias("stations"))
    lines = read(spark, d, "region").select(F.col("r_name").alias("alias"), F.col("r_regionkey").alias("line"))
    return stations.withColumn("line", F.lit(None).cast("int")).unionByName(lines.withColumn("stations", F.array().cast(stations.schema["stations"].dataType)))


def _kind(p1: Column, p2: Column) -> Column:
    """What the words before a name make of it: a line, a station or nothing."""
    line, station = F.col("line").isNotNull(), F.size("stations") > 0
    as_line, as_station = F.when(line, "LINE"), F.when(station, "STATION")
    return F.when(p1.isin(*P.LINE_WORDS) | (p2.isin(*P.LINE_WORDS) & p1.isin(*P.MODES)), as_line).when(p1.isin(*P.STATION_WORDS), as_station).when(
        p1.isin(*P.MODES), F.coalesce(as_line, as_station)).otherwise(F.coalesce(as_station, as_line))


def mentions(spark, d) -> DataFrame:
    """event_id, left and right end of a claimed link, and its named places: the longest name at each place, left to right, none overlapping.

    Runs of up to six words meet the names by equality; one row per report stays even where nothing is named."""
    words = F.filter(F.split(P.upper(F.col("said")), "[^A-Z0-9]+"), lambda w: w != "")
    ws, n = F.col("ws"), F.size("ws")
    gram = lambda i, m: F.struct(i.alias("pos"), m.alias("len"), F.array_join(F.slice(ws, i + 1, m), " ").alias("alias"), F.coalesce(F.get(ws, i - 1), F.lit("")).alias("p1"), F.coalesce(F.get(ws, i - 2), F.lit("")).alias("p2"))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(6), n - i)), lambda m: gram(i, m))))
    own = lambda at, x: F.struct(F.lit(at).alias("pos"), F.lit(0).alias("len"), x.alias("alias"), F.lit("").alias("p1"), F.lit("").alias("p2"))
    pair = P.between(P.folded(F.col("said")))
    ends = F.array(own(-3, F.lit(None).cast("string")), own(-1, F.col("pair")[0]), own(-2, F.col("pair")[1]))
    r = reports(spark, d).select("event_id", words.alias("ws"), pair.alias("pair"))
    g = r.select("event_id", F.inline(F.when(n > 0, F.concat(ends, runs)).otherwise(ends)))
    hit = g.join(names(spark, d), "alias", "left").where("pos = -3 or stations is not null")
    row = F.struct("pos", (-F.col("len")).alias("less"), "alias", "stations", "line", _kind(F.col("p1"), F.col("p2")).alias("kind"))
    all_ = hit.groupBy("event_id").agg(
        F.max(F.when(F.col("pos") == -1, F.col("stations"))).alias("left"), F.max(F.when(F.col("pos") == -2, F.col("stations"))).alias("right"),
        F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, row))).alias("rows"))  # at most six rows a word of one report
    state = lambda free, tried, kept: F.struct(free.alias("free"), tried.alias("tried"), kept.alias("kept"))

    def fold(a, h):
        take = (h["pos"] >= a["free"]) & (h["pos"] > a["tried"])
        return F.when(~take, a).otherwise(state(F.when(h["kind"].isNull(), a["free"]).otherwise(h["pos"] - h["less"]), h["pos"], F.when(h["kind"].isNull(), a["kept"]).otherwise(F.concat(a["kept"], F.array(h)))))

    empty = F.filter("rows", lambda h: F.lit(False))
    return all_.select("event_id", "left", "right", F.aggregate("rows", state(F.lit(0), F.lit(-1), empty), fold)["kept"].alias("named"))


_in = lambda x, ws: f"{x} IN ({', '.join(map(repr, ws))})"
NAMED = f"""{NAMES}, tok AS (SELECT event_id, list_filter(string_split_regex(upper(said), '[^A-Z0-9]+'), lambda w: w <> '') AS ws FROM {REPORTS}),
 at0 AS (SELECT event_id, ws, unnest(range(len(ws))) AS pos FROM tok), gram AS (SELECT event_id, pos, m AS len, array_to_string(ws[pos + 1:pos + m], ' ') AS alias, CASE WHEN pos > 0 THEN ws[pos] ELSE '' END AS p1,
 CASE WHEN pos > 1 THEN ws[pos - 1] ELSE '' END AS p2 FROM at0, range(1, 7) x(m) WHERE pos + m <= len(ws)),
 longest AS (SELECT g.*, ids, lines, line FROM gram g JOIN names USING (alias) QUALIFY row_number() OVER (PARTITION BY event_id, pos ORDER BY g.len DESC) = 1),
 kinds AS (SELECT * FROM (SELECT *, CASE WHEN {_in('p1', P.LINE_WORDS)} OR ({_in('p2', P.LINE_WORDS)} AND {_in('p1', P.MODES)}) THEN CASE WHEN line IS NOT NULL THEN 'LINE' END
 WHEN {_in('p1', P.STATION_WORDS)} THEN CASE WHEN len(ids) > 0 THEN 'STATION' END WHEN line IS NOT NULL THEN 'LINE' ELSE 'STATION' END AS kind FROM longest) WHERE kind IS NOT NULL),
 named AS (SELECT event_id, min(pos) AS pos FROM kinds GROUP BY event_id UNION ALL SELECT n.event_id, (SELECT min(k2.pos) FROM kinds k2 WHERE k2.event_id = n.event_id AND k2.pos >= n.pos + k.len)
 FROM named n JOIN kinds k ON k.event_id = n.event_id AND k.pos = n.pos WHERE (SELECT min(k2.pos) FROM kinds k2 WHERE k2.event_id = n.event_id AND k2.pos >= n.pos + k.len) IS NOT NULL)"""


@query("q_str18_mentions", f"WITH RECURSIVE {NAMED} SELECT event_id, pos, alias, kind FROM named JOIN kinds USING (event_id, pos)")
def named_places(spark, d):
    return mentions(spark, d).select("event_id", F.inline("named")).select("event_id", "pos", "alias", "kind")


def located(spark, d) -> DataFrame:
    """Report to place: a link with two sure neighbouring ends, else one station, else a line; several candidates are never guessed between."""
    m = mentions(spark, d)
    sure = lambda c: (F.size(c) == 1)
    a, b = F.col("left")[0], F.col("right")[0]
    link = F.coalesce(sure("left") & sure("right") & (a["line"] == b["line"]) & (F.abs(a["id"] - b["id"]) == 5), F.lit(False))
    lines = F.array_sort(F.array_distinct(F.transform(F.filter("named", lambda h: h["kind"] == "LINE"), lambda h: h["line"])))
    stations = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("named", lambda h: h["kind"] == "STATION"), lambda h: h["stations"]))))
    m = m.select("event_id", link.alias("link"), F.least(a["id"], b["id"]).alias("a"), F.greatest(a["id"], b["id"]).alias("b"), lines.alias("lines"), stations.alias("found"))
    narrow = F.filter("found", lambda s: F.array_contains(F.col("lines"), s["line"]))
    m = m.withColumn("ids", F.transform(F.when(F.size(narrow) > 0, narrow).otherwise(F.col("found")), lambda s: s["id"]))
    strategy = F.when(F.col("link"), "SEGMENT_BETWEEN").when(F.size("ids") > 0, "STATION").when(F.size("lines") > 0, "LINE").otherwise("NONE")
    sure_one = F.col("link") | (F.size("ids") == 1)
    trust = F.when(F.col("link"), 0.95).when(F.size("ids") == 1, 1.0).when(F.size("ids") > 1, 0.3).when(F.size("lines") > 0, 0.25).otherwise(0.0)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    key = F.when(F.col("link"), F.concat_ws("-", "a", "b")).when(F.size("ids") > 0, joined("ids")).when(F.size("lines") > 0, F.concat(F.lit("LINE:"), joined("lines"))).otherwise("NONE")
    return m.select("event_id", strategy.alias("strategy"), F.when(sure_one, "RESOLVED").otherwise("UNRESOLVED").alias("resolution"), trust.alias("trust"), key.alias("place"))


LOCATED = f"""{NAMED}, ends AS (SELECT p.event_id, a.ids[1] AS a, b.ids[1] AS b FROM {PLACES} p JOIN names a ON a.alias = p.l JOIN names b ON b.alias = p.r
 WHERE len(a.ids) = 1 AND len(b.ids) = 1 AND a.lines[1] = b.lines[1] AND abs(a.ids[1] - b.ids[1]) = 5),
 said_lines AS (SELECT event_id, list(DISTINCT line ORDER BY line) AS ls FROM named JOIN kinds USING (event_id, pos) WHERE kind = 'LINE' GROUP BY event_id),
 each AS (SELECT event_id, unnest(ids) AS id, unnest(lines) AS line FROM named JOIN kinds USING (event_id, pos) WHERE kind = 'STATION'),
 flag AS (SELECT DISTINCT e.event_id, id, coalesce(list_contains(ls, line), false) AS own FROM each e LEFT JOIN said_lines USING (event_id)),
 ones AS (SELECT event_id, list(id ORDER BY id) AS ids FROM (SELECT *, bool_or(own) OVER (PARTITION BY event_id) AS has FROM flag) WHERE own OR NOT has GROUP BY event_id),
 located AS (SELECT r.event_id, CASE WHEN a IS NOT NULL THEN 'SEGMENT_BETWEEN' WHEN ids IS NOT NULL THEN 'STATION' WHEN ls IS NOT NULL THEN 'LINE' ELSE 'NONE' END AS strategy,
 CASE WHEN a IS NOT NULL OR len(ids) = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution, CAST(CASE WHEN a IS NOT NULL THEN 0.95 WHEN len(ids) = 1 THEN 1 WHEN ids IS NOT NULL THEN 0.3 WHEN ls IS NOT NULL THEN 0.25 ELSE 0 END AS DOUBLE) AS trust,
 CASE WHEN a IS NOT NULL THEN least(a, b) || '-' || greatest(a, b) WHEN ids IS NOT NULL THEN array_to_string(ids, '|') WHEN ls IS NOT NULL THEN 'LINE:' || array_to_string(ls, '|') ELSE 'NONE' END AS place
 FROM events r LEFT JOIN ends USING (event_id) LEFT JOIN ones USING (event_id) LEFT JOIN said_lines USING (event_id))"""


@query("q_str19_locations", f"WITH RECURSIVE {LOCATED} SELECT * FROM located")
def locations(spark, d):
    return located(spark, d)


GAP, REPORTABLE, COPIED = 90, 0.3, 40  # minutes between reports of one incident; least confidence that is told; characters of a text that two strangers do not write alike
WITNESS = {"OFFICIAL": 3.0, "REALTIME": 1.5, "SOCIAL": 1.0}  # fixed: weight of a class in the vote on the issue
_g, _order = GAP * 60_000_000, "CASE issue " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(P.KINDS)) + " ELSE 99 END"
_of = lambda k: f"class = '{k}' AND live"

# Candidates of a day: written copies and reposts of one author's report are one witness (the first); every report has the places at which it overlaps others.
WITNESSES = f"""{LOCATED}, facts AS (SELECT p.event_id, ts, user_id, class, issue, quality, recovery, NOT (historical AND NOT ongoing) AS live, t, strategy, resolution, CAST(ts AS DATE) AS day, epoch_us(ts) AS us,
 CASE WHEN p.event_id % 11 = 0 THEN (user_id + 1) % 150 ELSE user_id END AS author, repost >= 0.5 OR p.event_id % 11 = 0 AS again,
 CAST(floor(CASE class {' '.join(f"WHEN '{k}' THEN {w}" for k, w in WITNESS.items())} END * CASE WHEN class = 'REALTIME' THEN 0.8 WHEN issue = 'UNKNOWN' THEN 0.2 ELSE 0.4 + 0.6 * least(1.0, {_most} / ({_sum})) END * CASE WHEN class = 'SOCIAL' THEN quality ELSE 1 END * 1000000 + 0.5001) AS BIGINT) AS vote,
 CASE WHEN strategy = 'SEGMENT_BETWEEN' THEN string_split(place, '-') WHEN strategy = 'NONE' THEN ['NONE:' || issue] ELSE [place] END AS keys FROM {PARSED} p JOIN located USING (event_id)),
 origin AS (SELECT day, t, min(struct_pack(us := us, event_id := event_id, user_id := user_id, again := again)) AS o FROM facts GROUP BY ALL), wrote AS (SELECT day, author, min(struct_pack(us := us, event_id := event_id)) AS e FROM facts GROUP BY ALL),
 kept AS (SELECT f.* FROM facts f JOIN origin USING (day, t) JOIN wrote USING (day, author) WHERE (f.event_id = o.event_id OR NOT (f.user_id = o.user_id OR f.again OR o.again OR length(f.t) >= {COPIED})) AND NOT (f.again AND e.event_id <> f.event_id))"""
INCIDENTS = f"""{WITNESSES}, said AS (SELECT event_id, us, unnest(keys) AS key FROM kept), runs AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) <= {_g} THEN NULL ELSE event_id END AS fresh FROM said),
 nodes AS (SELECT event_id, key, last_value(fresh IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS node FROM runs),
 links AS (SELECT DISTINCT a.node AS a, b.node AS b FROM nodes a JOIN nodes b USING (event_id) WHERE a.node <> b.node), reach(id, root) AS (SELECT DISTINCT node, node FROM nodes UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.id),
 roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id), member AS (SELECT event_id, min(root) AS incident FROM nodes JOIN roots ON id = node GROUP BY event_id),
 places AS (SELECT root AS incident, array_to_string(list(DISTINCT key ORDER BY key), '|') AS place FROM nodes JOIN roots ON id = node GROUP BY root)"""
_minutes = "floor((max(us) - max(us) FILTER (WHERE counts)) / 60000000.0)"


def witnesses(spark, d) -> DataFrame:
    """Located, weighed reports without the copies: of one text in a day the first, with its other writers only where the
    text is short and no repost; of a reposted author the first report."""
    p = parsed(reports(spark, d)).withColumn("confidence", P.issue_confidence(F.col("vote"), F.col("hit")))
    p = p.select("event_id", "ts", "user_id", "class", "issue", "confidence", "quality", "recovery", (~F.col("historical") | F.col("ongoing")).alias("live"), F.length("t").alias("size"), F.sha2(F.col("t").cast("binary"), 256).alias("said"), (F.col("repost") >= 0.5).alias("again"))
    structured = F.col("event_id") % 11 == 0
    sure = F.when(F.col("class") == "REALTIME", 0.8).when(F.col("issue") == "UNKNOWN", 0.2).otherwise(0.4 + 0.6 * F.col("confidence"))
    weight = risk.lookup(F.col("class"), WITNESS) * sure * F.when(F.col("class") == "SOCIAL", F.col("quality")).otherwise(1.0)
    keys = F.when(F.col("strategy") == "SEGMENT_BETWEEN", F.split("place", "-")).when(F.col("strategy") == "NONE", F.array(F.concat(F.lit("NONE:"), F.col("issue")))).otherwise(F.array("place"))
    f = p.join(located(spark, d).select("event_id", "strategy", "resolution", "place"), "event_id").select(
        "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.to_date("ts").alias("day"), "user_id", F.when(structured, (F.col("user_id") + 1) % 150).otherwise(F.col("user_id")).alias("author"), (F.col("again") | structured).alias("again"),
        "class", "issue", "quality", "recovery", "live", "size", "said", "strategy", "resolution", F.floor(weight * 1000000 + 0.5001).alias("vote"), keys.alias("keys"))
    f = graph.written(f)  # texts are parsed once; what follows reads it three times
    origin = f.groupBy("day", "said").agg(F.min(F.struct("us", "event_id", "user_id", "again")).alias("o"))
    wrote = f.groupBy("day", "author").agg(F.min(F.struct("us", "event_id")).alias("e"))
    other = (F.col("user_id") == F.col("o.user_id")) | F.col("again") | F.col("o.again") | (F.col("size") >= COPIED)
    kept = f.join(origin, ["day", "said"]).join(wrote, ["day", "author"])
    return kept.where(((F.col("event_id") == F.col("o.event_id")) | ~other) & ~(F.col("again") & (F.col("e.event_id") != F.col("event_id")))).drop("o", "e")


def incidents(kept: DataFrame) -> DataFrame:
    """(event_id, incident, key): reports that share a place and follow each other within GAP minutes, and all that hang
    together by reports of several places. ``kept``: event_id, us, keys.

    A place's reports are first summed by spans of GAP minutes, so neither a hot place nor the reports without any meet in
    one task: two spans hang together if they are neighbours and the gap between them is short enough.
    """
    said = kept.select("event_id", "us", F.floor(F.col("us") / _g).alias("span"), F.explode("keys").alias("key"))
    spans = said.groupBy("key", "span").agg(F.min(F.struct("us", "event_id")).alias("first"), F.max("us").alias("last"))
    w = W.partitionBy("key").orderBy("span")  # one row per span of a place
    near = (F.col("span") - F.lag("span").over(w) == 1) & (F.col("first.us") - F.lag("last").over(w) <= _g)
    spans = spans.withColumn("fresh", F.when(~F.coalesce(near, F.lit(False)), F.col("first.event_id")))
    runs = spans.select("key", "span", F.last("fresh", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("node"))
    nodes = graph.written(said.join(runs, ["key", "span"]).select("event_id", "key", "node"))
    own = nodes.groupBy("event_id").agg(F.min("node").alias("a"))
    links = nodes.join(own, "event_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    roots = graph.components(nodes.select(F.col("node").alias("id")).distinct(), links)
    return nodes.join(roots.select(F.col("id").alias("node"), F.col("root").alias("incident")), "node").select("event_id", "incident", "key")


@query("q_pip04_verified", f"""WITH RECURSIVE {INCIDENTS}, m AS (SELECT k.*, incident, class = 'SOCIAL' AND quality >= 0.5 AND live AS counts FROM kept k JOIN member USING (event_id)),
 votes AS (SELECT incident, issue, sum(vote) AS v FROM m WHERE live GROUP BY ALL), won AS (SELECT incident, min_by(issue, struct_pack(v := -v, o := {_order})) AS issue FROM votes GROUP BY incident),
 c AS (SELECT incident, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS reports, count(*) FILTER (WHERE live) AS live, coalesce(bool_and(resolution = 'UNRESOLVED') FILTER (WHERE live), true) AS unresolved, count(DISTINCT author) FILTER (WHERE counts) AS authors,
 coalesce(avg(quality) FILTER (WHERE counts), 0) AS q, count(*) FILTER (WHERE {_of('SOCIAL')} AND quality < 0.5) AS junk, count(*) FILTER (WHERE {_of('OFFICIAL')} AND NOT recovery) AS official, count(*) FILTER (WHERE {_of('REALTIME')}) AS realtime,
 coalesce(max(CASE WHEN resolution = 'RESOLVED' THEN 1.0::DOUBLE WHEN strategy = 'LINE' THEN 0.8 ELSE 0.6 END) FILTER (WHERE {_of('OFFICIAL')} AND NOT recovery), 1) AS oq, CASE WHEN bool_and(strategy <> 'NONE') FILTER (WHERE {_of('REALTIME')}) THEN 1::DOUBLE ELSE 0.6 END AS rq,
 coalesce(bool_or(recovery) FILTER (WHERE {_of('OFFICIAL')}), false) AS denied, coalesce({_minutes}, 0) AS mins FROM m GROUP BY incident),
 v AS (SELECT *, (1 - (1 - [0, .22, .32, .45, .53, .58, .60][least(authors, 6) + 1] * q * CASE WHEN mins <= 90 THEN 1 ELSE greatest(0.15, 1 - (mins - 90) / 270.0 * 0.85) END) * (1 - 0.9 * least(official, 1) * oq) * (1 - least(realtime * rq * 0.05, 0.15)))
 * CASE WHEN unresolved THEN 0.8 ELSE 1 END * CASE WHEN denied THEN 0.25 ELSE 1 END AS x FROM c), w AS (SELECT *, round(CASE WHEN unresolved THEN least(x, 0.45) ELSE x END, 6) AS confidence FROM v)
 SELECT incident, place, coalesce(won.issue, 'UNKNOWN') AS issue, start_ts, last_ts, reports, authors, junk, official, realtime, confidence, CASE WHEN live = 0 THEN 'STALE' WHEN confidence < {REPORTABLE} THEN 'REJECTED' WHEN denied THEN 'CLEARED' WHEN official > 0 THEN 'CONFIRMED' WHEN confidence >= 0.4 THEN 'REPORTED' ELSE 'CANDIDATE' END AS status
 FROM w JOIN places USING (incident) LEFT JOIN won USING (incident)""")
def verified(spark, d):
    """Evidence to incidents: reports without copies, clustered by shared places, voted on, scored and told or rejected."""
    kept = graph.written(witnesses(spark, d))
    member = graph.written(incidents(kept))
    place = member.groupBy("incident").agg(F.array_join(F.sort_array(F.collect_set("key")), "|").alias("place"))  # the places of one incident
    m = kept.join(member.groupBy("event_id").agg(F.min("incident").alias("incident")), "event_id")
    order = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(P.KINDS) for x in (k, i))), F.col("issue"))
    votes = m.where("live").groupBy("incident", "issue").agg(F.sum("vote").alias("v"))
    won = votes.groupBy("incident").agg(F.min_by("issue", F.struct(-F.col("v"), F.coalesce(order, F.lit(99)))).alias("issue"))
    is_ = lambda k: (F.col("class") == k) & F.col("live")
    counts, stated = is_("SOCIAL") & (F.col("quality") >= 0.5), is_("OFFICIAL") & ~F.col("recovery")
    trust = F.when(F.col("resolution") == "RESOLVED", 1.0).when(F.col("strategy") == "LINE", 0.8).otherwise(0.6)
    c = m.groupBy("incident").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("reports"), F.count_if("live").alias("live"), (F.count_if(F.col("live") & (F.col("resolution") == "RESOLVED")) == 0).alias("unresolved"),
        F.countDistinct(F.when(counts, F.col("author"))).alias("authors"), F.coalesce(F.avg(F.when(counts, F.col("quality"))), F.lit(0.0)).alias("q"), F.count_if(is_("SOCIAL") & (F.col("quality") < 0.5)).alias("junk"),
        F.count_if(stated).alias("official"), F.count_if(is_("REALTIME")).alias("realtime"), F.coalesce(F.max(F.when(stated, trust)), F.lit(1.0)).alias("oq"), F.when(F.min(F.when(is_("REALTIME"), F.col("strategy") != "NONE")), 1.0).otherwise(0.6).alias("rq"),
        (F.count_if(is_("OFFICIAL") & F.col("recovery")) > 0).alias("denied"), F.max(F.when(counts, F.col("ts"))).alias("newest"))
    age = F.coalesce(text.whole_minutes(F.col("newest"), F.col("last_ts")), F.lit(0))
    confidence = risk.calibrated(F.col("authors").cast("int"), F.col("q"), age, F.least(F.col("official"), F.lit(1)) * F.col("oq"), F.col("realtime") * F.col("rq"), F.col("unresolved"), F.col("denied"), F.lit(False))
    c = c.withColumn("confidence", confidence)
    status = F.when(F.col("live") == 0, "STALE").when(F.col("confidence") < REPORTABLE, "REJECTED").when(F.col("denied"), "CLEARED").when(F.col("official") > 0, "CONFIRMED").when(F.col("confidence") >= 0.4, "REPORTED").otherwise("CANDIDATE")
    return c.join(place, "incident").join(won, "incident", "left").select("incident", "place", F.coalesce("issue", F.lit("UNKNOWN")).alias("issue"), "start_ts", "last_ts", "reports", "authors", "junk", "official", "realtime", "confidence", status.alias("status"))


@query("q_agg31_phrase_rules", " UNION ALL ".join(f"SELECT {n} AS rule, '{i}' AS issue, {w} AS weight, count(*) AS reports, count(DISTINCT user_id) AS authors FROM (SELECT *, {_FOLD} AS t FROM {REPORTS}) WHERE {_is('t', r)} HAVING count(*) > 0" for n, (r, i, _, w) in enumerate(P.ISSUES)))
def phrase_rules(spark, d):
    """How often each issue rule speaks, and by how many authors: all rules in one pass over the texts."""
    t = reports(spark, d).withColumn("t", P.folded(F.col("said")))
    met = F.array_compact(F.array(*(F.when(text.matches(F.col("t"), r), F.struct(F.lit(n).alias("rule"), F.lit(i).alias("issue"), F.lit(w).alias("weight"))) for n, (r, i, _, w) in enumerate(P.ISSUES))))
    return t.select("user_id", F.inline(met)).groupBy("rule", "issue", "weight").agg(F.count("*").alias("reports"), F.countDistinct("user_id").alias("authors"))


SOCIAL_CUTS = (0.1, 0.22, 0.32, 0.45, 0.53, 0.58, 0.6)
_VERIFIED = ORACLES["q_pip04_verified"]


@query("q_pip10_evaluation", f"""SELECT cut, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM (SELECT c.cut AS cut, count(*) FILTER (WHERE s >= c.cut AND o) AS tp, count(*) FILTER (WHERE s >= c.cut AND NOT o) AS fp, count(*) FILTER (WHERE s < c.cut AND o) AS fn
 FROM (SELECT official > 0 AS o, [0, .22, .32, .45, .53, .58, .60][least(authors, 6) + 1] AS s FROM ({_VERIFIED})) CROSS JOIN (SELECT unnest({list(SOCIAL_CUTS)}::DOUBLE[]) AS cut) c GROUP BY c.cut)""")
def evaluation(spark, d):
    """Incidents that riders' reports alone would tell, against those that the operator stated, at every threshold."""
    v = verified(spark, d).select((F.col("official") > 0).alias("o"), risk.social_strength(F.col("authors").cast("int")).alias("s"), F.explode(F.filter(F.array(*map(F.lit, SOCIAL_CUTS)), lambda c: c.isNotNull())).alias("cut"))
    told = F.col("s") >= F.col("cut")
    c = v.groupBy("cut").agg(F.count_if(told & F.col("o")).alias("tp"), F.count_if(told & ~F.col("o")).alias("fp"), F.count_if(~told & F.col("o")).alias("fn"))
    return c.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))
