"""What lies behind an incident: a trace of steps with their sources; statements that repeat; the language of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelora.functions import text
from kelora.operators import graph
from kelora.plans.composites import STATEMENTS, _headline_sql, headline, statements
from kelora.plans.registry import query
from kelora.plans.reports import INCIDENTS, PARSED, REPORTS, incidents, parsed, reports, witnesses

SLUG = 140  # fixed: characters of a headline that tell statements apart


@query("q_win04_statements", f"""WITH h AS (SELECT s.event_id, CAST(s.ts + INTERVAL 8 HOUR AS DATE) AS day, substr(trim(regexp_replace(lower(headline), '[^a-z0-9]+', '-', 'g'), '-'), 1, {SLUG}) AS slug FROM {STATEMENTS} s JOIN {_headline_sql(STATEMENTS)} h ON h.event_id = s.event_id)
 SELECT event_id, day, min(event_id) OVER (PARTITION BY day, slug) AS original FROM h""")
def repeated_statements(spark, d):
    """Statements of one local day with the same headline are one; the first stands for all. An aggregate and a join, so a
    headline that thousands share is split."""
    s = statements(spark, d).select("event_id", F.to_date(F.expr("ts + interval 8 hours")).alias("day"), headline(F.col("said")).alias("h"))
    s = s.select("event_id", "day", F.substring(F.trim(F.regexp_replace(F.lower("h"), "[^a-z0-9]+", "-"), F.lit("-")), 1, SLUG).alias("slug"))
    s = graph.written(s)  # headlines are read twice
    first = s.groupBy("day", "slug").agg(F.min("event_id").alias("original"))
    return s.join(first, ["day", "slug"]).select("event_id", "day", "original")


_spoken = "CASE event_id % 40 WHEN 0 THEN said || ' 地铁' WHEN 1 THEN said || ' ரயில்' WHEN 2 THEN 'THE TRAIN TAK ADA' ELSE said END"
_words = f"list_filter(string_split(regexp_replace(upper(x), '{text.TOKEN_GAP}', ' ', 'g'), ' '), lambda w: w <> '')"
_held = lambda known: f"len(list_filter(ws, lambda w: list_contains({known}, w)))"


@query("q_str15_detected", f"""WITH t AS (SELECT event_id, x, {_words} AS ws FROM (SELECT event_id, {_spoken} AS x FROM {REPORTS})), v AS (SELECT *, CASE WHEN regexp_matches(x, '{text.CJK}') THEN 'zh' WHEN regexp_matches(x, '{text.TAMIL}') THEN 'ta' END AS script, {_held(text.MALAY)} AS ms, {_held(text.ENGLISH)} AS en FROM t)
 SELECT event_id, coalesce(script, CASE WHEN ms = 0 AND en = 0 THEN 'unknown' WHEN ms >= en THEN 'ms' ELSE 'en' END) AS language, round(CASE WHEN script IS NULL AND len(ws) > 0 THEN ms / len(ws) ELSE 0 END, 6)::DOUBLE AS malay, round(CASE WHEN script IS NULL AND len(ws) > 0 THEN en / len(ws) ELSE 0 END, 6)::DOUBLE AS english FROM v""")
def detected_language(spark, d):
    """The language of every report; some are in other scripts or mixed."""
    n = F.col("event_id") % 40
    x = F.when(n == 0, F.concat("said", F.lit(" 地铁"))).when(n == 1, F.concat("said", F.lit(" ரயில்"))).when(n == 2, "THE TRAIN TAK ADA").otherwise(F.col("said"))
    r = reports(spark, d).select("event_id", x.alias("x")).select("event_id", text.detected(F.col("x")).alias("l"))
    return r.select("event_id", "l.language", F.round("l.malay", 6).alias("malay"), F.round("l.english", 6).alias("english"))


STEPS = ("Evidence captured", "Reposts removed", "Location resolved", "Operator")


@query("q_pip11_traces", f"""WITH RECURSIVE {INCIDENTS}, m AS (SELECT k.*, incident FROM kept k JOIN member USING (event_id)), a AS (SELECT incident, count(*) AS n, min(ts) AS seen, min(ts) FILTER (WHERE class = 'OFFICIAL' AND live AND NOT recovery) AS told, string_agg(event_id::VARCHAR, ',' ORDER BY us, event_id) AS ids,
 string_agg(event_id::VARCHAR, ',' ORDER BY us, event_id) FILTER (WHERE class <> 'SOCIAL') AS official, count(*) FILTER (WHERE class = 'SOCIAL') AS social, array_to_string(list_sort(list(DISTINCT author) FILTER (WHERE class = 'SOCIAL')), ',') AS authors, count(DISTINCT author) FILTER (WHERE class = 'SOCIAL') AS n_authors FROM m GROUP BY incident),
 t AS (SELECT a.*, place FROM a JOIN places USING (incident)) SELECT incident, unnest([1, 2, 3, 4]) AS step, unnest(['{STEPS[0]}', '{STEPS[1]}', '{STEPS[2]}', CASE WHEN told IS NULL THEN 'Operator has not confirmed' ELSE 'Operator confirmed' END]) AS label,
 unnest([n || ' sources, first at ' || strftime(seen, '%Y-%m-%d %H:%M'), social || ' social items of ' || n_authors || ' authors', 'at ' || place, CASE WHEN told IS NULL THEN 'no statement yet' ELSE floor((epoch_us(told) - epoch_us(seen)) / 60000000.0)::BIGINT || ' minutes after the first report' END]) AS detail,
 unnest([ids, coalesce(authors, ''), place, coalesce(official, '')]) AS refs FROM t""")
def traces(spark, d):
    """The steps from evidence to an incident, each with what it says and the sources, authors or places it rests on."""
    kept = graph.written(witnesses(spark, d))
    member = graph.written(incidents(kept))
    place = member.groupBy("incident").agg(F.array_join(F.sort_array(F.collect_set("key")), "|").alias("place"))
    m = kept.join(member.groupBy("event_id").agg(F.min("incident").alias("incident")), "event_id")
    social, stated = F.col("class") == "SOCIAL", (F.col("class") == "OFFICIAL") & F.col("live") & ~F.col("recovery")
    own = F.struct("us", "event_id")
    ids = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["event_id"].cast("string")), ",")  # noqa: E731  (the sources of one incident are its trace)
    a = m.groupBy("incident").agg(
        F.count("*").alias("n"), F.min("ts").alias("seen"), F.min(F.when(stated, F.col("ts"))).alias("told"), ids(own).alias("ids"), ids(F.when(~social, own)).alias("official"),
        F.count_if(social).alias("social"), F.sort_array(F.collect_set(F.when(social, F.col("author")))).alias("who")).join(place, "incident")
    text_ = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    step = lambda label, detail, refs: F.struct(label.alias("label"), detail.alias("detail"), refs.alias("refs"))
    later = F.floor((F.unix_micros(F.col("told").cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))) / 60_000_000)
    steps = F.array(
        step(F.lit(STEPS[0]), text_(F.col("n"), " sources, first at ", F.date_format("seen", "yyyy-MM-dd HH:mm")), F.col("ids")),
        step(F.lit(STEPS[1]), text_(F.col("social"), " social items of ", F.size("who"), " authors"), F.array_join(F.col("who").cast("array<string>"), ",")),
        step(F.lit(STEPS[2]), text_("at ", F.col("place")), F.col("place")),
        step(F.when(F.col("told").isNull(), "Operator has not confirmed").otherwise("Operator confirmed"), F.when(F.col("told").isNull(), "no statement yet").otherwise(text_(later, " minutes after the first report")), F.col("official")))
    return a.select("incident", F.posexplode(steps)).select("incident", (F.col("pos") + 1).alias("step"), "col.label", "col.detail", "col.refs")


@query("q_str17_authors", f"""SELECT p.event_id, CASE WHEN p.event_id % 11 = 0 THEN 1.0 ELSE round(repost, 6) END AS repost, repost >= 0.5 OR p.event_id % 11 = 0 AS is_repost, CASE WHEN p.event_id % 11 = 0 THEN (user_id + 1) % 150 ELSE user_id END AS author FROM {PARSED} p""")
def authors(spark, d):
    """Whose words a report carries: a stated original author goes before the account that posted it."""
    structured = F.col("event_id") % 11 == 0  # every eleventh report states another author
    p = parsed(reports(spark, d)).select("event_id", "user_id", "repost")
    return p.select("event_id", F.when(structured, 1.0).otherwise(F.round("repost", 6)).alias("repost"), ((F.col("repost") >= 0.5) | structured).alias("is_repost"), F.when(structured, (F.col("user_id") + 1) % 150).otherwise(F.col("user_id")).alias("author"))
