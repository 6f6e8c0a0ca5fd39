"""Statements in the operator's words: every event is a statement with a headline; rule tables read line, issue, severity, kind and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.functions import rulings as R
from kelora.plans.registry import dealt, query, read
from kelora.plans.reports import _k

# what statements say; between them every rule of the tables speaks
PHRASES = (
    "Lif rosak", "Eskalator tidak berfungsi", "Elevator under maintenance", "Gangguan sistem semboyan", "Kerosakan semboyan", "Sistem isyarat terjejas", "Signalling system down", "Gangguan suis landasan", "Landasan retak",
    "Pemeriksaan landasan", "Objek di atas trek", "Struktur jejambat diperiksa", "Kinked rail, penjajaran lari", "Tren terkandas", "Tren gagal bergerak", "Kerosakan teknikal", "Masalah brek", "Kegagalan komponen",
    "Tren dikeluarkan daripada perkhidmatan", "Kehilangan kuasa", "Bunyi brek", "Pintu platform tersekat", "Kesesakan", "Penumpang berhimpit", "Pokok tumbang", "Banjir kilat", "Angin kencang", "Cuaca buruk",
    "Pencerobohan di laluan", "Jalan ditutup", "Bas tersangkut", "Kemalangan", "Kelewatan 20 minit", "Jejas jadual", "Tren lewat", "Tren bergerak lebih perlahan", "Perkhidmatan dihentikan", "Penutupan sementara stesen",
    "Ditutup sementara", "Tren berpatah balik", "Gangguan perkhidmatan", "Perkhidmatan terjejas", "Operasi satu landasan", "Perkhidmatan terhad", "Kesesakan yang teruk", "Gangguan sementara", "Pengumuman", "Insiden kebakaran",
    "Tren terbakar", "Nahas", "Perkhidmatan tidak dapat beroperasi", "Pulih sepenuhnya", "Kembali pulih", "Perkhidmatan terhenti", "Kerja-kerja naik taraf", "Kerja-kerja baik pulih", "Kerja baik pulih", "Penjadualan semula kerja",
    "Migrasi data", "Sesi ujian", "Pemeriksaan perakuan bomba", "Pembukaan semula stesen", "Akan ditutup, akan dijalankan", "Tawaran sebut harga", "Kempen", "Tambang percuma", "Diskaun", "Jom naik", "Eksplorasi Merdeka", "MotoGP",
    "BRT Run", "Perlawanan bola sepak", "Hari Raya", "Rekod penumpang", "Tahniah", "Laporan tahunan", "Sifar kemalangan", "Vaksin", "MyCity", "Kad debit", "Aplikasi", "Kelestarian", "Berita palsu", "Penstrukturan semula laluan",
    "Ujian menunjukkan petanda positif", "Berjalan lancar", "Waktu operasi", "Pelaksanaan projek", "Sasaran 200,000", "Kompleks parkir", "Integriti", "Penggantian komponen", "Penambahbaikan operasi", "Baik pulih fasiliti",
    "Pas bulanan", "Kolaborasi", "Siasatan dalaman", "Demand responsive", "Lorong bas, skip stop", "Polis bantuan", "Tingkat kekerapan", "Pengurangan jumlah tren", "Kelewatán “kecil” – sesak", "Single track working", "Hening",
)
LINE_SAID = (
    "Laluan Ampang / Sri Petaling", "Laluan Kelana Jaya", "Laluan KJ", "KJL", "Laluan Kajang", "KGL", "Laluan Putrajaya", "PYL", "Laluan Monorel", "monorel", "Laluan Sunway", "BRT", "Laluan Shah Alam", "Laluan Ampang", "Laluan Sri Petaling", "Kuala Lumpur",
)
STATIONS_SAID = (
    "Stesen {A}", "Stesen LRT {A} dan Stesen {B}", "stesen {A} Timur ke {B}", "Stesen tersebut", "Stesen {A}, Stesen MRT {B} akan pulih", "tiada", "Stesen monorel LRT {B} menuju {A}", "Stesen ini dan STESEN {A} Timur Utara Barat Daya",
)
_pick = lambda items, at: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + f"][({at}) % {len(items)} + 1]"
_n = len(PHRASES)
STATEMENTS = f"""(SELECT event_id, {_pick(PHRASES, '(event_id * 7 + k) // 3')} AS head, CASE WHEN event_id % 17 = 0 THEN {_pick(PHRASES, 'event_id')} ELSE
 {_pick(PHRASES, 'event_id')} || '. ' || {_pick(PHRASES, f'event_id // {_n} + k')} || '.  Prasarana memaklumkan pelanggan di ' || replace(replace({_pick(STATIONS_SAID, 'event_id + k')}, '{{A}}', 'Nation ' || (k % 25)), '{{B}}', 'Nation ' || ((k + 5) % 25))
 || '. ' || {_pick(LINE_SAID, 'event_id // 5 + k')} END AS body FROM (SELECT event_id, {_k} AS k FROM events))"""


def statements(spark, d) -> DataFrame:
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))
    div = lambda a, b: F.floor(a / b)
    station = lambda n: F.concat(F.lit("Nation "), (n % 25).cast("string"))
    where = F.replace(F.replace(pick(STATIONS_SAID, e + k), F.lit("{A}"), station(k)), F.lit("{B}"), station(k + 5))
    long = F.concat(pick(PHRASES, e), F.lit(". "), pick(PHRASES, div(e, _n) + k), F.lit(".  Prasarana memaklumkan pelanggan di "), where, F.lit(". "), pick(LINE_SAID, div(e, 5) + k))
    return dealt(read(spark, d, "events"), "event_id").select("event_id", pick(PHRASES, div(e * 7 + k, 3)).alias("head"), F.when(e % 17 == 0, pick(PHRASES, e)).otherwise(long).alias("body"))


_plain = lambda c: f"trim(regexp_replace(translate(strip_accents({c}), '‘’‛′“”–—―', '''''''''\"\"---'), '\\s+', ' ', 'g'))"
_groups = lambda *g: [(n, r) for n, r in enumerate(R.RULES) if r[0] in g]
_met = lambda c, *g: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '{r[3].replace(chr(39), chr(39) * 2)}') THEN {n} END" for n, r in _groups(*g)) + "], lambda x: x IS NOT NULL)"
_numbers = lambda *g: str([n for n, _ in _groups(*g)])
_count = lambda c, g: f"len(list_filter({c}, lambda x: list_contains({_numbers(g)}, x)))"
_total = lambda c, i: f"coalesce(list_sum(list_transform(list_filter({c}, lambda x: list_contains({[n for n, r in _groups('issue') if r[1] == i]}, x)), lambda x: {[r[2] for r in R.RULES]}[x + 1])), 0)"
READ = f"""s AS MATERIALIZED (SELECT event_id, body, upper({_plain('head')}) AS h, upper({_plain('body')}) AS b FROM {STATEMENTS}),
 m AS MATERIALIZED (SELECT event_id, length(trim(body)) AS size, {_met('b', 'line', 'issue', 'severity', 'disruption', 'planned', 'strong', 'weak')} AS met, {_met('h', 'issue')} AS hm FROM s)"""


def ruled(spark, d) -> DataFrame:
    """(event_id, size, met, hm): rules that match each body, and issue rules that match its headline."""
    up = lambda c: F.upper(R.plain(F.col(c)))
    # texts are folded in a projection of their own: each is read by many rules
    s = statements(spark, d).select("event_id", F.length(F.trim("body")).alias("size"), up("body").alias("body"), up("head").alias("head"))
    every = ("line", "issue", "severity", "disruption", "planned", "strong", "weak")
    return s.select("event_id", "size", R.hits(F.col("body"), *every).alias("met"), R.hits(F.col("head"), "issue").alias("hm"))


_scores = ", ".join(f"{_total('met', i)} + {R.HEADLINE} * {_total('hm', i)} AS s{n}" for n, i in enumerate(R.PRIORITY))
_cause = f"greatest({', '.join(f's{n}' for n, i in enumerate(R.PRIORITY) if i in R.CAUSES)}) >= {R.CAUSE_FLOOR}"
_kept = [f"CASE WHEN cause AND s{n} < {R.CROWDING_FLOOR} THEN 0 ELSE s{n} END" if i == "CROWDING" else f"CASE WHEN cause THEN 0 ELSE s{n} END" if i == "DELAY" else f"s{n}" for n, i in enumerate(R.PRIORITY)]
_sev = "list_max(list_transform(list_filter(met, lambda x: list_contains(" + _numbers("severity") + ", x)), lambda x: " + str([R.LEVELS.index(r[1]) * 100 + r[2] if r[0] == "severity" else 0 for r in R.RULES]) + "[x + 1]))"


@query("q_str20_statements", f"""WITH {READ}, c AS (SELECT *, {_scores} FROM m), k AS (SELECT *, {_cause} AS cause FROM c), f AS (SELECT event_id, met, {', '.join(f'{e} AS t{n}' for n, e in enumerate(_kept))} FROM k),
 l AS (SELECT event_id, string_agg(line, '|' ORDER BY first) AS lines FROM (SELECT event_id, line, min(pos) AS first FROM (SELECT event_id, unnest(string_split({[r[1] if r[0] == 'line' else '' for r in R.RULES]}[n + 1], '|')) AS line, n * 10 + unnest([0, 1][1:len(string_split({[r[1] if r[0] == 'line' else '' for r in R.RULES]}[n + 1], '|'))]) AS pos
 FROM (SELECT event_id, unnest(list_filter(met, lambda x: list_contains({_numbers('line')}, x))) AS n FROM m)) GROUP BY event_id, line) GROUP BY event_id)
 SELECT f.event_id, coalesce(l.lines, '') AS lines, CASE {' '.join(f"WHEN t{n} > 0 AND t{n} = greatest({', '.join(f't{j}' for j in range(len(_kept)))}) THEN '{i}'" for n, i in enumerate(R.PRIORITY))} ELSE 'UNKNOWN' END AS issue,
 CAST(greatest({', '.join(f't{j}' for j in range(len(_kept)))}) AS INTEGER) AS score, CAST({' + '.join(f'(t{n} > 0)::INT' for n in range(len(_kept)))} AS INTEGER) AS issues, {list(R.LEVELS)}[coalesce({_sev}, 0) // 100 + 1] AS severity, CAST(coalesce({_sev}, 0) AS INTEGER) AS severity_score FROM f LEFT JOIN l ON l.event_id = f.event_id""")
def ruled_statements(spark, d):
    """Lines, issue and severity of every statement; the headline counts twice, a cause deletes its symptoms."""
    r = ruled(spark, d).withColumn("scores", R.issue_scores(F.col("met"), F.col("hm"))).withColumn("worst", F.coalesce(R.severity_score(F.col("met")), F.lit(0)))
    best = F.get("scores", F.lit(0))
    return r.select("event_id", F.array_join(R.line_ids(F.col("met")), "|").alias("lines"), F.coalesce(best["issue"], F.lit("UNKNOWN")).alias("issue"), F.coalesce(best["score"], F.lit(0)).alias("score"), F.size("scores").alias("issues"),
                    F.element_at(F.array(*map(F.lit, R.LEVELS)), (F.floor(F.col("worst") / 100) + 1).cast("int")).alias("severity"), F.col("worst").cast("int").alias("severity_score"))


_d, _s, _w, _p = (_count("met", g) for g in ("disruption", "strong", "weak", "planned"))


@query("q_flt14_decisions", f"""WITH {READ} SELECT kind, disruption, strong, weak, planned, count(*) AS n FROM (SELECT CASE WHEN size < {R.READABLE} THEN 'UNREADABLE' WHEN {_d} = 0 OR {_count('met', 'line')} = 0 OR {_s} >= 1 THEN 'NON_INCIDENT'
 WHEN {_p} >= 2 AND {_d} <= 2 THEN 'PLANNED_SERVICE_CHANGE' WHEN {_w} >= 2 AND {_w} >= {_d} THEN 'NON_INCIDENT' ELSE 'INCIDENT' END AS kind, CAST({_d} AS INTEGER) AS disruption, CAST({_s} AS INTEGER) AS strong, CAST({_w} AS INTEGER) AS weak, CAST({_p} AS INTEGER) AS planned FROM m) GROUP BY ALL""")
def decisions(spark, d):
    """Kinds of documents by the list of decisions, with the markers that decided."""
    r = ruled(spark, d)
    marks = {g: R.count(F.col("met"), g).alias(g) for g in ("disruption", "strong", "weak", "planned")}
    return r.select(R.kind(F.col("size"), F.col("met")).alias("kind"), *marks.values()).groupBy("kind", *marks).agg(F.count("*").alias("n"))


@query("q_agg31_statement_rules", f"WITH {READ} SELECT rule, {[r[0] for r in R.RULES]}[rule + 1] AS grp, {[r[1] for r in R.RULES]}[rule + 1] AS name, count(*) AS bodies FROM (SELECT unnest(met) AS rule FROM m) GROUP BY ALL")
def statement_rules(spark, d):
    """How many statements each rule of the tables speaks in; all rules speak."""
    # outer: a plain explode would infer a filter on the list, which runs all rules once more on unfolded texts
    n = ruled(spark, d).select(F.explode_outer("met").alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("bodies"))
    of = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in R.RULES)), F.col("rule") + 1)
    return n.select("rule", of(0).alias("grp"), of(1).alias("name"), "bodies")


_station_names = "(SELECT n_nationkey AS id, 'NATION ' || n_nationkey AS name FROM nation UNION ALL SELECT 100 + n_nationkey, 'NATION ' || n_nationkey || ' TIMUR' FROM nation WHERE n_nationkey % 5 = 0)"


@query("q_str20_stations", f"""WITH s AS MATERIALIZED (SELECT event_id, {_plain('body')} AS x FROM {STATEMENTS}), p AS (SELECT event_id, string_split_regex(x, '(?i)Stesen\\s+') AS parts, regexp_extract_all(x, '(?i)(Stesen\\s+)', 1) AS gaps FROM s),
 o AS (SELECT event_id, parts, gaps, unnest(generate_series(1, len(parts) - 1)) AS i FROM p), w AS (SELECT event_id, i, list_sum(list_transform(parts[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda t: length(t))), 0) AS pos,
 list_transform(string_split_regex(substr(parts[i + 1], 1, {R.STATION_REACH}), '\\s+'), lambda t: regexp_replace(t, '[^A-Za-z0-9''/.\\-]', '', 'g')) AS ws FROM o),
 f AS (SELECT *, list_position(list_transform(ws, lambda t: list_contains({list(R.STATION_MODES)}, lower(t))), false) AS lead FROM w), g AS (SELECT event_id, i, pos, ws[lead:lead + {R.STATION_TOKENS - 1}] AS rest FROM f WHERE lead > 0),
 h AS (SELECT *, list_position(list_transform(rest, lambda t: t = '' OR list_contains({R.STATION_STOPS}, lower(t))), true) AS stop FROM g), k AS (SELECT event_id, pos, CASE WHEN coalesce(stop, 0) = 0 THEN rest ELSE rest[1:stop - 1] END AS ts FROM h),
 c AS (SELECT event_id, pos, ts, unnest(generate_series(1, len(ts))) AS n FROM k WHERE regexp_matches(ts[1], '^[A-Z0-9]'))
 SELECT event_id, CAST(pos AS INTEGER) AS pos, max_by(id, n) AS station, CAST(max(n) AS INTEGER) AS words FROM c JOIN {_station_names} t ON t.name = upper(array_to_string(ts[1:n], ' ')) GROUP BY event_id, pos""")
def stations(spark, d):
    """Stations named after "Stesen": the longest run of words that is a name."""
    said = statements(spark, d).select("event_id", F.inline(R.station_tokens(R.plain(F.col("body")))))
    runs = said.select("event_id", "at", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("n"))
    runs = runs.withColumn("name", F.upper(F.array_join(F.slice("tokens", 1, F.col("n")), " ")))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.concat(F.lit("NATION "), F.col("n_nationkey").cast("string")).alias("name"))
    names = nation.unionByName(nation.where("id % 5 = 0").select((F.col("id") + 100).alias("id"), F.concat("name", F.lit(" TIMUR")).alias("name")))
    return runs.join(names, "name").groupBy("event_id", F.col("at").alias("pos")).agg(F.max_by("id", "n").alias("station"), F.max("n").alias("words"))
