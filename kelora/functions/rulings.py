"""Operator statements read by rule tables: lines, issue, severity, stations and kind of document. Expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelora.functions import text

# Patterns over upper-case text with their names and weights, in order of the rules; word lists of station capture; order of issues.
LINES = (
    ("AG|PH", r"LALUAN\s+AMPANG\s*(?:\/|-|&|DAN)?\s*SRI\s+PETALING"), ("KJ", r"LALUAN\s+KELANA\s+JAYA"), ("KJ", r"LALUAN\s+KJ\b"), ("KJ", r"\bKJL\b"), ("KGL", r"LALUAN\s+KAJANG"), ("KGL", r"\bKGL\b"),
    ("PYL", r"LALUAN\s+PUTRAJAYA"), ("PYL", r"\bPYL\b"), ("MR", r"LALUAN\s+MONOREL"), ("MR", r"\bMONOREL\b"), ("BRT", r"LALUAN\s+SUNWAY"), ("BRT", r"\bBRT\b"), ("SA", r"LALUAN\s+SHAH\s+ALAM"),
    ("AG", r"LALUAN\s+AMPANG"), ("PH", r"LALUAN\s+SRI\s+PETALING"),
)
ISSUES = (
    ("ELEVATOR_FAULT", 6, r"\bLIF\b"), ("ELEVATOR_FAULT", 6, r"ESKALATOR"), ("ELEVATOR_FAULT", 4, r"ELEVATOR"),
    ("SIGNAL_FAULT", 6, r"SISTEM\s+SEMBOYAN"), ("SIGNAL_FAULT", 6, r"\bSEMBOYAN\b"), ("SIGNAL_FAULT", 5, r"SISTEM\s+ISYARAT|\bISYARAT\b"), ("SIGNAL_FAULT", 4, r"SIGNAL(?:LING)?\s+(?:SYSTEM|FAULT)"),
    ("TRACK_FAULT", 5, r"SUIS\s+LANDASAN"), ("TRACK_FAULT", 4, r"LANDASAN\s+(?:ROS AK|ROSAK|BENGKOK|RETAK|TERANGKAT|TIDAK\s+BERFUNGSI)"), ("TRACK_FAULT", 3, r"\bLANDASAN\b"), ("TRACK_FAULT", 3, r"\bTREK\b"),
    ("TRACK_FAULT", 4, r"STRUKTUR\s+JEJAMBAT|JEJAMBAT"), ("TRACK_FAULT", 3, r"\bKINKED\b|PENJAJARAN"),
    ("VEHICLE_BREAKDOWN", 7, r"TREN\s+TERKANDAS|TERKANDAS"), ("VEHICLE_BREAKDOWN", 5, r"TREN\s+(?:ROS AK|ROSAK|GAGAL|TIDAK\s+DAPAT)"), ("VEHICLE_BREAKDOWN", 4, r"KEROSAKAN\s+(?:TREN|TEKNIKAL|KOMPONEN|SISTEM)"),
    ("VEHICLE_BREAKDOWN", 4, r"MASALAH\s+(?:TEKNIKAL|MEKANIKAL|BREK|BEKALAN)"), ("VEHICLE_BREAKDOWN", 3, r"KEGAGALAN\s+(?:KOMPONEN|SISTEM|BREK)"),
    ("VEHICLE_BREAKDOWN", 3, r"KELUAR\s+DARIPADA\s+PERKHIDMATAN|DIKELUARKAN\s+DARIPADA\s+PERKHIDMATAN"), ("VEHICLE_BREAKDOWN", 3, r"KEHILANGAN\s+(?:KUASA|SUMBER\s+KUASA)|KELUAR\s+KUASA"), ("VEHICLE_BREAKDOWN", 3, r"\bBREK\b"),
    ("DOOR_FAULT", 5, r"PINTU\s+(?:PLATFORM|TREN|PSD)"), ("CROWDING", 4, r"KESESAKAN|\bSESAK\b"), ("CROWDING", 3, r"PENUMPANG\s+(?:RAMAI|BERHIMPIT|TERLALU\s+BANYAK)"),
    ("WEATHER", 6, r"POKOK\s+TUMBANG"), ("WEATHER", 5, r"\bBANJIR\b"), ("WEATHER", 5, r"ANGIN\s+KENCANG|RIBUT|PETIR|KILAT"), ("WEATHER", 4, r"\bCUACA\b"),
    ("ROAD_BLOCKED", 5, r"PENCEROBOHAN|MENCEROBOH"),
    ("ROAD_BLOCKED", 4, r"JALAN\s+DITUTUP|MENGHALANG\s+JALAN|TERSANGKUT\s+(?:DI|PADA)\s+(?:JALAN|STRUKTUR|TEROWONG)|(?:BAS|KENDERAAN|KERETA|LORI|VAN)\s+TERSANGKUT"), ("ROAD_BLOCKED", 3, r"KEMALANGAN|NAHAS"),
    ("DELAY", 3, r"KELEWATAN|MENGALAMI\s+KELEWATAN"), ("DELAY", 3, r"JEJAS\s+JADUAL"), ("DELAY", 2, r"\bLEWAT\b|\bTERLAMBAT\b"), ("DELAY", 2, r"BERGERAK\s+LEBIH\s+PERLAHAN|PERLAHAN"),
)
SEVERITIES = (
    ("SEVERE", 8, r"PERKHIDMATAN\s+(?:DIHENTIKAN|DIBERHENTIKAN|TERHENTI|TIDAK\s+DAPAT\s+BEROPERASI)"), ("SEVERE", 7, r"PENUTUPAN\s+(?:SEMENTARA\s+)?STESEN|STESEN\s+(?:DITUTUP|DIBUKA\s+SEMULA)"),
    ("SEVERE", 6, r"DITUTUP\s+SEMENTARA|PENUTUPAN"), ("SEVERE", 5, r"TREN\s+TERKANDAS|TERKANDAS"), ("SEVERE", 4, r"BERPATAH\s+BALIK|PERKHIDMATAN\s+ULANG-ALIK|PERKHIDMATAN\s+TREN\s+PERANTARA"),
    ("MAJOR", 5, r"GANGGUAN\s+(?:PERKHIDMATAN|TEKNIKAL|SISTEM|BEKALAN|SUIS|ISYARAT)"), ("MAJOR", 4, r"TERJEJAS|JEJAS\s+JADUAL"), ("MAJOR", 4, r"SATU\s+LANDASAN|SINGLE\s+TRACK|LANDASAN\s+TUNGGAL"),
    ("MAJOR", 3, r"PERKHIDMATAN\s+TERHAD|KEKERAPAN\s+BERKURANGAN|MENGURANGKAN\s+JUMLAH\s+TREN"), ("MAJOR", 3, r"KESESAKAN\s+(?:YANG\s+)?TERUK|SESAK"),
    ("MINOR", 2, r"KELEWATAN|LEWAT"), ("MINOR", 2, r"GANGGUAN\s+SEMENTARA"), ("INFO", 1, r"PENGUMUMAN|MAKLUMAN|ADVISORY"),
)
DISRUPTION = (
    r"GANGGUAN", r"TERJEJAS", r"TERKANDAS", r"KELEWATAN", r"KEROSAKAN", r"TERHENTI", r"DIHENTIKAN", r"PENUTUPAN", r"DITUTUP", r"INSIDEN", r"KEBAKARAN", r"TERBAKAR", r"KEMALANGAN", r"NAHAS", r"PENCEROBOHAN",
    r"TIDAK\s+BERFUNGSI", r"TIDAK\s+DAPAT\s+BEROPERASI", r"PULIH\s+SEPENUHNYA", r"KEMBALI\s+PULIH", r"SATU\s+LANDASAN", r"SINGLE\s+TRACK",
)
PLANNED = (
    r"KERJA-KERJA\s+NAIK\s+TARAF", r"KERJA-KERJA\s+BAIK\s+PULIH", r"KERJA\s+BAIK\s+PULIH", r"PENJADUALAN\s+SEMULA\s+KERJA", r"MIGRASI", r"SESI\s+UJIAN|UJIAN\s+(?:SISTEM|LANJUTAN|PERCUBAAN|MIGRASI)",
    r"PEMERIKSAAN\s+PERAKUAN\s+BOMBA", r"PERAKUAN\s+BOMBA", r"PEMBUKAAN\s+SEMULA", r"AKAN\s+DITUTUP|AKAN\s+DIJALANKAN|AKAN\s+DILAKSANAKAN",
)
STRONG = (
    r"TAWARAN|SEBUT\s+HARGA|PELANTIKAN|PUCUK\s+PIMPINAN", r"KEMPEN", r"TAMBANG\s+PERCUMA|PERCUMA\s+SEBULAN", r"DISKAUN|BELI\s+1\s+PERCUMA\s+1", r"JOM\s*NAIK", r"EKSPLORASI\s+MERDEKA", r"MOTOGP", r"\bBRT\s*RUN\b|LARIAN",
    r"PERLAWANAN|PIALA|BOLA\s+SEPAK", r"AMBANG\s+TAHUN|HARI\s+RAYA|RAMADAN|THAIPUSAM|MERDEKA|HARI\s+MENGUNDI", r"REKOD\s+(?:PENUMPANG|JUMLAH)|PENUMPANG\s+TERTINGGI", r"PENGIKTIRAFAN|ANUGERAH|PENGHARGAAN|TAHNIAH",
    r"LEMBARAN\s+BAHARU|LAPORAN\s+TAHUNAN", r"SIFAR\s+KEMALANGAN|KESELAMATAN\s+JALAN\s+RAYA|KESEDIAAN\s+DAN\s+SIAP\s+SIAGA", r"VAKSIN|\bPPV\b|COVID", r"OKU|SMILE|MYCITY|FIT\s+RAPID", r"KAD\s+DEBIT|PEMBAYARAN", r"PULSE|APLIKASI",
    r"KELESTARIAN|EKOSISTEM\s+MARIN|PENYU", r"TULAR|PALSU|MENAFIKAN", r"PENSTRUKTURAN\s+SEMULA\s+LALUAN", r"UJIAN(?:-UJIAN)?\s+(?:MENUNJUKKAN|LANJUTAN|PERCUBAAN|SISTEM|MIGRASI)",
    r"PEMBUKAAN\s+SEMULA|DIBUKA\s+SEPENUHNYA|BERJALAN\s+LANCAR", r"LANJUTAN\s+OPERASI|LANJUT\s+(?:WAKTU|PERKHIDMATAN|TEMPOH)|WAKTU\s+OPERASI", r"MENGAMBIL\s+MAKLUM|KEMAJUAN\s+PELAKSANAAN|PELAKSANAAN\s+PROJEK",
    r"SASARAN\s+\d|PURATA\s+PENGGUNAAN\s+HARIAN|JUMLAH\s+PENGGUNA", r"KOMPLEKS\s+PARKIR|SEBUAH\s+KERETA\b", r"MENINGKATKAN\s+KETELUSAN|KEBOLEHPERCAYAAN|INTEGRITI", r"PENGGANTIAN\s+KOMPONEN|MEMPERCEPATKAN\s+PROSES",
    r"PENAMBAHBAIKAN\s+(?:PERKHIDMATAN|OPERASI|FASILITI)", r"KERJA-KERJA\s+BAIK\s+PULIH\s+FASILITI|BAIK\s+PULIH\s+FASILITI",
)
WEAK = (
    r"\bPAS\b", r"KOLABORASI|MEMORANDUM\s+PERSEFAHAMAN|KERJASAMA", r"LAPORAN|SIASATAN\s+(?:MENYELURUH|DALAMAN)", r"DRT\b|DEMAND\s+RESPONSIVE", r"LORONG\s+BAS|SKIP\s+STOP|BAS\s+PERANTARA\s+(?:PERCUMA\s+)?(?:BAHARU|T250|T545)",
    r"JENAYAH|SUSPEK|POLIS\s+BANTUAN|TANGKAP", r"TINGKAT\s+KEKERAPAN|MENINGKATKAN\s+KEKERAPAN|KEKERAPAN\s+TREN\s+DAN\s+BAS", r"PENGURANGAN\s+JUMLAH\s+TREN", r"PEMBUKAAN\s+(?:SEMULA\s+)?(?:STESEN|LALUAN|PERKHIDMATAN)",
)
STATION_STOPS = """dan di ke yang untuk bagi dari daripada akan telah ini itu pada serta sahaja berikut menuju menghala sehingga hinggalah arah kepada adalah tidak masih turut juga pula namun manakala sementara selepas
sebelum apabila jika kerana akibat ekoran susulan berhampiran berdekatan terletak melibatkan terlibat atau dengan ialah merupakan sebagai oleh dalam atas bawah antara lain""".split()
STATION_MODES, STATION_TOKENS, STATION_REACH = ("lrt", "mrt", "monorel", "brt", "ktm"), 5, 80
CAUSES = ("VEHICLE_BREAKDOWN", "SIGNAL_FAULT", "TRACK_FAULT", "ELEVATOR_FAULT", "DOOR_FAULT", "WEATHER", "ROAD_BLOCKED")
PRIORITY = (*CAUSES, "CROWDING", "DELAY")
LEVELS = ("INFO", "MINOR", "MAJOR", "SEVERE")
HEADLINE, CAUSE_FLOOR, CROWDING_FLOOR, READABLE = 2, 3, 8, 60  # extra weight of a headline, score that names a cause, score that keeps crowding beside one, least characters

#: All rules, numbered: (group, name, weight, pattern).
RULES = (
    *(("line", n, 1, p) for n, p in LINES), *(("issue", n, w, p) for n, w, p in ISSUES), *(("severity", n, w, p) for n, w, p in SEVERITIES),
    *((g, g, 1, p) for g, ps in (("disruption", DISRUPTION), ("planned", PLANNED), ("strong", STRONG), ("weak", WEAK)) for p in ps),
)


def plain(x: Column) -> Column:
    """Without diacritics, with straight quotes and dashes, spaces squeezed; case stays."""
    x = F.translate(text.unmarked(x), "‘’‛′“”–—―", "''''\"\"---")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def hits(upper: Column, *groups: str) -> Column:
    """The numbers of the rules of these groups that match upper-case text, in their order; each pattern runs once."""
    return F.array_compact(F.array(*(F.when(text.matches(upper, p), F.lit(n)) for n, (g, _, _, p) in enumerate(RULES) if g in groups)))


def named(met: Column, group: str) -> Column:
    """Names of a group's matched rules."""
    own = {n: name for n, (g, name, _, _) in enumerate(RULES) if g == group}
    return F.transform(F.filter(met, lambda n: n.isin(*own)), lambda n: F.element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), n))


def count(met: Column, group: str) -> Column:
    return F.size(F.filter(met, lambda n: n.isin(*(k for k, r in enumerate(RULES) if r[0] == group))))


def line_ids(met: Column) -> Column:
    """The lines that a text names, each once, in the order of the rules."""
    return F.array_distinct(F.split(F.array_join(named(met, "line"), "|"), r"\|"))


def issue_scores(body: Column, head: Column) -> Column:
    """struct(issue, score) of every issue with a score, best first: weights of the body's rules and twice the headline's.

    A named cause deletes its symptom DELAY, and CROWDING under CROWDING_FLOOR. Ties go by PRIORITY.
    """
    weight = {n: w for n, (g, _, w, _) in enumerate(RULES) if g == "issue"}
    table = F.create_map(*(F.lit(x) for kv in weight.items() for x in kv))
    total = lambda met, name: F.aggregate(F.filter(met, lambda n: n.isin(*(k for k, r in enumerate(RULES) if r[:2] == ("issue", name)))), F.lit(0), lambda a, n: a + F.element_at(table, n))
    all_ = F.array(*(F.struct((total(body, k) + HEADLINE * total(head, k)).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("issue")) for i, k in enumerate(PRIORITY)))
    cause = lambda a: F.exists(a, lambda x: x["issue"].isin(*CAUSES) & (x["score"] >= CAUSE_FLOOR))
    kept = lambda a: F.filter(a, lambda x: (x["score"] > 0) & ~(cause(a) & ((x["issue"] == "DELAY") | (x["issue"] == "CROWDING") & (x["score"] < CROWDING_FLOOR))))
    return F.transform(F.sort_array(kept(all_), asc=False), lambda x: F.struct(x["issue"].alias("issue"), x["score"].alias("score")))


def severity_score(met: Column) -> Column:
    """100 times the worst level plus the largest weight of its rules; null where no rule speaks."""
    value = {n: LEVELS.index(name) * 100 + w for n, (g, name, w, _) in enumerate(RULES) if g == "severity"}
    return F.array_max(F.transform(F.filter(met, lambda n: n.isin(*value)), lambda n: F.element_at(F.create_map(*(F.lit(x) for kv in value.items() for x in kv)), n)))


def kind(size: Column, met: Column) -> Column:
    """INCIDENT, PLANNED_SERVICE_CHANGE, NON_INCIDENT or UNREADABLE, by an ordered list of decisions."""
    d, s, w, p = (count(met, g) for g in ("disruption", "strong", "weak", "planned"))
    none = (d == 0) | (count(met, "line") == 0) | (s >= 1)
    return F.when(size < READABLE, "UNREADABLE").when(none, "NON_INCIDENT").when((p >= 2) & (d <= 2), "PLANNED_SERVICE_CHANGE").when((w >= 2) & (w >= d), "NON_INCIDENT").otherwise("INCIDENT")


def station_tokens(x: Column) -> Column:
    """For each "Stesen" in plain text: struct(at, tokens), the place of the word and the capitalised words that follow,
    up to a stop word, STATION_TOKENS words or STATION_REACH characters; a mode of transport right after it is skipped."""
    parts = F.split(x, r"(?i)Stesen\s+")
    gaps = F.regexp_extract_all(x, F.lit(r"(?i)(Stesen\s+)"), F.lit(1))
    words = lambda p: F.transform(F.split(F.substring(p, 1, STATION_REACH), r"\s+"), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9'/.\-]", ""))
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, w: n + F.length(w))

    def one(p, i):
        w = words(p)
        first = F.array_position(F.transform(w, lambda t: F.lower(t).isin(*STATION_MODES)), False)
        rest = F.when(first > 0, F.slice(w, F.greatest(first, F.lit(1)).cast("int"), STATION_TOKENS))
        stop = F.array_position(F.transform(rest, lambda t: (t == "") | F.lower(t).isin(*STATION_STOPS)), True)
        kept = F.when(stop == 0, rest).otherwise(F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)).cast("int")))
        at = size(F.slice(parts, 1, i + 1)) + size(F.slice(gaps, 1, i))
        return F.struct(at.alias("at"), F.when(F.get(kept, F.lit(0)).rlike("^[A-Z0-9]"), kept).alias("tokens"))

    return F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), one), lambda s: s["tokens"].isNotNull())
