"""Disruption phrases in Malay and English: issue and severity votes, time posture, authenticity. Expressions on folded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelora.functions import text

# Patterns with their issue, severity and weight; markers with their weights; days that a phrase of the past implies.
ISSUES = (
    (r"\bTREN\s+TERKANDAS\b", "VEHICLE_BREAKDOWN", "MAJOR", 3),
    (r"\bTRAIN\s+(?:IS\s+)?STUCK\b", "VEHICLE_BREAKDOWN", "MAJOR", 3),
    (r"\bTREN\s+(?:ROS[AK]+|GAGAL|MATI)\b", "VEHICLE_BREAKDOWN", "MAJOR", 3),
    (r"\bKOMPONEN\s+BREK\b|\bBREK\s+(?:ROS[AK]+|GAGAL)\b", "VEHICLE_BREAKDOWN", "MAJOR", 2),
    (r"\bTREN\s+TERBAKAR\b|\bTREN\s+BERASAP\b", "VEHICLE_BREAKDOWN", "SEVERE", 3),
    (r"\bPINTU\s+(?:TREN\s+)?(?:ROS[AK]+|TERSEKAT|TIDAK\s+DAPAT\s+DITUTUP|GAGAL\s+DITUTUP)\b", "DOOR_FAULT", "MINOR", 3),
    (r"\bDOOR\s+(?:FAULT|PROBLEM|STUCK)\b", "DOOR_FAULT", "MINOR", 3),
    (r"\b(?:LIF|LIFT|ESKALATOR|ESCALATOR|ELEVATOR)\s+(?:ROS[AK]+|TIDAK\s+BERFUNGSI|GAGAL|MATI)\b", "ELEVATOR_FAULT", "MINOR", 3),
    (r"\b(?:LIF|LIFT|ESKALATOR|ELEVATOR)\b", "ELEVATOR_FAULT", "INFO", 1),
    (r"\b(?:SISTEM\s+)?ISYARAT\s+(?:ROS[AK]+|TERJEJAS|GAGAL|MASALAH|GANGGUAN)\b", "SIGNAL_FAULT", "MAJOR", 3),
    (r"\b(?:MASALAH|GANGGUAN|KEROSAKAN)\s+(?:SISTEM\s+)?ISYARAT\b", "SIGNAL_FAULT", "MAJOR", 3),
    (r"\bSIGNALL?ING\s+(?:PROBLEM|FAULT|ISSUE|FAILURE)\b", "SIGNAL_FAULT", "MAJOR", 3),
    (r"\bSIGNAL\s+(?:FAULT|FAILURE|PROBLEM)\b", "SIGNAL_FAULT", "MAJOR", 3),
    (r"\bLANDASAN\s+(?:ROS[AK]+|TERJEJAS|GAGAL)\b", "TRACK_FAULT", "MAJOR", 3),
    (r"\bGANGGUAN\s+SUIS\b|\bSUIS\s+(?:JEJAS|ROS[AK]+)\b", "TRACK_FAULT", "MAJOR", 3),
    (r"\bTRACK\s+(?:FAULT|PROBLEM|ISSUE)\b", "TRACK_FAULT", "MAJOR", 3),
    (r"\bPIES\b|\bSISTEM\s+PIES\b", "TRACK_FAULT", "MAJOR", 2),
    (r"\bKERJA[- ]KERJA\s+BAIK\s+PULIH\b", "TRACK_FAULT", "MINOR", 1),
    (r"\bSESAK(?:AN)?\b|\bPENUH\s+SESAK\b|\bBERTIMBUN\b", "CROWDING", "MINOR", 2),
    (r"\bPLATFORM\s+(?:PENUH|SESAK)\b|\bCROWDED\b|\bPACKED\b", "CROWDING", "MINOR", 2),
    (r"\bHUJAN\s+LEBAT\b|\bRIBUT\b|\bANGIN\s+KENCANG\b|\bCUACA\s+BURUK\b|\bHEAVY\s+RAIN\b|\bSTORM\b", "WEATHER", "MAJOR", 2),
    (r"\bKILAT\b|\bPETIR\b|\bLIGHTNING\b", "WEATHER", "MAJOR", 1),
    (r"\bBANJIR\b|\bFLOOD(?:ED|ING)?\b", "WEATHER", "MAJOR", 2),
    (r"\bJALAN\s+(?:DITUTUP|TERSEKAT|SESAK)\b|\bROAD\s+(?:CLOSED|BLOCKED)\b", "ROAD_BLOCKED", "MINOR", 2),
    (r"\bKEMALANGAN\b|\bACCIDENT\b", "ROAD_BLOCKED", "MINOR", 2),
    (r"\bGANGGUAN\s+PERKHIDMATAN\b|\bSERVICE\s+DISRUPTION\b", "DELAY", "MAJOR", 2),
    (r"\bPERKHIDMATAN\s+TERJEJAS\b|\bTERJEJAS\s+(?:JADUAL|PERKHIDMATAN)\b", "DELAY", "MAJOR", 2),
    (r"\b(?:JADUAL\s+PERJALANAN|JADUAL)\s+TERJEJAS\b", "DELAY", "MINOR", 2),
    (r"\bKELEWATAN\b|\bTERGENDALA\b|\bDELAY(?:ED|S)?\b|\bLAMBAT\b", "DELAY", "MINOR", 2),
    (r"\bPERKHIDMATAN\s+DIPENDEKKAN\b|\bSHORT(?:ENED)?\s+SERVICE\b|\bSHUTTLE\s+TRAIN\b", "DELAY", "MINOR", 2),
    (r"\bTREN\s+TIDAK\s+BERHENTI\b|\bSKIP\s+STOP\b", "DELAY", "MINOR", 2),
    (r"\bFREKUENSI\s+(?:JARANG|BERKURANGAN)\b|\bHEADWAY\s+(?:LONGER|INCREASED)\b", "DELAY", "MINOR", 2),
    (r"\b(?:MASALAH|GANGGUAN)\s+TEKNIKAL\b|\bTECHNICAL\s+(?:PROBLEM|ISSUE|FAULT)\b", "UNKNOWN", "MINOR", 1),
    (r"\bGANGGUAN\b|\bDISRUPTION\b|\bTERJEJAS\b", "UNKNOWN", "MINOR", 1),
)
SEVERITIES = (
    (r"\bBERHENTI\s+SEPENUHNYA\b|\bTIDAK\s+BEROPERASI\b|\bPERKHIDMATAN\s+DIHENTIKAN\b|\bSUSPEND(?:ED)?\b|\bTUTUP\s+SEPENUHNYA\b", "SEVERE", 3),
    (r"\bSEMUA\s+STESEN\b|\bSELURUH\s+LALUAN\b|\bSEPANJANG\s+LALUAN\b|\bWHOLE\s+LINE\b", "SEVERE", 3),
    (r"\bSANGAT\s+TERUK\b|\bTERUK\b|\bSEVERE\b|\bMAJOR\b|\bKRITIKAL\b|\bCRITICAL\b", "MAJOR", 2),
    (r"\bSEKURANG[- ]KURANGNYA\s+(\d+)\s*(?:MINIT|MINUTES?|JAM|HOURS?)\b", "MAJOR", 2),
    (r"\bLEBIH\s+(?:SATU\s+)?JAM\b|\bMORE\s+THAN\s+AN?\s+HOUR\b", "MAJOR", 2),
    (r"\bSEDIKIT\b|\bRINGAN\b|\bMINOR\b|\bSEBENTAR\b|\bBRIEF(?:LY)?\b|\bSLIGHT\b", "MINOR", 2),
    (r"\bMAKLUMAN\b|\bNOTIS\b|\bPENGUMUMAN\b|\bHEADS?\s+UP\b|\bADVISORY\b", "INFO", 1),
)
LEVELS = ("INFO", "MINOR", "MAJOR", "SEVERE")
RECOVERY = r"\bKEMBALI\s+BEROPERASI\b|\bBEROPERASI\s+SEPERTI\s+BIASA\b|\bDIPULIHKAN\b|\bPULIH\s+SEMULA\b|\bSELESAI\b|\bNORMAL\s+SEMULA\b|\bSERVICE\s+(?:HAS\s+BEEN\s+)?RESUMED\b|\bBACK\s+TO\s+NORMAL\b|\bCLEARED\b"
ONGOING = r"\bMASIH\b|\bSEHINGGA\s+SEKARANG\b|\bBELUM\s+PULIH\b|\bBERTERUSAN\b|\bBERPANJANGAN\b|\bSTILL\b|\bUNTIL\s+NOW\b|\bONGOING\b|\bSEDANG\s+(?:BERLAKU|TERJEJAS|TERKANDAS)\b|\bKEMAS\s+KINI\b|\bSTATUS\s+TERKINI\b"
NOW = r"\bSEKARANG\b|\bKINI\b|\bBARU\s+SAHAJA\b|\bJUST\s+NOW\b|\bTADI\b|\bSEDANG\b|\bTENGAH\b"
PAST = (
    (r"\bSEMALAM\b|\bYESTERDAY\b", 1), (r"\bKELMARIN\b|\bTHE\s+DAY\s+BEFORE\b", 2), (r"\bMINGGU\s+LEPAS\b|\bLAST\s+WEEK\b", 7),
    (r"\bBULAN\s+LEPAS\b|\bLAST\s+MONTH\b", 30), (r"\bTAHUN\s+LEPAS\b|\bLAST\s+YEAR\b", 365),
    (r"\bDAHULU\b|\bZAMAN\s+DULU\b|\bMASA\s+TU\b|\bHARI\s+ITU\b|\bTHROWBACK\b|\bTBT\b", 30), (r"\bINGAT\s+(?:TAK|LAGI)\b|\bKENANGAN\b|\bARWAH\b", 30),
)
PAST_YEAR, YEAR_DAYS = r"\b20(?:1[5-9]|2[0-4])\b", 365
SARCASM = (
    (r"/S\b", 1.0), (r"\b(?:HAHA|HAHAHA|HEHE|LOL|LMAO|ROFL)\b", 0.6), (r"[\x{1F600}-\x{1F60A}\x{1F642}\x{1F643}\x{1F923}]", 0.5), (r"\bSARKASTIK\b|\bSARCASM\b|\bSARKAS\b", 1.0),
    (r"\bKONON(?:NYA)?\b|\bKATANYA\b|\bALLEGEDLY\b", 0.8), (r"\b(?:BAGUS|TERBAIK|HEBAT|MENAKJUBKAN|EFEKTIF|CEKAP)\s*(?:LA|LAH|SANGAT|NYA|BETUL)?\b", 0.7),
    (r"\bTAHNIAH\b|\bSYABAS\b|\bCONGRATULATIONS\b", 0.7), (r"\bWOW\b|\bAMAZING\b|\bSPECTACULAR\b", 0.5), (r"\bMEMANG\s+(?:BAGUS|HEBAT|CEKAP|EFISIEN)\b", 0.8),
    (r"\bPENCAPAIAN\b|\bREKOD\s+BARU\b|\bWORLD\s+CLASS\b", 0.6), (r"\bALHAMDULILLAH\b", 0.4), (r"\b(?:ALAH|CIS|SIGH)\b", 0.3),
)
JOKE = (
    (r"\bPRANK\b|\bJOKE\b|\bMEME\b|\bLAWAK\b|\bJENAKA\b|\bKELAKAR\b", 1.0), (r"\bKAHWIN\b|\bHAPPY\s+BIRTHDAY\b|\bSELAMAT\s+HARI\s+JADI\b", 0.9),
    (r"\bJALAN\s+KAKI\b|\bBASIKAL\b|\bBERENANG\b|\bSWIMMING\b|\bPENGUIN\b|\bKAPAL\b|\bPERAHU\b", 0.8), (r"\bPOKEMON\b|\bGAME\b|\bGIVEAWAY\b|\bLOTERI\b", 0.7),
    (r"\bMAKAN\s+ANGIN\b|\bTIDUR\s+DI\s+STESEN\b|\bBERKHEMAH\b|\bCAMPING\b", 0.7), (r"[\x{1F602}\x{1F923}]{2,}", 0.8),
)
STALE = (
    (r"\bTHROWBACK\b|\bTBT\b|\bFLASHBACK\b", 1.0), (r"\bINGAT\s+(?:TAK|LAGI)\b|\bREMEMBER\s+WHEN\b", 0.9), (r"\bSEMALAM\b|\bKELMARIN\b|\bYESTERDAY\b", 0.7),
    (r"\bMINGGU\s+LEPAS\b|\bBULAN\s+LEPAS\b|\bTAHUN\s+LEPAS\b|\bLAST\s+(?:WEEK|MONTH|YEAR)\b", 0.9), (r"\bZAMAN\s+DULU\b|\bMASA\s+TU\b|\bHARI\s+ITU\b|\bDAHULU\b|\bDULU\b", 0.8),
    (r"\bKENANGAN\b|\bARWAH\b|\bR\.I\.P\b|\bALMARHUM\b", 0.9), (r"\b(?:19|20)\d{2}\b", 0.9), (r"\bSCREENSHOT\b|\bGAMBAR\s+LAMA\b|\bOLD\s+PHOTO\b", 0.6),
)
REPOST = (
    (r"^\s*RT\s*@", 1.0), (r"\bRT\s*@[A-Z0-9_]+", 1.0), (r"\bREPOST(?:ED|ING)?\b|\bRE-?POST\b", 1.0), (r"\bVIA\s*@[A-Z0-9_]+|\bCREDIT\s*(?:TO)?\s*:?|\bSUMBER\s*:", 0.8),
    (r"\bFORWARD(?:ED)?\b|\bFWD\b|\bCOPIED\b|\bCOPYPASTA\b|\bSHARE\s+THIS\b", 0.9), (r"\bAMBIL\s+DARI\b|\bSCREENSHOT\s+DARI\b", 0.8),
)
STALE_FACTORS, SARCASM_FACTORS, JOKE_FACTORS, QUALITY_FLOOR = (0.05, 0.9), (0.08, 0.85), (0.1, 0.8), 0.02  # (at 0.5 and over, slope below)
# Words that end a place name, most words of one, words before lines and stations, modes of transport.
PLACE_STOPWORDS = """DAN AND KE DI YANG BERHENTI TERJEJAS ROS ROSAK GANGGUAN SEKARANG KINI MASIH TIDAK TIADA ADA SEKAT SINI ITU INI PADA AKAN SUDAH DAH TELAH SEHINGGA SANGAT PULA LAH UNTUK
DARI SEBAB SEJAK PUKUL JAM MINIT MINUTES HOURS LAMA KIRA SILA GUNA LALUAN STESEN SEBELAH ARAH HINGGA SAMPAI SELEPAS KERANA SEMENTARA BAGI SAHAJA LAGI BELUM BUKAN IKUT NAIK ANTARA BETWEEN
MELALUI SERTA JUGA SEDANG DILAPORKAN STATION HENTIAN STOP PENUH SESAK RAMAI ORANG BERAT TERUK DAPAT BERGERAK MENUNGGU TUNGGU KENA TURUN MASUK KELUAR PAGI TENGAHARI PETANG MALAM HARI SEMUA
SETIAP MENGENAI AKIBAT""".split()
PLACE_TOKENS = 4
LINE_WORDS, STATION_WORDS = ("LALUAN", "LINE", "ALIRAN", "ROUTE"), ("STESEN", "STATION", "HENTIAN", "STOP")
MODES = ("LRT", "MRT", "MONOREL", "MONORAIL", "BRT", "KTM", "BAS", "TREN")
KINDS = tuple(dict.fromkeys(issue for _, issue, _, _ in ISSUES))  # in order of specificity


def upper(x: Column) -> Column:
    """Upper case without diacritics."""
    return F.upper(text.unmarked(x))


def folded(x: Column) -> Column:
    """Upper-case letters, digits, quotes, dashes and sentence ends; all else is one space."""
    x = F.regexp_replace(upper(x), "[‘’]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Z0-9'\- .!?;]+", " "), r"\s+", " "))


def hits(t: Column) -> Column:
    """Array of (issue or null, severity level, weight): the rules that match folded text, each pattern run once."""
    rules = [(r, i, s, w) for r, i, s, w in ISSUES] + [(r, None, s, w) for r, s, w in SEVERITIES]
    row = lambda i, s, w: F.struct(F.lit(i).cast("string").alias("issue"), F.lit(LEVELS.index(s)).alias("level"), F.lit(w).alias("weight"))
    return F.array_compact(F.array(*(F.when(text.matches(t, r), row(i, s, w)) for r, i, s, w in rules)))


def _weight(hit: Column, keep) -> Column:
    return F.aggregate(F.filter(hit, keep), F.lit(0), lambda a, h: a + h["weight"])


def issue(hit: Column) -> Column:
    """struct(weight, o, name): the heaviest issue, ties to the more specific; weight 0 where nothing matches."""
    held = lambda kind: _weight(hit, lambda h: h["issue"] == kind)
    votes = [F.struct(held(kind).alias("weight"), F.lit(-i).alias("o"), F.lit(kind).alias("name")) for i, kind in enumerate(KINDS)]
    return F.array_max(F.array(*votes))


def issue_name(vote: Column) -> Column:
    return F.when(vote["weight"] > 0, vote["name"]).otherwise("UNKNOWN")


def issue_confidence(vote: Column, hit: Column) -> Column:
    """The winner's share of all issue weight; nothing for UNKNOWN."""
    total = _weight(hit, lambda h: h["issue"].isNotNull())
    return F.when((vote["weight"] == 0) | (vote["name"] == "UNKNOWN"), 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(vote["weight"], total)))


def severity(hit: Column) -> Column:
    """struct(level, weight): the highest level that a rule names, with that level's heaviest rule; null where nothing matches."""
    return F.array_max(F.transform(hit, lambda h: F.struct(h["level"].alias("level"), h["weight"].alias("weight"))))


def severity_name(worst: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(worst["level"], F.lit(0)) + 1)


def severity_confidence(worst: Column) -> Column:
    return F.when(worst.isNull(), 0.0).otherwise(0.5 + F.least(F.lit(0.4), worst["weight"] / 10))


def days_ago(t: Column) -> Column:
    """Days that the text says have passed: by phrase, then by a bare past year, then 0 for now; else null."""
    return F.coalesce(*(F.when(text.matches(t, r), F.lit(n)) for r, n in PAST), F.when(text.matches(t, PAST_YEAR), F.lit(YEAR_DAYS)), F.when(text.matches(t, NOW), F.lit(0)))


def recovered(t: Column) -> Column:
    return text.matches(t, RECOVERY)


def ongoing(t: Column, past: Column, over: Column) -> Column:
    """Said to go on, or said of now without a past or an end."""
    return text.matches(t, ONGOING) | (text.matches(t, NOW) & ~past & ~over)


def marked(t: Column, markers) -> Column:
    """Sum of the weights of the markers found, a third each, at most 1."""
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, (F.when(text.matches(t, r), F.lit(w)).otherwise(0.0) for r, w in markers)) / 3)


def stale(t: Column, live: Column, days: Column) -> Column:
    """Staleness of a quote: a live report with a past reference counts 0.3 at most; a dead one by its age."""
    s = marked(t, STALE)
    past = F.coalesce(days >= 1, F.lit(False))
    return F.when(live, F.least(s, F.lit(0.3))).when(past, F.greatest(s, F.lit(0.7), F.least(F.lit(1.0), 0.5 + days / 60))).otherwise(s)


def quality(old: Column, mock: Column, joke: Column) -> Column:
    """Product of the three discounts, never under the floor."""
    one = lambda s, f: F.when(s >= 0.5, F.lit(f[0])).otherwise(1 - f[1] * s)
    return F.greatest(F.lit(QUALITY_FLOOR), one(old, STALE_FACTORS) * one(mock, SARCASM_FACTORS) * one(joke, JOKE_FACTORS))


def place(x: Column) -> Column:
    """Leading tokens up to a stopword (leading stopwords are skipped), four at most."""
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    stop = F.array(*map(F.lit, PLACE_STOPWORDS))
    begin = F.aggregate(words, F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept")), lambda a, w: F.when(
        a["done"] | (F.size(a["kept"]) >= PLACE_TOKENS), a).when(F.array_contains(stop, w), F.struct((F.size(a["kept"]) > 0).alias("done"), a["kept"].alias("kept"))).otherwise(
        F.struct(F.lit(False).alias("done"), F.concat(a["kept"], F.array(w)).alias("kept"))))
    return F.array_join(begin["kept"], " ")


def between(t: Column) -> Column:
    """array(left, right) of 'between X and Y' in folded text; null where there is no clean pair."""
    said = F.split(F.regexp_extract(t, r"\b(?:ANTARA|BETWEEN)\s+(.+)$", 1), "[.!?;]")[0]
    parts = F.split(said, r"\s+(?:DAN|AND|HINGGA|TO)\s+")
    left, right = place(parts[0]), place(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) >= 2) & (left != "") & (right != ""), F.array(left, right))


def after(t: Column, words) -> Column:
    """Places named after one of the keywords."""
    found = F.regexp_extract_all(t, F.lit(rf"\b(?:{'|'.join(words)})\s+([A-Z0-9][A-Z0-9'\- ]{{2,60}})"), F.lit(1))
    return F.filter(F.transform(found, place), lambda p: p != "")
