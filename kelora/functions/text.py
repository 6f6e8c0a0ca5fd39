"""Text and time expressions: keys, normalisation, language votes, hashes, clock times."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed stopwords for the language vote
STOPWORDS = {"en": "the and of to is that with for", "fr": "le la de et les une des que", "de": "der die und das ist zu nicht mit", "es": "el la de que los por con una"}


def let(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def required(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of a pattern holds at least one; none where the pattern does not show any."""

    def of(items) -> tuple[str, ...]:
        found, run = [], ""
        for kind, arg in [*items, (None, None)]:
            if kind is re._constants.LITERAL:
                run += chr(arg)
                continue
            found, run = found + [(run,)] * bool(run), ""
            if kind is re._constants.SUBPATTERN and not arg[1]:
                found.append(of(arg[3]))
            elif kind is re._constants.BRANCH:
                each = [of(x) for x in arg[1]]
                found.append(tuple(w for x in each for w in x) if all(each) else ())
            elif kind in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=())

    try:
        tree = re._parser.parse(pattern)
    except re.error:  # a form that only Java knows
        return ()
    return of(tree) if not tree.state.flags & re.IGNORECASE else ()


def matches(x: Column, pattern: str) -> Column:
    """``x.rlike(pattern)``; a search for the literals that a match needs goes first, since most patterns match few texts."""
    words = required(pattern)
    return reduce(lambda a, b: a | b, (x.contains(w) for w in words)) & x.rlike(pattern) if words else x.rlike(pattern)


def group_key(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def normalised(x: Column) -> Column:
    """Without repost prefix, leading mentions and links; spaces squeezed."""
    x = F.regexp_replace(x, r"(?i)^\s*RT\s+", "")
    x = F.regexp_replace(x, r"^(?:@\w+:?\s*)+", "")
    x = F.regexp_replace(x, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def content_hash(x: Column) -> Column:
    return F.sha2(F.lower(normalised(x)).cast("binary"), 256)


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over code points, as an unsigned long."""
    points = F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32)))


def clock_seconds(x: Column) -> Column:
    """HH:MM[:SS] to seconds of the service day; 24 hours and more are legal; malformed gives null."""
    part = lambda i: F.regexp_extract(x, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", i)
    h, m, s = part(1).try_cast("int"), part(2).try_cast("int"), F.when(part(3) == "", 0).otherwise(part(3).try_cast("int"))
    return F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s)


def clock_text(seconds: Column) -> Column:
    s = F.pmod(seconds, F.lit(86400))
    return F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"))


def whole_minutes(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000))


def language(text: Column) -> Column:
    """The language whose stopwords occur most often; ties go to the first in the table; no hit gives null."""
    held = lambda ws, s: F.size(F.filter(ws, lambda w: w.isin(*s.split())))  # noqa: E731  (a filter's own second argument would be an index)
    votes = lambda ws: F.array_max(F.array(*(F.struct(held(ws, s).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, (k, s) in enumerate(STOPWORDS.items()))))
    best = let(F.split(F.lower(text), r"[^\p{L}]+"), votes)
    return let(best, lambda v: F.when(v["n"] > 0, v["name"]))


_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", c)[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" and all(map(unicodedata.combining, unicodedata.normalize("NFKD", c)[1:]))]
_PLAIN = [unicodedata.normalize("NFKD", c)[0] for c in _MARKED]


def unmarked(x: Column) -> Column:
    """Latin letters without their diacritics; case stays."""
    return F.regexp_replace(F.translate(x, "".join(_MARKED), "".join(_PLAIN)), r"[\u0300-\u036f]", "")


def folded(x: Column) -> Column:
    """Upper case without diacritics; only letters, digits and ``'-.!?;`` are kept, spaces squeezed."""
    x = F.translate(F.upper(unmarked(x)), "\u2018\u2019", "''")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Z0-9'\- .!?;]+", " "), r"\s+", " "))


def display_name(x: Column, acronyms: list[str]) -> Column:
    """Title case word by word; acronyms are upper case and words of mixed case stay as they are."""
    parts = F.regexp_extract_all(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("([^ -]+|[ -])"), F.lit(1))

    def shown(t):
        title = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))
        return F.when(F.upper(t).isin(*acronyms), F.upper(t)).when((t != F.upper(t)) & (t != F.lower(t)), t).otherwise(title)

    return F.array_join(F.transform(parts, shown), "")


def position_hash(vehicle: Column, trip: Column, route: Column, lat: Column, lon: Column, bearing: Column, speed: Column, at: Column) -> Column:
    """SHA-256 over a vehicle position: six decimals for places, three for motion, empty for null."""
    fixed = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", c), F.lit(""))
    motion = lambda c: F.when(c.isNull(), "").otherwise(fixed(c, 3))
    parts = [vehicle, F.coalesce(trip, F.lit("")), F.coalesce(route, F.lit("")), fixed(lat, 6), fixed(lon, 6), motion(bearing), motion(speed), at.cast("string")]
    return F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256)


def lenient_seconds(x: Column) -> Column:
    """H:M[:S] to seconds without a range check; null where the text is no clock time."""
    part = lambda i: F.regexp_extract(x, r"^(\d+):(\d+)(?::(\d+))?$", i)
    s = F.when(part(3) == "", F.lit(0).cast("long")).otherwise(part(3).try_cast("long"))
    return part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + s


def hour24(hour: Column, part: Column) -> Column:
    """The hour of 24 of an hour with a Malay part of the day; without one it stays."""
    m = F.coalesce(F.regexp_replace(F.lower(part), r"\s+", " "), F.lit(""))
    before = m.isin("tengah malam", "pagi", "subuh", "malam")
    after = m.isin("tengah hari", "tengahari", "petang", "malam")
    return F.when(before & (hour == 12), 0).when(after & (hour < 12), hour + 12).otherwise(hour)


def document_date(x: Column) -> Column:
    """``D:YYYY[MM[DD[HH[MM[SS]]]]]`` at +08:00 as UTC; null where it cannot be read."""
    part = lambda i, low: F.coalesce(F.nullif(F.regexp_extract(x, r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?", i), F.lit("")), F.lit(low))
    stamp = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    return stamp.try_cast("timestamp_ntz") - F.expr("interval 8 hours")


def swaps_counted(a: str, b: str) -> int:
    """Edit distance in which a swap of two neighbours is one edit and no part is edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def typo_distance(a: Column, b: Column, budget: Column) -> Column:
    """The distance of ``swaps_counted`` where it is at most ``budget``, else null.

    A swap costs at most two plain edits, so the built-in distance rules out most pairs before Python sees them.
    """

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else swaps_counted(p, q) for p, q in zip(x, y)], dtype="Int64")

    near = F.levenshtein(a, b) <= 2 * budget
    # the branch not taken reaches the Arrow batch as nulls, which cost nothing
    d = F.pandas_udf(run, "long")(F.when(near, a), F.when(near, b))
    return F.when(d <= budget, d)


# fixed: scripts and words that tell a language
CJK, TAMIL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]", r"[\x{0b80}-\x{0bff}]"
TOKEN_GAP = r"[^A-Z\x{3400}-\x{9fff}\x{0b80}-\x{0bff}]+"
MALAY = """DAN YANG TIDAK TAK ADA DI KE DENGAN UNTUK SAYA AKU KAMI KITA SUDAH DAH BELUM MASIH INI ITU DARI PADA AKAN BILA KALAU JIKA SANGAT LAGI SEMUA ORANG TREN STESEN LALUAN PERKHIDMATAN GANGGUAN TERJEJAS
KELEWATAN SEKARANG KINI TADI SINI SANA BAGI TELAH BOLEH KENA PUN LAH JE KOT SEBAB""".split()
ENGLISH = """THE IS ARE WAS WERE AND OF TO IN ON FOR WITH THIS THAT NOT HAVE HAS HAD BEEN WILL WOULD CAN COULD AT BY FROM IT ITS AS BUT OR IF WHEN ALL PEOPLE TRAIN STATION LINE SERVICE DELAY AGAIN STILL""".split()


def detected(x: Column) -> Column:
    """struct(language, malay, english): the script decides first (zh, ta), then the words of each language; ties are Malay,
    no word is unknown. Shares are of all words of a text."""
    words = F.filter(F.split(F.regexp_replace(F.upper(x), TOKEN_GAP, " "), " "), lambda w: w != "")
    held = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    script = F.when(x.rlike(CJK), "zh").when(x.rlike(TAMIL), "ta")
    ms, en = held(MALAY), held(ENGLISH)
    share = lambda n: F.when(script.isNull() & (F.size(words) > 0), n / F.size(words)).otherwise(0.0)
    latin = F.when((ms == 0) & (en == 0), "unknown").when(ms >= en, "ms").otherwise("en")
    return F.struct(F.coalesce(script, latin).alias("language"), share(ms).alias("malay"), share(en).alias("english"))
