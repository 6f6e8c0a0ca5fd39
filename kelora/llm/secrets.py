"""Secret scans: candidates by pattern, then a random forest that removes false positives.

Candidates are values assigned to a keyword, private key blocks, quoted strings and long mixed tokens of a whole text,
found in time linear in its length. The forest sees candidate length, character transitions, entropy, dictionary
coverage, path shape and neighbouring words. The dictionary is the
DICTIONARY most frequent words of all documents, counted by Spark. The forest is trained on labelled findings: a bounded sample of the corpus' own candidates labelled by strict rules (provider formats and keyworded keys
are secrets; paths, addresses, counters, plain words and placeholders are not), and variants of them with a keyword
removed, the quotes dropped or the value replaced by ordinary words, so no single feature decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import TRAIN_ROWS, bounded, stored

# fixed patterns and word lists
TOKEN = re.compile(r"[A-Za-z0-9+/_\-.@:=]{12,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: A value after a keyword (and up to 64 more characters of its name) and '=' or ':': quoted with any characters, or
#: unquoted up to white space.
KEYED = re.compile(r"""(?x)
    (?:(?i:token|secret|password|passwd|pwd|api_?key|credential|access_key)|(?<![A-Za-z])(?i:key|auth|private))s?(?![a-z])[\w.\-]{0,64}+["']?+[ \t]*+[=:]+[ \t]*+
    (?: "((?:[^"\\\n]|\\.)++)" | '((?:[^'\\\n]|\\.)++)' | ([^\s"']\S*+) )""")
#: A private key block up to its END line; only the header where that is missing.
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----)?")
ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*[=:]+(?!/)(?=[^=:])")
PROVIDER = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*|-----BEGIN[ A-Z]*PRIVATE KEY-----)$")
QUOTES, DIGITS, LETTERS = ("'", '"'), "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYWORDS = "token secret password passwd pwd apikey api_key key credential credentials auth access_key private".split()
HARMLESS = "example sample placeholder dummy checksum sha1 sha256 md5 commit revision digest hash uuid id version mail http https www".split()
EMAIL = re.compile(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
WORDY = re.compile(r"[A-Za-z]{3,}")
EXTENSION = re.compile(r"\.[A-Za-z]{1,4}[0-9]?$")

N_FEATURES = 21
#: Words of the dictionary; this bounds what the driver collects and the executors receive.
DICTIONARY = 20_000
WORD_LENGTHS = (4, 20)
#: Distinct words a task counts before it hands them to Spark.
COUNTED_WORDS = 200_000
TREES, DEPTH, LEAST = 40, 7, 4
#: Most documents that are searched for training findings.
TRAIN_DOCS = 100_000
REDACTED = "[SECRET]"


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """At most ``size`` words (lower-case, letters only, found twice or more) of all texts, the most frequent ones.

    Frequencies are cut between logarithmic steps, whose number is bounded, so tied words stay or go together and the
    driver receives the steps and the chosen words only. Empty for no texts.
    """
    least, most = WORD_LENGTHS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            words: Counter = Counter()
            for token, n in seen.items():
                word = token.strip(".,;:!?()[]\"'")
                if word.isalpha() and least <= len(word) <= most:
                    words[word.lower()] += n
            seen.clear()
            return pd.DataFrame({"word": np.array(list(words), object), "n": np.array(list(words.values()), np.int64)}).astype({"word": object})

        for b in batches:
            for text in b["text"]:
                seen.update((text or "").split())
                if len(seen) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted.where("n > 1").withColumn("step", F.floor(F.log("n") * 64)), "words")
    total, cut = 0, None
    for r in sorted(counted.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):  # under 3,000 rows
        total += r.words
        if total > size:
            break
        cut = r.step
    return frozenset(r.word for r in counted.where(F.col("step") >= cut).select("word").collect()) if cut is not None else frozenset()


def coverage(value: str, words: frozenset[str]) -> float:
    """The share of ``value``'s characters inside dictionary words, longest first from the left of each run of letters."""
    covered = 0
    for run in WORDY.findall(value.lower()):
        at = 0
        while at + WORD_LENGTHS[0] <= len(run):
            n = next((k for k in range(min(WORD_LENGTHS[1], len(run) - at), WORD_LENGTHS[0] - 1, -1) if run[at : at + k] in words), 0)
            covered, at = covered + n, at + (n or 1)
    return covered / max(1, len(value))


def shape(value: str, before: str, after: str, known: frozenset[str] = frozenset()) -> list[float]:
    """The features of one candidate and the text around it (40 characters on either side); ``known`` is the dictionary."""
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    n = len(value)
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    hexes = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    words = WORDY.findall(value)
    near = nearby(before)
    vowels = sum(c in "aeiouAEIOU" for c in value) / n
    return [
        float(n), entropy, sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), kinds.count(0) / n, kinds.count(2) / n, kinds.count(3) / n, hexes,
        sum(map(len, words)) / n, float(max(map(len, words), default=0)), vowels, len(counts) / n,
        float("@" in value), float(value.count(".") + value.count("/")), *path_shape(value, before), float(any(w in KEYWORDS for w in near)), float(any(w in HARMLESS for w in near)),
        float(before.rstrip()[-1:] in ("=", ":") or before.rstrip().rstrip("\"'").rstrip()[-1:] in ("=", ":")), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        coverage(value, known),
    ]


def path_shape(value: str, before: str) -> list[float]:
    """How a value looks as a path: the share of its parts between separators that are words, a file's extension, a
    root, drive, scheme or longer path before it."""
    parts = [p for p in re.split(r"[/\\.]", value) if p]
    words = sum(p.isalpha() or p.replace("_", "").replace("-", "").isalpha() for p in parts)
    rooted = value.startswith(("/", "./", "../", "~/")) or "://" in value or before[-1:] in ("/", "\\", "~")
    return [words / len(parts) if len(parts) > 1 else 0.0, float(bool(EXTENSION.search(value))), float(rooted)]


def candidates(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(start, value, before, after) of each candidate of a whole text, in code points."""
    text = text or ""
    spans = [m.span() for m in PEM.finditer(text)]
    blocks = len(spans)
    for m in KEYED.finditer(text):
        a, z = m.span(m.lastindex)
        if m.lastindex == 3:  # unquoted: a sentence's punctuation is not the value's
            z = a + len(text[a:z].rstrip(".,;"))
        if z > a and not any(a < end and start < z for start, end in spans[:blocks]):
            spans.append((a, z))
    spans.sort()
    at, found = 0, []
    for m in TOKEN.finditer(text):
        value, a = m.group(), m.start()
        quoted = len(value) >= 16 and text[a - 1 : a] in QUOTES and text[m.end() : m.end() + 1] in QUOTES and value.isalpha()
        if not quoted and not (DIGIT.search(value) and LETTER.search(value)):
            continue
        skip = _assigned(value)
        value, a = value[skip:], a + skip
        if not PROVIDER.match(value):
            value = value.rstrip(".:=-")
        z = a + len(value)
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if len(value) >= 12 and not (at < len(spans) and spans[at][0] < z):
            found.append((a, z))
    for a, z in sorted(spans + found):
        yield a, text[a:z], text[max(0, a - 40) : a], text[z : z + 40]


def _assigned(value: str) -> int:
    """Where the value of ``name=value`` begins: after all names that leave 12 characters with a digit and a letter."""
    size = len(value.rstrip(".:=-"))
    last = min((max(map(value.rfind, kind)) for kind in (DIGITS, LETTERS)), default=-1)
    at = 0
    while (cut := ASSIGNED.match(value, at)) and size - cut.end() >= 12 and last >= cut.end():
        at = cut.end()
    return at


def nearby(before: str) -> list[str]:
    """The last three words before a value and the parts of compound ones."""
    words = re.findall(r"\w+", before.lower())[-3:]
    return words + [part for w in words if "_" in w for part in w.split("_")]


def sure(value: str) -> bool:
    """A provider's format or a private key block."""
    return bool(PROVIDER.match(value) or PEM.fullmatch(value))


def strict_label(value: str, before: str, after: str) -> int | None:
    """1 or 0 where a rule is sure, None where it is not; these are the labelled findings."""
    near = nearby(before)
    if sure(value):
        return 1
    if EMAIL.match(value) or re.match(r"^[\d.:/\-]+$", value) or any(w in HARMLESS for w in near) or "/" in value[:8]:
        return 0
    keyed = any(w in KEYWORDS for w in near) and before.rstrip().rstrip("\"'").rstrip()[-1:] in ("=", ":")
    if keyed and len(value) >= 20 and len(set(value)) >= 10 and sum(map(str.isdigit, value)) >= 3:
        return 1
    if sum(map(len, WORDY.findall(value))) > 0.75 * len(value) and not (keyed and len(value) >= 12):
        return 0
    return None


def number_of(rng: np.random.Generator, digits: int) -> str:
    return "".join(map(str, rng.integers(0, 10, digits)))


def labelled(value: str, before: str, after: str, seed: int, known: frozenset[str] = frozenset()) -> list[tuple[list[float], int]]:
    """Training findings of one candidate: itself and variants whose label is known."""
    form = lambda *of: shape(*of, known)
    label = strict_label(value, before, after)
    if label is None:
        return []
    out = [(form(value, before, after), label)]
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    if label:
        words = re.findall(r"[^\W\d_]{3,}", before + " " + after) or ["plain", "words"]
        plain = "_".join(rng.permutation(words)[:4].tolist())
        out.append((form(plain[:60], before, after), 0))  # an assigned value of ordinary words: a placeholder
        mail = f"{words[0]}{int(rng.integers(100))}@{words[-1]}.example.com"
        out.append((form(mail, " ".join(words[:3]) + " ", " "), 0))
        for cut in (16, 24, 32):
            if len(value) > cut:
                out.append((form(value[:cut], before, after), 1))
        upper = value.upper() if rng.integers(2) else value
        out.append((form(upper, before.upper() if rng.integers(2) else before, after), 1))
        # short and symbol-rich passwords, keys of letters only; words and numbers in the same places
        symbols = "".join(c + ("!@#$%^&*"[int(rng.integers(8))] if rng.integers(3) == 0 else "") for c in value[:14]) + "#"
        letters = "".join(chr(97 + int(k)) for k in rng.integers(0, 26, 20))
        key = ("password", "token", "secret", "passwd")[int(rng.integers(4))]
        for secret, quote in ((value[:10], ""), (words[0][:6].lower() + number_of(rng, 1) + value[:3], ""), (symbols, '"'), (symbols, ""), (letters, "")):
            gap = (" = ", "=", ": ")[int(rng.integers(3))]
            out.append((form(secret, words[-1] + " " + key + gap + quote, quote + " and"), 1))
        for plain in (words[0].lower(), words[-1].lower(), number_of(rng, 2)):
            out.append((form(plain, words[-1] + " " + key + ": ", " and"), 0))
        number = "".join(map(str, rng.integers(0, 10, 16)))
        out.append((form(number[:14] + "a", "the ", " "), 0))
    return out


class Forest:
    """A random forest of axis-parallel trees as flat arrays, grown by Gini impurity on random features."""

    def __init__(self, feature, cut, left, right, value, known: frozenset[str] = frozenset()):
        self.feature, self.cut, self.left, self.right, self.value, self.known = feature, cut, left, right, value, known

    @classmethod
    def grown(cls, x: np.ndarray, y: np.ndarray, known: frozenset[str] = frozenset(), seed: int = 5) -> "Forest":
        rng = np.random.default_rng(seed)
        trees = [cls._tree(x, y, rng.integers(0, len(x), len(x)), rng) for _ in range(TREES)]
        size = max(len(t) for t in trees)
        out = [np.zeros((TREES, size), kind) for kind in (np.int32, float, np.int32, np.int32, float)]
        for i, tree in enumerate(trees):
            for j, node in enumerate(tree):
                for k, v in enumerate(node):
                    out[k][i, j] = v
        return cls(*out, known)

    @staticmethod
    def _tree(x, y, rows, rng) -> list[list]:
        nodes: list[list] = []

        def grow(rows, depth) -> int:
            here = len(nodes)
            mean = float(y[rows].mean())
            nodes.append([0, math.inf, here, here, mean])
            if depth == 0 or len(rows) < 2 * LEAST or mean in (0.0, 1.0):
                return here
            best = (mean * (1 - mean) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], 5, replace=False):
                v = x[rows, f]
                for c in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 13))):
                    side = v <= c
                    k = int(side.sum())
                    if LEAST <= k <= len(rows) - LEAST:
                        a, b = y[rows[side]].mean(), y[rows[~side]].mean()
                        g = (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
                        if g < best[0]:
                            best = (g, int(f), float(c))
            if best[1] is not None:
                side = x[rows, best[1]] <= best[2]
                nodes[here][:2] = best[1], best[2]
                nodes[here][2] = grow(rows[side], depth - 1)
                nodes[here][3] = grow(rows[~side], depth - 1)
            return here

        grow(rows, DEPTH)
        return nodes

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves each row of ``x`` reaches."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for t in range(len(self.value)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[row, self.feature[t, at]] <= self.cut[t, at], self.left[t, at], self.right[t, at])
            total += self.value[t, at]
        return total / max(1, len(self.value))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, labels: DataFrame | None = None) -> Forest | None:
    """A forest from at most ``rows`` labelled findings; None where there are none of one of the classes.

    ``labels`` (value, before, after, label) are a user's labelled findings. Without them findings of about TRAIN_DOCS
    documents are labelled by strict rules, with variants of known label beside each.
    """
    known = dictionary(docs)

    def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                for start, value, before, after in candidates(text):
                    seed = hash_of(value)
                    out += [(x, y, seed) for x, y in labelled(value, before, after, seed, known)]
            yield pd.DataFrame(out, columns=["x", "y", "seed"])

    def given(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(shape(v, p or "", q or "", known), int(y), hash_of(v)) for v, p, q, y in zip(b["value"], b["before"], b["after"], b["label"]) if v]
            yield pd.DataFrame(out, columns=["x", "y", "seed"])

    kind = "x array<double>, y int, seed long"
    if labels is None:
        found = bounded(docs, TRAIN_DOCS, "doc_id").select("text").mapInPandas(variants, kind)
    else:
        found = bounded(labels.where("label is not null"), 2 * rows, "value").select("value", "before", "after", "label").mapInPandas(given, kind)
    got = found.distinct().orderBy(F.xxhash64("seed", "y"), "x").limit(rows).toPandas()
    if not len(got) or got["y"].nunique() < 2:
        return None
    return Forest.grown(np.vstack(got["x"]), got["y"].to_numpy(float), known)


def hash_of(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode(), 3) >> 1


def probabilities(found: list[tuple[int, str, str, str]], forest: Forest | None) -> np.ndarray:
    """The chance that each candidate is a secret; without a forest the strict rules decide (unsure: no)."""
    if not found:
        return np.zeros(0)
    if forest is None:
        return np.array([float(strict_label(*f[1:]) or 0) for f in found])
    certain = np.array([sure(f[1]) for f in found], float)
    return np.maximum(certain, forest(np.array([shape(*f[1:], forest.known) for f in found])))


def findings(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row per candidate of each document: doc_id, start, length, sha256 of the value, score, is_secret. Narrow.

    Null and empty texts have no candidates; repeated rows repeat their findings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            found = [(i, c) for i, t in zip(b["doc_id"], b["text"]) for c in candidates(t)]
            p = probabilities([c for _, c in found], forest)
            rows = [(i, c[0], len(c[1]), hashlib.sha256(c[1].encode()).hexdigest(), float(q), bool(q >= 0.5)) for (i, c), q in zip(found, p)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "value_sha256", "score", "is_secret"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, length long, value_sha256 string, score double, is_secret boolean")


def redacted(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by REDACTED and n_chars (where present) counted anew. Narrow.

    Null and empty texts stay; repeated rows stay repeated; other columns pass through. An empty table stays empty.
    """
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, c) for i, t in enumerate(b["text"]) for c in candidates(t)]
            p = probabilities([c for _, c in found], forest)
            spans: dict[int, list] = {}
            for (i, c), q in zip(found, p):
                if q >= 0.5:
                    spans.setdefault(i, []).append((c[0], len(c[1])))
            texts = b["text"].tolist()
            for i, own in spans.items():
                for a, n in reversed(own):
                    texts[i] = texts[i][:a] + REDACTED + texts[i][a + n :]
            out = b.assign(text=texts)
            if "n_chars" in names:
                changed = sorted(spans)
                column = out["n_chars"].tolist()
                for i in changed:
                    column[i] = len(texts[i])
                out["n_chars"] = pd.array([None if pd.isna(v) else int(v) for v in column], dtype="Int64")
            yield out[names]

    return docs.mapInPandas(run, docs.schema)


def op3(docs: DataFrame) -> DataFrame:
    """Findings of every row of ``docs`` by a forest that is fitted on it. Null and empty texts have none; a value found
    twice is two findings, in the order of their places, and repeated rows report theirs each; no rows give no rows."""
    return findings(docs, fit(docs))
