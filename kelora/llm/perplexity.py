"""Quality rules with n-gram perplexity.

A sub-word model: byte n-grams up to ORDER, about a word long, with modified Kneser-Ney smoothing, counted by Spark over
every whole text. Lower orders, discounts and back-off weights are joins and aggregates over the distinct n-grams. The
highest order leaves out n-grams that occur once (their mass goes to the back-off weight), so a text is not predicted by
n-grams that only itself holds. Each order is stored as a sorted hash array of its n-grams with log-probabilities and
one of its contexts with back-off weights; an n-gram that an order lacks is scored by the next lower one, down to the
uniform distribution. Per-language bands on the log-perplexity, taken from exact histograms over all documents, reject
documents above or below.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import stored

ORDER = 6
#: Entries that one scoring pass holds (12 bytes each, twice that with its index); a larger model is scored in several
#: passes, each over the places whose context ends with certain bytes.
PASS_ENTRIES = 12_000_000
#: Documents more than BAND interquartile ranges plus ROOM / sqrt(bytes) below or above their language's median are
#: rejected; short texts vary more, most of all downwards, where one common sentence is much of the text.
BAND_LOW, ROOM_LOW, BAND_HIGH, ROOM_HIGH = 2.5, 6.0, 1.5, 0.8
STEP = 0.001
SYMBOLS = "#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text (null: no words)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes.split() cuts at 20 and 09-0D only, as the word pattern does
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    return n, chars, sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words)


_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    at = np.zeros(n, np.uint64)
    for k in range(width):
        at += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _ODD[k]
    _, back, count = np.unique(at, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    if not len(twice):
        return 0
    seen = Counter(tuple(words[i : i + width]) for i in twice.tolist())  # equal hashes are compared word by word
    cover = np.zeros(len(words) + 1, np.int64)
    for i in twice.tolist():
        if seen[tuple(words[i : i + width])] > 1:
            cover[i] += 1
            cover[i + width] -= 1
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def grams(texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of all bytes of all texts, each text's number of bytes); texts begin with zero bytes as context."""
    parts = [(t or "").encode() for t in texts]
    pad = b"\0" * (order - 1)
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(pad + pad.join(parts), np.uint8)
    n = len(data) - order + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(order):
        out = out << np.uint64(8) | data[k : k + len(out)]
    own = np.ones(len(out), bool)
    ends = np.cumsum(sizes + order - 1)[:-1] - (order - 1)  # where the next text's padding begins, among predicted bytes
    for k in range(order - 1):
        own[ends[ends + k < len(out)] + k] = False
    return out[own], sizes


def _batches(text: pd.Series, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(text):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(text):
        yield start, len(text)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): how often each n-gram occurs in the corpus. Counted per task first, then summed by Spark."""

    def merge(found: list) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list = []
        for b in batches:
            for i, j in _batches(b["text"]):
                found.append(np.unique(grams(b["text"].iloc[i:j], order)[0], return_counts=True))
                if sum(len(k) for k, _ in found) > 2_000_000:
                    found = [merge(found)]
                    if len(found[0][0]) > 1_500_000:  # a task's table is bounded; Spark sums the parts
                        yield pd.DataFrame({"gram": found[0][0].view(np.int64), "n": found[0][1]})
                        found = []
        if found:
            keys, n = merge(found)
            yield pd.DataFrame({"gram": keys.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER, least: int = 2) -> DataFrame:
    """(k, kind, gram, value): the model. Kind 0 is the log-probability of an n-gram of order k, kind 1 the log of the
    back-off weight of a context of order k (the n-gram without its last byte).

    Interpolated modified Kneser-Ney: the highest order uses counts, lower ones the number of distinct left extensions;
    each order has discounts D1, D2 and D3+ from its counts of counts. N-grams of the highest order that occur less than
    ``least`` times are left out.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    lower, parts = None, []
    for k in range(1, order + 1):
        level = stored(levels[k], f"order{k}") if k < order else levels[k]
        few = {r.n: r.c for r in level.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}  # four rows
        n1, n2, n3, n4 = (float(few.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        own = least if k == order and k > 1 else 1
        discount = F.when(F.col("n") < own, F.col("n")).when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = level.withColumn("ctx", F.shiftright("gram", 8)).withColumn("d", discount.cast("double"))
        total = level.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        level = level.where(F.col("n") >= own).join(total, "ctx")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            level = level.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
            below = F.col("below")
        p = (F.col("n") - F.col("d") + F.col("mass") * below) / F.col("total")
        lower = stored(level.select("gram", p.alias("p")), f"model{k}")
        parts += [lower.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), "gram", F.log("p").alias("value"))]
        parts += [total.select(F.lit(k).alias("k"), F.lit(1).alias("kind"), F.col("ctx").alias("gram"), F.log(F.col("mass") / F.col("total")).alias("value"))]
    model = parts[0]
    for x in parts[1:]:
        model = model.unionByName(x)
    return stored(model, "model")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def by_hash(grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams and their values, sorted by hash."""
    at = np.argsort(grams * _SPREAD)
    return grams[at], values[at].astype(np.float32)


class HashArray:
    """A sorted hash array with an index of where each hash prefix begins."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = np.uint64(64 - max(1, int(2 * len(grams)).bit_length()))
        self.keys, self.values = np.append(grams, np.uint64(0)), np.append(values, np.float32(0))
        counts = np.bincount((grams * _SPREAD >> self.bits).astype(np.int64), minlength=1 << int(64 - self.bits))
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The value of each n-gram; NaN where it is not held."""
        prefix = (grams * _SPREAD >> self.bits).astype(np.int64)
        at, end = self.start[prefix], self.start[prefix + 1]
        hit = (self.keys[at] == grams) & (at < end)
        out = np.where(hit, self.values[at], np.float32(np.nan))
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at = at[left] + 1 if len(at) != len(left) else at + 1
            hit = self.keys[at] == grams[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (at + 1 < end[left])
            left, at = left[go], at[go]
        return out


def _log_probabilities(g: np.ndarray, model: dict, order: int) -> np.ndarray:
    """The log-probability of the last byte of each packed n-gram given those before it."""
    out, left = np.zeros(len(g), np.float32), np.arange(len(g))
    for k in range(order, 0, -1):
        probs, backs = model[k, 0], model[k, 1]
        got = probs(g[left] & np.uint64((1 << 8 * k) - 1))
        hit = ~np.isnan(got)
        out[left[hit]] += got[hit]
        left = left[~hit]
        if not len(left):
            break
        back = backs(g[left] >> np.uint64(8) & np.uint64((1 << 8 * (k - 1)) - 1))
        out[left] += np.nan_to_num(back, nan=0.0)  # a context never seen backs off whole
    out[left] += np.float32(-np.log(256))
    return out


def _packed(model: DataFrame, order: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(k, kind) -> n-grams and values sorted by hash. Tasks pack their rows into bytes, so the driver holds 12 bytes an entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for x, rows in b.groupby(["k", "kind"]):
                own = held.setdefault(x, ([], []))
                own[0].append(rows["gram"].to_numpy(np.int64).tobytes())
                own[1].append(rows["value"].to_numpy(np.float32).tobytes())
        if held:
            yield pd.DataFrame([(k, kind, b"".join(g), b"".join(v)) for (k, kind), (g, v) in held.items()], columns=["k", "kind", "grams", "values"])

    parts: dict = {(k, kind): [] for k in range(1, order + 1) for kind in (0, 1)}
    for r in model.mapInPandas(run, "k int, kind int, grams binary, values binary").collect():
        parts[r.k, r.kind].append((r.grams, r["values"]))
    return {x: by_hash(np.frombuffer(b"".join(g for g, _ in own), np.uint64), np.frombuffer(b"".join(v for _, v in own), np.float32)) for x, own in parts.items()}


def shares(model: DataFrame, order: int, entries: int) -> list[list[tuple[int, int]]]:
    """Passes over the model: lists of (m, ending), the last m bytes of the contexts that a pass holds.

    An ending with more than ``entries`` n-grams is split by the byte before it, down to whole contexts (which have at
    most 256 n-grams of an order), so no pass is larger than that, whatever the texts' bytes. Together all endings cover
    each context once. The driver sees 256 counts for each ending that is split, at most one for ``entries`` n-grams.
    """
    context = F.when(F.col("kind") == 1, F.col("gram")).otherwise(F.shiftright("gram", 8))
    rows, heavy, passes, room = model.select("k", context.alias("c")), [None], [], 0
    for m in range(1, order):
        if not heavy:
            break
        ending = F.col("c").bitwiseAND(F.lit((1 << 8 * m) - 1))
        own = rows.where(F.col("k") > m)
        if m > 1:
            own = own.where(F.col("c").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1)).isin(heavy))
        sizes = {int(r.v): r.n for r in own.groupBy(ending.alias("v")).agg(F.count("*").alias("n")).collect()}
        parents, heavy = heavy, []
        for v in (byte << 8 * (m - 1) | (parent or 0) for parent in parents for byte in range(256)):
            n = sizes.get(v, 0)
            if n > entries and m < order - 1:
                heavy.append(v)
                continue
            if not passes or n > room:
                passes.append([])
                room = entries
            passes[-1].append((m, v))
            room -= n
    return passes or [[]]


def _held(own: list[tuple[int, int]], order: int):
    """Filter on the model's rows that a pass needs: contexts with one of its endings, and shorter ones that end so."""
    context = F.when(F.col("kind") == 1, F.col("gram")).otherwise(F.shiftright("gram", 8))
    keep = F.col("k") == 1
    for m in sorted({m for m, _ in own}):
        values = [v for n, v in own if n == m]
        keep |= (F.col("k") > m) & context.bitwiseAND(F.lit((1 << 8 * m) - 1)).isin(values)
        for k in range(2, m + 1):
            keep |= (F.col("k") == k) & context.isin(sorted({v & (1 << 8 * (k - 1)) - 1 for v in values}))
    return keep


def log_perplexity(docs: DataFrame, model: DataFrame, order: int = ORDER, entries: int = PASS_ENTRIES) -> DataFrame:
    """``docs`` plus n_bytes and log_ppl (mean negative log-probability of a byte; null for empty texts and nulls).

    Columns of these names are replaced. A model over ``entries`` is scored in passes over the places whose context ends
    with certain bytes (``shares``), so what is broadcast is bounded by ``entries``.
    """
    spark = docs.sparkSession
    passes = shares(model, order, entries)
    docs = docs.drop("n_bytes", "log_ppl").select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(0.0).alias("log_ppl"))
    names, schema = docs.columns, docs.schema
    for k, own in enumerate(passes):
        part = model if len(passes) == 1 else model.where(_held(own, order))
        arrays = _packed(part, order)
        mine = {m: np.array(sorted(v for n, v in own if n == m), np.uint64) for m in {m for m, _ in own}} if len(passes) > 1 else None
        sent = spark.sparkContext.broadcast((arrays, mine))  # about `entries` entries

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            arrays, mine = sent.value
            tables = {x: HashArray(*own) for x, own in arrays.items()}
            for b in batches:
                for i, j in _batches(b["text"]):
                    part = b.iloc[i:j]
                    g, sizes = grams(part["text"], order)
                    sums = np.zeros(len(g) + 1)
                    if mine is None:
                        np.cumsum(_log_probabilities(g, tables, order), dtype=np.float64, out=sums[1:])
                    else:
                        hit = np.zeros(len(g), bool)
                        for m, values in mine.items():
                            hit |= np.isin(g >> np.uint64(8) & np.uint64((1 << 8 * m) - 1), values)
                        at = np.flatnonzero(hit)
                        sums[at + 1] = _log_probabilities(g[at], tables, order)
                        np.cumsum(sums, out=sums)
                    ends = np.cumsum(sizes)
                    yield part.assign(n_bytes=sizes, log_ppl=part["log_ppl"].to_numpy() - (sums[ends] - sums[ends - sizes]))[names]

        docs = docs.mapInPandas(run, schema)
        if k + 1 < len(passes):
            docs = stored(docs, "scored")
    return docs.withColumn("log_ppl", F.when(F.col("n_bytes") > 0, F.col("log_ppl") / F.col("n_bytes")))


def bands(scored: DataFrame) -> DataFrame:
    """(band_lang, mid, spread) for each language (null is one): exact quantiles of the histogram of log_ppl over all documents."""
    bins = scored.where("log_ppl is not null").groupBy("lang", F.floor(F.col("log_ppl") / STEP).cast("long").alias("bin")).count().toPandas()  # languages x about 6000 bins
    rows = []
    for lang, g in bins.groupby("lang", dropna=False):
        g = g.sort_values("bin")
        reach = g["count"].cumsum() / g["count"].sum()
        q1, q2, q3 = (float(g["bin"][reach >= q].iloc[0]) * STEP for q in (0.25, 0.5, 0.75))
        rows.append((None if pd.isna(lang) else lang, q2, max(q3 - q1, 10 * STEP)))
    return scored.sparkSession.createDataFrame(rows, "band_lang string, mid double, spread double")


def op6(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: base counts, base_failed, kept, log_ppl.

    Null and empty texts have no words, so they fail; texts of ties and repeated rows get equal values; an empty table
    gives no rows; extra columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = kneser_ney(stored(count_grams(docs), "grams"))
    scored = log_perplexity(docs, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [base_counts(t) for t in b["text"]]
            got = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], index=b.index)
            yield pd.concat([b[["doc_id", "lang", "n_bytes", "log_ppl"]], got], axis=1)

    counted = stored(scored.mapInPandas(run, "doc_id long, lang string, n_bytes long, log_ppl double, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"), "counted")
    limits = F.broadcast(bands(counted))  # one row a language, checked when its histogram was read
    root = F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    low = F.col("mid") - F.col("spread") * BAND_LOW - ROOM_LOW / root
    high = F.col("mid") + F.col("spread") * BAND_HIGH + ROOM_HIGH / root
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    inside = F.coalesce(F.col("log_ppl").between(low, high), F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl", "lang", "n_bytes",
    )
