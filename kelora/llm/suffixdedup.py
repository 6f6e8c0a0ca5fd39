"""Removal of long repeated byte strings by column-wise multi-document suffix sorting.

Windows of ``length`` bytes are the strings to compare. Each window has an anchor: the leftmost smallest hash among
the short grams that start in its first SPAN bytes. Equal windows have equal anchors at equal distances, so windows
are compared only among places with the same anchor text. For each anchor place, all windows that use it form one
context (a byte range). Spark counts contexts: one that occurs again is repeated as a whole. Contexts that share an
anchor but differ are dealt into shards and aligned at the anchor; a shard is then built column by column from the
right: each round reads one symbol of every context, updates the sorted order of the suffixes (the transform) by a
stable partition on that symbol and the common prefixes of neighbours by range minima, and marks the windows whose
common prefix with a neighbour reaches ``length``. Columns are read in order from the shard that Spark sorted through
its external shuffle files. An anchor with more than SHARD contexts is dealt again by longer common texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import bitmap, marked, stored

LENGTH, SPAN, GRAM = 400, 256, 48
#: Words of a passage that is reported, and the words of the short grams among which its anchor is chosen.
PASSAGE, WORD_GRAM = 51, 6
#: Contexts of one shard.
SHARD = 8_000
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("p", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("q", _INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                cache[name] = np.multiply.accumulate(x)
    return cache["p"][:n], cache["q"][:n]


class Rolling:
    """Hashes of parts of one array of symbols (64-bit) that depend on their symbols only."""

    def __init__(self, symbols: np.ndarray):
        power, self.back = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(29)


def anchors(symbols: np.ndarray, valid: np.ndarray, length: int, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, key hash, context hash) of the runs of valid windows that share an anchor."""
    n = len(symbols) - length + 1
    roll = Rolling(symbols)
    q = np.arange(n + span - 1)
    mask = np.uint64((1 << 21) - 1)
    v = roll(q, gram) & ~mask | q.astype(np.uint64)
    rows = -(-len(v) // span)
    v = np.concatenate([v, np.full(rows * span - len(v), ~np.uint64(0))]).reshape(rows, span)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:n], left[span - 1 : span - 1 + n]) & mask).astype(np.int64)
    s = np.flatnonzero(valid[:n])
    if not len(s):
        return (np.zeros(0, np.int64),) * 5
    p = at[s]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
    p, lo, hi = p[first], s[first], s[last]
    key = roll(p, length - span + 1)
    ctx = roll(lo, hi - lo + length) ^ ((p - lo).astype(np.uint64) << np.uint64(20) | (p - hi).astype(np.uint64)) * np.uint64(_BASE)
    return p, lo, hi, key, ctx


def _buffers(texts: list[bytes], length: int):
    """Byte arrays of about _CHUNK: several texts with a 255 between them, or part of a long one.

    Yields (data, valid window starts, [(row, start in data, start in text)]).
    """
    held, places, size = [], [], 0

    def flush():
        data = np.frombuffer(b"\xff".join(held), np.uint8)
        valid = np.zeros(len(data), bool)
        for (_, a, _), t in zip(places, held):
            valid[a : a + max(0, len(t) - length + 1)] = True
        return data, valid, places

    for row, t in enumerate(texts):
        for c in range(0, len(t) - length + 1, _CHUNK):
            part = t[c : c + _CHUNK + length - 1]
            if held and size + len(part) > _CHUNK:
                yield flush()
                held, places, size = [], [], 0
            places.append((row, size, c))
            held.append(part)
            size += len(part) + 1
    if held:
        yield flush()


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word of a whole text, that depends on the word only."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        end = at + _CHUNK
        while end < len(raw) and not _WHITE[raw[end]]:
            end += 1
        data = np.frombuffer(raw[at:end], np.uint8)
        edge = np.diff(np.concatenate([[0], (~_WHITE[data]).view(np.int8), [0]]))
        start = np.flatnonzero(edge == 1)
        out.append(Rolling(_BYTES[data])(start, np.flatnonzero(edge == -1) - start))
        at = end
    return np.concatenate(out) if len(out) > 2 else out[-1]


def _word_buffers(texts: list[bytes], most: int = 400_000):
    """(row of each word, word hashes) of whole texts, about ``most`` words at a time; short texts are hashed together."""
    held, size, rows, words, total = [], 0, [], [], 0

    def hashed():
        data = b" ".join(t for _, t in held)
        lengths = np.array([len(t) + 1 for _, t in held])
        start = np.flatnonzero(np.diff(np.concatenate([[0], (~_WHITE[np.frombuffer(data, np.uint8)]).view(np.int8)])) == 1)
        own = np.searchsorted(np.cumsum(lengths), start, "right")
        rows.append(np.array([r for r, _ in held])[own])
        words.append(word_hashes(data))

    for row, t in enumerate(texts):
        held.append((row, t))
        size += len(t)
        if size > _CHUNK:
            hashed()
            total += len(words[-1])
            held, size = [], 0
        if total > most:
            yield np.concatenate(rows), np.concatenate(words)
            rows, words, total = [], [], 0
    if held:
        hashed()
    if rows:
        yield np.concatenate(rows), np.concatenate(words)


def _word_contexts(texts: list[bytes], passage: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, key, ctx, p, lo, hi) of the distinct contexts of windows of ``passage`` words; places count words."""
    for rows, words in _word_buffers(texts):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for c in range(0, len(words) - passage + 1, _CHUNK):
            part, own = words[c : c + _CHUNK + passage - 1], rows[c : c + _CHUNK + passage - 1]
            valid = np.zeros(len(part), bool)
            valid[: len(part) - passage + 1] = own[: len(part) - passage + 1] == own[passage - 1 :]
            p, lo, hi, key, ctx = anchors(part, valid, passage, passage - WORD_GRAM + 1, WORD_GRAM)
            if len(p):
                shift = c - first[np.searchsorted(first, c + lo, "right") - 1]
                at = np.unique(ctx ^ (own[lo] + 1).astype(np.uint64) * np.uint64(_INVERSE), return_index=True)[1]
                yield tuple(x[at] for x in (own[lo], key, ctx, p + shift, lo + shift, hi + shift))


def contexts(docs: DataFrame, length: int, span: int, gram: int, passage: int) -> DataFrame:
    """(rid, key, ctx, p, lo, hi, n): the distinct contexts of each text, n the times one occurs in it (1 for words).

    Rows with n = 0 are not contexts: they are the window ranges, merged where they meet, of contexts that a text itself
    repeats. Periodic texts repeat one context thousands of times; so they cost a few rows, not one per period.
    """
    odd = np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rid = b["rid"].to_numpy()
            raws = [(t or "").encode() for t in b["text"]]
            for data, valid, places in _buffers(raws, length):
                p, lo, hi, key, ctx = anchors(_BYTES[data], valid, length, span, gram)
                if not len(p):
                    continue
                starts = np.array([a for _, a, _ in places])
                which = np.searchsorted(starts, lo, "right") - 1
                shift = np.array([c - a for _, a, c in places])[which]
                who = rid[np.array([r for r, _, _ in places])[which]]
                key &= ~odd
                _, first, back, times = np.unique(ctx ^ (which + 1).astype(np.uint64) * np.uint64(_INVERSE), return_index=True, return_inverse=True, return_counts=True)
                yield pd.DataFrame({"rid": who[first], "key": key[first].view(np.int64), "ctx": ctx[first].view(np.int64), "p": (p + shift)[first], "lo": (lo + shift)[first], "hi": (hi + shift)[first], "n": times})
                own = np.flatnonzero(times[back] > 1)
                if len(own):
                    new = np.ones(len(own), bool)
                    new[1:] = (which[own][1:] != which[own][:-1]) | (lo[own][1:] > hi[own][:-1] + 1)
                    a, z = own[new], own[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)]
                    yield pd.DataFrame({"rid": who[a], "key": 0, "ctx": 0, "p": 0, "lo": (lo + shift)[a], "hi": (hi + shift)[z], "n": 0})
            for row, key, ctx, p, lo, hi in _word_contexts(raws, passage):
                yield pd.DataFrame({"rid": rid[row], "key": (key | odd).view(np.int64), "ctx": ctx.view(np.int64), "p": p, "lo": lo, "hi": hi, "n": 1})

    return docs.select("rid", "text").mapInPandas(run, "rid long, key long, ctx long, p int, lo int, hi int, n int")


def column_wise(texts: list[np.ndarray], shift: np.ndarray, d_high: np.ndarray, d_low: np.ndarray, length: int, owner: np.ndarray | None = None) -> np.ndarray:
    """repeated[i, d]: whether context i's window that starts d symbols before its anchor equals another context's.

    Context i is ``texts[i]`` (small unsigned integers), its anchor ``shift[i]`` symbols in; its windows have d_low[i] <=
    d <= d_high[i]. Symbols are read column by column from the right; ``order`` lists contexts by the suffix that starts
    at the column, ``lcp[k]`` is the common prefix of order[k - 1] and order[k]. With ``owner``, only windows equal to one
    of another owner count.
    """
    m = len(texts)
    most, right = int(d_high.max()), int((np.array([len(t) for t in texts]) - shift).max())
    grid = np.zeros((m, most + right), np.uint32 if texts[0].dtype.itemsize > 1 else np.uint16)  # 0 stands where a context has no symbol
    for i, t in enumerate(texts):
        a = most - int(shift[i])
        grid[i, a : a + len(t)] = t
        grid[i, a : a + len(t)] += 1
    columns = np.ascontiguousarray(grid.T)
    order, lcp = np.arange(m), np.zeros(m, np.int32)
    out = np.zeros((m, most + 1), bool)
    for x in range(most + right - 1, -1, -1):
        symbol = columns[x][order]
        perm = np.argsort(symbol, kind="stable")
        sorted_symbol, before = symbol[perm], perm
        new = np.zeros(m, np.int32)
        same = np.flatnonzero((sorted_symbol[1:] == sorted_symbol[:-1]) & (sorted_symbol[1:] > 0)) + 1
        if len(same):
            a, b = before[same - 1] + 1, before[same]  # the minimum of lcp over a..b
            gap = b - a
            least = lcp[b]
            far = np.flatnonzero(gap > 0)
            if len(far):
                least = least.copy()
                table, k = lcp, 0
                level = np.frexp(gap[far] + 1)[1] - 1  # floor(log2(number of entries))
                for k in range(int(level.max()) + 1):
                    now = far[level == k]
                    least[now] = np.minimum(table[a[now]], table[b[now] - (1 << k) + 1])
                    table = np.concatenate([np.minimum(table[: -(1 << k)], table[1 << k :]), table[-(1 << k) :]]) if (1 << k) < m else table
            new[same] = np.minimum(least + 1, length)
        order, lcp = order[perm], new
        if x <= most:
            d = most - x
            same = lcp >= length
            hit = same.copy()
            hit[:-1] |= same[1:]
            if owner is not None and hit.any():  # a run of equal windows counts where it has two owners
                run = np.flatnonzero(~same)
                own = owner[order]
                mixed = np.minimum.reduceat(own, run) != np.maximum.reduceat(own, run)
                hit &= np.repeat(mixed, np.diff(np.append(run, m)))
            out[order[hit], d] = True
    d = np.arange(most + 1)
    return out & (d >= d_low[:, None]) & (d <= d_high[:, None])


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _sorted_shards(parts: DataFrame, length: int, passage: int, shard: int) -> DataFrame:
    """(rid, words, lo, hi): window starts of ``parts`` (rid, key, p, lo, hi, cnt, body) that are repeated within a key.

    A context of bytes counts wherever else it occurs, one of words where another document holds it.
    """

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        odd = (rows["key"].to_numpy() & 1).astype(bool)
        for own in (odd, ~odd):
            part = rows[own]
            if not len(part):
                continue
            words = own is odd
            p, lo, hi = (part[c].to_numpy(np.int64) for c in ("p", "lo", "hi"))
            texts, owner = [np.frombuffer(t, np.uint64 if words else np.uint8) for t in part["body"]], None
            if words:  # words become their rank in the shard; contexts that several documents hold differ from all
                ranks = np.unique(np.concatenate(texts), return_inverse=True)[1].astype(np.uint32)
                texts = np.split(ranks, np.cumsum([len(t) for t in texts])[:-1])
                many = part["cnt"].to_numpy() > 1
                owner = np.unique(np.where(many, np.arange(len(part)), part["rid"].to_numpy()) ^ np.where(many, 1 << 62, 0), return_inverse=True)[1]
            hit = column_wise(texts, p - lo, p - lo, p - hi, passage if words else length, owner)
            got = [(rid, words, a - d2, a - d1) for rid, a, row in zip(part["rid"], p.tolist(), hit) for d1, d2 in _runs(row)]
            yield pd.DataFrame(got, columns=["rid", "words", "lo", "hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for b in batches:
            start = 0
            key = b["key"].to_numpy()
            for cut in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(b)]:
                if key[start] != last and size + cut - start > shard and held:
                    yield from solve(pd.concat(held))
                    held, size = [], 0
                held.append(b.iloc[start:cut])
                size, last, start = size + cut - start, key[start], cut
        if held:
            yield from solve(pd.concat(held))

    return parts.repartition("key").sortWithinPartitions("key").mapInPandas(run, "rid long, words boolean, lo int, hi int")


def _finer(parts: DataFrame, length: int, passage: int, width: int) -> DataFrame:
    """Contexts cut into blocks of ``width`` windows, keyed by the longer text that all windows of a block share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                rows = []
                for rid, key, p, lo, hi, cnt, body in b[["rid", "key", "p", "lo", "hi", "cnt", "body"]].iloc[i : i + 256].itertuples(index=False):
                    unit, size = (8, passage) if key & 1 else (1, length)
                    for d0 in range((p - hi) // width * width, p - lo + 1, width):
                        a, z = max(lo, p - d0 - width + 1), min(hi, p - d0)  # window starts of the block
                        common = body[(p - d0 - lo) * unit : max(0, p - d0 - width + 1 - lo + size) * unit]  # empty where a block is wider than a window
                        own = body[(a - lo) * unit : (z - lo + size) * unit]
                        name = hashlib.blake2b(b"%d.%d.%d." % (unit, width, d0) + common, digest_size=8).digest()
                        ctx = hashlib.blake2b(b"%d.%d." % (p - a, p - z) + own, digest_size=8).digest()
                        name = int.from_bytes(name, "big", signed=True)
                        rows.append((rid, name | 1 if key & 1 else name & ~1, int.from_bytes(ctx, "big", signed=True), p, a, z, cnt, own))
                yield pd.DataFrame(rows, columns=["rid", "key", "ctx", "p", "lo", "hi", "cnt", "body"])

    return parts.mapInPandas(run, "rid long, key long, ctx long, p int, lo int, hi int, cnt long, body binary")


def repeated_windows(docs: DataFrame, length: int = LENGTH, span: int = SPAN, gram: int = GRAM, shard: int = SHARD, passage: int = PASSAGE) -> DataFrame:
    """(rid, words, lo, hi): ranges of window starts in each text of ``docs`` (rid, text) whose ``length`` bytes occur
    elsewhere, or, where ``words``, whose ``passage`` words occur in another document."""
    words = (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("words")
    found = stored(contexts(docs, length, span, gram, passage), "contexts")
    inside, places = found.where("n = 0").select("rid", F.lit(False).alias("words"), "lo", "hi"), found.where("n > 0")
    # written, so that both sides of the next join are plain exchanges and a hot anchor's partition can be split
    often = stored(places.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key"), "often")
    places = stored(places.join(often, "key", "left_semi"), "places")
    one = F.min(F.struct("rid", "p", "lo", "hi")).alias("one")
    kinds = stored(places.groupBy("key", "ctx").agg(F.sum("n").alias("cnt"), one), "kinds")
    whole = places.join(kinds.where("cnt > 1").select("key", "ctx"), ["key", "ctx"], "left_semi").select("rid", words, "lo", "hi")
    # written, so that both sides of the next join are plain exchanges and a hot anchor's partition can be split
    many = stored(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("cnt").alias("least")).where("kinds > 1 and least = 1").select("key", "kinds"), "many")
    asked = kinds.join(many, "key").select("one.*", "key", "ctx", "cnt", "kinds")
    wanted = stored(asked.groupBy("rid").agg(F.collect_list(F.struct("key", "ctx", "cnt", "kinds", "p", "lo", "hi")).alias("want")), "wanted")
    some = marked(docs, stored(bitmap(wanted, "rid"), "bits"), "rid").where("maybe")  # texts without such contexts are not shuffled

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rid, text, want in zip(b["rid"], b["text"], b["want"]):
                raw = text.encode()
                hashes = word_hashes(raw) if any(w["key"] & 1 for w in want) else None
                body = lambda w: hashes[w["lo"] : w["hi"] + passage].tobytes() if w["key"] & 1 else raw[w["lo"] : w["hi"] + length]  # noqa: B023, E731
                yield pd.DataFrame([(rid, w["key"], w["ctx"], w["cnt"], w["kinds"], w["p"], w["lo"], w["hi"], body(w)) for w in want], columns=["rid", "key", "ctx", "cnt", "kinds", "p", "lo", "hi", "body"])

    kind = "rid long, key long, ctx long, cnt long, kinds long, p int, lo int, hi int, body binary"
    parts = some.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "want").mapInPandas(bodies, kind)
    parts = stored(parts.dropDuplicates(["key", "ctx"]), "parts")
    found = inside.unionByName(whole).unionByName(_sorted_shards(parts.where(F.col("kinds") <= shard), length, passage, shard))
    dense = parts.where(F.col("kinds") > shard)
    for width in (32, 4, 1):
        if dense.isEmpty():
            break
        fine = stored(_finer(dense, length, passage, width), "fine")
        # for words, a block that only one document holds is no passage of another
        apart = (F.col("key").bitwiseAND(F.lit(1)) == 0) | (F.col("cnt") > 1) | (F.col("first") != F.col("last"))
        kinds = fine.groupBy("key", "ctx").agg(F.count("*").alias("blocks"), F.max("cnt").alias("cnt"), F.min("rid").alias("first"), F.max("rid").alias("last"), F.min(F.struct("rid", "p", "lo", "hi", "body")).alias("one"))
        kinds = stored(kinds.select("key", "ctx", ((F.col("blocks") > 1) & apart).alias("again"), "cnt", "one.*"), "finekinds")
        found = found.unionByName(fine.join(kinds.where("again").select("key", "ctx"), ["key", "ctx"], "left_semi").select("rid", words, "lo", "hi"))
        many = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
        open_ = kinds.withColumn("cnt", F.when(F.col("again"), F.lit(2)).otherwise(F.col("cnt"))).drop("again").join(many, "key")
        found = found.unionByName(_sorted_shards(open_.where(F.col("kinds") <= shard), length, passage, shard))
        dense = open_.where(F.col("kinds") > shard)
    return found


def _merged(ranges) -> list[list[int]]:
    """Ranges that meet or overlap, merged."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def cleaned(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """Columns of ``docs`` plus n_bytes, n_removed, n_spans, spans, kept (the remaining bytes) and n_passage_words (words in
    passages of over 50 words that another document holds, removed or not) per document.

    Null texts are empty. Texts shorter than ``length`` bytes keep everything. Rows with equal doc_id and text are
    documents of their own: each holds the other's strings, so a long text that is copied is removed from all copies.
    """
    # columns get numbers, so that no name of the user's meets one of this function's
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "n_passage_words")]
    own = [*names, *(["text"] if "text" not in names else [])]
    numbered = [f"c{i}" for i in range(len(own))]
    said = numbered[own.index("text")]
    # equal rows share a rid; they are told apart where contexts are counted, since each row is read on its own
    tagged = docs.select(*(F.col(c).alias(n) for c, n in zip(own, numbered)), F.xxhash64(F.col("doc_id"), F.col("text")).alias("rid"))
    passage = how.get("passage", PASSAGE)
    long_enough = F.length(said) * 4 >= F.least(F.lit(length), F.lit(2 * passage - 1))
    found = repeated_windows(tagged.select("rid", F.col(said).alias("text")).where(long_enough), length, **how)
    per = stored(found.groupBy("rid").agg(F.collect_list(F.struct("words", "lo", "hi")).alias("cover")), "cover")
    tagged = marked(tagged, stored(bitmap(per, "rid"), "bits"), "rid")
    hit = tagged.where("maybe").join(per.hint("shuffle_hash"), "rid", "left").select(*numbered, "cover")
    joined = tagged.where("not maybe").select(*numbered, F.lit(None).cast(per.schema["cover"].dataType).alias("cover")).unionByName(hit)
    new = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "n_passage_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, cover in zip(b[said], b["cover"]):
                raw = (text or "").encode()
                cover = cover if cover is not None else ()
                spans = _merged((c["lo"], c["hi"] + length) for c in cover if not c["words"])
                passages = _merged((c["lo"], c["hi"] + passage) for c in cover if c["words"])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                rows.append((len(raw), sum(h - l for l, h in spans), len(spans), [{"lo": l, "hi": h} for l, h in spans], b"".join(kept), sum(h - l for l, h in passages)))
            yield pd.concat([b[numbered[: len(names)]], pd.DataFrame(rows, columns=new, index=b.index)], axis=1)

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(names, numbered))
    out = joined.mapInPandas(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary, n_passage_words long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(names, numbered)), *new)


def op9(docs: DataFrame) -> DataFrame:
    """The digest of ``cleaned``, and whether a document holds a passage of over 50 words that another one holds too.

    A row per row of ``docs``; see ``cleaned`` for nulls and repeated rows; no rows give no rows.
    """
    out = cleaned(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words", (F.col("n_passage_words") > 0).alias("repeats_passage"))
