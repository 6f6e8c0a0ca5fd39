"""Removal of repeated word passages by seed and extend.

A window is ``length`` consecutive words of one document; a word goes if it lies in a window that also starts in a
document with a smaller doc_id. Seeds are winnowed: each window's anchor is the smallest hash among its short word grams,
so equal windows have equal anchors at equal distances and documents are joined on anchors only. An anchor is extended
both ways to the union of all windows that chose it (a context); Spark groups contexts by their text. Where a whole
context is repeated, all its windows are. Where contexts share the anchor but differ further out, one context of each kind
is extended window by window around the anchor, and windows are grouped by their text. Windows that repeat are merged to
maximal repeats. No pair of documents is emitted: a group of m equal texts costs m rows, its smallest doc_id stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import bitmap, marked, stored
from kelora.llm.suffixdedup import Rolling, _merged, _word_buffers, anchors, word_hashes

LENGTH, GRAM = 50, 16
NEW = ("n_words", "n_removed", "spans", "kept_text")


def contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, digest, key, ctx, lo, n): runs of n windows from word lo on that share an anchor, with hashes of the
    anchor's text and of the whole context. Runs that meet with one context, as in periodic texts, are one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["at"].to_numpy()
            raws = [t.encode() for t in b["text"]]
            for rows, words in _word_buffers(raws):
                if len(words) < length:
                    continue
                valid = np.zeros(len(words), bool)
                valid[: len(words) - length + 1] = rows[: len(words) - length + 1] == rows[length - 1 :]
                _, lo, hi, key, ctx = anchors(words, valid, length, length - gram + 1, gram)
                if not len(lo):
                    continue
                new = np.ones(len(lo), bool)
                new[1:] = (lo[1:] != hi[:-1] + 1) | (ctx[1:] != ctx[:-1]) | (key[1:] != key[:-1]) | (rows[lo[1:]] != rows[lo[:-1]])
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(lo)) - 1
                first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                start = first[np.searchsorted(first, lo[a], "right") - 1]
                yield pd.DataFrame({"at": at[rows[lo[a]]], "key": key[a].view(np.int64), "ctx": ctx[a].view(np.int64), "lo": lo[a] - start, "n": hi[z] - lo[a] + 1})

    kind = docs.select(F.struct("doc_id", "digest").alias("at"), "text")
    return kind.mapInPandas(run, f"at {kind.schema['at'].dataType.simpleString()}, key long, ctx long, lo int, n int").select("at.*", "key", "ctx", "lo", "n")


def windows(asked: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, key, window, lo): every window of the asked runs (text, want: key, lo, n), hashed one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, text, want in zip(b["at"], b["text"], b["want"]):
                roll = Rolling(word_hashes(text.encode()))
                n = np.array([w["n"] for w in want])
                lo = np.repeat([w["lo"] for w in want], n) + np.concatenate([np.arange(k) for k in n])
                key = np.repeat(np.array([w["key"] for w in want], np.int64), n)
                yield pd.DataFrame({"at": [at] * len(lo), "key": key, "window": roll(lo, length).view(np.int64), "lo": lo})

    kind = asked.schema["at"].dataType.simpleString()
    return asked.select("at", "text", "want").mapInPandas(run, f"at {kind}, key long, window long, lo int").select("at.*", "key", "window", "lo")


def _rank(prefix: str = "") -> Column:
    """The order of doc_ids, nulls last; two nulls are equal."""
    own = F.col(f"{prefix}doc_id")
    return F.struct(own.isNull().alias("none"), own.alias("doc_id"))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, digest, lo, n): runs of windows of ``docs`` (doc_id, digest, text) that start in a smaller doc_id too.

    A run may be reported in pieces; runs of one document do not contradict each other.
    """
    places = stored(contexts(docs.where(F.length("text") >= 2 * length - 1), length, gram), "anchors")
    often = places.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    places = marked(places, stored(bitmap(often, "key"), "bits"), "key").where("maybe").drop("maybe")
    one = F.min(F.struct(_rank().alias("rank"), "doc_id", "digest", "lo", "n")).alias("one")
    kinds = stored(places.groupBy("key", "ctx").agg(F.count("*").alias("c"), one), "kinds")
    first = kinds.where("c > 1").select("key", "ctx", F.col("one.rank").alias("first"))
    whole = places.join(first, ["key", "ctx"]).where(_rank() > F.col("first")).select("doc_id", "digest", "lo", "n")

    # written, so that both sides of the join are plain exchanges and a hot anchor's partition can be split
    open_ = stored(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key"), "open")
    asked = kinds.join(open_, "key").select("one.doc_id", "one.digest", "key", "one.lo", "one.n")
    wanted = stored(asked.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("key", "lo", "n")).alias("want")), "wanted")
    some = marked(docs, stored(bitmap(wanted, "doc_id", "digest"), "bits"), "doc_id", "digest").where("maybe")
    both = some.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.digest") == F.col("w.digest")))
    each = stored(windows(both.select(F.struct("d.doc_id", "d.digest").alias("at"), "text", "want"), length), "windows")
    least = each.groupBy("key", "window").agg(F.min(_rank()).alias("first"), F.max(_rank()).alias("last")).where("first < last").select("key", "window", "first")
    single = each.join(least, ["key", "window"]).where(_rank() > F.col("first")).select("doc_id", "digest", "lo", F.lit(1).alias("n"))
    return whole.unionByName(single)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Columns of ``docs`` plus n_words, n_removed, spans (maximal removed runs of words: lo, hi) and kept_text (the kept
    words joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null texts have no words; documents under ``length`` words keep all.
    Null doc_ids count as larger than all others and as equal to each other. Rows with one doc_id remove nothing from
    each other, so repeated rows all keep what one of them keeps. Columns with one of the new names are replaced. No rows
    give no rows. A task holds the words of one text at a time, whatever its length.
    """
    names = [c for c in docs.columns if c.lower() not in NEW]
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(repeated(texts, length, gram), "repeats")
    spans = stored(found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("lo", "n")).alias("gone")), "spans")
    own = docs.select(F.struct(*names).alias("row"), "doc_id", F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    own = marked(own, stored(bitmap(spans, "doc_id", "digest"), "bits"), "doc_id", "digest")
    kind = spans.schema["gone"].dataType
    hit = own.where("maybe").alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.digest") == F.col("s.digest")), "left")
    own = own.where(~F.col("maybe")).select("row", "text", F.lit(None).cast(kind).alias("gone")).unionByName(hit.select("row", "text", "gone"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, gone in zip(b["text"], b["gone"]):
                words = text.encode().split()
                cuts = _merged((g["lo"], g["lo"] + g["n"] - 1 + length) for g in (gone if gone is not None else ()))
                kept, at = [], 0
                for lo, hi in cuts:
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), [{"lo": lo, "hi": hi} for lo, hi in cuts], b" ".join(kept).decode()))
            yield pd.concat([b[["row"]], pd.DataFrame(rows, columns=NEW, index=b.index)], axis=1)

    return own.mapInPandas(run, f"row {own.schema['row'].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_text string").select("row.*", *NEW)


def op12(docs: DataFrame) -> DataFrame:
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in SQL: every window's text with its smallest doc_id, then a window frame over word places.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS u FROM documents),
p AS (SELECT doc_id, u, unnest(generate_series(1, len(u))) AS i FROM d),
w AS (SELECT doc_id, i, u[i] AS word, CASE WHEN i + 49 <= len(u) THEN sha256(array_to_string(u[i:i + 49], ' ')) END AS k FROM p),
m AS (SELECT k, min(doc_id) AS first FROM w WHERE k IS NOT NULL GROUP BY k),
f AS (SELECT w.doc_id, i, word, coalesce(m.first < w.doc_id, false)::INT AS hit FROM w LEFT JOIN m ON w.k = m.k),
c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(u)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
