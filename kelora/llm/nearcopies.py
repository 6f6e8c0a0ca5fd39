"""Near copies by exact Jaccard similarity of word shingles: SimHash BK-trees inside MinHash shards.

Texts with equal shingle sets are one node. At Jaccard 0.8 SimHash fingerprints differ in about ten of 64 bits, so the
blocks that op5 deals its trees by (three bits) would be too short to tell texts apart. Here shards are MinHash bands
(BANDS keys of ROWS minima): a pair of similarity 0.8 shares one with probability 1 - (1 - 0.8^4)^20 = 0.99997. Each
node's fingerprint is first compared with that of one hub, the root, of each of its shards, which settles dense groups in linear work. Shards that then
still hold different components build BK-trees over the nodes' SimHash fingerprints and follow only edges within
RADIUS bits, 4.2 standard deviations above the mean of a pair of similarity 0.8. Every candidate is verified by the exact
Jaccard similarity of the whole texts' shingle sets, in the shard's own task; only links that join components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import stored
from kelora.llm.simhash import components, near_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, RADIUS = 20, 4, 22
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in shingles), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values, none empty."""
    common = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def similar(x: bytes, y: bytes) -> bool:
    """Whether two stored shingle sets have the similarity; their sizes alone rule most pairs out."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    return jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY


def _bands(s: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))]


def _majority(s: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 16):
        counts += np.unpackbits(s[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(s)).tobytes(), "big")


def signatures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, fp, bands): node is the digest of the shingle set, fp its SimHash. Narrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t) for t in b["text"]]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([_majority(s) for s in sets], np.uint64).view(np.int64)
            yield b[keys].assign(node=node, fp=fp, bands=[np.array(_bands(s), np.uint64).view(np.int64) for s in sets])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInPandas(run, f"{kinds}, node long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, body): the shingle set of each of ``texts`` (node, text) as bytes. Narrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "body": [shingle_set(t).tobytes() for t in b["text"]]})

    return texts.mapInPandas(run, "node long, body binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, body) have the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[similar(x, y) for x, y in zip(b["x"], b["y"])], ["a", "b"]]

    first = sets.select(F.col("node").alias("a"), F.col("body").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def by_hub(keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (node, fp, hub, hub_fp, ...) whose SimHash fingerprint is within RADIUS of their hub's."""
    return keyed.where((F.col("node") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= RADIUS))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, component): a row for each row of ``docs`` (doc_id, digest, text); near copies share a component.

    Null and empty texts are one node, whose shingle is the empty text. Repeated rows repeat; no rows give no rows.
    """
    signed = stored(signatures(docs, ["doc_id", "digest"]), "signatures")
    nodes = signed.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("digest").alias("digest"))
    keyed = nodes.select("node", "digest", "fp", F.posexplode("bands").alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.min_by("fp", "node").alias("hub_fp")).where("n > 1").drop("n")
    keyed = stored(keyed.join(hubs, ["band", "key"]), "buckets")  # shared buckets only
    # one text of each node that shares a bucket; equal digests are equal texts
    wanted = keyed.groupBy("node").agg(F.min("digest").alias("d"))
    own = docs.select("digest", "text").join(wanted, F.col("digest").eqNullSafe(F.col("d")))
    sets = stored(shingle_sets(own.groupBy("node").agg(F.first("text").alias("text"))), "sets")

    # the hub is the root of its shard's tree: fingerprints tell candidates here as everywhere in the trees
    to_hubs = by_hub(keyed).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = stored(verified(to_hubs, sets), "verified")
    found = components(links)
    placed = keyed.join(found, F.col("node") == F.col("id"), "left").select(F.col("band").alias("pair"), "key", F.col("node").alias("id"), "fp", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("pair", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("pair", "key")
    open_ = placed.join(mixed, ["pair", "key"]).join(sets.withColumnRenamed("node", "id"), "id")
    more = stored(near_links(open_, RADIUS, similar), "verified")
    if not more.isEmpty():
        found = components(links.union(more))
    return signed.select("doc_id", "digest", "node").join(found, F.col("node") == F.col("id"), "left").select("doc_id", "digest", F.coalesce("root", "node").alias("component"))
