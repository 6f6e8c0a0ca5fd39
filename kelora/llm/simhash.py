"""SimHash near-dedup with BK-trees.

Fingerprints are 64-bit majority votes over XXH64 of word shingles. Two fingerprints that differ in at most three
bits agree on at least two of five blocks, so each of the ten pairs of blocks deals the distinct fingerprints into
shards; links cross no shard border of all ten. A BK-tree per shard keys its children by the Hamming distance to the
parent and follows only edges within the radius. A shard with more than SHARD nodes is split: each part has its own
tree, and the other members are probed against it. A tree gives star links between a fingerprint and one member of
each group it meets, so their number stays linear however dense a group is. Components are found by label
propagation with pointer jumping over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import stored

RADIUS, SHINGLE = 3, 3
#: Most nodes of one tree.
SHARD = 20_000
_EDGES = (0, 13, 26, 39, 52, 64)
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:])]
MASKS = [_BLOCKS[i] | _BLOCKS[j] for i, j in combinations(range(5), 2)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # on bytes: lower() changes A-Z, split() cuts at 20 and 09-0D only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]
    n, counts = len(shingles), np.zeros(64, np.int64)
    hashes = np.fromiter(map(_hash, shingles), ">u8", n)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x, 42)


def fingerprints(docs: DataFrame, keys: list[str], width: int = SHINGLE) -> DataFrame:
    """(keys, fp): fp is the fingerprint as a signed long. Narrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)
            yield b[keys].assign(fp=fp)

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInPandas(run, f"{kinds}, fp long")


class BKTree:
    """A tree of distinct fingerprints that also keeps their groups (a union-find over its nodes).

    ``same[i]`` is a node whose group all of node i's subtree belongs to, or -1: a search skips such a subtree once
    its own group is that one, so dense groups cost little.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.value, self.child, self.same, self.up = [], [], [], []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def search(self, x: int, own: int = -1) -> list[int]:
        """One node of each group that has a member within the radius; with ``own``, joins those groups to it."""
        hits: dict[int, int] = {}
        radius = self.radius
        stack = [0] if self.value else []
        while stack:
            i = stack.pop()
            s = self.same[i]
            if s >= 0 and (self.find(s) in hits):
                continue
            d = (x ^ self.value[i]).bit_count()
            if d <= radius:
                hits.setdefault(self.find(i), i)
            for e, c in self.child[i].items():
                if d - radius <= e <= d + radius:
                    stack.append(c)
        for root in hits if own >= 0 else ():
            self.up[root] = own
        return list(hits.values())

    def near(self, x: int) -> list[int]:
        """All nodes within the radius."""
        hits, stack, radius = [], [0] if self.value else [], self.radius
        while stack:
            i = stack.pop()
            d = (x ^ self.value[i]).bit_count()
            if d <= radius:
                hits.append(i)
            stack += [c for e, c in self.child[i].items() if d - radius <= e <= d + radius]
        return hits

    def add(self, x: int) -> list[int]:
        """Insert ``x``; the nodes it links to (one a group), as indexes."""
        new = len(self.value)
        self.up.append(new)
        hits = self.search(x, new)
        path = self.insert(x)
        root = self.find(new)
        for i in path:
            if self.same[i] >= 0 and self.find(self.same[i]) != root:
                self.same[i] = -1
        return hits

    def insert(self, x: int) -> list[int]:
        """Insert ``x`` without a search; the nodes above it."""
        new, at, path = len(self.value), 0, []
        while new:
            path.append(at)
            d = (x ^ self.value[at]).bit_count()
            nxt = self.child[at].get(d)
            if nxt is None:
                self.child[at][d] = new
                break
            at = nxt
        self.value.append(x)
        self.child.append({})
        self.same.append(new)
        return path


def split_shards(dealt: DataFrame) -> DataFrame:
    """``dealt`` (pair, key, fp, ...) with part and role: a shard of more than SHARD rows is split into parts.

    A row builds its own part's tree (role 0) and is probed against the other parts' trees (role 1).
    """
    counts = dealt.groupBy("pair", "key").agg(F.count("*").alias("n"))
    big = counts.where(F.col("n") > SHARD).select(F.col("pair").alias("p2"), F.col("key").alias("k2"), F.ceil(F.col("n") / SHARD).cast("int").alias("parts"))
    big = stored(big, "bigshards")
    if big.isEmpty():
        return dealt.select("*", F.lit(0).alias("part"), F.lit(0).alias("role"))
    with_parts = dealt.join(big, (F.col("pair") == F.col("p2")) & (F.col("key") == F.col("k2")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    work = with_parts.withColumn("own", own).select(*dealt.columns, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return work.select(*dealt.columns, "part", (F.col("part") != F.col("own")).cast("int").alias("role"))


def shards(work: DataFrame, visit, out: str) -> DataFrame:
    """``visit(shard, rows)`` for each run of rows of one (pair, key, part), roles in order; it returns a frame or None.

    ``shard`` is a dict that lasts as long as the shard does, so rows of one shard may come in several batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, shard = None, {}
        for b in batches:
            pair, key, part = (b[c].to_numpy() for c in ("pair", "key", "part"))
            new = np.ones(len(b), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(new)
            found = []
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(b)).tolist()):
                now = int(pair[s]), int(key[s]), int(part[s])
                if now != name:
                    name, shard = now, {}
                    if e - s == 1 and e < len(b):
                        continue  # a shard of one: nothing to link, no tree to build
                found += visit(shard, b, s, e)
            if found:
                yield pd.DataFrame(found)

    return work.repartition("pair", "key", "part").sortWithinPartitions("pair", "key", "part", "role", "fp").mapInPandas(run, out)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): star links between the ids of ``nodes`` (id, fp; distinct fp) whose fingerprints are near."""
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in MASKS))
    dealt = nodes.select("id", "fp", F.posexplode(masks).alias("pair", "mask")).select("id", "fp", "pair", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))

    def visit(shard: dict, b: pd.DataFrame, s: int, e: int) -> list[dict]:
        tree, ids = shard.setdefault("tree", BKTree()), shard.setdefault("ids", [])
        out = []
        for x, ident, role in zip(b["fp"].to_numpy()[s:e].view(np.uint64).tolist(), b["id"].to_numpy()[s:e].tolist(), b["role"].to_numpy()[s:e].tolist()):
            if role:
                hits = tree.search(x)
            else:
                hits = tree.add(x)
                ids.append(ident)
            out += [{"a": ident, "b": ids[h]} for h in hits]
        return out

    return shards(split_shards(dealt), visit, "a long, b long").distinct()


def near_links(dealt: DataFrame, radius: int, similar) -> DataFrame:
    """(a, b): links that join roots, between rows of ``dealt`` (id, fp, pair, key, root, body) of one (pair, key).

    Tree hits within ``radius`` are candidates; ``similar(body, body)`` decides. Roots that a link has joined are one
    group from then on, and hits inside a group are not compared, so links stay linear however dense a group is.
    """

    def visit(shard: dict, b: pd.DataFrame, s: int, e: int) -> list[dict]:
        if not shard:
            shard.update(tree=BKTree(radius), rows=[], up={})
        tree, rows, up = shard["tree"], shard["rows"], shard["up"]

        def find(r: int) -> int:
            while up.setdefault(r, r) != r:
                up[r] = r = up[up[r]]
            return r

        out = []
        columns = (b[c].to_numpy()[s:e].tolist() for c in ("id", "root", "role"))
        for x, ident, root, role, body in zip(b["fp"].to_numpy()[s:e].view(np.uint64).tolist(), *columns, b["body"].iloc[s:e]):
            for h in tree.near(x):
                other, its, one = rows[h]
                if find(its) != find(root) and similar(one, body):
                    up[find(its)] = find(root)
                    out.append({"a": min(ident, other), "b": max(ident, other)})
            if not role:
                tree.insert(x)
                rows.append((ident, root, body))
        return out

    return shards(split_shards(dealt), visit, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each id that has a link.

    Each round takes the smallest label among the neighbours, then jumps to that label's own label; labels are written
    tables, and the number of rounds grows with the logarithm of the longest chain.
    """
    both = stored(edges.union(edges.select("b", "a")).distinct(), "links")
    label = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id")
    label = stored(label, "labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("id").alias("j"), F.col("root").alias("far"))
        new = step.join(jump, step["root"] == jump["j"], "left").select("id", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        new = stored(new, "labels")
        if new.where("root <> old").isEmpty():
            return new.select("id", "root")
        label = new.select("id", "root")


def grouped(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id, the smallest doc_id of each row's group of near fingerprints.

    Nodes are the distinct fingerprints, so groups of exact copies cost one row, and a doc_id that occurs with several
    texts links nothing by itself. Null doc_ids link like others but are ignored when the smallest is taken; a group of
    only such rows has a null component_id. An empty table gives an empty result.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp")))
    placed = nodes.join(found, nodes["fp"] == found["id"], "left").select("fp", "least", "root")
    heads = placed.where("root is not null").groupBy("root").agg(F.min("least").alias("head")).withColumnRenamed("root", "g")
    # fingerprints without a link have no root to meet on
    alone = placed.where("root is null").select(F.col("fp").alias("node"), F.col("least").alias("component_id"))
    named = alone.unionByName(placed.join(heads, F.col("root") == F.col("g")).select(F.col("fp").alias("node"), F.col("head").alias("component_id")))
    return prints.join(named, prints["fp"] == named["node"]).drop("node")


def op5(docs: DataFrame) -> DataFrame:
    out = grouped(stored(fingerprints(docs, ["doc_id"]), "fingerprints"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
