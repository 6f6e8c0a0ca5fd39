"""The prefix trie of conversations, built by van Emde Boas recursion.

A trie of height 2^k is cut at half depth into an upper trie and the lower forests that hang below it, and both are cut
again in the same way down to single turns. All sub-tries of one size are cut in one round, so a trie of depth n takes
about log2(n) rounds, and round k moves one row per 2^k turns:

1. names of aligned blocks of 2, 4, 8, ... turns, bottom up, each from the names of its halves;
2. top down, each block of a forest is split: the cut prefix (forest, first half) names the forest of the second half.
   Equal first halves of one forest become one row here, with the number of their conversations, so copies and shared
   beginnings are merged before they are split further;
3. at single turns each row is a node. Totals of forests of height 1, 2, 4, ... are summed bottom up, each forest's upper
   half plus the lower forests at its cut;
4. totals are grafted upward: whole subtrees at depths divisible by 2^k are known first; those at odd multiples of half
   that depth follow, each from its own forest and the subtrees at the next cut.

Names are 128-bit digests of role, text and order. No array or group holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.llm.common import stored

ROOT = b""
#: Conversation ids of one piece of a node's list of members that end there.
PIECE = 4096
#: Turns of the first conversation of each hundred that others start with are fewer than this.
HEADS = 6


def digest(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of parts whose lengths are told apart by the caller."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def indexed(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, sym): turns numbered from 0 within their conversation; sym is a digest of role and text and, in its
    last four bytes, the text's code points.

    Rows go by turn (null first), then by digest. They are sorted in ranges, so a conversation may span many tasks; its
    pieces are counted and numbered by running sums over at most one row per task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    sym = F.concat(name, F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", sym.alias("sym"))
    order = (F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("sym").asc())
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "sym", F.monotonically_increasing_id().alias("at")), "turns")
    task = F.shiftright("at", 33)
    runs = rows.groupBy("conv_id", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("conv_id", "task", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("task", task).join(runs, ["conv_id", "task"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "sym")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the first h turns of conversation c - c % 100, then c's own turns after its first h; h is
    crc32 of c's decimal digits, modulo 6. Turns are (conv_id, at, sym), conversations (conv_id)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 100
    known = size.select("conv_id", h.alias("h"), base.alias("base"))
    known = stored(known.join(size.select(F.col("conv_id").alias("base"), "n"), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("skip")), "rebuilt")
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("i") < HEADS - 1)).select(F.col("conv_id").alias("base"), "i", "sym")
    head = known.join(heads, "base").where("i < h").select("conv_id", F.col("i").alias("at"), "sym")
    tail = turns.join(known, "conv_id").where("i >= h").select("conv_id", (F.col("skip") + F.col("i") - F.col("h")).alias("at"), "sym")
    return stored(head.unionByName(tail), "symbols"), known.select("conv_id")


def named_blocks(symbols: DataFrame) -> list[DataFrame]:
    """Level k: (conv_id, j, name, left, right) of the blocks of 2^k turns; at level 0 only names."""
    deepest = symbols.agg(F.max("at")).first()[0]
    levels = [symbols.select("conv_id", F.col("at").alias("j"), F.col("sym").alias("name"))]
    for _ in range(int(deepest or 0).bit_length()):
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        halves = levels[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(side(0).alias("left"), side(1).alias("right"))
        levels.append(stored(halves.withColumn("name", digest(F.col("left"), F.coalesce("right", F.lit(b"")))), "blocks"))
    return levels


def split(blocks: list[DataFrame]) -> list[DataFrame]:
    """Level k: the distinct (forest, name) of the blocks of 2^k turns with their start, the name of the prefix they end,
    conversations (n, smallest rep) and, where sequences end in the block, their whole name."""
    top = len(blocks) - 1
    whole = blocks[top].groupBy("name").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"))
    rows = whole.select(F.lit(ROOT).alias("forest"), "name", F.lit(0).cast("long").alias("at"), digest(F.lit(ROOT), F.col("name")).alias("end"), "n", "rep", F.col("name").alias("whole"))
    levels = [stored(rows, "forests")]
    for k in range(top, 0, -1):
        halves = blocks[k].select(F.col("conv_id").alias("rep"), F.col("j").alias("j"), "left", "right")
        # the representative alone has this block at this place, so both sides of the join have one row per key
        cut = levels[0].withColumn("j", F.shiftright("at", k)).join(halves, ["rep", "j"])
        upper = cut.groupBy("forest", F.col("left").alias("name")).agg(
            F.max("at").alias("at"), F.sum("n").alias("n"), F.min("rep").alias("rep"), F.max(F.when(F.col("right").isNull(), F.col("whole"))).alias("whole")
        ).withColumn("end", digest(F.col("forest"), F.col("name")))
        lower = cut.where("right is not null").select(digest(F.col("forest"), F.col("left")).alias("forest"), F.col("right").alias("name"), (F.col("at") + (1 << k - 1)).alias("at"), "end", "n", "rep", "whole")
        levels.insert(0, stored(upper.unionByName(lower), "forests"))
    return levels


def _ends(known: DataFrame, top: DataFrame) -> DataFrame:
    """(whole, ends_sha256): the hash of the ids of the conversations with one whole sequence, streamed piece by piece."""
    own = known.join(top.select("conv_id", F.col("name").alias("whole")), "conv_id", "left").withColumn("whole", F.coalesce("whole", F.lit(ROOT)))
    piece = own.groupBy("whole", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, None
        for b in batches:
            rows = []
            for whole, ids in zip(b["whole"], b["ids"]):
                if held is not None and whole == last:
                    held.update(b"," + ids.encode())
                    continue
                if held is not None:
                    rows.append((last, held.hexdigest()))
                held, last = hashlib.sha256(ids.encode()), whole
            yield pd.DataFrame(rows, columns=["whole", "ends_sha256"])
        if held is not None:
            yield pd.DataFrame([(last, held.hexdigest())], columns=["whole", "ends_sha256"])

    return piece.repartition("whole").sortWithinPartitions("whole", "piece").select("whole", "ids").mapInPandas(run, "whole binary, ends_sha256 string")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("forest", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def grafted(levels: list[DataFrame], own: DataFrame) -> DataFrame:
    """(id, leaves, saved): totals of all strict descendants of every node that has any. ``own`` are the single nodes."""
    top = len(levels) - 1
    totals = [stored(_summed(own.select("forest", "at", "leaves", "saved")), "totals")]
    for k in range(1, top + 1):
        below = totals[-1].select(F.col("forest").alias("end"), "leaves", "saved")
        upper = levels[k - 1].where(F.shiftright("at", k - 1) % 2 == 0).select("forest", "at", "end").join(below, "end").drop("end")
        same = totals[-1].where(F.col("at") % (1 << k) == 0)
        totals.append(stored(_summed(same.unionByName(upper.select(*same.columns))), "totals"))
    whole = totals[top]
    for k in range(top - 1, -1, -1):
        below = whole.select(F.col("forest").alias("end"), "leaves", "saved")
        odd = F.shiftright("at", k) % 2 == 1
        lower = levels[k].where(odd).select("forest", "at", "end").join(below, "end").drop("end")
        fresh = totals[k].where(odd)
        whole = whole.unionByName(stored(_summed(fresh.unionByName(lower.select(*fresh.columns))), "grafts"))
    return whole.select(F.col("forest").alias("id"), "leaves", "saved")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; see the query's contract.

    Null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left out. Rows of one turn
    go by a digest of role and text; repeated rows are turns of their own. Extra columns are not read. A table without
    conversations has no nodes.
    """
    symbols, known = rebuilt(stored(indexed(conversations), "indexed"))
    blocks = named_blocks(symbols)
    levels = split(blocks)
    chars = F.conv(F.hex(F.substring("name", 17, 4)), 16, 10).cast("long")
    nodes = levels[0].select(F.col("end").alias("id"), "forest", "at", "n", "rep", "whole", ((F.col("n") - 1) * chars).alias("saved"))
    children = nodes.groupBy("forest").agg(F.count("*").alias("n_children")).withColumnRenamed("forest", "id")
    root = known.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 0").select(F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("forest"), F.lit(-1).cast("long").alias("at"), "n", "rep", F.lit(ROOT).alias("whole"), F.lit(0).cast("long").alias("saved"))
    nodes = nodes.unionByName(root).join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    below = grafted(levels, nodes.where("forest is not null")).select("id", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    parents = nodes.where("n_children > 0").select(F.col("id").alias("forest"), F.col("rep").alias("parent_conv_id"))
    out = nodes.join(below, "id", "left").join(parents, "forest", "left").join(_ends(known, blocks[-1]), "whole", "left")
    more = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
    return out.select(
        F.col("rep").alias("conv_id"), (F.col("at") + 1).alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        more("leaves", "more_leaves").alias("n_leaves"), more("saved", "more_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11(conversations: DataFrame) -> DataFrame:
    return trie(conversations.select("conv_id", "turn", "role", "text"))


#: The same rows in SQL: chained hashes name prefixes; a node's ancestors are the prefixes of its smallest member.
SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
s AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS crc FROM n),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295::BIGINT) % 6 AS h FROM s),
b AS (SELECT c.conv_id, t.i AS pos, r, x FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, least(c.h, coalesce(n.n, 0)) + t.i - c.h, r, x FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN n ON n.conv_id = c.base WHERE t.i >= c.h),
k AS (SELECT conv_id, pos + 1 AS depth, length(x) AS chars, sha256(string_agg(sha256(length(r) || ':' || r || x), ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS id FROM b
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
l AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(id) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM k),
g AS (SELECT id, min(conv_id) AS conv_id, min(depth) AS depth, min(up) AS up, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends FROM l GROUP BY id),
h AS (SELECT g.*, coalesce(ch.n, 0) AS n_children FROM g LEFT JOIN (SELECT up, count(*) AS n FROM g GROUP BY up) ch ON ch.up = g.id),
sub AS (SELECT k.id, sum((h.n_children = 0)::INT) AS n_leaves, sum(h.saved) AS saved FROM h JOIN k ON k.conv_id = h.conv_id AND k.depth <= h.depth GROUP BY k.id)
SELECT h.conv_id, h.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, h.n_convs::BIGINT AS n_convs, h.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, h.ends AS ends_sha256
FROM h JOIN sub ON sub.id = h.id LEFT JOIN h p ON p.id = h.up
"""
