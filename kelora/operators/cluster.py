"""Incident clustering and greedy one-to-one matching: order-dependent folds kept inside small, gap-bounded groups."""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.operators.graph import written


def blocks(df: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """``df`` with ``block``: a new one after each gap over ``minutes``; no cluster can reach across such a gap."""
    w = W.partitionBy(key).orderBy(ts, "id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return df.withColumn("fresh", F.coalesce((gap > minutes * 60_000_000).cast("int"), F.lit(1))).withColumn("block", F.sum("fresh").over(w)).drop("fresh")


def clusters(candidates: DataFrame, minutes: int = 90) -> DataFrame:
    """(id, line, block, cluster): each candidate (id, line, segment, ts) joins the best-overlapping open cluster of its line.

    Overlap counts 4 for a shared segment and 1 for the line; the first best wins; a cluster stays open for
    ``minutes`` after its last report and its footprint grows by union.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        open_: list[list] = []  # last time, segments, number: only those still open
        out, made, limit = [], 0, pd.Timedelta(minutes=minutes)
        for row in g.sort_values(["ts", "id"]).itertuples():
            open_ = [c for c in open_ if row.ts - c[0] <= limit]
            best = max(open_, key=lambda c: 4 * (row.segment in c[1]) + 1, default=None)  # the first of equal ones
            if best is None:
                best = [row.ts, set(), made]
                made += 1
                open_.append(best)
            best[0] = max(best[0], row.ts)
            best[1].add(row.segment)
            out.append((row.id, row.line, row.block, best[2]))
        return pd.DataFrame(out, columns=["id", "line", "block", "cluster"])

    return blocks(candidates, "line", "ts", minutes).groupBy("line", "block").applyInPandas(fold, "id long, line long, block long, cluster long")


def greedy_matches(pairs: DataFrame, key: str) -> DataFrame:
    """(lid, rid): one-to-one, in the order of lid; each takes its closest unmatched partner, ties by rid.

    ``pairs``: key, lid, lts, rid, rts, apart_us. Pairs that overlap no other pair's span of time can't compete, so the
    fold runs in blocks of overlapping spans instead of whole keys.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for lid, own in g.sort_values(["lid", "apart_us", "rid"]).groupby("lid", sort=True):
            rid = next((r for r in own["rid"] if r not in taken), None)
            if rid is not None:
                taken.add(rid)
                out.append((lid, rid))
        return pd.DataFrame(out, columns=["lid", "rid"])

    w = W.partitionBy(key).orderBy("start", "lid", "rid")
    spans = pairs.select(key, "lid", "rid", "apart_us", F.least("lts", "rts").alias("start"), F.greatest("lts", "rts").alias("end"))
    fresh = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("fresh", fresh.cast("int")).withColumn("block", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy(key, "block").applyInPandas(fold, "lid long, rid long")


def nearest_matches(left: DataFrame, right: DataFrame, key: str, minutes: int) -> DataFrame:
    """(lid, rid): one-to-one, in the order of lid; each takes its closest unmatched partner of the key, ties by rid.

    ``left``: key, lid, lts. ``right``: key, rid, rts. Partners are at most ``minutes`` apart; rows without key, id or time
    have none. These are the ``greedy_matches`` of all such pairs, but no pair is built. Nothing reaches across a gap over
    ``minutes``: gaps are found between spans of that length, one row per span of a key, and the rows between two gaps are
    a block. A task reads its blocks as one stream, in order, and holds a single block.
    """
    limit = minutes * 60_000_000
    side = lambda rows, own, at, is_left: rows.select(F.col(key).alias("key"), F.col(own).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.lit(is_left).alias("is_left"))
    rows = side(left, "lid", "lts", True).unionByName(side(right, "rid", "rts", False)).where("key is not null and id is not null and at is not null")
    rows = rows.withColumn("span", F.floor(F.col("at") / limit))
    w = W.partitionBy("key").orderBy("span")
    spans = rows.groupBy("key", "span").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spans = spans.withColumn("fresh", F.coalesce((F.col("first") - F.lag("last").over(w) > limit).cast("int"), F.lit(1)))
    items = rows.join(spans.select("key", "span", F.sum("fresh").over(w).alias("block")), ["key", "span"]).select("key", "block", "at", "is_left", "id")

    def fold(batches):
        stream = (r for g in batches for r in zip(*(g[c].tolist() for c in ("key", "block", "at", "is_left", "id"))))
        out = []
        for _, own in groupby(stream, key=itemgetter(0, 1)):
            out += nearest_of_block([r[2:] for r in own], limit)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["lid", "rid"])
                out = []
        yield pd.DataFrame(out, columns=["lid", "rid"])

    return items.repartition("key", "block").sortWithinPartitions("key", "block").mapInPandas(fold, "lid long, rid long")


def nearest_of_block(rows: list[tuple[int, bool, int]], limit: int) -> list[tuple[int, int]]:
    """The matches of one block of (at, is_left, id). Each moment keeps its unmatched right ids, the smallest last; one that
    has none left points to its neighbours, so that the nearest on either side is found by a few steps."""
    lefts = sorted((i, t) for t, is_left, i in rows if is_left)
    waiting: dict[int, list[int]] = {}
    for i, t in sorted(((i, t) for t, is_left, i in rows if not is_left), reverse=True) if lefts else ():
        waiting.setdefault(t, []).append(i)
    moments, n = sorted(waiting), len(waiting)
    down, up = list(range(n + 2)), list(range(n + 2))  # moments count from 1; 0 and n + 1 are the ends
    taken: set[int] = set()
    out = []

    def free(link: list[int], i: int) -> int:
        while 0 < i <= n:
            own = waiting[moments[i - 1]]
            while own and own[-1] in taken:
                own.pop()
            if own:
                return i
            if link[i] == i:
                down[i], up[i] = i - 1, i + 1
            link[i] = link[link[i]]
            i = link[i]
        return 0

    for lid, own in groupby(lefts if moments else (), key=itemgetter(0)):
        near = []
        for _, t in own:
            k = bisect_right(moments, t)
            near += [(abs(moments[i - 1] - t), waiting[moments[i - 1]][-1]) for i in (free(down, k), free(up, k + 1)) if i]
        best = min((x for x in near if x[0] <= limit), default=None)
        if best:
            taken.add(best[1])
            out.append((lid, best[1]))
    return out


def head_clusters(candidates: DataFrame, minutes: int = 120) -> DataFrame:
    """(id, head): each candidate (id, key, ts) joins the first cluster of its key whose head is at most ``minutes`` older.

    Heads of a key are more than ``minutes`` apart, so the head after x is the first candidate later than x + ``minutes``,
    and heads are what is reached from the first candidate by such steps. Steps are found between neighbouring spans of
    ``minutes``, reached by pointer doubling, and each candidate looks for its head in its own span and the one before. No
    task needs more of a key than two spans; candidates without id, key or time are in no cluster.
    """
    width = F.lit(minutes * 60_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    items = written(candidates.where("id is not null and key is not null and ts is not null").select("id", "key", at.alias("at"), F.floor(at / width).alias("span")))
    own = F.struct("at", "id")
    firsts = items.groupBy("key", "span").agg(F.min(own).alias("first"))
    # the first candidate after x + minutes lies in the next span, or is the first one of a later span
    asks = items.select("key", (F.col("span") + 1).alias("span"), (F.col("at") + width).alias("at"), "id", F.lit(None).cast("struct<at:bigint,id:bigint>").alias("item"))
    both = asks.unionByName(items.select("key", "span", "at", "id", own.cast("struct<at:bigint,id:bigint>").alias("item")))
    down = W.partitionBy("key", "span").orderBy(F.desc("at"), F.col("item").isNotNull(), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    near = both.withColumn("next", F.last("item", ignorenulls=True).over(down)).where("item is null").select("key", "span", "id", "next")
    marks = firsts.unionByName(firsts.select("key", (F.col("span") + 1).alias("span"), F.lit(None).cast(firsts.schema["first"].dataType).alias("first"))).groupBy("key", "span").agg(F.max("first").alias("first"))
    later = marks.select("key", "span", F.last("first", ignorenulls=True).over(W.partitionBy("key").orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)).alias("later"))  # one row per span of a key
    step = written(near.join(later, ["key", "span"]).select("id", F.coalesce(F.col("next.id"), F.col("later.id")).alias("next")).where("next is not null"))
    heads = written(items.groupBy("key").agg(F.min(own).alias("first")).select(F.col("first.id").alias("id")))
    while True:
        further = written(heads.join(step, "id").select(F.col("next").alias("id")).join(heads, "id", "left_anti").distinct())
        if further.isEmpty():
            break
        heads = written(heads.unionByName(further))
        step = written(step.join(step.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")))
    found = items.join(heads, "id").select("key", "span", own.alias("head"))
    found = found.unionByName(found.withColumn("span", F.col("span") + 1))  # a span holds one head at most
    return items.join(found, ["key", "span"]).where(own >= F.col("head")).groupBy("id").agg(F.max("head").alias("h")).select("id", F.col("h.id").alias("head"))
