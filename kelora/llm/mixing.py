"""Mixing sources to target weights by cube-method balanced sampling.

Each document is taken floor(ratio) times for sure, with ratio = target / size of its source, and once more with
probability frac(ratio). The cube method draws these extra copies: its flight phase moves the inclusion probabilities
along directions that leave the totals of tokens and of documents unchanged until all but two per group are 0 or 1.
Groups are bounded buckets of one source; what stays fractional is flown again across buckets, level by level, and
only the last few documents of a source land by a fixed random draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.llm.common import stored

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents of one source that fly together, about.
BUCKET = 2_000
EDGE = 1e-9
#: Drawn documents that may be exchanged at the landing to make up for a long one that landed.
LANDINGS, LOOSE = 8, 0.01
COLUMNS = ["row", "source", "size", "draw", "p"]


def targets(sizes: dict, weights: tuple = WEIGHTS, most: float = MOST) -> dict:
    """Target words by source (in code-point order, null last): shares of all words by weight, each at most ``most``
    times its source; the excess is shared again by weight among the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out, left = set(), {}, float(sum(sizes.values()))
    while len(full) < len(names):
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        out |= {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if out[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = most * sizes[s]
            full.add(s)
            left -= out[s]
    return out


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray, land: bool) -> np.ndarray:
    """Move ``p`` (each in 0..1) to 0 or 1, keeping sum(p) and sum(p * size); at most two stay fractional unless ``land``.

    Landing rounds those two and then exchanges at most LANDINGS drawn documents for others, so that the words come near
    their total again while the number of documents stays within one of its own.
    """
    start, sizes = p.astype(float), size.astype(float)
    p, size = start.tolist(), sizes.tolist()
    live: list[int] = []
    for i in range(len(p)):
        if EDGE < p[i] < 1 - EDGE:
            live.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(live) == 3:
            a, b, c = live
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])  # null space of the two constraints
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(live, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(live, u) if x)
            step = up if draws[i] * (up + down) < down else -down
            for k, x in zip(live, u):
                p[k] += step * x
                if p[k] < EDGE or p[k] > 1 - EDGE:
                    p[k] = float(round(p[k]))
            live = [k for k in live if 0 < p[k] < 1]
    if land and live:  # landing: of the outcomes whose number of documents is nearest, that whose words are nearest
        many, want = sum(p[k] for k in live), sum(p[k] * size[k] for k in live)
        bits = [[m >> j & 1 for j in range(len(live))] for m in range(1 << len(live))]
        best = min(bits, key=lambda b: (round(abs(sum(b) - many) - 0.5) > 0, abs(sum(x * size[k] for x, k in zip(b, live)) - want), b))
        for k, x in zip(live, best):
            p[k] = float(x)
    out = np.array(p)
    return _swapped(start, sizes, out) if land else out


def _swapped(start: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out`` after at most LANDINGS exchanges of a drawn document for another: their number stays, words near their total.

    A source of few documents may have no such exchange; while its words are off by more than LOOSE of their total, a
    single document is drawn or dropped instead.
    """
    free = np.flatnonzero((start > EDGE) & (start < 1 - EDGE))
    for _ in range(LANDINGS):
        off = float(((out - start) * sizes).sum())
        drawn, left = free[out[free] > 0.5], free[out[free] < 0.5]
        one = np.abs(off + np.where(out[free] > 0.5, -sizes[free], sizes[free]))
        if not len(drawn) or not len(left):
            break
        left = left[np.argsort(sizes[left], kind="stable")]
        near = np.searchsorted(sizes[left], sizes[drawn] - off)
        pairs = np.concatenate([np.maximum(near - 1, 0), np.minimum(near, len(left) - 1)])
        drawn = np.concatenate([drawn, drawn])
        after = np.abs(off - sizes[drawn] + sizes[left[pairs]])
        i = int(after.argmin())
        if after[i] < abs(off):
            out[drawn[i]], out[left[pairs[i]]] = 0.0, 1.0
        elif one.min() < abs(off) > LOOSE * float((start * sizes).sum()):
            out[free[one.argmin()]] = 1 - out[free[one.argmin()]]
        else:
            break
    return out


def _flown(fly: DataFrame, ids: list[str], keys: list[str], land: bool) -> DataFrame:
    """One flight in each group of ``keys``: long documents first, then in the fixed order of the draws."""
    kinds = ", ".join(f"`{k}` {fly.schema[k].dataType.simpleString()}" for k in ids)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "draw", *ids, "row"], ascending=[False] + [True] * (len(ids) + 2), kind="stable")  # small ones last, so they land
        chance = (group["draw"].to_numpy() % (1 << 31)) / float(1 << 31)
        return group[[*ids, *COLUMNS]].assign(p=flight(group["p"].to_numpy(), group["size"].to_numpy(), chance, land))

    return fly.groupBy(*keys).applyInPandas(run, f"{kinds}, row int, source string, size long, draw long, p double")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, row, source, size, source_size, target, copies) for each row of ``docs``.

    ``keys`` name the columns that tell documents apart; ``row`` tells repeated rows of one document apart. Null or
    empty texts have size 0. A null source is a source of its own, last in order. Empty tables give an empty result.
    The draw is a hash of keys, size and row, so reruns agree and ties fall the same way. Extra columns are not read.
    """
    ids = list(keys)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    base = docs.select(*ids, "source", words.alias("size"))
    # rows that share keys, source and size are told apart by explode after counting, so no window meets a hot key
    base = base.groupBy(*ids, "source", "size").count().select(*ids, "source", "size", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("row"))
    base = stored(base, "sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()  # one row per source
    sizes = {r.source: r.source_size for r in per}
    target = targets(sizes, weights, most)
    spark = docs.sparkSession
    plan = [(s, s is None, int(sizes[s]), float(target[s]), float(target[s] / sizes[s]) if sizes[s] else 0.0, max(1, math.ceil(n / BUCKET))) for s, n in ((r.source, r.n) for r in per)]
    plan = spark.createDataFrame(plan, "source string, none boolean, source_size long, target double, ratio double, buckets int")
    plan = F.broadcast(plan) if len(per) <= 100_000 else plan  # one small row per source, its number checked
    one = base.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "none")
    sure = F.floor(F.col("ratio") + EDGE)
    one = one.withColumn("sure", sure.cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - sure))
    one = one.withColumn("draw", F.xxhash64(*ids, "size", "row", F.lit("mix")))
    fly = one.select(*ids, "row", "source", "size", "draw", "p", F.pmod(F.shiftright("draw", 20), F.col("buckets")).alias("bucket"))
    settled, n, most_buckets = [], None, max((r.n for r in per), default=0)
    while True:
        last = most_buckets <= BUCKET
        flown = stored(_flown(fly, ids, ["source"] if last else ["source", "bucket"], last), "flight")
        settled.append(flown.where(f"p <= {EDGE} or p >= {1 - EDGE}"))
        if last:
            break
        rest = flown.where(f"p > {EDGE} and p < {1 - EDGE}")  # two a bucket at most
        n = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        most_buckets, level = n, len(settled)
        fly = rest.withColumn("bucket", F.pmod(F.xxhash64("draw", F.lit(level)), F.lit(max(1, math.ceil(n / BUCKET)))))
    extra = settled[0]
    for s in settled[1:]:
        extra = extra.unionByName(s)
    extra = extra.select(*(F.col(k).alias(f"{k}_2") for k in ids), F.col("row").alias("row_2"), F.col("size").alias("size_2"), F.col("source").alias("source_2"), F.round("p").cast("long").alias("extra"))
    match = (F.col("row") == F.col("row_2")) & (F.col("size") == F.col("size_2"))
    for k in [*ids, "source"]:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    return one.join(extra, match).select(*ids, "row", "source", "size", "source_size", "target", (F.col("sure") + F.col("extra")).alias("copies"))


def op10(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
