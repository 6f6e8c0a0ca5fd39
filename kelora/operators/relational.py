"""Relational operators of the domain that need a plan shape of their own."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import risk
from kelora.operators.graph import written


def active_at(at: Column, start: str = "start_ts", end: str = "end_ts") -> Column:
    """Closed interval; a null end is open."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at))


def fuse_segments(evidence: DataFrame) -> DataFrame:
    """Noisy-OR per segment: one scan, one shuffle with partial aggregates.

    ``evidence``: segment, source, p, severity (rank), issue, confidence, ts.
    """
    n = F.countDistinct("source")
    best = F.max_by("issue", F.struct("severity", "confidence", (-F.ascii("issue")).alias("o")))
    out = evidence.groupBy("segment").agg(
        F.round(risk.noisy_or_agg(F.col("p")), 6).alias("probability"), n.alias("sources"), F.max("ts").alias("last_ts"),
        F.max("severity").cast("long").alias("severity_rank"), best.alias("issue"),
    )
    bonus = 0.5 * (1 - F.exp(-(F.col("sources") - 1) / 2))
    return out.withColumn("bonus", F.round(bonus, 6)).withColumn("band", risk.band(F.col("probability")))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


CANDIDATES = 1_000_000  # pairs that one slice of a cell compares; a task takes a few slices


def beside(points: DataFrame, cell: Column, around: Column) -> DataFrame:
    """(cell, slice, l, r): every row of ``points`` (id, ...) with every row that is in the cells around it, as structs.

    ``cell``: the cell of a point; ``around``: the cells, its own with them, whose points can be its neighbours. A cell's
    points are cut into slices by the pairs that they will be compared in, and there are as many tasks as these pairs ask
    for, however few bytes the points have. All pairs of one left point are in one slice.
    """
    p = points.select(F.struct("*").alias("p"), F.col("id"), cell.alias("cell"), around.alias("around"))
    held = p.groupBy("cell").agg(F.count("*").alias("n"))
    met = p.select(F.explode("around").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
    work = written(held.join(met, "cell").select("cell", (F.col("n") * F.col("m")).alias("pairs")))
    parts = (work.agg(F.sum("pairs")).first()[0] or 0) // (4 * CANDIDATES) + 1
    slices = work.select("cell", F.ceil(F.col("pairs") / CANDIDATES).alias("slices"))
    left = p.join(slices, "cell").select("cell", F.pmod(F.xxhash64("id"), "slices").alias("slice"), F.col("p").alias("l"))
    right = p.select(F.col("p").alias("r"), F.explode("around").alias("cell")).join(slices, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "r")
    # the hint keeps the partitions: a broadcast of so few bytes would leave all pairs to the tasks that read the points
    return left.repartition(parts, "cell", "slice").hint("merge").join(right.repartition(parts, "cell", "slice"), ["cell", "slice"])


def near_points(points: DataFrame, radius: float) -> DataFrame:
    """(cell, slice, l, r, d): rows of ``points`` (id, x, y, ...), l.id < r.id, at most ``radius`` apart, by grid cells, then refined."""
    at = lambda c, i=0: F.floor(F.col(c) / radius).cast("long") + i
    around = F.array(*(F.struct(at("x", i).alias("x"), at("y", j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    d = F.sqrt(F.pow(F.col("l.x") - F.col("r.x"), F.lit(2.0)) + F.pow(F.col("l.y") - F.col("r.y"), F.lit(2.0)))
    both = beside(points, F.struct(at("x").alias("x"), at("y").alias("y")), around)
    return both.where("l.id < r.id").withColumn("d", d).where(F.col("d") <= radius)


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (a < b, d) of ``points`` (id, x, y) at most ``radius`` apart."""
    return near_points(points.select("id", "x", "y"), radius).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "d")


BLOCK = 1_000  # points of a cell that are compared with another block at once


def met_once(points: DataFrame, cell: Column, ahead: Callable[[Column], Column] | None = None) -> DataFrame:
    """(l_<column>, r_<column>): rows of ``points`` (id, ...) that share a cell, or whose cells meet, each two once and in
    no order; rows of one id never meet.

    ``ahead``: the cells that a cell meets beside its own; of two cells only one may name the other. Cells are cut into
    blocks, so both sides are copied once for each block that they meet and a task compares two blocks at a time, however
    dense a cell is.
    """
    p = points.select("*", cell.alias("cell")).where("id is not null")
    held = written(p.groupBy("cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    a, b = (held.select(F.col("cell").alias(k), F.col("n").alias(f"n_{k}"), F.col("blocks").alias(f"blocks_{k}")) for k in "ab")
    meets = a.join(b, F.col("a") == F.col("b"))
    if ahead is not None:
        meets = meets.unionByName(a.withColumn("to", F.explode(ahead(F.col("a")))).join(b, F.col("to") == F.col("b")).drop("to"))
    meets = written(meets.select("*", (F.col("a") == F.col("b")).alias("own"), F.monotonically_increasing_id().alias("meet")))
    parts = (meets.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0) // (4 * CANDIDATES) + 1
    block = lambda k: F.pmod(F.xxhash64("id"), F.col(f"blocks_{k}"))
    zero = F.lit(0).cast("long")
    side = lambda k: p.join(meets.withColumnRenamed(k, "cell"), "cell").withColumn("block", block(k))
    left = side("a").withColumn("with", F.explode(F.sequence(F.when(F.col("own"), F.col("block")).otherwise(zero), F.col("blocks_b") - 1)))
    left = left.select("meet", (F.col("block") * F.col("blocks_b") + F.col("with")).alias("slot"), (F.col("own") & (F.col("block") == F.col("with"))).alias("same"), *(F.col(c).alias(f"l_{c}") for c in points.columns))
    right = side("b").withColumn("with", F.explode(F.sequence(zero, F.when(F.col("own"), F.col("block")).otherwise(F.col("blocks_a") - 1))))
    right = right.select("meet", (F.col("with") * F.col("blocks_b") + F.col("block")).alias("slot"), *(F.col(c).alias(f"r_{c}") for c in points.columns))
    both = left.repartition(parts, "meet", "slot").hint("merge").join(right.repartition(parts, "meet", "slot"), ["meet", "slot"])
    return both.where((F.col("l_id") < F.col("r_id")) | (~F.col("same") & (F.col("l_id") > F.col("r_id")))).drop("meet", "slot", "same")


def near_on_sphere(points: DataFrame, metres: float) -> DataFrame:
    """(l_<column>, r_<column>, metres): rows of ``points`` (id, lat, lon, ...) at most ``metres`` apart on the sphere, each two once.

    Cells are degrees: half as high as the distance, and half as wide as it is at the latitude farthest from the equator,
    where a degree of longitude is shortest; they close around the globe. Chords tell the pairs, and the sphere's distance
    decides where a chord is too near the limit to tell.
    """
    far = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    exact = math.sin(min(math.pi / 2, metres / (2 * K.EARTH_M)))
    half = exact * (1 + 1e-9) + 1e-12
    high = 2 * math.degrees(math.asin(min(1.0, half)))
    narrow = math.cos(math.radians(min(90.0, far)))
    wide = 2 * math.degrees(math.asin(half / narrow)) if half < narrow else 360.0
    n = int(720 // (wide * (1 + 1e-9)))
    n = n if n > 4 else 1  # fewer than five cells are all beside each other
    x, y = F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / (360.0 / n)).cast("long"), F.floor(F.col("lat") / (high / 2)).cast("long")
    place = lambda x, y: F.struct(F.pmod(x, F.lit(n)).cast("long").alias("x"), y.cast("long").alias("y"))
    steps = [(i, j) for i in range(-2, 3) for j in range(3) if (j, i) > (0, 0) and (n > 1 or i == 0)]
    ahead = lambda c: F.array(*(place(c["x"] + i, c["y"] + j) for i, j in steps))
    lat, lon = F.radians("lat"), F.radians("lon")
    own = points.select("*", F.cos(lat).alias("cos"), (F.cos(lat) * F.cos(lon)).alias("ux"), (F.cos(lat) * F.sin(lon)).alias("uy"), F.sin(lat).alias("uz"))
    apart = lambda c: F.col(f"l_{c}") - F.col(f"r_{c}")
    squared = sum((apart(c) * apart(c) for c in ("uy", "uz")), apart("ux") * apart("ux"))
    s, t = F.sin(F.radians(apart("lat")) / 2), F.sin(F.radians(apart("lon")) / 2)
    d = 2 * K.EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), s * s + F.col("l_cos") * F.col("r_cos") * (t * t))))
    surely = 4 * max(0.0, exact * (1 - 1e-9) - 1e-12) ** 2
    near = met_once(own, place(x, y), ahead).where((squared <= 4 * half * half) & ((squared < surely) | (d <= metres)))
    return near.withColumn("metres", d).drop(*(f"{k}_{c}" for k in "lr" for c in ("cos", "ux", "uy", "uz")))


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """left (keys, lid, lts) with right (keys, rid, rts) at most ``minutes`` apart: time buckets as an equi key with neighbour probes."""
    size = minutes * 60
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / size)
    a = left.withColumn("bucket", bucket("lts"))
    b = right.withColumn("bucket", F.explode(F.sequence(bucket("rts") - 1, bucket("rts") + 1)))
    apart = F.abs(F.unix_micros(F.col("lts").cast("timestamp")) - F.unix_micros(F.col("rts").cast("timestamp")))
    return a.join(b, [*keys, "bucket"]).where(apart <= size * 1_000_000).drop("bucket").withColumn("apart_us", apart)


def next_event(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Forward as-of: for each row of left (key, lid, lts) the first rts >= lts of right (key, rts).

    One shuffle by key: both sides in one stream, then the next right time by a window; no inequality join.
    """
    both = left.select(key, "lid", F.col("lts").alias("t"), F.lit(0).alias("side")).unionByName(right.select(key, F.lit(None).cast("long").alias("lid"), F.col("rts").alias("t"), F.lit(1).alias("side")))
    # from the latest time back: a frame that grows costs a step a row, one that shrinks is read anew for every row
    w = W.partitionBy(key).orderBy(F.desc("t"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    nxt = F.last(F.when(F.col("side") == 1, F.col("t")), ignorenulls=True).over(w)
    return both.withColumn("next_ts", nxt).where("side = 0").select(key, "lid", F.col("t").alias("lts"), "next_ts")


def diff(old: DataFrame, new: DataFrame, key: str, value: str, delta: float) -> DataFrame:
    """Full-outer change set: NEW, CLEARED, CONFIDENCE_UP, CONFIDENCE_DOWN, UNCHANGED."""
    o, n = old.select(F.col(key).alias("ok"), F.col(value).alias("ov")), new.select(F.col(key).alias("nk"), F.col(value).alias("nv"))
    kind = F.when(F.col("ok").isNull(), "NEW").when(F.col("nk").isNull(), "CLEARED").when(F.col("nv") - F.col("ov") > delta, "CONFIDENCE_UP").when(F.col("ov") - F.col("nv") > delta, "CONFIDENCE_DOWN").otherwise("UNCHANGED")
    return o.join(n, F.col("ok") == F.col("nk"), "full_outer").select(F.coalesce("ok", "nk").alias(key), kind.alias("change"))
