"""Column expressions of the risk model: confidence, penalties, arrival windows, scores. All run inside codegen."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions.text import let


def lookup(col: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col), F.lit(default)) if default is not None else F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col)


def tiers(col: Column, steps, otherwise: str) -> Column:
    """The name of the first step that ``col`` reaches."""
    return F.coalesce(*(F.when(col >= at, F.lit(name)) for at, name in steps), F.lit(otherwise))


def band(confidence: Column) -> Column:
    return tiers(confidence, K.BANDS, "VERY_LOW")


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def noisy_or(*channels: Column) -> Column:
    return 1 - reduce(lambda a, b: a * b, [1 - c for c in channels])


def noisy_or_agg(p: Column) -> Column:
    """Aggregate: 1 - product(1 - p)."""
    return 1 - F.product(1 - p)


def social_strength(authors: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, K.SOCIAL)), (F.least(authors, F.lit(len(K.SOCIAL) - 1)) + 1).cast("int"))


def recency(minutes: Column, window: int = K.WINDOW_MINUTES) -> Column:
    """1 inside the window, then linear down to the floor three windows later."""
    return F.when(minutes <= window, F.lit(1.0)).otherwise(F.greatest(F.lit(K.STALE_FLOOR), 1 - (minutes - window) / (3.0 * window) * (1 - K.STALE_FLOOR)))


def calibrated(authors: Column, quality: Column, minutes: Column, official: Column, realtime: Column, unresolved: Column, denied: Column, offline: Column) -> Column:
    """Confidence of a cluster of evidence, 0 to 1, rounded to six places."""
    value = noisy_or(social_strength(authors) * quality * recency(minutes), F.lit(K.OFFICIAL) * official, F.least(realtime * K.REALTIME_EACH, F.lit(K.REALTIME_CAP)))
    value = value * F.when(unresolved, K.UNRESOLVED).otherwise(1.0) * F.when(denied, K.DENIAL).otherwise(1.0) * F.when(offline, K.OFFLINE).otherwise(1.0)
    return F.round(F.when(unresolved, F.least(value, F.lit(K.UNRESOLVED_CAP))).otherwise(value), 6)


def knot_weight(confidence: Column) -> Column:
    """Piecewise-linear weight of a confidence. Slopes are quotients of exact differences."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    exact = lambda a, b: float(Decimal(str(a)) - Decimal(str(b)))
    out = None
    for (x0, y0), (x1, y1) in zip(K.KNOTS, K.KNOTS[1:]):
        line = F.lit(y0) + (c - x0) * (exact(y1, y0) / exact(x1, x0))
        out = F.when(c <= x1, line) if out is None else out.when(c <= x1, line)
    return out


def penalty_seconds(severity: Column, issue: Column, confidence: Column, run: Column) -> Column:
    """Whole seconds, rounded half up. The factor of severity and issue is an exact decimal before it becomes a double,
    and factors are multiplied from left to right, so a product that lies on a half does not fall below it."""
    one = lambda x: Decimal(str(x))
    known = {(s, i): float((one(m) - 1) * one(w)) for s, m in K.SEVERITY.items() for i, w in K.ISSUE.items()}
    other = float(one(0.5))  # weight of an issue that is not listed
    of = lambda s: F.coalesce(lookup(issue, {i: known[s, i] for i in K.ISSUE}), F.lit(float((one(K.SEVERITY[s]) - 1) * one(other))))
    factor = F.lit(0.0)
    for s in K.SEVERITY:
        factor = F.when(severity == s, of(s)).otherwise(factor)
    return half_up(factor * knot_weight(confidence) * run)


def arrival_window(mu: Column, legs: Column, scheduled: Column) -> Column:
    """struct(mean, p10, p90) of the arrival; p10 is never before the timetable."""
    jitter = F.lit(K.JITTER) + K.JITTER_ROOT * F.sqrt(legs)
    sigma = F.sqrt(F.pow(K.SPREAD * mu, F.lit(2.0)) + jitter * jitter)
    mean = scheduled + mu
    return F.struct(mean.alias("mean"), F.greatest(scheduled, mean - K.Z90 * sigma).alias("p10"), (mean + K.Z90 * sigma).alias("p90"))


def router_score(exposure: Column, delay_share: Column, transfers: Column) -> Column:
    return 1 - 0.55 * exposure - 0.3 * delay_share - 0.1 * F.least(F.lit(1.0), transfers / 4.0)


def walk_seconds(metres: Column) -> Column:
    return half_up(F.greatest(F.lit(K.WALK_BASE), F.least(F.lit(K.WALK_CAP), K.WALK_BASE + metres / K.WALK_SPEED)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = K.EARTH_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def consequence(severity: Column, issue: Column) -> Column:
    """Weight of a disruption's consequence, 0 to 1."""
    worst = max(K.SEVERITY.values()) - 1
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lookup(severity, K.SEVERITY, 1.0) - 1) / worst * lookup(issue, K.ISSUE, 0.5)))


def _times32(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2^32, in halves so that no long overflows."""
    mask = F.lit((1 << 32) - 1)
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16).cast("long")
    return (high + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(mask)


def draw(seed: Column, n: Column) -> Column:
    """The n-th uniform draw (from 0) of the mulberry32 generator, seeded by the first 32 bits of SHA-256."""
    mask = F.lit((1 << 32) - 1)
    start = F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    a = (start + (n + 1) * F.lit(0x6D2B79F5)).bitwiseAND(mask)
    once = lambda a: _times32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    twice = lambda b: b.bitwiseXOR((b + _times32(b.bitwiseXOR(F.shiftright(b, 7)), b.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    # each step names the one before it several times; the seed is hashed once
    return let(let(let(a, once), twice), lambda c: c.bitwiseXOR(F.shiftright(c, 14))) / 4294967296.0
