"""Scalar expressions against hand values and grids."""

from pyspark.sql import functions as F

from kelora.functions import constants as K
from kelora.functions import risk, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_clock(spark):
    for given, want in (("07:05", 25500), ("25:00:30", 90030), ("7:5", None), ("10:61", None), ("", None)):
        assert one(spark, text.clock_seconds(F.lit(given))) == want
    assert one(spark, text.clock_text(F.lit(-60))) == "23:59"
    assert one(spark, text.clock_text(F.lit(90060))) == "01:01"


def test_fnv(spark):
    assert one(spark, text.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, text.fnv1a(F.lit("foobar"))) == 0xBF9CF968


def test_half_up(spark):
    assert one(spark, risk.half_up(F.lit(-2.5))) == -2
    assert one(spark, risk.half_up(F.lit(2.5))) == 3


def test_weight_is_monotone_and_hits_its_knots(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("c")).select("c", risk.knot_weight(F.col("c")).alias("w")).orderBy("c").collect()
    assert all(a.w <= b.w for a, b in zip(rows, rows[1:]))
    for x, y in K.KNOTS:
        assert abs(one(spark, risk.knot_weight(F.lit(x))) - y) < 1e-9


def test_confidence_grows_with_authors_and_shrinks_with_denial(spark):
    c = lambda n, denied=False, unresolved=False: one(spark, risk.calibrated(F.lit(n), F.lit(1.0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(unresolved), F.lit(denied), F.lit(False)))
    values = [c(n) for n in range(9)]
    assert values == sorted(values) and values[1] == 0.22 and values[6] == values[8] == 0.6
    assert c(6, denied=True) == 0.15 and c(6, unresolved=True) == 0.45


def test_bands_and_walk(spark):
    assert [one(spark, risk.band(F.lit(x))) for x in (0.9, 0.65, 0.4, 0.2, 0.1)] == ["VERY_HIGH", "HIGH", "MODERATE", "LOW", "VERY_LOW"]
    assert [one(spark, risk.walk_seconds(F.lit(m))) for m in (0.0, 120.0, 5000.0)] == [120, 220, 900]


def test_haversine(spark):
    assert abs(one(spark, risk.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111195.08) < 0.5


def test_typo_distance(spark, sf):
    from functools import lru_cache

    from kelora import catalog
    from kelora.functions import text

    def brute(a, b):
        @lru_cache(None)
        def d(i, j):
            if not i or not j:
                return i + j
            best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
            return min(best, d(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else best

        return d(len(a), len(b))

    assert text.swaps_counted("abcd", "abdc") == 1 and text.swaps_counted("ca", "abc") == 3 and text.swaps_counted("", "ab") == 2
    rows = catalog.QUERIES["q_str08_typo_distance"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert len(rows) == 2 * n - 1
    for r in rows:
        want = brute(r.p_name, r.mention)
        assert r.distance == (want if want <= (2 if len(r.p_name) >= 8 else 1) else None)


def test_greedy_matches_and_clusters_against_plain_loops(spark):
    import datetime as dt

    import numpy as np

    from kelora.operators import cluster

    rng, at = np.random.default_rng(2), lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m))
    left = [(int(u), i, at(m)) for i, (u, m) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 9000, 60)))]
    right = [(int(u), 100 + i, at(m)) for i, (u, m) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 9000, 60)))]
    pairs = [(u, i, a, j, b, int(abs((a - b).total_seconds()) * 1_000_000)) for u, i, a in left for v, j, b in right if u == v and abs((a - b).total_seconds()) <= 360 * 60]
    kinds = "user_id long, lid long, lts timestamp_ntz, rid long, rts timestamp_ntz, apart_us long"
    got = {r.lid: r.rid for r in cluster.greedy_matches(spark.createDataFrame(pairs, kinds), "user_id").collect()}
    taken, want = set(), {}
    for _, i, _ in sorted(left, key=lambda x: x[1]):
        for p in sorted((p for p in pairs if p[1] == i), key=lambda p: (p[5], p[3])):
            if p[3] not in taken:
                taken.add(p[3])
                want[i] = p[3]
                break
    assert got == want and len(want) > 10

    seen = [(i, int(line), int(seg), at(m)) for i, (line, seg, m) in enumerate(zip(rng.integers(0, 2, 120), rng.integers(0, 6, 120), rng.integers(0, 4000, 120)))]
    out = cluster.clusters(spark.createDataFrame(seen, "id long, line long, segment long, ts timestamp_ntz")).collect()
    named = {r.id: (r.line, r.block, r.cluster) for r in out}
    made: list = []
    plain = {}
    for i, line, seg, t in sorted(seen, key=lambda x: (x[3], x[0])):
        open_ = [c for c in made if c[0] == line and t - c[1] <= dt.timedelta(minutes=90)]
        best = max(open_, key=lambda c: 4 * (seg in c[2]) + 1, default=None)
        if best is None:
            best = [line, t, set(), len(made)]
            made.append(best)
        best[1] = t
        best[2].add(seg)
        plain[i] = best[3]
    assert len(set(named.values())) == len(made)
    assert all((named[i] == named[j]) == (plain[i] == plain[j]) for i in plain for j in plain)
