"""What the third round of findings showed: each test failed before its finding was mended."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from kelora import catalog
from kelora.functions import constants as K
from kelora.functions import phrases, rulings, text
from kelora.operators import cluster, places, relational, routing, scan
from kelora.plans import composites, reports
from kelora.plans import rulings as rulings_plans


def against_sql(spark, folder, name, columns):
    """Rows of a query and of its SQL over the parquet files of ``folder``, by their first column."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = sorted(con.execute(f"select {columns} from ({catalog.ORACLES[name]})").fetchall(), key=repr)
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).selectExpr(*columns.split(", ")).collect()), key=repr), want


@pytest.mark.parametrize("name", ["q_mth07_penalty", "q_jon14_overlay_penalty", "q_mth22_priced_risk"])
def test_penalties_on_a_half(spark, tmp_path, name):
    """Parts of every type and size at prices whose penalties lie on a half: 0.15 * 0.2 * 250 + 0.5 is 8, not just below it."""
    duckdb.sql(f"""COPY (SELECT row_number() OVER () AS p_partkey, t AS p_type, CAST(s AS INTEGER) AS p_size, 900 + n * 12.5::DOUBLE AS p_retailprice
     FROM (SELECT unnest(['ECONOMY', 'SMALL', 'STANDARD', 'PROMO']) AS t), range(1, 51) a(s), range(160) b(n)) TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    got, want = against_sql(spark, tmp_path, name, "p_partkey, penalty_seconds")
    assert len(want) == 32000 and got == want


def test_alternative_paths_keep_to_their_bound(spark):
    """A path of six cheap edges is too long for a bound of four; a dearer, shorter way to a station on it counts then."""
    edges = [(i, i + 1, 10, 0, i, i) for i in range(6)] + [(0, 3, 45, 0, 10, 10), (3, 6, 200, 0, 11, 11), (0, 6, 9000, 0, 12, 12)]
    net = spark.createDataFrame(edges, "a long, b long, seconds long, penalty long, segment long, name long")
    asked = spark.createDataFrame([("r", 0, 6, 2)], "run string, origin long, dest long, transfers long")

    def paths(**bound):
        found: dict = {}
        for r in scan.alternatives(asked, net, **bound).orderBy("rank", "hop").collect():
            found.setdefault(r["rank"], []).append(r.segment)
        return list(found.values())

    assert paths()[:2] == [[0, 1, 2, 3, 4, 5], [10, 3, 4, 5]]
    assert paths(longest=4)[0] == [10, 3, 4, 5] and all(len(p) <= 4 for p in paths(longest=4))
    assert paths(longest=2)[0] == [10, 11] and paths(longest=1) == [[12]]


@pytest.mark.parametrize("lat, lon", [(3.0, 101.0), (51.0, 179.9985), (-60.0, -70.0)])
def test_walks_far_from_the_prime_meridian(spark, lat, lon):
    """At 101 degrees east a step north moves a point sideways on a plane that counts longitudes from zero; cells also
    close at 180 degrees."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, f"S{i}", lat + float(a), (lon + float(b) + 180) % 360 - 180) for i, (a, b) in enumerate(rng.uniform(0, 0.008, (80, 2)))]
    h = lambda p, q: math.sin(math.radians(q[3] - p[3]) / 2) ** 2 + math.cos(math.radians(p[3])) * math.cos(math.radians(q[3])) * math.sin(math.radians(q[4] - p[4]) / 2) ** 2
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] != q[1] and 2 * K.EARTH_M * math.asin(math.sqrt(h(p, q))) <= places.WALKABLE)
    got = sorted((r.a, r.b) for r in places.walkable(spark.createDataFrame(rows, "id long, line long, name string, lat double, lon double")).collect())
    assert got == want and len(want) > 100


def test_dense_cells_are_cut_into_slices(spark, monkeypatch):
    """All points in one cell: the pairs are dealt to many tasks, none is lost or told twice, a point's pairs stay together."""
    monkeypatch.setattr(relational, "CANDIDATES", 50)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(5).uniform(0, 300, (60, 2)))]
    near = relational.near_points(spark.createDataFrame(pts, "id long, x double, y double"), 100.0)
    assert near.rdd.getNumPartitions() > 4
    rows = near.selectExpr("l.id as a", "r.id as b", "cell", "slice").collect()
    want = sorted((p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and math.dist(p[1:], q[1:]) <= 100)
    assert sorted((r.a, r.b) for r in rows) == want
    assert len({r.slice for r in rows}) > 1 and all(len({(r.cell, r.slice) for r in rows if r.a == i}) <= 1 for i in range(60))


def test_rows_are_dealt_before_their_texts_are_read(spark, sf):
    """The events of one small file are parsed by every core, not by the one task that reads the file."""
    for rows in (reports.reports(spark, sf), composites.statements(spark, sf), rulings_plans.statements(spark, sf)):
        assert rows.rdd.getNumPartitions() >= 32


def test_literals_before_patterns_change_nothing(spark):
    """Every pattern of the tables finds the same texts with its literals asked for first."""
    said = spark.createDataFrame([(x.upper(),) for x in (*reports.SAYINGS, *composites.STATED, *rulings_plans.PHRASES, "LAST YEAR 2019 LOL /S", "R.I.P", "CREDIT TO:")], "x string")
    patterns = [r[0] for t in (phrases.ISSUES, phrases.SEVERITIES, phrases.PAST, phrases.SARCASM, phrases.JOKE, phrases.STALE, phrases.REPOST) for r in t]
    patterns += [phrases.RECOVERY, phrases.ONGOING, phrases.NOW, phrases.PAST_YEAR, *(r[3] for r in rulings.RULES)]
    both = said.select(*(F.sum((text.matches(F.col("x"), p) != F.col("x").rlike(p)).cast("int")) for p in patterns)).first()
    assert not any(both) and sum(bool(text.required(p)) for p in patterns) > 150
    assert text.required("a|b*") == () and text.required("(?i)abc") == () and text.required("(?:AB|CDE)+F?") == ("AB", "CDE") and text.required(r"[\x{1F602}]{2,}") == ()


def test_walks_along_a_long_line_do_not_recurse(spark):
    """Stations one after the other: a walk over 3,000 of them was a recursion as deep."""
    asked = spark.createDataFrame([("r", 0, 3000, 0, 4, False, None)], "run string, origin long, dest long, depart long, transfers long, risk boolean, bans array<long>")
    none = spark.createDataFrame([], "a long, b long, dep long, arr long, trip long, line long, segment long, multiplier double, penalty double")
    on_foot = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(2).cast("long").alias("seconds"))
    hops = scan.searched(scan.requests_table(asked, none, on_foot)).collect()
    assert len(hops) == 3000 and {h.effective for h in hops} == {6000.0}


def test_greedy_match_builds_no_pairs(spark, tmp_path):
    """20,000 errors and as many purchases of one user within six hours: 400 million pairs, which one group held before."""
    n, rng = 20_000, np.random.default_rng(6)
    lts, rts = rng.integers(0, 20_000, n), rng.integers(0, 20_000, n)
    duckdb.from_arrow(pa.table({"k": np.arange(2 * n), "s": np.concatenate([lts, rts])})).query("e", f"""COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, 7::BIGINT AS user_id,
     CASE WHEN k < {n} THEN 'error' ELSE 'purchase' END AS event_type FROM e) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    free, want = rts.astype("float64"), {}
    for i, t in enumerate(lts):
        r = int(np.abs(free - t).argmin())  # the first of equal ones
        want[i], free[r] = n + r, np.inf
    assert {r.lid: r.rid for r in catalog.QUERIES["q_jon25_greedy_match"](spark, str(tmp_path)).collect()} == want


def test_nearest_matches_are_those_of_all_pairs(spark):
    """Ties of time and distance, gaps of the limit and just over it, repeated and missing values; ids in no order of time."""
    rng = np.random.default_rng(7)
    at = lambda n: (np.cumsum(rng.choice([0, 20, 60, 61, 400], n, p=[0.3, 0.3, 0.2, 0.1, 0.1])) * 60).tolist()
    rows = lambda first: [(int(k), int(i), s) for k in range(8) for i, s in zip(first + 1000 * k + rng.permutation(60), at(60))]
    left, right = rows(0), rows(100)
    left, right = [*left, *left[:5], (1, None, 60), (None, 9000, 60)], [*right, *right[:5], (1, 9001, None)]
    frame = lambda r, i, t: spark.createDataFrame(r, f"k long, {i} long, s long").select("k", i, F.timestamp_seconds("s").cast("timestamp_ntz").alias(t))
    left, right = frame(left, "lid", "lts"), frame(right, "rid", "rts")
    whole = lambda x, i, t: x.where(f"k is not null and {i} is not null and {t} is not null")
    pairs = relational.interval_pairs(whole(left, "lid", "lts"), whole(right, "rid", "rts"), ["k"], 60)
    want = sorted(tuple(r) for r in cluster.greedy_matches(pairs, "k").collect())
    assert sorted(tuple(r) for r in cluster.nearest_matches(left, right, "k", 60).collect()) == want and len(want) > 150


def test_diverse_journeys_look_at_no_trip_in_vain(spark, monkeypatch):
    """200 trips leave the hub where the way changes; only the two that call at the destination are looked at."""
    stops = [("A", 1, 1, 29000), ("H", 1, 2, 29300), *((s, t, n, 29400 + n) for t in range(10, 210) for n, s in ((1, "H"), (2, "X"), (3, "Y"))), ("H", 300, 1, 29400), ("D", 300, 2, 29900), ("H", 301, 1, 29500), ("D", 301, 2, 30000)]
    stops = spark.createDataFrame([(t, n, s, at, t % 7) for s, t, n, at in stops], "trip long, seq int, station string, time long, line long")
    asked = spark.createDataFrame([("q", "A", 28800, "D")], "query string, station string, depart long, dest string")
    most, real = [], routing.written

    def counted(df):
        out = real(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(routing, "written", counted)
    got = [(r["rank"], r.arrival, r.trips) for r in routing.diverse(asked, stops, 2).orderBy("rank").collect()]
    assert got == [(1, 29900, [1, 300]), (2, 30000, [1, 301])] and max(most) <= 6


def test_diverse_journeys_of_a_dense_network(spark, tmp_path):
    """Few stations, many trips that call at one twice, equal arrivals: as in the SQL."""
    duckdb.sql(f"COPY (SELECT s::BIGINT AS s_suppkey FROM range(110) r(s)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    duckdb.sql(f"""COPY (SELECT o::BIGINT AS l_orderkey, hash(o, n, 1)::HUGEINT % 60 + CASE WHEN hash(o, n, 2) % 3 = 0 THEN 50 ELSE 0 END AS l_suppkey, n::INTEGER AS l_linenumber, 1::BIGINT AS l_partkey,
     1.0::DOUBLE AS l_extendedprice, 1.0::DOUBLE AS l_quantity, TIMESTAMP '1995-01-01' + to_days((hash(o, n, 3)::HUGEINT % 9)::INTEGER) AS l_shipdate FROM range(6000) a(o), range(1, 8) b(n)) TO '{tmp_path}/parts.parquet' (FORMAT parquet)""")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_suppkey::BIGINT AS l_suppkey) FROM '{tmp_path}/parts.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = against_sql(spark, tmp_path, "q_gra02_diverse_journeys", "query, arrival, trips, rank")
    assert got == want and len(want) > 4
