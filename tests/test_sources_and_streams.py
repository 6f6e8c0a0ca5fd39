"""Feeds, snapshots, streams, clustering, matching and routing on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from kelora import catalog
from kelora.operators import aliases, cluster, graph, relational, routing
from kelora.plans.further import STATUS
from kelora.sources import gtfs, snapshots
from kelora.streaming import incidents, positions

FILES = {
    "stops": "stop_id,stop_name,stop_lat,stop_lon\nA, Alpha ,3.1,101.5\nB,\"Be\"\"ta, x\",oops,101.6\nC,Gamma,3.2,\n",
    "routes": "route_id,route_type\nR,1\n",
    "trips": "route_id,service_id,trip_id,trip_headsign,direction_id\nR,WD,T1,x,0\nR,WE,T2,x,\n",
    "frequencies": "trip_id,start_time,end_time,headway_secs\nT1,06:00:00,07:00:00,600\nT2,06:00:00,07:00:00,600\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,00:00:00,00:00:00,A,1\nT1,00:02:00,00:02:30,B,2\nT1,00:05:00,00:05:00,C,3\nT2,0:00:00,0:00:00,A,1\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20240101,20241231\nWE,0,0,0,0,0,true,yes,20240101,20241231\n",
}


def feed(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / f"{name}.txt").write_text(("﻿" if name == "stops" else "") + body, encoding="utf-8")
    return gtfs.feed(spark, str(tmp_path))


def test_feed(spark, tmp_path):
    t = feed(spark, tmp_path)
    rows = {r.stop_id: r for r in t["stops"].collect()}
    assert rows["A"].stop_name == "Alpha" and rows["B"].stop_name == 'Be"ta, x' and rows["B"].stop_lat is None
    assert "shapes" not in t and t["calendar"].where("weekdays[0]").count() == 1


def test_window_expansion_equals_filtered_full_expansion(spark, tmp_path):
    t = feed(spark, tmp_path)
    full = gtfs.connections(t, 1, 0, 200_000)
    window = gtfs.connections(t, 1, 22_000, 23_500)
    assert full.count() == 12 and sorted(window.collect()) == sorted(full.where("departure between 22000 and 23500").collect())
    assert gtfs.connections(t, 3, 0, 10).count() == 0


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, s string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 5, "d"), (1, 0, "z")], "id int, v int, s string")
    out = snapshots.upserted(old, new, ["id"], "v")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "a"), (2, 1, "c"), (3, 5, "d")]
    root = str(tmp_path / "snap")
    snapshots.write(old, root, 1)
    snapshots.write(out, root, 2)
    assert snapshots.read(spark, root).count() == 3 and snapshots.read(spark, root, "9").count() == 0
    snapshots.ndjson(old, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").limit(300)
    twice = e.unionByName(e.limit(100)).coalesce(1).sortWithinPartitions("ts")
    twice.write.parquet(str(tmp_path / "in"))
    s = positions.source(spark, str(tmp_path / "in"), e.schema)
    positions.run(positions.deduped(s, "60 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = e.withColumn("content_hash", positions.content_hash()).select("content_hash").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
    seen = []
    positions.each_batch(s, lambda df, n: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == e.count() + 100


def test_clusters_and_matches(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    rows = [(1, 1, 5, at(0)), (2, 1, 6, at(60)), (3, 1, 5, at(140)), (4, 1, 5, at(400)), (5, 2, 5, at(0))]
    got = {r.id: (r.line, r.block, r.cluster) for r in cluster.clusters(spark.createDataFrame(rows, "id long, line long, segment int, ts timestamp_ntz")).collect()}
    assert got[1] == got[2] == got[3] == (1, 1, 0) and got[4] == (1, 2, 0) and got[5] == (2, 1, 0)
    left, right = {1: 0, 2: -4, 3: 4, 4: 900}, {10: 5, 11: -3, 12: 903}  # times; 4 and 12 lie apart from all others
    met = [(1, 10), (1, 11), (2, 11), (2, 10), (3, 10), (4, 12)]
    pairs = spark.createDataFrame([(0, i, left[i], j, right[j], abs(left[i] - right[j])) for i, j in met], "k int, lid long, lts long, rid long, rts long, apart_us long")
    assert sorted(tuple(r) for r in cluster.greedy_matches(pairs, "k").collect()) == [(1, 11), (2, 10), (4, 12)]


def test_next_event_and_components(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, 1, t), (1, 2, t + dt.timedelta(hours=5))], "u long, lid long, lts timestamp_ntz")
    right = spark.createDataFrame([(1, t), (1, t + dt.timedelta(hours=1))], "u long, rts timestamp_ntz")
    got = {r.lid: r.next_ts for r in relational.next_event(left, right, "u").collect()}
    assert got == {1: t, 2: None}
    nodes = spark.range(1, 8).select("id")
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 6), (4, 4)], "a long, b long")
    assert {r.id: r.root for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_routing(spark):
    stops = spark.createDataFrame([("x", 1, "A", 100, 0), ("x", 2, "B", 200, 0), ("y", 1, "B", 250, 0), ("y", 2, "C", 300, 0), ("z", 1, "B", 270, 0), ("z", 2, "C", 400, 0)], "trip string, seq int, station string, time int, run int")
    q = spark.createDataFrame([(1, "A", 90)], "query int, station string, depart int")
    got = {r.station: (r.arrival, r.rides) for r in routing.earliest_arrivals(q, stops, None, 2).collect()}
    assert got == {"A": (90, 0), "B": (200, 1), "C": (400, 2)}  # 60 s to change: y at 250 is missed
    risky = stops.withColumn("run", F.when(F.col("trip") == "x", 100).otherwise(0))
    assert "C" not in {r.station for r in routing.earliest_arrivals(q, risky, None, 2).collect()}
    walk = spark.createDataFrame([("B", "D", 30)], "a string, b string, seconds int")
    assert {r.station: r.arrival for r in routing.earliest_arrivals(q, stops, walk, 1).collect()}["D"] == 230


def test_incident_stream_equals_batch_fold(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"))
    rows = sorted(e.collect(), key=lambda r: (r.at, r.seq))
    for k in range(3):  # three files, in order of time
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    writer = incidents.upserts(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    writer.foreachBatch(lambda df, n: seen.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in seen:
        if r.reports > last.get((r.id, r.start), (None, 0))[1]:
            last[r.id, r.start] = (r.status, r.reports)
    want = catalog.QUERIES["q_stm08_keyed_upsert"](spark, sf).withColumn("start", F.col("start").cast("timestamp")).collect()
    assert last == {(r.user_id, r.start): (r.status, r.reports) for r in want}


def test_diverse_journeys_avoid_lines(spark):
    stops = spark.createDataFrame([(1, 1, "A", 100, 1), (1, 2, "B", 200, 1), (2, 1, "A", 110, 2), (2, 2, "B", 300, 2), (3, 1, "A", 120, 1), (3, 2, "B", 220, 1)], "trip long, seq int, station string, time int, line long")
    q = spark.createDataFrame([(7, "A", 90, "B")], "query int, station string, depart int, dest string")
    got = [(r.rank, r.arrival, r.trips) for r in routing.diverse(q, stops, 2).orderBy("rank").collect()]
    assert got == [(1, 200, [1]), (2, 300, [2])]


def test_alias_lookup_steps(spark):
    names = spark.createDataFrame([("PASAR SENI",), ("PASAR SENA",), ("KLCC",), (None,)], "alias string")
    said = spark.createDataFrame([("PASAR SENI",), ("PASARSENI",), ("PASAR SENO",), ("APSAR SNEI",), ("KLCX",), (None,)], "mention string")
    got = {r.mention: (r.how, r.aliases) for r in aliases.lookup(said, names).collect()}
    assert got == {"PASAR SENI": ("exact", ["PASAR SENI"]), "PASARSENI": ("compact", ["PASAR SENI"]), "PASAR SENO": ("fuzzy", ["PASAR SENA", "PASAR SENI"]), "APSAR SNEI": ("fuzzy", ["PASAR SENI"])}
