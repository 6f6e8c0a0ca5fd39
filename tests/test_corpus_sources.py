"""Captures, scenarios, network snapshots, stop lists and the insert-if-absent sink on small files."""

import json

import pytest
from pyspark.sql import functions as F

from kelora.sources import corpus
from kelora.streaming import positions


def test_records_and_scenario(spark, tmp_path):
    ok = {"id": "a", "text": "x", "sourceClass": "SOCIAL", "publishedAt": "t", "retrievedAt": "t"}
    (tmp_path / "c.json").write_text(json.dumps({"posts": [ok, ok | {"id": ""}, ok | {"id": "b", "sourceClass": "OTHER"}, {"id": "n"}], "statements": [ok | {"id": "s", "sourceClass": "OFFICIAL_STATEMENT"}]}, indent=1))
    r = corpus.records(spark, str(tmp_path / "c.json"))
    assert sorted(x.id for x in r.collect()) == ["a", "s"]
    (tmp_path / "s.json").write_text(json.dumps({"scenarios": [{"id": "one", "now": "t", "sourceIds": ["s", "a"]}, {"id": "bad", "now": "t", "sourceIds": ["zz"]}]}))
    at = str(tmp_path / "s.json")
    assert [x.id for x in corpus.scenario(spark, at, "one", r).orderBy("place").collect()] == ["s", "a"]
    with pytest.raises(ValueError):
        corpus.scenario(spark, at, "none", r)
    with pytest.raises(Exception, match="unknown record"):
        corpus.scenario(spark, at, "bad", r).collect()


def test_snapshot(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"lines": [{"id": "L"}, {"mode": "x"}], "stations": [{"id": "A", "lat": 1.5}], "segments": [{"id": "1", "lineId": "L"}, {"id": "2"}]}))
    t = corpus.snapshot(spark, str(tmp_path / "n.json"))
    assert t["lines"].first().mode == "LRT" and t["lines"].count() == 1
    assert t["stations"].first().lat == 1.5 and t["stations"].first().lon == 0
    assert [(s.id, s.scheduledRunSeconds, s.scheduledDwellSeconds) for s in t["segments"].collect()] == [("1", 120.0, 18.0)]


def test_stop_lists(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name,route_id\nA, Alpha One ,R\nA,Other,R\n\nB,,R\nC,Gamma,Q\n')
    got = {r.stop_id: (r.name, r.key) for r in corpus.stop_index(spark, str(tmp_path / "stops.txt")).collect()}
    assert got == {"A": (" Alpha One ", "alpha-one"), "C": ("Gamma", "gamma")}
    assert corpus.plain(spark, str(tmp_path / "stops.txt")).first().stop_name == " Alpha One "
    (tmp_path / "bad.txt").write_text("a,b\n")
    with pytest.raises(ValueError):
        corpus.stop_index(spark, str(tmp_path / "bad.txt"))
    trips, routes = corpus.mapped(spark.createDataFrame([("r", 1), ("q", 2)], "route_id string, trip int"), spark.createDataFrame([("r",), ("q",)], "route_id string"), {"R": "KJ"})
    assert [(t.trip, t.line) for t in trips.collect()] == [(1, "KJ")] and routes.count() == 1


def test_compact(spark, tmp_path):
    stops = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "stop_id string, lat double")
    p = spark.createDataFrame([("x", 300, ["B", "A"], [60]), ("y", 0, ["A", "Z"], [])], "pattern string, headway int, stops array<string>, runs array<int>")
    assert sorted(tuple(r) for r in corpus.compact_problems(p, stops).collect()) == [("y", "lengths differ"), ("y", "no frequency"), ("y", "unknown stop Z")]
    corpus.write_compact(stops, p.where("pattern = 'x'"), str(tmp_path / "c"))
    assert [s.stop_id for s in spark.read.parquet(str(tmp_path / "c")).first().stops] == ["B", "A"]
    corpus.write_corpus(stops, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_insert_absent(spark, tmp_path):
    sink = positions.insert_absent(str(tmp_path), ["id"])
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    sink(df, 0)
    sink(df.where("false"), 1)
    sink(df.withColumn("id", F.col("id") + 1), 2)
    sink(df.withColumn("id", F.col("id") + 1), 2)  # repeated after a failure
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [1, 2, 3]
    assert sorted((r.batch, r.seen, r.written) for r in spark.read.parquet(str(tmp_path / "cycles")).collect()) == [(0, 3, 2), (1, 0, 0), (2, 3, 1)]
