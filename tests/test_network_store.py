"""Networks are written and read back; unsound ones are refused. The evidence corpus and places on small inputs."""

import pytest
from pyspark.sql import functions as F

from kelora.operators.places import places
from kelora.plans import entities
from kelora.sources import corpus, network


def tables(spark, links=(("s1", "L", "a", "b", 120.0), ("s2", "L", "b", "a", 130.0)), stations=(("a", "A", 3.0, 101.0), ("b", "B", 3.1, 101.1))):
    return {
        "lines": spark.createDataFrame([("L", "Line")], "id string, shortName string"), "stations": spark.createDataFrame(list(stations), "id string, name string, lat double, lon double"),
        "segments": spark.createDataFrame(list(links), "id string, lineId string, fromStationId string, toStationId string, scheduledRunSeconds double"),
    }


def test_network_round_trip(spark, tmp_path):
    network.save(tables(spark), str(tmp_path))
    network.save(tables(spark, stations=(("a", "A2", 3.0, 101.0), ("b", "B", 3.1, 101.1))), str(tmp_path))
    got = network.load(spark, str(tmp_path))
    assert sorted(r.name for r in got["stations"].collect()) == ["A2", "B"] and got["segments"].count() == 2


@pytest.mark.parametrize("change, said", [
    ({"links": [("s1", "L", "a", "zz", 120.0)]}, "unknown toStationId of segment s1"), ({"links": [("s1", "M", "a", "b", 120.0)]}, "unknown line of segment s1"), ({"links": [("s1", "L", "a", "a", 120.0)]}, "segment to itself s1"),
    ({"links": [("s1", "L", "a", "b", 0.0)]}, "no running time of segment s1"), ({"stations": [("a", "A", 3.0, None), ("b", "B", 3.1, 101.1)]}, "no place of station a"), ({"stations": [("a", "A", 3.0, 101.0)] * 2 + [("b", "B", 3.1, 101.1)]}, "repeated station a"),
])
def test_unsound_networks_are_refused(spark, tmp_path, change, said):
    network.save(tables(spark, **change), str(tmp_path))
    with pytest.raises(ValueError, match=said):
        network.load(spark, str(tmp_path))


def test_missing_networks_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no network"):
        network.load(spark, str(tmp_path))
    t = tables(spark)
    network.save({**t, "stations": t["stations"].drop("lat")}, str(tmp_path))
    with pytest.raises(ValueError, match="stations.lat"):
        network.load(spark, str(tmp_path))


def test_compact_round_trip(spark, tmp_path):
    stops = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "stop_id string, name string")
    patterns = spark.createDataFrame([("p", 300, ["c", "a", "b"]), ("q", 600, ["a", "b"])], "pattern string, headway int, stops array<string>")
    corpus.write_compact(stops, patterns, f"{tmp_path}/good")
    s, p = network.load_compact(spark, f"{tmp_path}/good")
    assert sorted(map(tuple, s.collect())) == [("a", "A"), ("b", "B"), ("c", "C")] and sorted((r.pattern, r.headway, r.stops) for r in p.collect()) == [("p", 300, ["c", "a", "b"]), ("q", 600, ["a", "b"])]
    corpus.write_compact(stops, patterns.withColumn("headway", F.lit(0)), f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="headway"):
        network.load_compact(spark, f"{tmp_path}/bad")


def test_corpus_is_the_same_whatever_the_partitions(spark, sf, monkeypatch):
    one = sorted(map(str, entities.corpus(spark, sf).collect()))
    whole = entities.read
    monkeypatch.setattr(entities, "read", lambda spark, d, name: whole(spark, d, name).repartition(13))
    assert sorted(map(str, entities.corpus(spark, sf).collect())) == one and len(one) > 100


def test_places_by_name_list_and_distance(spark):
    p = spark.createDataFrame([(1, 0, "x", 0.0, 0.0), (2, 1, "x", 900.0, 900.0), (3, 2, "y", 930.0, 900.0), (4, 3, "z", 5000.0, 0.0), (5, 3, "w", 9000.0, 0.0), (6, 3, "v", 20000.0, 0.0)], "id long, line long, name string, x double, y double")
    listed = spark.createDataFrame([(4, 5)], "a long, b long")
    assert {r.id: r.place for r in places(p, listed).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_index_of_a_snapshot(spark, tmp_path):
    """Platforms a and c share a name, d lies beside b: two places, one of them an interchange."""
    (tmp_path / "n.json").write_text("""{"lines": [{"id": "L", "shortName": "L"}, {"id": "M", "shortName": "M"}], "stations": [{"id": "a", "name": "Hub", "lat": 3.0, "lon": 101.0}, {"id": "b", "name": "B", "lat": 3.1, "lon": 101.1},
        {"id": "c", "name": "Hub", "lat": 3.2, "lon": 101.2}, {"id": "d", "name": "D", "lat": 3.1002, "lon": 101.1}, {"id": "", "name": "no id"}], "segments": [{"id": "1", "lineId": "L", "fromStationId": "a", "toStationId": "b"}, {"id": "2", "lineId": "M", "fromStationId": "c", "toStationId": "x"}]}""")
    got = {r.id: (r.place, r.lines, r.interchange) for r in network.index(corpus.snapshot(spark, str(tmp_path / "n.json"))).collect()}
    assert got == {"a": ("a", ["L", "M"], True), "c": ("a", ["L", "M"], True), "b": ("b", ["L"], False), "d": ("b", ["L"], False)}
    listed = spark.createDataFrame([("a", "b")], "a string, b string")
    assert {r.place for r in network.index(corpus.snapshot(spark, str(tmp_path / "n.json")), listed).collect()} == {"a"}
