"""Phrases, authenticity and places on sentences whose meaning is plain."""

import pytest
from pyspark.sql import functions as F

from kelora.functions import phrases as P
from kelora.plans.reports import parsed

SAID = {
    "Sistem isyarat gagal dekat Maluri": ("SIGNAL_FAULT", "MAJOR"), "Landasan gagal selepas hujan": ("TRACK_FAULT", "MAJOR"), "Pintu tersekat": ("DOOR_FAULT", "MINOR"),
    "Eskalator mati di hentian": ("ELEVATOR_FAULT", "MINOR"), "Tren berasap, semua stesen": ("VEHICLE_BREAKDOWN", "SEVERE"), "Ribut dan kilat": ("WEATHER", "MAJOR"),
    "Road closed near the depot": ("ROAD_BLOCKED", "MINOR"), "Masalah teknikal": ("UNKNOWN", "MINOR"), "Pengumuman sahaja": ("UNKNOWN", "INFO"), "": ("UNKNOWN", "INFO"), "A sunny day": ("UNKNOWN", "INFO"),
    "Gangguan perkhidmatan kerana masalah isyarat": ("SIGNAL_FAULT", "MAJOR"),
}


def rows(spark, texts):
    return {r["said"]: r for r in parsed(spark.createDataFrame([(t,) for t in texts], "said string")).withColumn("sure", P.issue_confidence(F.col("vote"), F.col("hit"))).collect()}


def test_issue_and_severity(spark):
    got = rows(spark, SAID)
    assert {t: (r["issue"], r["severity"]) for t, r in got.items()} == SAID
    assert got["A sunny day"]["sure"] == 0 and got["Gangguan perkhidmatan kerana masalah isyarat"]["sure"] == pytest.approx(3 / 6)


def test_time_posture(spark):
    over, past, live = "Laluan kembali beroperasi sekarang", "Semalam tren rosak, tadi dah ok", "Semalam rosak, masih tergendala"
    got = rows(spark, [over, past, live])
    assert got[over]["recovery"] and not got[over]["ongoing"]
    assert got[past]["historical"] and not got[past]["ongoing"] and got[past]["stale"] >= 0.7
    assert got[live]["historical"] and got[live]["ongoing"] and got[live]["stale"] <= 0.3


def test_quality(spark):
    honest, mock, copied = "Tren rosak di Maluri", "Wow tahniah, memang bagus, world class haha", "RT @someone tren rosak"
    got = rows(spark, [honest, mock, copied])
    assert got[honest]["quality"] == 1 and got[mock]["quality"] < 0.5 and got[mock]["sarcasm"] >= 0.5
    assert got[copied]["repost"] >= 0.5 and got[copied]["quality"] == 1


def test_places(spark):
    df = spark.createDataFrame([("Tren berhenti antara Damai dan Jelatek sejak pagi.",), ("antara dan",), ("stesen LRT Damai sesak",)], "said string")
    t = P.folded(F.col("said"))
    got = [(list(r[0]) if r[0] else None, list(r[1])) for r in df.select(P.between(t), P.after(t, P.STATION_WORDS)).collect()]
    assert got == [(["DAMAI", "JELATEK"], []), (None, []), (None, ["LRT DAMAI"])]


def test_null_text_names_nothing(spark):
    r = parsed(spark.createDataFrame([(None,)], "said string")).select("issue", "severity", "quality").first()
    assert r["issue"] == "UNKNOWN" and r["severity"] == "INFO"
