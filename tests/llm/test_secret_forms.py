"""Planted secrets of each form are candidates as a whole and are redacted."""

import hashlib

import pytest

from kelora.llm import secrets

AWS = "AKIA" + "ABCDEFGH23456789"
PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc+/12==\n-----END RSA PRIVATE KEY-----"
FORMS = [
    ("then password = hunter2abc and", "hunter2abc"), ('then password = "p@ss!w0rd#x9" and', "p@ss!w0rd#x9"), ("then token: \"AbC$12!dEf&34*\" and", "AbC$12!dEf&34*"),
    ("then token=abcdefghijklmnopqrst and", "abcdefghijklmnopqrst"), (f"then api_key={AWS} and", AWS), (f"then region={AWS} and", AWS), (f"then\n{PEM}\nand", PEM),
    ("then db_password: 'x y;z9' and", "x y;z9"),
]


@pytest.mark.parametrize("text,value", FORMS)
def test_candidate(text, value):
    assert [(text[a : a + len(v)], v) for a, v, _, _ in secrets.candidates(text)] == [(value, value)]


def test_redacted(spark):
    texts = [f'and token = "{hashlib.sha1(str(i).encode()).hexdigest()}" more words{i}@mail.example.com river stone here' for i in range(60)]
    forest = secrets.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    target = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS[:7])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(target, forest).collect()}
    assert got == {i: t.replace(v, "[SECRET]") for i, (t, v) in enumerate(FORMS[:7])}
