"""The near-dedup stage against brute-force Jaccard similarity."""

import numpy as np
import pytest

import corpus_pipeline as P
from kelora.llm import nearcopies


def test_stage_against_brute_force(spark, sf):
    rng = np.random.default_rng(4)
    words = lambda n: rng.permutation(20_000)[:n].astype(str).tolist()
    texts = []
    for k in range(30):
        base = words(200)
        texts.append(" ".join(base))
        for j in range(3):  # each changed word costs five shingles: similarity about 0.95 down to 0.75
            copy = list(base)
            for at in rng.choice(40, 1 + (k + j) % 6, replace=False) * 5 + 2:
                copy[at] = f"x{k}y{j}z{at}"
            texts.append(" ".join(copy))
    texts += ["", None, "a b", "A  B"]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    plain = []
    for t in texts:
        w = (t or "").lower().split()
        plain.append({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = sorted({find(i) for i in range(len(texts))})
    assert len(want) < len(texts) - 30  # copies were planted
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, sf).collect()) == want


def test_repeated_id_with_other_text(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (1, "quite other words stand here now", "en", "s", 1), (None, "Alpha beta gamma delta epsilon zeta", "en", "s", 1)]
    kept = P.drop_near_copies(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert sorted(r.text for r in kept) == sorted(r[1] for r in rows[:2])


def test_jaccard_by_hand():
    a, b = nearcopies.shingle_set("a b c d e f"), nearcopies.shingle_set("A b c d e g")
    assert len(a) == 2 and nearcopies.jaccard(a, b) == pytest.approx(1 / 3)
