"""The corpus pipeline: every stage's effect on a small table."""

import corpus_pipeline as P
from kelora.llm import toxicity
from kelora.llm.common import stored


def brute_representatives(docs):
    """Smallest doc_id of each component of pairs with Jaccard 0.8 or more over five-word shingles."""
    sets = []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(docs)):
        for i in range(j):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    least: dict = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, cur = [docs.count()], docs
    for name, stage in P.STAGES[:-1]:
        before = cur
        cur = stored(stage(spark, cur, sf), name)
        assert cur.columns == docs.columns
        counts.append(cur.count())
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in cur.collect()) == brute_representatives([(r.doc_id, r.text) for r in before.collect()])
        if name == "secret_scans":
            assert not cur.where("text rlike 'token = \"[0-9a-f]{40}\"'").count()
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    packed = P.pack(spark, cur, sf).collect()
    ends: dict = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_repeated_rows_and_nulls(spark, sf):
    rows = [(1, "alpha beta gamma delta epsilon", "en", "s", 5), (1, "alpha beta gamma delta epsilon", "en", "s", 5), (2, "alpha beta gamma delta epsilon", "en", None, 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "quite other words stand here now", "fr", "s", 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    kept = sorted(r.doc_id for r in P.drop_near_copies(spark, docs, sf).collect())
    assert kept == [1, 3, 5]
    assert P.mix_sources(spark, docs, sf).columns == docs.columns
    assert P.pack(spark, docs, sf).count() == len(rows)
    model = ({}, toxicity.np.zeros(toxicity.N_FEATURES + 1))
    assert toxicity.score(docs, model).count() == len(rows)


def test_extra_columns_with_clashing_names(spark, sf):
    """Every name that a stage uses itself comes through with the user's values."""
    names = "size copy copies digest own_digest row_hash drawn kept_row toxicity n i row node component value fp".split()
    rows = [(i, f"word{i} alpha beta gamma delta epsilon zeta eta {i} " * 3, "en", "s", 5, *range(700, 700 + len(names))) for i in range(6)] + [(6, None, None, None, None, *[None] * len(names)), (None, "", None, "s", 0, *range(700, 700 + len(names)))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names)
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r["size"] in (700, None) and r["fp"] in (700 + len(names) - 1, None) for r in got), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert P.pack(spark, docs, sf).count() == len(rows) and P.pack(spark, docs.limit(0), sf).count() == 0


def test_mixing_stage_tells_equal_ids_apart(spark, sf):
    """Rows with one doc_id, or none, are drawn one by one; wholly equal rows are repeated together."""
    rows = [(None, f"text number {i} with some words", "en", "s", 1) for i in range(40)] + [(1, "same row", "en", "s", 1)] * 5
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = P.mix_sources(spark, docs, sf).collect()  # one source: its target is its size, so each row is taken once
    assert sorted(r.text for r in out) == sorted(r[1] for r in rows)
