"""Prefix trie, seed and extend, fill-in-the-middle: plain versions on small tables, odd and empty tables, one long text."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelora.llm import fillmiddle, perplexity, prefixtrie, seedextend

TURNS = "conv_id long, turn long, role string, text string, depth string, forest int"
DOCS = "doc_id long, text string, n_words string, Row string, digest int"


def plain_trie(rows):
    """The contract by loops over whole rebuilt conversations."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + t[h:]
    members: dict = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), set()).add(c)
    out = []
    for node, own_ in members.items():
        sub = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in own_ if len(built[c]) == len(node))
        out.append((
            min(own_), len(node), min(members[node[:-1]]) if node else None, len(own_), sum(len(n) == len(node) + 1 for n in sub),
            sum(not any(m[:-1] == n for m in members if m) for n in sub), sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in sub),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(kind):
    rng = np.random.default_rng(4)
    if kind == "shared":
        return [(c, t, "user" if t % 2 else "assistant", f"say {rng.integers(0, 2)} é") for c in [*range(12), *range(100, 130), 205] for t in range(int(rng.integers(1, 12)))]
    if kind == "odd":
        rows = [(1, None, None, None), (1, 0, "user", ""), (1, 3, "u", "x"), (None, 0, "user", "lost"), (None, None, None, None), (301, 1, "user", "alone"), (302, 0, "user", "alone"), (302, 1, "user", "alone")]
        return rows + [(300 + k, t, "user", "same") for k in (10, 11, 12, 13, 14) for t in range(9)] + [(400, 0, "user", "y" * 1_000_000)]
    return [(7, t, "user", str(t % 3)) for t in range(150)] + [(8, t, "user", str(t % 3)) for t in range(140)]  # long ones


@pytest.mark.parametrize("kind", ["shared", "odd", "long"])
def test_trie_against_plain(spark, kind):
    rows = conversations(kind)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(5)
    assert sorted(map(tuple, prefixtrie.op11(docs).collect()), key=repr) == plain_trie(rows)


def test_trie_of_repeated_and_no_rows(spark):
    rows = [(5, 0, "user", "a")] * 3 + [(9, 0, "user", "b"), (9, 0, "user", "b")]
    got = prefixtrie.op11(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)
    assert prefixtrie.op11(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixtrie.op11(spark.createDataFrame([(None, 1, "user", "a", "x", 1)], TURNS)).collect() == []


def test_ends_in_pieces(spark, monkeypatch):
    """A node at which many conversations end, listed piece by piece."""
    monkeypatch.setattr(prefixtrie, "PIECE", 7)
    rows = [(c, t, "user", "same") for c in range(1000, 1090) for t in range(6)]
    assert sorted(map(tuple, prefixtrie.op11(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)).collect()), key=repr) == plain_trie(rows)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dedup(rows, length):
    """(n_words, n_removed, hash of kept words) per row, by every window of every text."""
    words = [WORD.findall(t or "") for _, t in rows]
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least: dict = {}
    for i, w in enumerate(words):
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            least[k] = min(least.get(k, rank(i)), rank(i))
    out = []
    for i, w in enumerate(words):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if least[tuple(w[s : s + length])] < rank(i):
                gone[s : s + length] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((rows[i][0], len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("gram", [3, 8])
def test_seed_and_extend_against_every_window(spark, gram):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(rng.choice(["a", "bé", "c", "dd"], n))
    shared = [word(n) for n in (12, 18, 40)]
    texts = [word(9) + "\n" + shared[i % 3] + "\t\x0b" + word(7) + " " + " ".join(shared[(i + 1) % 3].split()[:14]) for i in range(24)]
    near = word(90).split()
    texts += [" ".join(near[:k] + ["edit", str(k)] + near[k + 1 :]) for k in (5, 30, 31, 60)]
    own = " ".join(f"w{i}" for i in range(15))
    texts += [own + " " + own, "", None, shared[0], "  " + shared[2] + " x", "a b", "z " * 300, "z " * 200, "y z " * 60, "p q r " * 50, "q r p " * 40, shared[2], shared[2]]
    ids = [*range(len(texts) - 2), None, None]
    rows = [(int(i) if i is not None else None, t) for i, t in zip(ids, texts)]
    rows += [rows[3], (2, "another text of an id that is taken " + shared[1])]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)
    out = seedextend.deduplicated(docs, 12, gram).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256), "Row", "digest").collect()
    assert sorted((tuple(r)[:4] for r in out), key=repr) == plain_dedup(rows, 12)
    assert {(r["Row"], r["digest"]) for r in out} == {("y", 1)}


def test_seed_and_extend_edges(spark):
    long = " ".join(f"w{i % 977}x{i % 1009}" for i in range(100_000))
    rows = [(4, long), (2, "start " + long[:400_000]), (1, "x" * 1_000_000), (3, long[300_000:])]
    got = seedextend.op12(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_dedup(rows, 50)
    assert seedextend.op12(spark.createDataFrame([], DOCS)).collect() == []


def test_maximal_spans(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(["a", *base[10:70], "b", *base[100:149], "c", *base[100:150]]))]
    out = {r.doc_id: r for r in seedextend.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[2].spans] == [(1, 61), (112, 162)] and out[1].n_removed == 0
    assert out[2].kept_text == " ".join(["a", "b", *base[100:149], "c"])


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[k : k + 8], 16) for k in range(0, 32, 8))
    n, sha = len(units), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fill_in_the_middle_against_plain(spark):
    texts = ["", None, "a", "<P>", "x <S> y", "<", "<P", "P><S", "ab1cd é\U0001f600ß\n\t z", "zz " * 400_000, "\x0b\x0c", "[@`{"] + [f"Word{i}, {'é' * (i % 4)}<{i}>\r\nnext" * (i % 9) for i in range(150)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (3, "again"), (3, "again"), (-5, "minus five"), (1 << 62, "large id 1")]
    out = fillmiddle.op13(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted((plain_fim(*r) for r in rows), key=repr)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fillmiddle.op13(spark.createDataFrame([], DOCS)).collect() == []


def test_pieces_cover_the_text_once(spark):
    rows = [(i, f"some text, number {i}: é{i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x", "kept", 1) for r in rows], DOCS).withColumn("Output", F.lit("old"))
    for r in fillmiddle.transformed(docs).collect():
        raw = rows[r.doc_id][1].encode()
        own = sorted((p.start, p.length) for p in r.pieces if p.buffer == fillmiddle.TEXT)
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == len(raw)
        assert b"".join(fillmiddle.streamed([tuple(p) for p in r.pieces], raw)).decode() == r.output and r.Row == "kept"
    assert fillmiddle.cut((0, 10, 8), 3, 3) == [(0, 10, 3), (0, 13, 0), (0, 13, 5)]


def test_sql(spark, sf):
    """The SQL of the three on the small tables."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for table, query, sql in (("documents", seedextend.op12, seedextend.SQL), ("documents", fillmiddle.op13, fillmiddle.SQL), ("conversations", prefixtrie.op11, prefixtrie.SQL)):
        df = query(spark.read.parquet(f"{sf}/{table}.parquet"))
        cur = con.execute(sql)
        assert df.columns == [c[0] for c in cur.description]
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)


def test_language_model_in_bounded_passes(spark):
    """One byte before nearly all places: its share is split by the bytes before it, and scores stay the same."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(chr(97 + x) + " " for x in rng.integers(0, 26, 60))) for i in range(20)] + [(98, ""), (99, None)], "doc_id long, text string")
    model = perplexity.kneser_ney(perplexity.count_grams(docs, 4), 4)
    n, entries = model.count(), 120
    passes = perplexity.shares(model, 4, entries)
    assert len(passes) > 2 and any(m > 1 for own in passes for m, _ in own)
    sizes = [model.where(perplexity._held(own, 4)).where("k > 1").count() for own in passes]
    assert max(sizes) <= entries + 2 * 256 and sum(sizes) >= n - 256
    covered = [(m, v) for own in passes for m, v in own]
    for c in rng.integers(0, 1 << 24, 200).tolist() + [0x202020, 0x612020]:
        assert sum((c & (1 << 8 * m) - 1) == v for m, v in covered) == 1
    a, b = ({r.doc_id: r.log_ppl for r in perplexity.log_perplexity(docs, model, 4, e).collect()} for e in (10**6, entries))
    assert all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-5 for k in a) and a[98] is None
