"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its UTF-8 text and the
sentinels. Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels between them, the inverse
permutation gives the text's order back, and texts and hashes are made by streaming the descriptors' bytes in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, SENTINEL = 0, 1
SENTINELS = b"<P><S><M>"
#: Descriptors of the sentinel before the prefix, the middle and the suffix.
MARKS = ((SENTINEL, 0, 3), (SENTINEL, 6, 3), (SENTINEL, 3, 3))
#: The parts (0 prefix, 1 middle, 2 suffix) in the order of the output.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, "1"
NEW = ("n_units", "form", "prefix_chars", "middle_chars", "pieces", "output")


def unit_starts(text: str) -> np.ndarray:
    """Code point offsets of the units ``[A-Za-z]+|[^A-Za-z]`` of a text."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = (c | 32) - np.uint32(97) < 26
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(~inside)


def cut(piece: tuple[int, int, int], *at: int) -> list[tuple[int, int, int]]:
    """A descriptor split at ascending byte offsets; parts may be empty."""
    buffer, start, length = piece
    edges = [0, *at, length]
    return [(buffer, start + a, b - a) for a, b in zip(edges, edges[1:])]


def arranged(parts: list[tuple[int, int, int]], form: str) -> list[tuple[int, int, int]]:
    """Descriptors of the output: parts in the form's order, each behind its sentinel; plain parts as they are."""
    return [x for k in ORDERS[form] for x in (MARKS[k], parts[k])] if form in ORDERS else parts


def streamed(pieces: list[tuple[int, int, int]], raw: bytes) -> Iterator[memoryview]:
    buffers = (memoryview(raw), memoryview(SENTINELS))
    return (buffers[b][s : s + n] for b, s, n in pieces if n)


def table_of(text: str, digest: str, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW):
    """(n units, form, prefix and middle code points or None, descriptors of the output) of one document.

    ``digest`` is the hexadecimal SHA-256 that draws the cuts (first two 32-bit groups) and the form (next two).
    """
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    starts, size = unit_starts(text), len(text.encode())
    n = len(starts)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, [(TEXT, 0, size)]
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(starts[k]) if k < n else len(text) for k in (first, second))
    form = "spm" if h[3] % 100 < spm_below else "psm"
    in_bytes = len(text[:a].encode())
    parts = cut((TEXT, 0, size), in_bytes, in_bytes + len(text[a:b].encode()))
    return n, form, a, b - a, arranged(parts, form)


def transformed(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Columns of ``docs`` plus NEW: units, form, code points of prefix and middle (null if plain), descriptors, output.

    Cuts and forms are drawn from sha256 of ``seed:doc_id`` (a null id: ``seed:`` alone), so equal ids are cut alike and
    results do not depend on partitions. Null texts are empty; empty texts and texts that hold a sentinel stay plain.
    Repeated rows are transformed each on their own; columns with one of the new names (in any case) are replaced. No
    rows give no rows. Texts are read whole; a task holds one Arrow batch of them.
    """
    names = [c for c in docs.columns if c.lower() not in NEW]
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    own = docs.select(F.struct(*names).alias("row"), F.coalesce("text", F.lit("")).alias("text"), draw.alias("digest"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, digest in zip(b["text"], b["digest"]):
                n, form, before, middle, pieces = table_of(text, digest, plain_from, spm_below)
                output = b"".join(streamed(pieces, text.encode())).decode()
                rows.append((n, form, before, middle, [{"buffer": x, "start": s, "length": k} for x, s, k in pieces], output))
            got = pd.DataFrame(rows, columns=NEW, index=b.index)
            got[["prefix_chars", "middle_chars"]] = got[["prefix_chars", "middle_chars"]].astype("Int64")
            yield pd.concat([b[["row"]], got], axis=1)

    kinds = f"row {own.schema['row'].dataType.simpleString()}, n_units long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string"
    return own.mapInPandas(run, kinds).select("row.*", *NEW)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts, found between the sentinels, in the inverse permutation's order."""
    parts = F.split(output, "<[PSM]>")
    back = {f: [order.index(k) + 2 for k in range(3)] for f, order in ORDERS.items()}
    whole = lambda f: F.concat(*(F.element_at(parts, k) for k in back[f]))
    return F.when(form == "psm", whole("psm")).when(form == "spm", whole("spm")).otherwise(output)


def op13(docs: DataFrame) -> DataFrame:
    out = transformed(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same rows in SQL: units as a list, cuts as sums of unit lengths, the output's parts joined in another order.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, x, len(u) AS n, u, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS p, ('0x' || h[25:32])::BIGINT % 100 AS s FROM t),
f AS (SELECT doc_id, x, n, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR p >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
  length(array_to_string(u[1:least(a, b)], '')) AS pre, length(array_to_string(u[1:greatest(a, b)], '')) AS til FROM d),
o AS (SELECT doc_id, x, n, form, CASE WHEN form <> 'plain' THEN pre END AS prefix_chars, CASE WHEN form <> 'plain' THEN til - pre END AS middle_chars,
  CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || substr(x, 1, pre) || '<S>' || substr(x, til + 1) || '<M>' || substr(x, pre + 1, til - pre) ELSE '<S>' || substr(x, til + 1) || '<P>' || substr(x, 1, pre) || '<M>' || substr(x, pre + 1, til - pre) END AS y FROM f)
SELECT doc_id, n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, sha256(y) AS output_sha256, sha256(x) AS restored_sha256 FROM o
"""
