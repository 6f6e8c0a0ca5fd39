"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

A piece's length is an integer of at most ``capacity``, so best fit decreasing depends only on how many pieces have
each length. The plan is therefore made from that bounded histogram: lengths go from long to short, a segment tree
over remaining capacities finds the tightest open bin in logarithmic time, and equal pieces that meet equal bins are
placed together. Spark then ranks the pieces of each length and reads their place off the plan: the packing is the
global one at any scale, and no task or driver holds the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.llm.common import stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Pieces that one ranking task takes of a length, about.
RANK_ROWS = 1_000_000


class Encoder:
    """Ids of ``byte_bpe_50k.json``. The rank form of the same vocabulary gives equal ids several times faster and
    encodes all texts but those that hold the special token's string, which only the JSON form treats specially."""

    def __init__(self, name: str = TOKENIZER, folder: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.at = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
        self.name, self.slow = name, None
        with open(self.at(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if text and SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.at(f"{self.name}.json"))
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4") if text else np.zeros(0, "<u4")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first of several may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, keys: list[str], capacity: int = CAPACITY, tokenizer_folder: str | None = None) -> DataFrame:
    """One row per piece of each document: keys, piece, start, length, ids_crc32. Narrow; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder(folder=tokenizer_folder), np.array([END_ID], "<u4")
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b["text"]):
                ids = np.concatenate([encoder.ids(text), end])
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
            got = b[keys].iloc[at].reset_index(drop=True)
            yield pd.concat([got, pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])], axis=1)

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInPandas(run, f"{kinds}, piece int, start long, length long, ids_crc32 long")


class Tree:
    """A segment tree over remaining capacities; a leaf is set while some open bin has that much room."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.on = bytearray(2 * self.n)

    def set(self, at: int, on: bool) -> None:
        at += self.n
        self.on[at] = on
        while at > 1:
            at >>= 1
            self.on[at] = self.on[2 * at] | self.on[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest set capacity of at least ``least``; -1 if there is none."""
        at = least + self.n
        if self.on[at]:
            return least
        while at > 1:
            if not at & 1 and self.on[at + 1]:
                at += 1
                while at < self.n:
                    at = 2 * at + (not self.on[2 * at])
                return at - self.n
            at >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing of ``histogram`` (length -> count): rows (length, low, high, each, bin, offset).

    The piece of rank r (low <= r < high) of a length goes to bin ``bin + (r - low) // each`` at
    ``offset + (r - low) % each * length``.
    """
    room: dict[int, list[list[int]]] = {}  # remaining capacity -> ranges of bins [first, number]
    tree, rows, bins = Tree(capacity), [], 0

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            room.setdefault(left, []).append([first, number])
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            left = tree.tightest(length)
            if left < 0:
                left, first, number = capacity, bins, -(-(count - rank) // (capacity // length))
                bins += number
            else:
                first, number = room[left].pop()
                if not room[left]:
                    tree.set(left, False)
            each = left // length  # the bin just used is again the tightest while a piece still fits
            full = min(number, (count - rank) // each)
            if full:
                rows.append((length, rank, rank + full * each, each, first, capacity - left))
                put(left - each * length, first, full)
                rank += full * each
            if full < number and rank < count:
                rest = count - rank
                rows.append((length, rank, count, each, first + full, capacity - left))
                put(left - rest * length, first + full, 1)
                rank, full = count, full + 1
            if left < capacity or full < number:
                put(left, first + full, number - full)
    return rows


def packed(cut: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored piece table) with sequence_id and offset. Repeated rows are placed one by one."""
    spark = cut.sparkSession
    total = cut.count()
    salts = max(32, -(-total // RANK_ROWS))
    order = [*keys, "piece", "start", "ids_crc32"]
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    # ranks: those of the lower salts of a length, then the own place; no window meets a whole length
    lower = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(lower), F.lit(0))).select("length", "salt", "base")
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1
    ranked = salted.withColumn("place", place).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # `capacity` rows at most
    steps = plan(histogram, capacity)
    table = spark.createDataFrame(pd.DataFrame(steps, columns=["plen", "low", "high", "each", "bin", "shift"]), "plen long, low long, high long, each long, bin long, shift long") if steps else spark.createDataFrame([], "plen long, low long, high long, each long, bin long, shift long")
    if len(steps) <= 500_000:  # its size depends on the capacity, not on the input; checked all the same
        table = F.broadcast(table)
    hit = ranked.join(table, (F.col("length") == F.col("plen")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return hit.select(*keys, "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("shift") + step % F.col("each") * F.col("length")).alias("offset"))


def op7(docs: DataFrame) -> DataFrame:
    """A row per piece of every row of ``docs``. A null or empty text is the end id alone, repeated rows are placed one by
    one, pieces of equal length go in the order of id, piece, start and hash; no rows give no rows."""
    return packed(stored(pieces(docs, ["doc_id"]), "pieces"), ["doc_id"])
