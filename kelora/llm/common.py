"""Small helpers that the operators share: shared storage, label split, bounded training samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most labelled rows a classifier is fitted on (documented bound; scoring and counting cover every row).
TRAIN_ROWS = 20_000


#: 64-bit words of a membership bitmap: its size is fixed (16 million bits), so it may be broadcast whatever the input.
BITMAP_WORDS = 1 << 18

#: Rows of one Arrow batch: whole documents are long, so a batch holds few of them.
ARROW_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; also lowers the session's Arrow batch to ARROW_ROWS, unless the user set it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        found = spark.conf.get("kelora.scratch.dir", None) or tempfile.mkdtemp(prefix="kelora-")
        spark.conf.set("kelora.scratch.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kelora/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by a hash of ``keys`` below a share; all of them where there are fewer.

    The share is taken from the table's row count, so neither a sort nor the driver sees more than the sample.
    """
    n = df.count()
    return df if n <= rows else df.where(F.xxhash64(*keys) / 2.0**64 + 0.5 < rows / n)


def training_docs(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out.

    The sample is the ``rows`` smallest xxhash64(doc_id): fixed for given tables, independent of partitions.
    A document labelled more than once takes its largest label; null ids and null labels are not used.
    """
    chosen = (
        bounded(labels, 2 * rows, "doc_id").select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # at most `rows` pairs of numbers, so this broadcast has a fixed size bound
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def widened(df: DataFrame, name: str, kind: str):
    """The schema of ``df`` plus one column; a column of that name is replaced, so clashing extra columns do no harm."""
    return df.drop(name).select("*", F.lit(None).cast(kind).alias(name)).schema


def bitmap(keys: DataFrame, *names: str) -> DataFrame:
    """(slot, bits): at most BITMAP_WORDS rows that hold a bit for each row of ``keys``."""
    h = F.xxhash64(*names)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
    return keys.select(F.pmod(h, F.lit(BITMAP_WORDS)).alias("slot"), bit.alias("b")).groupBy("slot").agg(F.bit_or("b").alias("bits"))


def marked(rows: DataFrame, bits: DataFrame, *names: str) -> DataFrame:
    """``rows`` plus ``maybe``: false where the bitmap shows that a row's key is not in it; true is to be checked."""
    h = F.xxhash64(*names)
    own = rows.withColumn("slot", F.pmod(h, F.lit(BITMAP_WORDS))).join(F.broadcast(bits), "slot", "left")
    hit = F.call_function("bit_get", F.col("bits"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")) == 1
    return own.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("slot", "bits")
