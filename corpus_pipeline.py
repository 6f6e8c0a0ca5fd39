"""A training corpus in five stages: each takes what its predecessor kept and returns the columns of ``documents``.

1. toxicity: documents that score 0.5 or more go.
2. SimHash near-dedup: one document of each group of near copies (five-word shingles, Jaccard 0.8) stays, the one with
   the smallest doc_id; BK-trees over SimHash fingerprints inside MinHash shards find candidates, exact Jaccard decides.
3. secret scans: secrets are replaced in the text; no document goes.
4. mixing: each document is repeated as often as the balanced sample takes it (0 to 3 times).
5. best-fit packing: one row per piece with its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelora.llm import mixing, nearcopies, packing, secrets, toxicity
from kelora.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5. Null and empty texts match no clause and stay; repeated rows share their fate."""
    score = free(docs, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column (column names compare without case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id (null ids last), then the smallest digest of the text.

    Null and empty texts are one group. Of wholly repeated rows one stays. Rows of one doc_id with different texts are
    told apart by the digest. Extra columns are kept whatever their names; no rows give no rows.
    """
    own, rows = free(docs, "own_digest"), "n"
    digest = F.xxhash64("text")
    members = nearcopies.groups(docs.select("doc_id", "text", digest.alias("digest"))).groupBy("component", "doc_id", "digest").agg(F.count("*").alias(rows))
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", rows)).alias("d"))
    keep = first.select(F.struct("d.doc_id", "d.digest", f"d.{rows}").alias(free(docs, "kept_row")))
    mine, hit = docs.withColumn(own, digest), free(docs, "kept_row")
    kept = mine.join(keep, F.col("doc_id").eqNullSafe(F.col(f"{hit}.doc_id")) & F.col(own).eqNullSafe(F.col(f"{hit}.digest")))
    # a doc_id with several rows may hold wholly equal texts, of which one stays
    once = kept.where(F.col(f"{hit}.{rows}") == 1).select(*docs.columns)
    return once.unionByName(kept.where(F.col(f"{hit}.{rows}") > 1).dropDuplicates(["doc_id", own]).select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets in its text replaced; null and empty texts and extra columns stay as they are."""
    return secrets.redacted(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the balanced sample takes it (0 to 3 times); rows of one source only are all taken once.

    Rows are known by doc_id and a hash of all their columns, so rows with one doc_id, or none, are drawn one by one.
    Wholly equal rows can't be told apart: one of them is repeated as often as all of them are taken together. Null and
    empty texts have size 0. Extra columns are kept whatever their names; no rows give no rows.
    """
    own, hit = free(docs, "row_hash"), free(docs, "drawn")
    whole = F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull())))
    mine = docs.withColumn(own, whole)
    taken = mixing.mixed(mine.select("doc_id", "source", "text", F.col(own).alias("row_hash")), keys=("doc_id", "row_hash"))
    taken = taken.groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    drawn = mine.join(taken.select(F.struct("doc_id", "row_hash", "copies", "n").alias(hit)), F.col("doc_id").eqNullSafe(F.col(f"{hit}.doc_id")) & (F.col(own) == F.col(f"{hit}.row_hash")))
    once = drawn.where(F.col(f"{hit}.n") == 1)
    drawn = once.unionByName(drawn.where(F.col(f"{hit}.n") > 1).dropDuplicates(["doc_id", own]))
    copy = F.explode(F.sequence(F.lit(1), F.col(f"{hit}.copies").cast("int")))
    return drawn.select(*docs.columns, copy.alias(free(docs, "copy"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document; null and empty texts are the end id alone, repeated rows are pieces of their own."""
    return packing.packed(stored(packing.pieces(docs, ["doc_id"]), "pieces"), ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: The stages use trained models, near links and a random draw, which SQL cannot express; tests/llm check them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
