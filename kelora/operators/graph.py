"""Graph operators: connected components by label propagation with pointer jumping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors see: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kelora.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        at = tempfile.mkdtemp(prefix="kelora-")
        spark.conf.set("kelora.scratch.dir", at)
    return f"{at.rstrip('/')}/kelora/graph-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each id of ``nodes``; ``edges`` has a, b. Rounds grow with the log of the diameter."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = written(nodes.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["id"] == near["a"], "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.select(F.col("id").alias("j"), F.col("root").alias("far"))
        new = written(step.join(jump, step["root"] == jump["j"], "left").select("id", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        label = new.select("id", "root")
        if new.where("root <> old").isEmpty():
            return label
