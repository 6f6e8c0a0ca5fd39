"""Query registration: a Spark function and, where SQL can express it, the DuckDB oracle beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in a few parts for every core, before much is computed of each: a small file is read by few tasks, and what
    its rows cost does not show in its bytes."""
    return rows.repartition(max(32, 4 * rows.sparkSession.sparkContext.defaultParallelism), key)
