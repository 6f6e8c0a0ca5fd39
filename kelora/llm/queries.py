"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelora.llm import chat, fillmiddle, matroska, mixing, packing, perplexity, prefixtrie, quality, secrets, seedextend, simhash, suffixdedup, toxicity
from kelora.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.op2(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.op6(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op7(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8(spark, table(spark, sf_dir, "conversations"))


def op9_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.op9(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10(table(spark, sf_dir, "documents"))


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.op11(table(spark, sf_dir, "conversations"))


def op12_seedextend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seedextend.op12(table(spark, sf_dir, "documents"))


def op13_fillmiddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.op13(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_matroska, op3_secrets, op4_quality, op5_simhash, op6_perplexity, op7_packing, op8_chat, op9_suffixdedup, op10_mixing,
        op11_prefixtrie, op12_seedextend, op13_fillmiddle,
    )
}

#: The others are no plain SQL queries (trained models, binary formats, greedy packing, random draws): tests/llm hold
#: each against brute force, a round trip or held-out accuracy.
ORACLES: dict[str, str] = {"op11_prefixtrie": prefixtrie.SQL, "op12_seedextend": seedextend.SQL, "op13_fillmiddle": fillmiddle.SQL}
