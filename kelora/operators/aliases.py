"""Alias lookup: exact, then compact, then fuzzy, each tried only on what the one before left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelora.functions import text


def budget(name: Column) -> Column:
    """Typos that are forgiven, by the length of the name."""
    n = F.length(name)
    return F.when(n >= 10, 2).when(n >= 6, 1).otherwise(0)


def shortened(names: Column) -> Column:
    """The array's strings and all those with one character less."""
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    return F.array_distinct(F.concat(names, F.flatten(F.transform(F.filter(names, lambda s: F.length(s) > 0), drop))))


def _keys(name: Column) -> Column:
    one = F.array(name)
    return F.when(budget(name) == 2, shortened(shortened(one))).when(budget(name) == 1, shortened(one)).otherwise(one)


def lookup(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, how, aliases): the aliases that each distinct mention names; none: no row. Ties are all kept, sorted.

    ``mentions``: mention; ``aliases``: alias; both folded to upper case. Names within k typos share a string with at
    most k characters removed from each, so the fuzzy step is an equi join on those strings; it asks for the same
    number of words, and a mention's own budget holds.
    """
    m, a = mentions.select("mention").where("mention is not null").distinct(), aliases.select("alias").where("alias is not null").distinct()
    exact = m.join(a, F.col("mention") == F.col("alias")).select("mention", F.lit("exact").alias("how"), F.lit(0).alias("distance"), "alias")
    rest = m.join(a, F.col("mention") == F.col("alias"), "left_anti")
    key = lambda df, c: df.withColumn("key", text.group_key(F.col(c)))
    compact = key(rest, "mention").where("key <> ''").join(key(a, "alias"), "key").select("mention", F.lit("compact").alias("how"), F.lit(0).alias("distance"), "alias")
    left = rest.join(compact.select("mention").distinct(), "mention", "left_anti")
    words = lambda c: F.size(F.split(c, " "))
    # an alias may be one budget class below the mention, so it is shortened as often as the longest mention may be
    probes = left.select("mention", words("mention").alias("words"), F.explode(_keys(F.col("mention"))).alias("key"))
    known = a.select("alias", words("alias").alias("words"), F.explode(shortened(shortened(F.array("alias")))).alias("key"))
    pairs = probes.join(known, ["key", "words"]).select("mention", "alias").distinct()
    near = pairs.withColumn("distance", text.typo_distance(F.col("mention"), F.col("alias"), budget(F.col("mention")))).where("distance is not null")
    fuzzy = near.select("mention", F.lit("fuzzy").alias("how"), F.col("distance").cast("int").alias("distance"), "alias")
    tied = exact.unionByName(compact).unionByName(fuzzy).groupBy("mention", "how", "distance").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return tied.groupBy("mention").agg(F.min_by(F.struct("how", "aliases"), "distance").alias("best")).select("mention", "best.how", "best.aliases")
