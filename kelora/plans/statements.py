"""Text, label, conversation and page queries: statements, deduplication, evaluation metrics, provenance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.functions import text
from kelora.plans.registry import query, read

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^\s*RT\s+', ''), '^(?:@\w+:?\s*)+', ''), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("q_str03_group_key", "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS key FROM part")
def group_key(spark, d):
    return read(spark, d, "part").select("p_partkey", text.group_key(F.col("p_name")).alias("key"))


@query("q_str11_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("q_str10_normalise", f"SELECT item_id, {_NORM} AS clean FROM benchmark")
def normalise(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.normalised(F.col("text")).alias("clean"))


@query("q_agg05_repost_collapse", "SELECT h AS hash, count(*) AS copies, min(doc_id) AS original, count(DISTINCT source) AS authors FROM (SELECT *, sha256(text) AS h FROM documents WHERE length(text) >= 40) GROUP BY h HAVING count(*) > 1")
def repost_collapse(spark, d):
    docs = read(spark, d, "documents").where(F.length("text") >= 40)
    h = F.sha2(F.col("text").cast("binary"), 256)  # only the digest is shuffled, never the text
    return docs.select("doc_id", "source", h.alias("hash")).groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("original"), F.countDistinct("source").alias("authors")).where("copies > 1")


@query("q_agg30_repost_texts", "SELECT count(*) AS reposted, CAST(coalesce(sum(n), 0) AS BIGINT) AS documents FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def repost_texts(spark, d):
    h = read(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).count().where("count > 1")
    return h.agg(F.count("*").alias("reposted"), F.coalesce(F.sum("count"), F.lit(0)).alias("documents"))


@query("q_win04_document_dedupe", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g') ORDER BY doc_id) AS original FROM documents")
def document_dedupe(spark, d):
    # the whole text's slug; only its digest is shuffled
    slug = F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "-").cast("binary"), 256)
    docs = read(spark, d, "documents").select("doc_id", "source", slug.alias("slug"))
    first = docs.groupBy("source", "slug").agg(F.min("doc_id").alias("original"))  # an aggregate and a join: a hot slug is split
    return docs.join(first, ["source", "slug"]).select("doc_id", "original")


_CLASS = r"CASE WHEN regexp_matches(text, '(?i)\btoken\b') THEN 'INCIDENT' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'PLANNED' WHEN length(text) < 30 THEN 'UNREADABLE' ELSE 'NON_INCIDENT' END"


@query("q_flt14_document_class", f"SELECT {_CLASS} AS class, count(*) AS n FROM documents GROUP BY 1")
def document_class(spark, d):
    t = F.col("text")
    kind = F.when(t.rlike(r"(?i)\btoken\b"), "INCIDENT").when(t.rlike("(?i)licen[sc]e"), "PLANNED").when(F.length(t) < 30, "UNREADABLE").otherwise("NON_INCIDENT")
    return read(spark, d, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


_RULES = (("sch", 1.0), ("tion", 2.0), ("ing", 0.5), ("elle", 1.5))


@query("q_agg31_rule_scores", "SELECT lang, r.rule AS rule, round(sum(r.w), 4) AS score FROM documents JOIN (VALUES ('sch', 1.0::DOUBLE), ('tion', 2.0), ('ing', 0.5), ('elle', 1.5)) r(rule, w) ON contains(text, r.rule) GROUP BY ALL")
def rule_scores(spark, d):
    # the rules are columns of one pass, not a join that copies every text once a rule
    docs = read(spark, d, "documents")
    one = docs.groupBy("lang").agg(*(F.sum(F.when(F.col("text").contains(r), F.lit(w))).alias(r) for r, w in _RULES))
    return one.unpivot(["lang"], [r for r, _ in _RULES], "rule", "score").where("score is not null").select("lang", "rule", F.round("score", 4).alias("score"))


_VOTES = ", ".join(f"len(list_filter(ws, lambda w: list_contains({s.split()}, w))) AS {k}" for k, s in text.STOPWORDS.items())
_MOST = f"greatest({', '.join(text.STOPWORDS)})"


@query("q_str15_language_vote", f"""SELECT lang, CASE WHEN {_MOST} = 0 THEN NULL {' '.join(f"WHEN {k} = {_MOST} THEN '{k}'" for k in text.STOPWORDS)} END AS voted, count(*) AS n
 FROM (SELECT lang, {_VOTES} FROM (SELECT lang, string_split_regex(lower(text), '[^\\p{{L}}]+') AS ws FROM documents)) GROUP BY ALL""")
def language_vote(spark, d):
    return read(spark, d, "documents").groupBy("lang", text.language(F.col("text")).alias("voted")).agg(F.count("*").alias("n"))


@query("q_str13_fnv1a", "SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM part")
def fnv(spark, d):
    return read(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"))


@query("q_agg13_precision_recall", """SELECT round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM
 (SELECT count(*) FILTER (WHERE s AND quality = 1) AS tp, count(*) FILTER (WHERE s AND quality = 0) AS fp, count(*) FILTER (WHERE NOT s AND quality = 1) AS fn FROM (SELECT quality, n_chars > 1000 AS s FROM labels JOIN documents USING (doc_id)))""")
def precision_recall(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") > 1000).alias("s"))
    c = x.agg(F.count_if(F.col("s") & (F.col("quality") == 1)).alias("tp"), F.count_if(F.col("s") & (F.col("quality") == 0)).alias("fp"), F.count_if(~F.col("s") & (F.col("quality") == 1)).alias("fn"))
    div = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


@query("q_agg14_threshold_sweep", """SELECT t.cut AS cut, count(*) FILTER (WHERE n_chars >= t.cut AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= t.cut AND quality = 0) AS fp FROM labels JOIN documents USING (doc_id)
 CROSS JOIN (SELECT unnest([200, 500, 1000, 2000, 4000, 8000, 16000]) AS cut) t GROUP BY t.cut""")
def threshold_sweep(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    cuts = F.filter(F.array(*map(F.lit, (200, 500, 1000, 2000, 4000, 8000, 16000))), lambda c: F.lit(True))
    # seven counters a row, summed map-side: no row is copied through a shuffle
    return x.select("n_chars", "quality", F.explode(cuts).alias("cut")).groupBy("cut").agg(
        F.count_if((F.col("n_chars") >= F.col("cut")) & (F.col("quality") == 1)).alias("tp"), F.count_if((F.col("n_chars") >= F.col("cut")) & (F.col("quality") == 0)).alias("fp"))


@query("q_agg16_corpus_summary", "SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS en, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE contains(text, '|')) AS tables FROM documents")
def corpus_summary(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("text").contains("|")).alias("tables"))


@query("q_set02_new_and_cleared", "SELECT 'NEW' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'CLEARED', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def new_and_cleared(spark, d):
    a, b = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    side = lambda x, y, s: x.distinct().join(y, "doc_id", "left_anti").agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return side(a, b, "NEW").unionByName(side(b, a, "CLEARED"))


@query("q_win11_islands", """SELECT conv_id, island, role, count(*) AS turns, min(turn) AS first_turn FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM
 (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations)) GROUP BY ALL""")
def islands(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, d, "conversations").withColumn("fresh", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    return c.withColumn("island", F.sum("fresh").over(w)).groupBy("conv_id", "island", "role").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query("q_win15_hop_delta", "SELECT conv_id, turn, CAST(length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS delta FROM conversations")
def hop_delta(spark, d):
    n = F.length("text")
    return read(spark, d, "conversations").select("conv_id", "turn", (n - F.lag(n).over(W.partitionBy("conv_id").orderBy("turn"))).cast("long").alias("delta"))


@query("q_win10_ordered_distinct", "SELECT conv_id, string_agg(role, '>' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_distinct(spark, d):
    first = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "role"))), lambda x: x.role), ">").alias("roles"))


@query("q_dat10_hosts", r"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1")
def hosts(spark, d):
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"))


@query("q_str06_titles", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def titles(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_KEYS = "(SELECT k, min(item_id) AS item_id FROM (SELECT item_id, string_split(text, ' ')[1] AS k FROM benchmark UNION ALL SELECT item_id, left(text, 3) FROM benchmark) WHERE k <> '' GROUP BY k)"


@query("q_jon21_longest_prefix", f"SELECT doc_id, arg_max(item_id, length(k)) AS item_id FROM documents JOIN {_KEYS} ON starts_with(text, k) GROUP BY doc_id")
def longest_prefix(spark, d):
    b = read(spark, d, "benchmark")
    keys = b.select("item_id", F.split("text", " ")[0].alias("k")).unionByName(b.select("item_id", F.substring("text", 1, 3).alias("k")))
    keys = keys.where("k <> ''").groupBy("k").agg(F.min("item_id").alias("item_id"))
    # prefixes of every length that a key has are equi keys: no theta join
    lengths = sorted(r[0] for r in keys.select(F.length("k")).distinct().collect())  # the lengths of words: a few numbers
    docs = read(spark, d, "documents").select("doc_id", F.explode(F.array(*(F.substring("text", 1, n) for n in lengths or [1]))).alias("k")).distinct()
    hit = docs.join(keys, "k")
    return hit.groupBy("doc_id").agg(F.max_by("item_id", F.length("k")).alias("item_id"))
