"""Queries over the driver tables, each with its DuckDB twin: the generic half of every operator on large data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verilane.functions import rules, text
from verilane.operators import relational as rel
from verilane.operators import screening
from verilane.operators.passages import occurrences

QUERIES: dict = {}
SQL: dict = {}


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _hits(spark, d):
    """Verbatim occurrences: the passage is rewritten, the text only lower-cased and its white space collapsed. item_id, doc_id and the place of the first one."""
    needles = T(spark, d, "benchmark").select("item_id", F.lower(text.quote_key(F.col("text"))).alias("needle"))
    docs = T(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("haystack"))
    return occurrences(needles, docs, "doc_id").join(needles, "needle").select("item_id", "doc_id", "needle", "at")


_NEEDLE = r"""lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(translate(text, '“”‘’', '""'''''), '\[[^\]]*\]', '', 'g'), '…', ' '), '\.{3,}', ' ', 'g'), '\s+', ' ', 'g')))"""
_HITS = rf"""n AS (SELECT item_id, {_NEEDLE} AS needle FROM benchmark),
t AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS haystack FROM documents), hits AS (SELECT item_id, doc_id, needle, haystack FROM n JOIN t ON contains(haystack, needle) WHERE needle <> '')"""


@query(f"""WITH {_HITS} SELECT b.item_id, count(h.doc_id) AS n_docs, CASE WHEN count(h.doc_id) > 0 THEN 'VERBATIM' ELSE 'FABRICATED' END AS worst,
CASE WHEN count(h.doc_id) > 0 THEN 'Green' ELSE 'Yellow' END AS color FROM benchmark b LEFT JOIN hits h USING (item_id) GROUP BY b.item_id""")
def quote_verbatim(spark, d):
    found = _hits(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    out = T(spark, d, "benchmark").select("item_id").join(found, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long")))
    out = out.withColumn("worst", rules.quote_bucket(F.when(F.col("n_docs") > 0, 1.0).otherwise(0.0)))
    return out.withColumn("color", rules.color(F.lit("VERIFIED"), F.lit("supported"), F.col("worst")))


@query(f"""WITH {_HITS}, p AS (SELECT b.item_id, d.lang, max(CASE WHEN h.doc_id IS NULL THEN 2 ELSE 0 END) AS sev FROM benchmark b JOIN (SELECT DISTINCT lang FROM documents) d ON true
LEFT JOIN (SELECT DISTINCT h.item_id, x.lang, h.doc_id FROM hits h JOIN documents x USING (doc_id)) h ON h.item_id = b.item_id AND h.lang = d.lang GROUP BY ALL)
SELECT item_id, CASE max(sev) WHEN 2 THEN 'FABRICATED' ELSE 'VERBATIM' END AS worst, CASE WHEN bool_or(sev = 2) THEN 'Yellow' ELSE '' END AS quote_floor FROM p GROUP BY item_id""")
def quote_worst_floor(spark, d):
    """Each passage is checked in every language; the worst result of a passage decides. A passage that some language lacks isn't there."""
    docs = T(spark, d, "documents")
    langs = docs.select("lang").distinct().count()
    found = _hits(spark, d).select("item_id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.countDistinct("lang").alias("n"))
    checked = T(spark, d, "benchmark").select("item_id").distinct().join(found, "item_id", "left")
    sim = F.when(F.coalesce("n", F.lit(0)) == langs, 1.0).otherwise(0.0)
    worst = checked.withColumn("sim", sim).withColumn("worst", rules.quote_bucket(F.col("sim")))
    return worst.select("item_id", "worst", F.when(rules.quote_floors(F.col("worst"), F.col("sim")), "Yellow").otherwise("").alias("quote_floor"))


@query(f"""WITH {_HITS}, q AS (SELECT item_id, doc_id, haystack, strpos(haystack, needle) AS p, length(needle) AS n FROM hits)
SELECT item_id, doc_id, CASE WHEN greatest(p - 30, 1) > 1 THEN '...' ELSE '' END || substring(haystack, greatest(p - 30, 1), least(p + n + 30, length(haystack) + 1) - greatest(p - 30, 1))
|| CASE WHEN least(p + n + 30, length(haystack) + 1) <= length(haystack) THEN '...' ELSE '' END AS context FROM q""")
def context_window(spark, d):
    docs = T(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"\s+", " ").alias("haystack"))
    hits = docs.join(_hits(spark, d), "doc_id")
    return hits.select("item_id", "doc_id", text.context_window(F.col("haystack"), F.col("at"), F.length("needle"), 30).alias("context"))


@query("""SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[“"]([^"“”]{3,}?)[”"]', 1), lambda s: trim(s)), lambda s: len(regexp_split_to_array(s, '\\s+')) >= 2)) AS span FROM documents""")
def quoted_spans(spark, d):
    return T(spark, d, "documents").select("doc_id", F.explode(text.quoted_spans(F.col("text"))).alias("span"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_shipdate DESC) AS rn FROM lineitem)
SELECT o.o_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice FROM orders o LEFT JOIN r ON r.l_orderkey = o.o_orderkey AND rn = 1""")
def merge_last_wins(spark, d):
    items = T(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return rel.merge_last_wins(T(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", order).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT o_orderstatus, count(*) AS n, count_if(c_custkey IS NOT NULL) AS matched, count_if(c_acctbal < 0) AS owing, count_if(c_custkey IS NULL) AS unmatched
FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderstatus""")
def merge_status_hist(spark, d):
    joined = T(spark, d, "orders").select("o_orderstatus", "o_custkey").join(T(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNotNull()).alias("matched"), F.count_if(F.col("c_acctbal") < 0).alias("owing"), F.count_if(F.col("c_custkey").isNull()).alias("unmatched"))


@query("""WITH one AS (SELECT c_custkey, max(o_totalprice) AS best FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1),
two AS (SELECT c_custkey, max(o_totalprice) AS best FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT c_custkey FROM one WHERE best >= 200000) GROUP BY 1)
SELECT c.c_custkey, CASE WHEN one.best >= 200000 THEN 'first' WHEN two.best IS NOT NULL THEN 'second' ELSE 'none' END AS stage,
CASE WHEN one.best >= 200000 THEN one.best ELSE two.best END AS score FROM customer c LEFT JOIN one USING (c_custkey) LEFT JOIN two USING (c_custkey)""")
def lookup_cascade(spark, d):
    """The second, dearer stage sees only what the first has not credibly resolved."""
    who = T(spark, d, "customer").select("c_custkey")
    orders = T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderpriority")
    first = orders.where("o_orderpriority = '1-URGENT'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("score")).where("score >= 200000").join(who, "c_custkey", "left_semi")
    left = rel.pending(who, first, ["c_custkey"])
    second = left.join(orders, "c_custkey").groupBy("c_custkey").agg(F.max("o_totalprice").alias("score"))
    found = first.withColumn("stage", F.lit("first")).unionByName(second.withColumn("stage", F.lit("second")))
    return who.join(found, "c_custkey", "left").withColumn("stage", F.coalesce("stage", F.lit("none")))


_PAIR = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _dated(spark, d):
    items = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    orders = T(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return items.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))


@query(f"""SELECT year(o_orderdate) AS cited, year(l_shipdate) AS filed, count(*) AS n, count_if(abs(year(l_shipdate) - year(o_orderdate)) <= 5) AS symmetric,
count_if(year(l_shipdate) - year(o_orderdate) <= 5) AS one_sided, count_if(year(o_orderdate) >= 1990) AS in_era {_PAIR} GROUP BY ALL""")
def temporal_gates(spark, d):
    y, c = F.year("l_shipdate"), F.year("o_orderdate")
    return _dated(spark, d).groupBy(c.alias("cited"), y.alias("filed")).agg(
        F.count("*").alias("n"), F.count_if(rules.temporal_gate(y, c)).alias("symmetric"), F.count_if(rules.filing_gate(y, c)).alias("one_sided"), F.count_if(rules.era_gate(c)).alias("in_era"))


@query(f"""SELECT month(o_orderdate) AS m, count(*) AS n, count_if(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= 14) AS near,
count_if(abs(date_diff('day', make_date(year(o_orderdate), 6, 15), CAST(l_shipdate AS DATE))) <= 14) AS near_by_year {_PAIR} GROUP BY ALL""")
def date_window_14d(spark, d):
    iso = F.date_format("l_shipdate", "yyyy-MM-dd")
    y, m, day = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    none = F.lit(None).cast("int")
    return _dated(spark, d).groupBy(m.alias("m")).agg(F.count("*").alias("n"), F.count_if(rules.within_days(y, m, day, iso)).alias("near"), F.count_if(rules.within_days(y, none, none, iso)).alias("near_by_year"))


@query(f"""WITH p AS (SELECT o_orderkey, o_orderdate AS o, l_shipdate AS l {_PAIR})
SELECT o_orderkey, round(max(CASE WHEN year(o) = year(l) THEN CASE WHEN month(o) <> month(l) THEN 0.75 WHEN day(o) = day(l) THEN 1.0 ELSE 0.9 END WHEN abs(year(o) - year(l)) = 1 THEN 0.5 ELSE 0.0 END), 4) AS date_share,
round(max(CASE WHEN year(o) <> year(l) THEN 0.0 WHEN month(o) = month(l) THEN greatest(0.0, 1.0 - abs(day(o) - day(l)) / 31.0) ELSE greatest(0.0, 0.3 - abs(month(o) - month(l)) / 12.0) END), 4) AS proximity FROM p GROUP BY o_orderkey""")
def date_score_proximity(spark, d):
    iso = F.date_format("l_shipdate", "yyyy-MM-dd")
    cited = (F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return _dated(spark, d).groupBy("o_orderkey").agg(F.round(F.max(rules.date_share(*cited, iso)), 4).alias("date_share"), F.round(F.max(rules.date_proximity(*cited, iso)), 4).alias("proximity"))


@query(f"""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o, CAST(l_shipdate AS DATE) AS l {_PAIR}),
f AS (SELECT o_orderkey, l, CASE WHEN l = o THEN 1 WHEN year(l) = year(o) AND abs(month(l) - month(o)) <= 1 THEN 2 WHEN year(l) = year(o) THEN 3 END AS ord FROM p)
SELECT o_orderkey, min(ord) AS ord, count_if(ord = m) AS n FROM (SELECT *, min(ord) OVER (PARTITION BY o_orderkey) AS m FROM f WHERE ord IS NOT NULL) GROUP BY o_orderkey""")
def progressive_ranges(spark, d):
    """The first range that holds a document wins: the day, then the months around, then the year. One join and one aggregation."""
    ranges = rules.date_ranges(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    filed = F.date_format("l_shipdate", "yyyy-MM-dd")
    first = F.get(F.filter(ranges, lambda r: filed.between(r["lo"], r["hi"])), F.lit(0))["ord"]
    # only lines of the order's year can lie in a range
    held = _dated(spark, d).where(F.year("l_shipdate") == F.year("o_orderdate")).select("o_orderkey", first.alias("ord")).where("ord is not null")
    counts = held.groupBy("o_orderkey").agg(F.min("ord").alias("ord"), *[F.count_if(F.col("ord") == k).alias(f"n{k}") for k in (1, 2, 3)])
    return counts.select("o_orderkey", "ord", F.get(F.array("n1", "n2", "n3"), F.col("ord") - 1).alias("n"))


@query("""WITH s AS (SELECT p_brand, p_partkey, p_type, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS rn FROM part)
SELECT p_brand, p_partkey, p_retailprice FROM s WHERE rn = 1""")
def top1_candidate(spark, d):
    return rel.first_wins(T(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_size"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@query("""WITH t AS (SELECT *, CASE WHEN lower(p_type) LIKE '%steel%' THEN 3 WHEN lower(p_type) LIKE '%brass%' THEN 2 ELSE 0 END AS tier FROM part),
p AS (SELECT *, max(CASE WHEN tier > 0 OR p_size > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS pooled FROM t)
SELECT p_brand, p_partkey, tier, pages FROM (SELECT p_brand, p_partkey, tier, least(p_size, 50) AS pages, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 100) DESC, tier DESC, least(p_size, 50) DESC, p_partkey) AS rn
FROM p WHERE pooled = 0 OR tier > 0 OR p_size > 25) WHERE rn = 1""")
def best_doc_rank(spark, d):
    """Four sort keys inside the preferred pool, or in all rows where the pool is empty."""
    own = T(spark, d, "part").withColumn("tier", F.when(F.lower("p_type").contains("steel"), 3).when(F.lower("p_type").contains("brass"), 2).otherwise(0))
    good = (F.col("tier") > 0) | (F.col("p_size") > 25)
    pooled = own.withColumn("pooled", F.bool_or(good).over(Window.partitionBy("p_brand"))).where(~F.col("pooled") | good).withColumn("pages", F.least("p_size", F.lit(50)))
    return rel.first_wins(pooled, ["p_brand"], [F.desc(F.round(F.col("p_retailprice") / 100)), F.desc("tier"), F.desc("pages"), F.col("p_partkey")]).select("p_brand", "p_partkey", "tier", "pages")


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: len(t) >= {}))"


@query(f"""WITH t AS (SELECT p_partkey, p_brand, list_filter({_TOK.format('p_name', 4)}, lambda t: NOT list_contains({text.NAME_STOP_WORDS!r}, t)) AS tok FROM part),
f AS (SELECT p_brand, tok AS cited FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM t) WHERE rn = 1)
SELECT t.p_brand, count(*) AS n, count_if(len(cited) = 0 OR list_has_any(cited, tok)) AS kept FROM t JOIN f USING (p_brand) GROUP BY t.p_brand""")
def name_token_gate(spark, d):
    own = T(spark, d, "part").select("p_partkey", "p_brand", text.name_tokens(F.col("p_name")).alias("tok"))
    cited = rel.first_wins(own, ["p_brand"], [F.col("p_partkey")]).select("p_brand", F.col("tok").alias("cited"))
    return own.join(cited, "p_brand").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(rules.name_gate(F.col("cited"), F.col("tok"))).alias("kept"))


@query(f"""WITH t AS (SELECT p_partkey, p_brand, {_TOK.format('p_name', 3)} AS a, {_TOK.format('p_type', 3)} AS b FROM part),
f AS (SELECT * FROM t),
s AS (SELECT x.p_partkey, f.p_partkey AS file, src, len(list_intersect(v, f.a)) / len(list_distinct(list_concat(v, f.a))) AS score
FROM (SELECT p_partkey, p_brand, 1 AS src, a AS v FROM t UNION ALL SELECT p_partkey, p_brand, 2, b FROM t) x JOIN f USING (p_brand) WHERE len(v) > 0 AND len(f.a) > 0 AND x.p_partkey <> f.p_partkey)
SELECT p_partkey, file, src, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY src, score DESC, file) AS rn FROM s WHERE score >= 0.25) WHERE rn = 1""")
def token_jaccard_link(spark, d):
    """Linkage by token overlap against all files of the same brand: the first source that reaches the threshold wins.

    Equal token sets of a brand are scored once, and only against sets with a shared token. Of each set the two smallest files, and of
    each source's files the two best, are enough, since a part leaves out one file, itself.
    """
    own = T(spark, d, "part").select("p_partkey", "p_brand", F.sort_array(text.tokens(F.col("p_name"), 3)).alias("a"), F.sort_array(text.tokens(F.col("p_type"), 3)).alias("b"))
    sources = own.select("p_partkey", "p_brand", F.posexplode(F.array("a", "b")).alias("pos", "v")).withColumn("src", F.col("pos") + 1).drop("pos")
    files = own.select("p_brand", F.col("a").alias("f"), F.col("p_partkey").alias("file")).distinct()
    files = rel.top_k(files, ["p_brand", "f"], [F.col("file")], 2)
    left = sources.select("p_brand", "v").distinct().withColumn("t", F.explode("v"))
    right = files.select("p_brand", "f").distinct().withColumn("t", F.explode("f"))
    scored = left.join(right, ["p_brand", "t"]).select("p_brand", "v", "f").distinct().withColumn("score", text.jaccard(F.col("v"), F.col("f"))).where("score >= 0.25")
    named = scored.join(files, ["p_brand", "f"]).groupBy("p_brand", "v", "file").agg(F.max("score").alias("score"))
    best = rel.top_k(named, ["p_brand", "v"], [F.desc("score"), F.col("file")], 2)
    found = sources.join(best, ["p_brand", "v"]).where("p_partkey <> file")
    return rel.first_wins(found, ["p_partkey"], [F.col("src"), F.desc("score"), F.col("file")]).select("p_partkey", "file", "src", F.round("score", 6).alias("score"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    return rel.pending(T(spark, d, "documents").select("doc_id", "source"), T(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS hit FROM documents")
def cache_split(spark, d):
    return rel.cache_split(T(spark, d, "documents").select("doc_id"), T(spark, d, "labels"), "doc_id", F.col("quality") == 1)


@query("""WITH n AS (SELECT doc_id, min(quality) AS q FROM labels WHERE toxic = 0 GROUP BY 1) SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE q = 1)""")
def record_resume(spark, d):
    """A recorded outcome that is only transient is recorded again."""
    return rel.pending(T(spark, d, "documents").select("doc_id", "lang"), T(spark, d, "labels").where("toxic = 0 and quality = 1"), ["doc_id"])


@query("""SELECT CASE quality WHEN 1 THEN 'Green' ELSE 'Red' END AS expected, CASE WHEN toxic = 1 THEN 'Red' WHEN n_chars < 500 THEN 'Yellow' ELSE 'Green' END AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def gt_confusion(spark, d):
    joined = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return screening.confusion(joined, F.when(F.col("quality") == 1, "Green").otherwise("Red"), F.when(F.col("toxic") == 1, "Red").when(F.col("n_chars") < 500, "Yellow").otherwise("Green"))


@query("""SELECT lang, count(*) AS total, count_if(quality = 1 AND toxic = 0) AS correct, count_if(quality = 0 AND toxic = 1) AS caught, count_if(quality = 1 AND toxic = 1) AS over_flagged, round(count_if(quality = 1 AND toxic = 0) / count(*), 6) AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def corpus_accuracy(spark, d):
    joined = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    c = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    return joined.groupBy("lang").agg(F.count("*").alias("total"), c.alias("correct"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("caught"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("over_flagged"), F.round(c / F.count("*"), 6).alias("accuracy"))


@query("""SELECT lang, count_if(quality = 0 AND toxic = 0) AS q0_t0, count_if(quality = 0 AND toxic = 1) AS q0_t1, count_if(quality = 1 AND toxic = 0) AS q1_t0, count_if(quality = 1 AND toxic = 1) AS q1_t1 FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def label_crosstab(spark, d):
    joined = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    names = ["q0_t0", "q0_t1", "q1_t0", "q1_t1"]
    out = joined.withColumn("k", F.format_string("q%d_t%d", "quality", "toxic")).groupBy("lang").pivot("k", names).count()
    return out.fillna(0, names)


@query("""WITH x AS (SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN 'WRONG_CASE' WHEN n_chars % 7 = 0 THEN 'CITE_UNCONFIRMED' WHEN n_chars % 5 = 0 THEN 'NOT_FOUND' ELSE 'VERIFIED' END AS st,
CASE WHEN quality = 0 THEN 'partial' WHEN toxic = 1 THEN 'unsupported' ELSE 'supported' END AS su, CASE WHEN n_chars < 300 THEN 'CLOSE' ELSE 'VERBATIM' END AS q, CASE WHEN quality = 1 THEN 'green' ELSE 'Red' END AS a, CASE WHEN toxic = 1 THEN 'f' ELSE '' END AS f FROM labels JOIN documents USING (doc_id))
SELECT doc_id, CASE st WHEN 'NOT_FOUND' THEN 'Gray' WHEN 'WRONG_CASE' THEN 'Red' WHEN 'CITE_UNCONFIRMED' THEN 'CheckCite' ELSE CASE su WHEN 'unsupported' THEN 'Red' WHEN 'partial' THEN 'Yellow' ELSE CASE q WHEN 'CLOSE' THEN 'Yellow' ELSE 'Green' END END END AS color,
CASE WHEN st = 'WRONG_CASE' THEN 'Red' WHEN st = 'CITE_UNCONFIRMED' THEN 'CheckCite' WHEN st = 'NOT_FOUND' AND f = '' THEN 'Gray' WHEN a = 'green' THEN 'Green' ELSE 'Red' END AS lane FROM x""")
def lane_color(spark, d):
    x = T(spark, d, "labels").join(T(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    status = F.when(n % 9 == 0, "WRONG_CASE").when(n % 7 == 0, "CITE_UNCONFIRMED").when(n % 5 == 0, "NOT_FOUND").otherwise("VERIFIED")
    support = F.when(F.col("quality") == 0, "partial").when(F.col("toxic") == 1, "unsupported").otherwise("supported")
    return x.select("doc_id", rules.color(status, support, F.when(n < 300, "CLOSE").otherwise("VERBATIM")).alias("color"), rules.lane(status, F.when(F.col("quality") == 1, "green").otherwise("Red"), F.when(F.col("toxic") == 1, "f").otherwise("")).alias("lane"))


_AB = "a AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 10 <> 4)"


def _versions(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.where("doc_id % 10 <> 3"), docs.where("doc_id % 10 <> 4").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))


@query(f"""WITH {_AB} SELECT doc_id, a.lang AS old_lang, b.lang AS new_lang, a.n_chars AS old_n_chars, b.n_chars AS new_n_chars,
CASE WHEN a.n_chars IS NULL THEN 'gained' WHEN b.n_chars IS NULL THEN 'lost' WHEN a.lang IS NOT DISTINCT FROM b.lang THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id)""")
def ab_diff(spark, d):
    old, new = _versions(spark, d)
    return rel.difference(old, new, ["doc_id"], ["lang", "n_chars"])


@query(f"""WITH {_AB} SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'gained' WHEN b.doc_id IS NULL THEN 'lost' WHEN a.lang IS NOT DISTINCT FROM b.lang THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id) GROUP BY change""")
def snapshot_diff(spark, d):
    old, new = _versions(spark, d)
    return rel.difference(old, new, ["doc_id"], ["lang", "n_chars"]).groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT old, new, count(*) AS n, coalesce(old = 'purchase' AND new <> 'purchase', false) AS regression FROM e WHERE old IS NOT NULL GROUP BY ALL""")
def transition_matrix(spark, d):
    prior = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = T(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("new"), prior.alias("old")).where("old is not null")
    return steps.groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("regression", (F.col("old") == "purchase") & (F.col("new") != "purchase"))


@query("""WITH v AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS first FROM part GROUP BY ALL), g AS (SELECT p_brand, p_type, count(*) AS variants, min(first) AS first FROM v GROUP BY ALL HAVING count(*) > 1) SELECT * FROM g""")
def variants_per_name(spark, d):
    """Names with more than one location, and the first row that showed each."""
    own = T(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("first"))
    return own.groupBy("p_brand", "p_type").agg(F.count("*").alias("variants"), F.min("first").alias("first")).where("variants > 1")


@query("SELECT md5(text) AS h, count(*) AS n, count(DISTINCT source) AS names FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT source) > 1")
def dup_conflict(spark, d):
    return T(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("names")).where("n > 1 and names > 1")


@query(r"""WITH w AS (SELECT DISTINCT role, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) >= 5)) AS word FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT word, count_if(role = 'user') AS u, count_if(role = 'assistant') AS a FROM w GROUP BY word) SELECT CASE WHEN a = 0 THEN 'only_first' WHEN u = 0 THEN 'only_second' ELSE 'both' END AS side, count(*) AS n, min(word) AS least FROM s GROUP BY ALL""")
def toa_body_diff(spark, d):
    words = T(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).select("role", F.explode(text.tokens(F.col("text"), 5)).alias("word")).distinct()
    sides = words.groupBy("word").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return sides.groupBy(F.when(F.col("a") == 0, "only_first").when(F.col("u") == 0, "only_second").otherwise("both").alias("side")).agg(F.count("*").alias("n"), F.min("word").alias("least"))


_CELL = "SELECT lang, source, doc_id, CAST(n_chars AS DOUBLE) AS x FROM documents"
_BASE = f"c AS ({_CELL}), m AS (SELECT lang, source, median(x) AS med, count(x) AS n FROM c GROUP BY ALL), b AS (SELECT lang, source, med, n, median(abs(x - med)) AS mad FROM c JOIN m USING (lang, source) GROUP BY ALL)"


@query(f"WITH {_BASE} SELECT lang, source, round(med, 4) AS median, round(mad, 4) AS mad, n FROM b")
def median_mad(spark, d):
    return screening.median_mad(T(spark, d, "documents"), ["lang", "source"], "n_chars").select("lang", "source", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "n")


@query(f"WITH {_BASE} SELECT doc_id, round(CASE WHEN mad = 0 THEN 0 ELSE (x - med) / (1.4826 * mad) END, 4) AS z, abs(CASE WHEN mad = 0 THEN 0 ELSE (x - med) / (1.4826 * mad) END) >= 3.5 AS outlier FROM c JOIN b USING (lang, source)")
def robust_z(spark, d):
    return screening.z_scores(T(spark, d, "documents"), ["lang", "source"], "n_chars").select("doc_id", F.round("z", 4).alias("z"), "outlier")


@query("""WITH c AS (SELECT lang, source, doc_id, CAST(n_chars AS DOUBLE) AS x FROM documents), k AS (SELECT lang, source FROM c GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT a.lang, a.source, a.doc_id, a.x AS own, b.x AS x FROM c a JOIN k USING (lang, source) JOIN c b ON b.lang = a.lang AND b.source = a.source AND b.doc_id <> a.doc_id),
m AS (SELECT lang, source, doc_id, own, median(x) AS med FROM p GROUP BY ALL), q AS (SELECT m.lang, m.source, m.doc_id, m.own, m.med, median(abs(p.x - m.med)) AS mad FROM m JOIN p USING (doc_id) GROUP BY ALL)
SELECT lang, source, count(*) AS n, count_if(mad > 0 AND abs((own - med) / (1.4826 * mad)) >= 3.5) AS n_tail, round(count_if(mad > 0 AND abs((own - med) / (1.4826 * mad)) >= 3.5) / count(*), 6) AS tail_rate FROM q GROUP BY ALL""")
def loo_tail(spark, d):
    out = screening.leave_one_out(T(spark, d, "documents"), ["lang", "source"], "n_chars")
    return out.withColumn("tail_rate", F.round("tail_rate", 6))


@query("""WITH s AS (SELECT quality, unnest(['short', 'long', 'shouting']) AS signal, unnest([n_chars < 300, n_chars > 8000, text = upper(text)]) AS fired FROM labels JOIN documents USING (doc_id)),
r AS (SELECT signal, count_if(fired AND quality = 0) AS bad_fired, count_if(quality = 0) AS bad_n, count_if(fired AND quality <> 0) AS good_fired, count_if(quality <> 0) AS good_n FROM s GROUP BY signal)
SELECT *, CASE WHEN bad_fired > 0 AND good_fired = 0 THEN 'SEPARATES' WHEN bad_fired + good_fired > 0 THEN 'FIRES' ELSE 'silent' END AS verdict FROM r""")
def signal_matrix(spark, d):
    joined = T(spark, d, "labels").join(T(spark, d, "documents"), "doc_id").withColumn("stratum", F.when(F.col("quality") == 0, "bad").otherwise("good"))
    return screening.firing_matrix(joined, "stratum", {"short": F.col("n_chars") < 300, "long": F.col("n_chars") > 8000, "shouting": F.col("text") == F.upper("text")}, "bad")


@query(r"""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words, len(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS different,
length(text) - length(replace(text, chr(10), '')) + 1 AS lines, round(len(regexp_extract_all(text, '[.!?]')) / length(text), 6) AS mark_rate, contains(text, 'the') AS has_the FROM documents WHERE length(text) > 0""")
def doc_metrics(spark, d):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return T(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("different"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.round(F.regexp_count("text", F.lit("[.!?]")) / F.length("text"), 6).alias("mark_rate"), F.contains("text", F.lit("the")).alias("has_the"))


@query("SELECT conv_id, count(*) AS n, round(avg(length(text)), 4) AS mean, round(stddev_pop(length(text)) / avg(length(text)), 6) AS cv FROM conversations GROUP BY conv_id HAVING avg(length(text)) > 0")
def cv_uniformity(spark, d):
    n = F.length("text")
    return T(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_pop(n) / F.nullif(F.avg(n), F.lit(0.0)), 6).alias("cv")).where("mean > 0")


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT o_orderpriority, count(*) AS n, count_if(abs(x - o_totalprice) <= greatest(100.0, 0.05 * o_totalprice)) AS agree FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def rate_reconcile(spark, d):
    sums = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("x"))
    joined = sums.join(T(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("x") - F.col("o_totalprice")) <= F.greatest(F.lit(100.0), 0.05 * F.col("o_totalprice"))).alias("agree"))


@query("""WITH c AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 40 ELSE 20 END AS want, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS size FROM documents),
shares AS (SELECT lang, max(want) AS want, max(size) AS size FROM c GROUP BY lang UNION ALL SELECT x, 40, 0 FROM (VALUES ('en'), ('de')) AS v(x) WHERE x NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)),
rest AS (SELECT doc_id, lang, rn, row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) AS k FROM c WHERE rn > want)
SELECT doc_id, lang, rn FROM c WHERE rn <= want UNION ALL SELECT doc_id, lang, rn FROM rest WHERE k <= (SELECT sum(greatest(0, want - size)) FROM shares)""")
def stratified_sample(spark, d):
    """A sample by hash order instead of a random generator: the same at every run. What strata lack of their share is filled from the rest, by hash order."""
    large, share, rest = ("en", "de"), 40, 20
    want = F.when(F.col("lang").isin(*large), share).otherwise(rest)
    hashed = F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string")))
    own = T(spark, d, "documents").select("doc_id", "lang").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id")))
    chosen = own.where(F.col("rn") <= want)
    # a large stratum has its share even where it has no row
    sizes = {r["lang"]: r["n"] for r in T(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = dict.fromkeys(sizes, rest) | dict.fromkeys(large, share)
    lacking = sum(max(0, n - sizes.get(lang, 0)) for lang, n in shares.items())
    return chosen.unionByName(own.where(F.col("rn") > want).orderBy(hashed, "doc_id").limit(lacking)) if lacking else chosen


@query("""WITH v AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(*) AS n, count(k) AS parsed, count_if(k >= 50) AS flagged, sum(k) AS total FROM v GROUP BY 1""")
def json_flags(spark, d):
    """A cell that doesn't parse counts as empty."""
    own = T(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("parsed"), F.count_if(F.col("k") >= 50).alias("flagged"), F.sum("k").alias("total"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS filed, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def flatten_entries(spark, d):
    """Entries with nested documents, flattened again with their parent's date."""
    items = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("docs"))
    entries = T(spark, d, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return entries.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.explode("docs").alias("doc")).select("o_orderkey", "filed", "doc.*")


@query("""SELECT source, count(*) AS claims, count(DISTINCT lang) AS cards, string_agg(DISTINCT lang, '; ' ORDER BY lang) AS langs, min(doc_id) AS first FROM documents GROUP BY source""")
def grouped_cards(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(F.count("*").alias("claims"), F.countDistinct("lang").alias("cards"), F.concat_ws("; ", F.sort_array(F.collect_set("lang"))).alias("langs"), F.min("doc_id").alias("first"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, count(*) AS n_lines, count_if(regexp_matches(line, '^\s*[0-9]+')) AS numbered, round(count_if(regexp_matches(line, '^\s*[0-9]+')) / count(*), 6) AS share, max(CASE WHEN line <> '' THEN pos END) AS last FROM l GROUP BY doc_id""")
def line_gutter_ratio(spark, d):
    lines = T(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hit = F.col("line").rlike(r"^\s*[0-9]+")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(hit).alias("numbered"), F.round(F.count_if(hit) / F.count("*"), 6).alias("share"), F.max(F.when(F.col("line") != "", F.col("at") + 1)).alias("last"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'licence' WHEN contains(lower(text), '@') THEN 'contact' WHEN contains(text, '!!') THEN 'shouting' WHEN n_chars < 300 THEN 'short' ELSE 'prose' END AS kind FROM documents""")
def classify_keywords(spark, d):
    low = F.lower("text")
    return T(spark, d, "documents").select("doc_id", F.when(low.rlike("licen[cs]e"), "licence").when(low.contains("@"), "contact").when(F.col("text").contains("!!"), "shouting").when(F.col("n_chars") < 300, "short").otherwise("prose").alias("kind"))


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&\w+;', ' ', 'g'), '[\s\xA0]+', ' ', 'g'))"


@query(f"SELECT page_id, length({_VISIBLE}) AS visible, length({_VISIBLE}) < 3000 AS is_short FROM pages")
def markup_visible_length(spark, d):
    n = F.length(text.visible_text(F.col("html")))
    return T(spark, d, "pages").select("page_id", n.alias("visible"), (n < 3000).alias("is_short"))


@query(f"""WITH v AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length({_VISIBLE}) AS n FROM pages), o AS (SELECT host, list(struct_pack(page_id := page_id, n := n) ORDER BY page_id) AS all_ FROM v GROUP BY host),
f AS (SELECT host, list_reduce(list_prepend(struct_pack(page_id := CAST(-1 AS BIGINT), n := CAST(1500 AS BIGINT)), all_), lambda best, x: CASE WHEN x.n >= 3000 AND x.n > 2 * best.n THEN x ELSE best END) AS best FROM o) SELECT host, best.page_id AS page_id, best.n AS n FROM f""")
def short_text_sibling(spark, d):
    """A sibling replaces the best so far only if it is twice as long as that, one after another in order: a fold, not a maximum."""
    own = T(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length(text.visible_text(F.col("html"))).cast("long").alias("n"))
    listed = own.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("page_id", "n"))).alias("sites"))
    start = F.struct(F.lit(-1).cast("long").alias("page_id"), F.lit(1500).cast("long").alias("n"))
    best = F.aggregate("sites", start, lambda b, x: F.when((x["n"] >= 3000) & (x["n"] > 2 * b["n"]), x).otherwise(b))
    return listed.select("host", best.alias("best")).select("host", "best.page_id", "best.n")


@query("""WITH r AS (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_short' WHEN contains(text, '!!') THEN 'shouting' WHEN rn > 1 THEN 'dup_within' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'known_bad' ELSE 'kept' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def funnel_reasons(spark, d):
    """Each row is dropped for the first check it fails."""
    rank = F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("doc_id"))
    own = T(spark, d, "documents").select("doc_id", "n_chars", F.contains("text", F.lit("!!")).alias("loud"), rank.alias("rn"))
    bad = T(spark, d, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("bad")).distinct()
    reason = F.when(F.col("n_chars") < 100, "too_short").when(F.col("loud"), "shouting").when(F.col("rn") > 1, "dup_within").when(F.col("bad"), "known_bad").otherwise("kept")
    return own.join(bad, "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) SELECT lang, source, doc_id, place FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS place FROM u WHERE rn = 1 AND n_chars >= 200) WHERE place <= 3""")
def first_n_per_cell(spark, d):
    """The first three of each cell in order, one per group of equal texts."""
    one = rel.first_wins(T(spark, d, "documents").withColumn("h", F.md5("text")), ["h"], [F.col("doc_id")]).where("n_chars >= 200")
    return rel.top_k(one, ["lang", "source"], [F.col("doc_id")], 3, "place").select("lang", "source", "doc_id", "place")


@query("SELECT lang, quality, count(*) AS n, round(avg(n_chars), 3) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING count(*) >= 5")
def stratum_means(spark, d):
    return T(spark, d, "documents").select("doc_id", "lang", "n_chars").join(T(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("mean")).where("n >= 5")


@query("""SELECT d.doc_id, CASE l.quality WHEN 0 THEN 'dropped' WHEN 1 THEN 'relabelled' ELSE 'as is' END AS ruling, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS rn FROM labels) l ON l.doc_id = d.doc_id AND l.rn = 1""")
def ruling_upsert(spark, d):
    rulings = T(spark, d, "labels").withColumn("ruling", F.when(F.col("quality") == 0, "dropped").otherwise("relabelled")).withColumn("ord", F.col("quality") * 10 + F.col("toxic"))
    base = T(spark, d, "documents").select("doc_id", F.lit("as is").alias("ruling"), F.lit(0).alias("toxic"))
    return rel.upsert(base, rulings, "doc_id", ["ruling", "toxic"], "ord")


@query("""SELECT r_name, n_name, CASE WHEN rn = 1 THEN 'supreme' WHEN rn = 2 THEN 'appeals' ELSE 'district' END AS kind, series, n_name || ' ' || series AS reporter FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name), n_name) AS rn FROM nation JOIN region ON r_regionkey = n_regionkey)
JOIN (SELECT unnest(['', '2d', '3d', '4th']) AS series) ON true""")
def reporter_dim(spark, d):
    """A dimension built by preference ranking and expanded by series."""
    own = T(spark, d, "nation").join(F.broadcast(T(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.length("n_name"), "n_name")))
    kind = F.when(F.col("rn") == 1, "supreme").when(F.col("rn") == 2, "appeals").otherwise("district")
    return ranked.select("r_name", "n_name", kind.alias("kind"), F.explode(F.array(*map(F.lit, ("", "2d", "3d", "4th")))).alias("series")).withColumn("reporter", F.concat_ws(" ", "n_name", "series"))
