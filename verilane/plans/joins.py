"""Joins that need more than an equality of keys: similar sets, passages, intervals, prefixes, runs and numbering, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verilane.functions import rules, text
from verilane.operators import citestream
from verilane.operators import relational as rel
from verilane.operators.clusters import largest_clusters_of_rows
from verilane.operators.fuzzy import fuzzy_quotes
from verilane.operators.passages import occurrences
from verilane.operators.ranges import in_intervals, longest_prefix, numbered, without_gutters
from verilane.operators.similar import TextSets, digest, set_pairs
from verilane.sources.session import cut

from .tables import T

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


# --- similar sets

#: Different texts with their five-word shingles, and all pairs of them at 0.8, from every pair that shares a shingle.
_ALIKE = r"""w AS (SELECT unhex(md5(text)) AS t, min(doc_id) AS doc_id, list_filter(regexp_split_to_array(lower(any_value(text)), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents GROUP BY 1),
sh AS (SELECT DISTINCT t, hash(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END) AS s FROM (SELECT t, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
k AS (SELECT t, count(*) AS n FROM sh GROUP BY t),
m AS (SELECT a.t AS t1, b.t AS t2, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.t <> b.t GROUP BY ALL),
alike AS (SELECT t1, t2, x.n AS n1, y.n AS n2, shared, x.n + y.n - shared AS total FROM m JOIN k x ON x.t = t1 JOIN k y ON y.t = t2 WHERE shared * 5 >= 4 * (x.n + y.n - shared))"""


@query(f"""WITH {_ALIKE}, d AS (SELECT doc_id, unhex(md5(text)) AS t, left(text, 40) AS p, length(text) AS n FROM documents),
c AS (SELECT a.doc_id, b.doc_id AS other, CASE WHEN a.t = b.t THEN 0.99 ELSE 0.92 END AS score FROM d a JOIN d b ON a.p = b.p AND a.doc_id <> b.doc_id WHERE a.t = b.t OR abs(a.n - b.n) <= 50
UNION ALL SELECT a.doc_id, b.doc_id, round(shared / total, 3) FROM alike JOIN d a ON a.t = t1 JOIN d b ON b.t = t2),
s AS (SELECT doc_id, other, max(score) AS score FROM c GROUP BY ALL)
SELECT doc_id, other, score, CASE WHEN score >= 0.90 THEN 'high' ELSE 'possible' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS rn FROM s) WHERE rn <= 10""")
def dup_finder_tiers(spark, d):
    """The ten best partners of each row: equal texts (0.99), texts of one opening and nearly one length (0.92), and texts whose shingles are alike.

    Likeness is found by the exact similarity join, whatever the texts begin with. Of equal texts the eleven smallest ids are enough. A row with under
    ten equal ones takes those of its opening from the twenty smallest ids within 50 of its length (at most ten of them have its own
    text), and of each like text the ten smallest ids.
    """
    docs = T(spark, d, "documents").select("doc_id", "text")
    own = docs.select("doc_id", digest(F.col("text")).alias("h"), F.left("text", F.lit(40)).alias("p"), F.length("text").alias("n"))
    named = own.withColumnsRenamed({"doc_id": "other", "h": "h2"})
    exact = own.join(rel.top_k(named, ["p", "h2"], [F.col("other")], 11).drop("n").withColumnRenamed("h2", "h"), ["p", "h"]).select("doc_id", "other", F.lit(0.99).alias("score"))
    few = own.join(own.groupBy("p", "h").count().where("count <= 10").drop("count"), ["p", "h"])
    least = rel.top_k(named, ["p", "n"], [F.col("other")], 20)
    spans = few.select("p", F.col("n").alias("at")).distinct().withColumn("n", F.explode(F.sequence(F.col("at") - 50, F.col("at") + 50)))
    around = rel.top_k(spans.join(least, ["p", "n"]), ["p", "at"], [F.col("other")], 20).drop("n").withColumnRenamed("at", "n")
    near = few.join(around, ["p", "n"]).where("h <> h2").select("doc_id", "other", F.lit(0.92).alias("score"))
    pairs = TextSets(docs, any_id="doc_id").pairs().withColumn("score", F.round(F.col("shared") / F.col("total"), 3))
    both = pairs.select(F.col("t1").alias("h"), F.col("t2").alias("h2"), "score").unionByName(pairs.select(F.col("t2").alias("h"), F.col("t1").alias("h2"), "score"))
    partners = rel.top_k(both.join(rel.top_k(named.select("other", "h2"), ["h2"], [F.col("other")], 10), "h2"), ["h"], [F.desc("score"), F.col("other")], 10)
    like = own.select("doc_id", "h").join(partners, "h").select("doc_id", "other", "score")
    scored = exact.unionByName(near).unionByName(like).where("doc_id <> other").groupBy("doc_id", "other").agg(F.max("score").alias("score"))
    best = rel.top_k(scored, ["doc_id"], [F.desc("score"), F.col("other")], 10)
    return best.select("doc_id", "other", "score", F.when(F.col("score") >= 0.90, "high").otherwise("possible").alias("tier"))


@query(f"""WITH {_ALIKE} SELECT a.doc_id, b.doc_id AS other, round(shared / total, 6) AS jaccard, round(shared / least(n1, n2), 6) AS overlap, shared = n1 AS inside, shared = n2 AS holds
FROM alike JOIN w a ON a.t = t1 JOIN w b ON b.t = t2 WHERE a.doc_id < b.doc_id""")
def token_sets(spark, d):
    """Jaccard, overlap and subset of the shingle sets of all pairs of different texts that are alike, each text by its smallest id."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    first = docs.groupBy(digest(F.col("text")).alias("t")).agg(F.min("doc_id").alias("id"))
    found = TextSets(docs, any_id="doc_id")
    sizes = found.sets.select("t", "n").join(first, "t")
    ends = [sizes.withColumnsRenamed({"t": f"t{k}", "n": f"n{k}", "id": f"id{k}"}) for k in (1, 2)]
    pairs = found.pairs().join(ends[0], "t1").join(ends[1], "t2")
    mine = F.col("id1") < F.col("id2")
    n1, n2 = F.when(mine, F.col("n1")).otherwise(F.col("n2")), F.when(mine, F.col("n2")).otherwise(F.col("n1"))
    return pairs.select(
        F.least("id1", "id2").alias("doc_id"), F.greatest("id1", "id2").alias("other"), F.round(F.col("shared") / F.col("total"), 6).alias("jaccard"),
        F.round(F.col("shared") / F.least("n1", "n2"), 6).alias("overlap"), (F.col("shared") == n1).alias("inside"), (F.col("shared") == n2).alias("holds"),
    )


@query(r"""WITH c AS (SELECT p_brand, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: len(t) >= 3))) AS tok, p_type, p_size, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY ALL)
SELECT a.k AS p_partkey, b.k AS candidate, a.n AS copies, b.n AS candidate_copies, round(0.5 * s * CASE WHEN s > 0.3 THEN 1.0 ELSE 0.25 END + 0.2 * CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END + 0.2 * CASE WHEN a.p_size = b.p_size THEN 1.0 WHEN abs(a.p_size - b.p_size) = 1 THEN 0.5 ELSE 0 END, 3) AS score
FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.k < b.k AND len(a.tok) > 0 AND len(b.tok) > 0, LATERAL (SELECT len(list_intersect(a.tok, b.tok)) / len(list_distinct(list_concat(a.tok, b.tok))) AS s) WHERE s >= 0.4""")
def weighted_score(spark, d):
    """Every pair of parts of a brand whose names have two fifths of their words in common, scored in the candidates' shares; parts that the score can't tell apart are one row."""
    own = T(spark, d, "part").withColumn("tok", F.sort_array(text.tokens(F.col("p_name"), 3)))
    classes = own.groupBy("p_brand", "tok", "p_type", "p_size").agg(F.min("p_partkey").alias("k"), F.count("*").alias("n"))
    # names are few, parts many: names are compared once for each brand, and only parts whose names are alike meet
    names = cut(classes.where(F.size("tok") > 0).select("p_brand", "tok").distinct().withColumn("name", F.monotonically_increasing_id()))
    one, other = F.col("a").alias("na"), F.col("b").alias("nb")
    alike = set_pairs(names, "name", "tok", "0.4", ["p_brand"]).withColumn("s", F.col("shared") / F.col("total"))
    same = names.select(F.col("name").alias("na"), F.col("name").alias("nb"), F.lit(1.0).alias("s"))
    alike = alike.select(one, other, "s").unionByName(alike.select(other.alias("na"), one.alias("nb"), "s")).unionByName(same)
    named = cut(classes.join(names, ["p_brand", "tok"]).select("name", "k", "p_type", "p_size", "n"))
    ends = [named.select(F.col("name").alias(f"n{key}"), F.col("k").alias(key), F.col("p_type").alias(f"t_{key}"), F.col("p_size").alias(f"s_{key}"), F.col("n").alias(f"n_{key}")) for key in ("a", "b")]
    pairs = alike.join(ends[0], "na").join(ends[1], "nb").where("a < b")
    year = F.when(F.col("s_a") == F.col("s_b"), 1.0).when(F.abs(F.col("s_a") - F.col("s_b")) == 1, 0.5).otherwise(0.0)
    w = rules.WEIGHTS
    score = w["name"] * F.col("s") * F.when(F.col("s") > 0.3, 1.0).otherwise(rules.PARTY_FACTOR) + w["court"] * F.when(F.col("t_a") == F.col("t_b"), 1.0).otherwise(0.0) + w["date"] * year
    return pairs.select(F.col("a").alias("p_partkey"), F.col("b").alias("candidate"), F.col("n_a").alias("copies"), F.col("n_b").alias("candidate_copies"), F.round(score, 3).alias("score"))


_LINES = r"""l AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda t: len(t) >= 3))) AS tok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT row_number() OVER (ORDER BY doc_id, tok) AS node, * FROM (SELECT doc_id, tok, count(*) AS n FROM l WHERE len(tok) >= 4 GROUP BY ALL))"""


@query(f"""WITH RECURSIVE {_LINES}, e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.node <> b.node WHERE len(list_intersect(a.tok, b.tok)) * 5 >= 3 * len(list_distinct(list_concat(a.tok, b.tok)))),
r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach), c AS (SELECT node, min(reach) AS root FROM r GROUP BY node),
s AS (SELECT doc_id, root, sum(n) AS size FROM n JOIN c USING (node) GROUP BY ALL) SELECT doc_id, count(*) AS n_clusters, CAST(max(size) AS BIGINT) AS max_cluster FROM s GROUP BY doc_id""")
def proposition_clusters(spark, d):
    """Clusters of like lines of each document, found where the document lies; texts above 4 million characters by joins."""
    lines = F.transform(F.split("text", "\n"), lambda line: text.tokens(line, 3))
    return largest_clusters_of_rows(T(spark, d, "documents"), "doc_id", lines, F.length("text") > 1 << 22)


# --- passages

_CALLS = """p AS (SELECT DISTINCT array_to_string(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')[:2], ' ') AS phrase FROM conversations WHERE role = 'user'),
h AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS haystack FROM documents)"""


@query(f"""WITH {_CALLS}, f AS (SELECT doc_id, phrase, strpos(haystack, phrase) AS at_ FROM h JOIN p ON phrase <> '' AND contains(haystack, phrase))
SELECT doc_id, count(phrase) AS n_phrases, min(at_) AS first_at, min(phrase) AS least FROM f GROUP BY doc_id""")
def known_fakes(spark, d):
    """Documents that hold any of the phrases that user turns open with, as substrings: thousands of short patterns, one scan of the documents."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    turns = T(spark, d, "conversations").where("role = 'user'")
    phrases = turns.select(F.array_join(F.slice(F.split(flat("text"), " "), 1, 2), " ").alias("needle")).distinct()
    found = occurrences(phrases, T(spark, d, "documents").select("doc_id", flat("text").alias("haystack")), "doc_id")
    return found.groupBy("doc_id").agg(F.count("needle").alias("n_phrases"), F.min("at").cast("long").alias("first_at"), F.min("needle").alias("least"))


@query(None)
def fuzzy_quote(spark, d):
    """Every passage with each ninth word changed, looked for in all documents: where a fifth of its words or fewer differ, how many and what that makes of the quote."""
    quote_words = F.split(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "), " ")
    changed = F.array_join(F.transform(quote_words, lambda w, i: F.when(i % 9 == 4, "changed").otherwise(w)), " ")
    quotes = T(spark, d, "benchmark").select("item_id", changed.alias("quote"))
    found = fuzzy_quotes(quotes, T(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id", "quote", "text")
    likeness = 1 - F.col("edits") / F.col("words")
    return found.select("item_id", "doc_id", "words", "edits", F.round(likeness, 4).alias("similarity"), rules.quote_bucket(likeness).alias("result"))


# --- intervals, prefixes, runs, numbers


def _pieces(df, column: str, mark: str):
    """doc_id, k (from 0), start and stop (in characters, without the mark) of the pieces between marks."""
    each = df.select("doc_id", F.posexplode(F.split(column, mark, -1)).alias("k", "piece")).select("doc_id", "k", F.length("piece").cast("long").alias("n"))
    ends = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("k"))
    return each.select("doc_id", "k", (ends - 1 - F.col("n")).alias("start"), (ends - 1).alias("stop"))


_PIECES = """SELECT doc_id, k - 1 AS k, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - 1 - n AS start, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - 1 AS stop
FROM (SELECT doc_id, generate_subscripts(string_split(text, {0}), 1) AS k, length(unnest(string_split(text, {0}))) AS n FROM documents)"""


@query(f"""WITH l AS ({_PIECES.format("chr(10)")}), s AS (SELECT doc_id, k AS cluster, stop AS pos FROM ({_PIECES.format("'.'")})),
j AS (SELECT l.doc_id, l.k AS line, s.cluster, s.pos FROM l JOIN s ON l.doc_id = s.doc_id AND l.start <= s.pos AND s.pos < l.stop)
SELECT doc_id, line, count(*) AS n, min(pos) AS first_pos, arg_min(cluster, pos) AS cluster FROM j GROUP BY doc_id, line""")
def offset_range_join(spark, d):
    """Full stops mapped to their lines by character offset: of the offsets in a line the first one's number wins."""
    docs = T(spark, d, "documents")
    lines = _pieces(docs, "text", "\n").withColumnRenamed("k", "line")
    stops = _pieces(docs, "text", r"\.").select("doc_id", F.col("k").alias("cluster"), F.col("stop").alias("pos"))
    inside = in_intervals(stops, lines, ["doc_id"], "pos", "start", "stop")
    return inside.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min_by("cluster", "pos").alias("cluster"))


@query("""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS prefix, min(quality) AS ruling FROM labels GROUP BY 1),
j AS (SELECT d.doc_id, prefix, ruling, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(prefix) DESC) AS rn FROM documents d LEFT JOIN p ON starts_with(CAST(d.doc_id AS VARCHAR), prefix))
SELECT doc_id, prefix, ruling FROM j WHERE rn = 1""")
def prefix_rulings(spark, d):
    """Rulings of labels keyed by a prefix of a document's number: the longest one wins."""
    rulings = T(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("prefix")).agg(F.min("quality").alias("ruling"))
    return longest_prefix(T(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("c")), rulings, "c", "prefix").select("doc_id", "prefix", "ruling")


_PAGES = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS pos,
CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE '' || l_linenumber END || ' part ' || l_partkey AS line FROM lineitem)"""


@query(rf"""WITH {_PAGES}, n AS (SELECT l_orderkey, pos, TRY_CAST(regexp_extract(line, '^([0-9]{{1,2}})\s', 1) AS INTEGER) AS num FROM l), b AS (SELECT *, lag(num) OVER (PARTITION BY l_orderkey ORDER BY pos) AS prior FROM n WHERE num IS NOT NULL),
g AS (SELECT l_orderkey, count(*) AS numbered, count_if(prior IS NULL OR num <> prior + 1) AS runs, count_if(num = prior + 1) AS by_one, count(*) - 1 AS steps FROM b GROUP BY l_orderkey),
r AS (SELECT t.*, coalesce(numbered, 0) AS numbered, coalesce(steps, 0) AS steps, coalesce(by_one, 0) AS by_one, coalesce(runs, 0) AS runs FROM (SELECT l_orderkey, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS whole, string_agg(regexp_replace(line, '^[0-9]{{1,2}}\s', ''), ' ' ORDER BY pos) AS flowing FROM l GROUP BY 1) t LEFT JOIN g USING (l_orderkey))
SELECT l_orderkey, n_lines, numbered, steps, by_one, runs, gutter, CASE WHEN gutter THEN flowing ELSE whole END AS text FROM (SELECT *, n_lines >= 5 AND numbered >= 0.6 * n_lines AND by_one >= 0.5 * steps AS gutter FROM r)""")
def gutter_pages(spark, d):
    """Pages of lines, one for each order, whose lines begin with their numbers unless they were returned: a gutter of line numbers is found and taken away."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"))
    line = F.concat(F.when(F.col("l_returnflag") == "R", "returned").otherwise(F.col("l_linenumber").cast("string")), F.lit(" part "), F.col("l_partkey").cast("string"))
    lines = T(spark, d, "lineitem").select("l_orderkey", place.alias("at"), line.alias("line"))
    return without_gutters(lines, ["l_orderkey"], "at", "line").drop("longest")


@query("""WITH u AS (SELECT source AS k, doc_id * 3 AS ord FROM documents UNION ALL SELECT c_mktsegment, c_custkey * 3 + 1 FROM customer UNION ALL SELECT p_brand, p_partkey * 3 + 2 FROM part)
SELECT k, ord, row_number() OVER (ORDER BY ord) AS place FROM (SELECT k, min(ord) AS ord FROM u WHERE k IS NOT NULL GROUP BY k)""")
def ordered_union_distinct(spark, d):
    """Different keys of three lists by where they were first seen, numbered by ranges."""
    parts = [T(spark, d, t).select(F.col(k).alias("k"), (F.col(i) * 3 + at).alias("ord")) for at, (t, k, i) in enumerate((("documents", "source", "doc_id"), ("customer", "c_mktsegment", "c_custkey"), ("part", "p_brand", "p_partkey")))]
    return numbered(rel.first_seen(parts[0].unionByName(parts[1]).unionByName(parts[2]), "k", "ord"), [], [F.col("ord")], "place")


@query("""SELECT source || '-' || CASE WHEN rn < 10 THEN '0' ELSE '' END || rn AS claim_id, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""")
def claim_numbers(spark, d):
    """Ids of claims by source, numbered by ranges: a source may hold a third of all rows."""
    own = numbered(T(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], "at")
    return own.select(F.format_string("%s-%02d", "source", "at").alias("claim_id"), "doc_id")


@query("""WITH f AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 9 END AS lane FROM documents JOIN labels USING (doc_id)) SELECT lang, doc_id, lane, row_number() OVER (PARTITION BY lang ORDER BY lane, doc_id) AS card FROM f WHERE lane < 9""")
def card_numbers(spark, d):
    """One counter of cards across lanes, within each document group, numbered by ranges."""
    lane = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(9)
    own = T(spark, d, "documents").select("doc_id", "lang").join(T(spark, d, "labels"), "doc_id").withColumn("lane", lane).where("lane < 9")
    return numbered(own.select("lang", "doc_id", "lane"), ["lang"], [F.col("lane"), F.col("doc_id")], "card")


# --- citation streams


def _briefs(spark, d):
    """A brief for each customer: its orders by date, each of which cites one of three cases in full, in short, by name or by Id."""
    own = T(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("k"), (F.floor(F.col("o_orderkey") / 4) % 3).alias("j"), "o_orderdate")
    word = F.translate(F.lpad((F.col("o_custkey") * 10 + F.col("j")).cast("string"), 9, "0"), "0123456789", "bcdfghjklm")
    page = F.col("o_custkey") % 500 + 1
    said = (
        F.when(F.col("k") == 0, F.format_string("See P%s v. D%s, %d F.3d %d (holding so).", word, word, F.col("j") + 100, page))
        .when(F.col("k") == 1, F.lit("Id. at 5."))
        .when(F.col("k") == 2, F.format_string("See %d F.3d at 7.", F.col("j") + 100))
        .otherwise(F.format_string("See D%s, supra, at 9.", word))
    )
    lines = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", said.alias("said"))))
    return own.groupBy("o_custkey").agg(F.array_join(F.transform(lines, lambda x: x["said"]), " ").alias("text"))


_STREAM = """e AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord, o_orderkey % 4 AS k, o_orderkey // 4 % 3 AS j FROM orders),
n AS (SELECT *, CASE WHEN k = 0 OR EXISTS (SELECT 1 FROM e f WHERE f.c = e.c AND f.k = 0 AND f.j = e.j AND f.ord < e.ord) THEN j END AS t FROM e WHERE k <> 1),
a AS (SELECT e.c, e.ord, e.k, CASE WHEN e.k <> 1 THEN any_value(e.j) FILTER (e.k = 0 OR x.t IS NOT NULL) ELSE arg_max(m.s, m.ord).t END AS t FROM e LEFT JOIN n x ON x.c = e.c AND x.ord = e.ord LEFT JOIN (SELECT *, struct_pack(t := t) AS s FROM n) m ON e.k = 1 AND m.c = e.c AND m.ord < e.ord GROUP BY e.c, e.ord, e.k),
r AS (SELECT *, t IS NOT NULL AND row_number() OVER (PARTITION BY c, t ORDER BY ord) > 1 AS again FROM a)"""


@query(f"""WITH {_STREAM} SELECT c AS o_custkey, CAST(ord AS INTEGER) AS ord, CASE k WHEN 0 THEN 'full' WHEN 1 THEN 'id' WHEN 2 THEN 'short' ELSE 'supra' END AS kind, (t + 100) || ' F.3d ' || (c % 500 + 1) AS target, again FROM r""")
def citation_stream(spark, d):
    """Every citation of every brief with its kind and what it stands for."""
    return citestream.resolved(_briefs(spark, d), "o_custkey", "text")


@query(f"""WITH {_STREAM} SELECT c AS o_custkey, count(*) AS n_cites, count_if(k = 0) AS n_full, count_if(k = 2) AS n_short, count_if(k = 3) AS n_supra, count_if(k = 1) AS n_id, count_if(t IS NULL) AS unresolved, count(DISTINCT t) AS targets,
round(count_if(again) / count(*), 3) AS repeat_rate, round(count_if(k = 0) / count(*), 3) AS parenthetical_rate FROM r GROUP BY c""")
def citation_rates(spark, d):
    """How often briefs repeat what they cite, by which forms, and with a parenthetical."""
    return citestream.rates(_briefs(spark, d), "o_custkey", "text")
