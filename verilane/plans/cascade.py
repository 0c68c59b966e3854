"""The whole resolution cascade over cases made from the driver tables: orders are cases, their lines the documents of their dockets."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilane.functions import text
from verilane.functions.parse import parse_citation
from verilane.operators.resolve import resolve

from .fixtures import _begins, _like
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


#: Digits to consonants, so that every case has words of its own.
_FROM, _TO = "0123456789", "bcdfghjklm"
#: What a line of an order is as a document of its docket.
_KINDS = {"R": "OPINION AND ORDER", "A": "MOTION TO DISMISS", "N": "ORDER granting relief"}
#: A key beyond all orders: the case of another name.
_OTHER = 500_000_000


def cases(spark, d):
    """The citations of all orders, one each, and the clusters, dockets and documents that they are looked up in.

    By priority: the right location; a location that isn't on record; a docket number with the full date; another case's name at the right location; and a name
    alone. Orders that are done are on record as clusters, the others as dockets with documents.
    """
    own = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.left("o_orderpriority", F.lit(1)).alias("kind"))
    word = lambda key: F.translate(F.lpad(key.cast("string"), 9, "0"), _FROM, _TO)
    name = lambda key: F.concat(F.lit("P"), word(key), F.lit(" v. D"), word(key))
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    at = lambda page: F.format_string("%d F.3d %d", F.col("o_custkey") % 900 + 1, page)
    right, wrong = at(key + 1), at(key + _OTHER + 1)  # an order's pages are its own, however many orders there are
    number = F.format_string("1:%s-cv-%05d", F.date_format(day, "yy"), key)
    year, full = F.date_format(day, "yyyy"), F.concat(F.date_format(day, "MMM. "), F.dayofmonth(day).cast("string"), F.date_format(day, ", yyyy"))
    court = lambda when: F.concat(F.lit(" (S.D.N.Y. "), when, F.lit(")"))
    kind = F.col("kind")
    cited = (
        F.when(kind == "1", F.concat(name(key), F.lit(", "), right, court(year)))
        .when(kind == "2", F.concat(name(key), F.lit(", "), wrong, court(year)))
        .when(kind == "3", F.concat(name(key), F.lit(", No. "), number, court(full)))
        .when(kind == "4", F.concat(name(key + _OTHER), F.lit(", "), right, court(year)))
        .otherwise(name(key))
    )
    iso = F.date_format(day, "yyyy-MM-dd")
    cites = own.select(key.alias("ord"), cited.alias("citation"))
    shared = [name(key).alias("case_name"), F.lit("nysd").alias("court_id"), iso.alias("date_filed")]
    clusters = own.where("o_orderstatus = 'F'").select(key.alias("cluster_id"), *shared, F.array(right).alias("citations"))
    dockets = own.where("o_orderstatus <> 'F'").select(key.alias("docket_id"), *shared, number.alias("docket_number"))
    # dealt by the order, so that neither the lines' aggregation nor the join to dockets shuffles them again
    lines = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_quantity", "l_tax").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.min("l_shipdate").alias("day"), F.max("l_quantity").alias("pages"), F.max("l_tax").alias("tax"))
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    documents = lines.select(
        F.col("l_orderkey").alias("docket_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.try_element_at(kinds, F.col("flag")).alias("description"),
        F.date_format("day", "yyyy-MM-dd").alias("date_filed"), F.col("pages").cast("int").alias("page_count"), (F.col("tax") >= 0.05).alias("is_free"),
    )
    return cites, clusters, dockets, documents


_DOC = "lower(description)"
_SHARE = "CASE WHEN year(l.day) = year(o.day) THEN CASE WHEN kind <> '3' THEN 1.0 WHEN month(l.day) <> month(o.day) THEN 0.75 WHEN day(l.day) = day(o.day) THEN 1.0 ELSE 0.9 END WHEN abs(year(l.day) - year(o.day)) = 1 THEN 0.5 ELSE 0.0 END"
_NEAR = "CASE WHEN year(l.day) <> year(o.day) OR kind <> '3' THEN 0.0 WHEN month(l.day) = month(o.day) THEN greatest(0.0, 1.0 - abs(day(l.day) - day(o.day)) / 31.0) ELSE greatest(0.0, 0.3 - abs(month(l.day) - month(o.day)) / 12.0) END"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS printed, left(o_orderpriority, 1) AS kind, CAST(o_orderdate AS DATE) AS day FROM orders),
l AS (SELECT l_orderkey AS k, l_orderkey * 10 + l_linenumber AS document_id, CASE max(l_returnflag) WHEN 'R' THEN 'OPINION AND ORDER' WHEN 'A' THEN 'MOTION TO DISMISS' WHEN 'N' THEN 'ORDER granting relief' END AS description,
  CAST(min(l_shipdate) AS DATE) AS day, CAST(max(l_quantity) AS INTEGER) AS pages, max(l_tax) >= 0.05 AS free FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT o.k, document_id, pages, free, {_SHARE} AS share, {_NEAR} AS near, (NOT {_begins(_DOC, text.NOT_SUBSTANTIVE_PREFIXES)} AND {_like(_DOC, text.SUBSTANTIVE_WORDS)}) OR free AS ruling,
  CASE WHEN {_like(_DOC, text.LIKELY_OPINION_WORDS)} THEN CASE WHEN free THEN 3 ELSE 2 END WHEN {_like(_DOC, text.ORDER_WORDS)} THEN CASE WHEN free THEN 2 ELSE 1 END WHEN free THEN 1 ELSE 0 END AS tier,
  CASE WHEN starts_with({_DOC}, 'motion to ') OR starts_with({_DOC}, 'motion for ') OR {_like(_DOC, text.PROCEDURAL_WORDS)} THEN false
  WHEN {_like(_DOC, text.OPINION_WORDS)} AND abs(date_diff('day', CASE WHEN kind = '3' THEN o.day ELSE make_date(year(o.day), 6, 15) END, l.day)) <= 14 THEN true ELSE pages >= 5 AND free END AS opinion
  FROM o JOIN l ON l.k = o.k WHERE NOT printed AND kind IN ('1', '2', '3')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ruling DESC, share DESC, near DESC, tier DESC, least(pages, 50) DESC, document_id) AS rn FROM f) WHERE rn = 1),
s AS (SELECT o.*, b.document_id, coalesce(b.opinion, false) AS opinion, b.k IS NULL AS bare,
  CASE WHEN printed AND kind = '1' THEN 1.0 WHEN printed AND kind = '4' THEN 1.0 WHEN printed AND kind IN ('2', '3') THEN 0.9 WHEN kind IN ('1', '2', '3') THEN 0.7 + 0.2 * coalesce(share, 1.0) + CASE WHEN kind = '3' THEN 0.05 ELSE 0 END END AS s FROM o LEFT JOIN b ON b.k = o.k),
t AS (SELECT *, CASE WHEN NOT printed AND bare AND kind IN ('1', '2') THEN s * 0.6 ELSE s END AS score FROM s)
SELECT k AS ord, CASE WHEN kind = '5' THEN 'INSUFFICIENT_DATA' WHEN printed THEN CASE kind WHEN '4' THEN 'WRONG_CASE' WHEN '2' THEN 'CITE_UNCONFIRMED' ELSE 'VERIFIED' END
  WHEN kind = '4' THEN 'NOT_FOUND' WHEN opinion THEN 'VERIFIED_VIA_RECAP' WHEN kind = '3' THEN 'VERIFIED_DOCKET_ONLY' ELSE 'CITE_UNCONFIRMED' END AS status,
CASE WHEN printed AND kind <> '5' THEN k END AS cluster_id, CASE WHEN NOT printed AND kind IN ('1', '2', '3') THEN k END AS docket_id, CASE WHEN opinion THEN document_id END AS document_id, round(score, 4) AS score,
CASE WHEN kind = '5' OR (kind = '4' AND NOT printed) THEN NULL WHEN printed AND kind IN ('1', '4') THEN 'citation_lookup' WHEN printed THEN 'opinion_search' WHEN kind = '3' THEN 'recap_document_search' ELSE 'recap_docket_search' END AS stage,
CASE WHEN printed AND kind = '2' THEN 'cite_contradicted' WHEN NOT printed AND kind IN ('1', '2') THEN 'cite_not_on_record' END AS warning FROM t""")
def resolve_cascade(spark, d):
    """Every order's citation through the cascade: exact location, opinions by name, dockets by number and by name, and their best documents."""
    cites, clusters, dockets, documents = cases(spark, d)
    out = resolve(cites.withColumn("parsed", parse_citation(F.col("citation"))), clusters, dockets, documents)
    return out.select("ord", "status", "cluster_id", "docket_id", "document_id", "score", "stage", "warning")
