"""The docket half of the cascade: dockets by number or name, the best document of each, and whether it is the cited opinion.

Inputs. citations: ord and parsed. dockets: docket_id, case_name, court_id, date_filed and docket_number. documents: docket_id, document_id, description,
date_filed, page_count and is_free. Dates are ISO strings.

Dockets are found by equal numbers, after normalisation, and by shared distinctive name tokens; the gates apply to both. A docket's documents are all known
here, so no range of dates is fetched first: one equi-join on the docket and one aggregation give the best document of every citation and docket, whatever
number of documents a docket holds; nothing is sorted or listed by docket. Pairs are found as two numbers, and what both sides hold is joined to them
once, after repeated pairs are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilane.functions import rules, text


def name_pairs(citations: DataFrame, candidates: DataFrame, key: str, gate) -> DataFrame:
    """Different pairs (ord, key) whose names share the hash of a distinctive token and whose years pass gate(filed, cited)."""
    hashes = lambda c: F.explode(F.transform(text.name_tokens(c), lambda t: F.xxhash64(t))).alias("_tok")
    a = citations.select("ord", F.col("parsed.year").alias("_year"), hashes(F.col("parsed.case_name")))
    b = candidates.select(key, rules.year_of(F.col("date_filed")).alias("_filed"), hashes(F.col("case_name")))
    return a.join(b, "_tok").where(gate(F.col("_filed"), F.col("_year"))).select("ord", key).distinct()


def number_pairs(citations: DataFrame, dockets: DataFrame) -> DataFrame:
    """Pairs (ord, docket_id) whose docket numbers are equal after normalisation; a citation or docket without a number has none."""
    number = lambda c: F.nullif(text.docket_number(c), F.lit("")).alias("_number")
    return citations.select("ord", number(F.col("parsed.docket_number"))).join(dockets.select("docket_id", number(F.col("docket_number"))), "_number").select("ord", "docket_id")


def with_rows(pairs: DataFrame, citations: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Pairs (ord, key) with the columns of both."""
    return pairs.join(citations, "ord").join(candidates.withColumnRenamed(key, "_own"), F.col(key).eqNullSafe(F.col("_own"))).drop("_own")


def share_a_token(cited: Column, caption: Column) -> Column:
    """Whether two names share a distinctive token."""
    return F.coalesce(F.arrays_overlap(text.name_tokens(cited), text.name_tokens(caption)), F.lit(False))


def gated(pairs: DataFrame) -> DataFrame:
    """Pairs whose names share a distinctive token, if both have a name and the cited one has any, and whose years are possible."""
    p = F.col("parsed")
    named = (F.coalesce(p["case_name"], F.lit("")) != "") & (F.coalesce("case_name", F.lit("")) != "")
    own = F.when(named, rules.name_gate(text.name_tokens(p["case_name"]), text.name_tokens(F.col("case_name")))).otherwise(True)
    return pairs.where(own & rules.filing_gate(rules.year_of(F.col("date_filed")), p["year"]) & rules.era_gate(p["year"]))


def docket_pairs(citations: DataFrame, dockets: DataFrame) -> DataFrame:
    """Every citation with every docket found by number or name, once."""
    possible = lambda filed, cited: rules.filing_gate(filed, cited) & rules.era_gate(cited)
    met = number_pairs(citations, dockets).unionByName(name_pairs(citations, dockets, "docket_id", possible)).distinct()
    return gated(with_rows(met, citations, dockets, "docket_id"))


#: Pages beyond which a document isn't taken for a likelier opinion.
MOST_PAGES = 50


def with_best_document(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs with document (document_id, description, date_filed, page_count and is_free), null where the docket has none.

    Rulings and free documents go before all others; then what the document's date earns in the score, then the nearer date, the likelier kind
    of opinion, the longer one, and the smaller id.
    """
    p, day = F.col("parsed"), F.col("_d.date_filed")
    cited = (F.col("_y"), F.col("_m"), F.col("_n"))
    free, pages = F.coalesce("_d.is_free", F.lit(False)), F.coalesce(F.col("_d.page_count").cast("int"), F.lit(0))
    described = F.coalesce("_d.description", F.lit(""))
    ruling = text.is_substantive(F.lower(described)) | free
    rank = F.struct(
        ruling.alias("ruling"), F.coalesce(rules.date_share(*cited, day), F.lit(0.0)).alias("share"), F.coalesce(rules.date_proximity(*cited, day), F.lit(0.0)).alias("near"),
        text.opinion_tier(described, free).alias("tier"), F.least(pages, F.lit(MOST_PAGES)).alias("pages"), (-F.col("_d.document_id")).alias("id"),
    )
    docs = documents.select("docket_id", F.struct("document_id", "description", "date_filed", F.coalesce("page_count", F.lit(0)).cast("int").alias("page_count"), F.coalesce("is_free", F.lit(False)).alias("is_free")).alias("_d"))
    best = pairs.select("ord", "docket_id", p["year"].alias("_y"), p["month"].alias("_m"), p["day"].alias("_n")).join(docs, "docket_id").groupBy("ord", "docket_id").agg(F.max_by("_d", rank).alias("document"))
    return pairs.join(best, ["ord", "docket_id"], "left")


def is_opinion(parsed: Column, document: Column) -> Column:
    """Whether a document is the cited opinion; false without one."""
    near = rules.within_days(parsed["year"], parsed["month"], parsed["day"], document["date_filed"])
    return F.coalesce(document["document_id"].isNotNull() & rules.is_cited_opinion(document["description"], near, F.lit(False), document["page_count"], document["is_free"]), F.lit(False))
