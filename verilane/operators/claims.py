"""The verbs over claims, each a function from DataFrames to a DataFrame that carries all other columns through.

merge -> check_quotes -> crosscheck -> triage -> apply_verdicts -> findings, and full() for the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilane.functions import rules, text
from verilane.functions.parse import parse_citation
from verilane.functions.similarity import verify_quote
from verilane.sources.session import cut

from .relational import first_wins, last_wins

LINK_THRESHOLD = 0.25


def number_claims(claims: DataFrame, document: str, order: list[str]) -> DataFrame:
    """claim_id as document-NN from 01, in order within each document."""
    at = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    return claims.withColumn("claim_id", F.format_string("%s-%02d", F.col(document), at))


def merge(claims: DataFrame, results: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Claims with the last result row of their citation: cl_status, cl_url, matched_name, matched_court, matched_court_id, syllabus."""
    own = ["status", "cl_url", "matched_name", "matched_court", "matched_court_id", "syllabus"]
    keyed = results.withColumn("_key", text.match_key(F.col("citation"))).where(F.col("_key") != "")
    last = last_wins(keyed, ["_key"], [ordinal]).select("_key", *[F.col(c).alias("cl_status" if c == "status" else c) for c in own])
    return claims.withColumn("_key", text.match_key(F.col("cited_case"))).join(last, "_key", "left").drop("_key")


def link_files(claims: DataFrame, files: DataFrame) -> DataFrame:
    """opinion_file by token overlap with the url's slug, the matched name or the cited name, the first of these that reaches the threshold.

    Only claims that are located are linked. Pairs come from shared tokens, so claims and files aren't compared one by one.
    """
    slug = F.element_at(F.split(F.regexp_replace(F.coalesce("cl_url", F.lit("")), "/+$", ""), "/"), -1)
    sources = F.array(slug, F.coalesce("matched_name", F.lit("")), F.element_at(F.split(F.coalesce("cited_case", F.lit("")), ","), 1))
    asked = claims.where(F.col("cl_status").isin(*rules.LOCATED, "WRONG_CASE")).select("claim_id", F.posexplode(F.transform(sources, lambda s: text.tokens(s, 3))).alias("_src", "_st"))
    stems = files.select("file", "ord", text.tokens(F.regexp_replace("file", r"\.[^.]*$", ""), 3).alias("_ft"))
    pairs = asked.withColumn("_t", F.explode("_st")).join(stems.withColumn("_t", F.explode("_ft")), "_t").drop("_t").dropDuplicates(["claim_id", "_src", "file"])
    scored = pairs.withColumn("_score", text.jaccard(F.col("_st"), F.col("_ft"))).where(F.col("_score") >= LINK_THRESHOLD)
    best = first_wins(scored, ["claim_id"], [F.col("_src"), F.desc("_score"), F.col("ord")]).select("claim_id", F.concat(F.lit("opinions/"), "file").alias("opinion_file"))
    return claims.drop("opinion_file").join(best, "claim_id", "left").withColumn("opinion_file", F.coalesce("opinion_file", F.lit("")))


def check_quotes(claims: DataFrame, opinions: DataFrame) -> DataFrame:
    """quote_check (JSON), quote_check_worst and quote_floor. opinions: opinion_file, body, was_ocrd. Each text is cleaned once."""
    clean = opinions.withColumn("body", text.visible_text(F.col("body")))
    clean = clean.withColumn("body", F.when(F.col("was_ocrd"), text.ocr_folded(F.col("body"))).otherwise(F.col("body")))
    quotes = claims.select("claim_id", "opinion_file", F.posexplode(F.from_json(F.coalesce("quoted_text", F.lit("[]")), "array<string>")).alias("_at", "quote"))
    joined = quotes.join(clean, "opinion_file")
    asked = F.when(F.col("was_ocrd"), text.ocr_folded(text.quote_key(F.col("quote")))).otherwise(F.col("quote"))
    checked = joined.withColumn("_q", verify_quote(asked, F.col("body")))
    severity = F.when(F.col("_q.result") == "FABRICATED", 2).when(F.col("_q.result") == "CLOSE", 1).otherwise(0)
    entry = F.struct("_at", "quote", F.col("_q.result").alias("result"), F.col("_q.similarity").alias("similarity"))
    per = checked.groupBy("claim_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["quote"].alias("quote"), e["result"].alias("result"), e["similarity"].alias("similarity")))).alias("quote_check"),
        F.max(severity).alias("_s"), F.bool_or(rules.quote_floors(F.col("_q.result"), F.col("_q.similarity"))).alias("_f"),
    )
    known = opinions.select("opinion_file", F.lit(True).alias("_has")).distinct()
    out = claims.join(per, "claim_id", "left").join(known, "opinion_file", "left")
    worst = F.when(F.col("_s").isNotNull(), F.element_at(F.array(F.lit("VERBATIM"), F.lit("CLOSE"), F.lit("FABRICATED")), F.col("_s") + 1)).when(F.col("_has"), "NO_QUOTES").otherwise("NO_OPINION")
    out = out.withColumn("quote_check_worst", worst).withColumn("quote_floor", F.when(F.col("_f"), "Yellow").otherwise("")).withColumn("quote_check", F.coalesce("quote_check", F.lit("[]")))
    return out.drop("_s", "_f", "_has")


def crosscheck(claims: DataFrame, cited_lists: DataFrame, courts: DataFrame) -> DataFrame:
    """crosscheck_flags (JSON, empty if none): location variants across lists, and a court that isn't the cited one.

    cited_lists: ord and line of all lists of a document. courts: abbrev and id.
    """
    parsed = cited_lists.withColumn("b", text.base_cite(F.trim("line"))).where("b is not null").select("ord", "line", "b.*")
    first = first_wins(parsed, ["name_norm", "volume", "reporter", "page"], [F.col("ord")])
    variants = first.groupBy("name_norm").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("_v")).where(F.size("_v") > 1).select("name_norm", F.transform("_v", lambda x: x["line"]).alias("variants"))
    squash = lambda c: F.regexp_replace(F.lower(c), r"[\s.]", "")
    dim = courts.select(squash(F.col("abbrev")).alias("_court"), F.col("id").alias("cited_id")).dropDuplicates(["_court"])
    own = claims.withColumn("name_norm", text.base_cite(F.col("cited_case"))["name_norm"]).withColumn("_cited", parse_citation(F.col("cited_case"))["court"])
    out = own.join(variants, "name_norm", "left").withColumn("_court", squash(F.col("_cited"))).join(F.broadcast(dim), "_court", "left")
    other = (F.coalesce("matched_court_id", F.lit("")) != "") & F.col("cited_id").isNotNull() & (F.col("cited_id") != F.col("matched_court_id"))
    toa = F.when(F.col("variants").isNotNull(), F.struct("variants"))
    court = F.when(other, F.struct(F.col("_cited").alias("cited"), "cited_id", F.col("matched_court_id").alias("matched_id"), F.col("matched_court").alias("matched")))
    flags = F.when(toa.isNotNull() | court.isNotNull(), F.to_json(F.struct(toa.alias("toa_mismatch"), court.alias("court_mismatch")))).otherwise("")
    return out.withColumn("crosscheck_flags", flags).drop("name_norm", "variants", "_cited", "_court", "cited_id")


def triage(claims: DataFrame) -> DataFrame:
    c = F.col
    return claims.withColumn("triage_track", rules.triage_track(c("opinion_file"), c("cl_status"), c("quote_check_worst"), c("quote_floor"), c("quoted_text"), c("crosscheck_flags")))


def apply_verdicts(claims: DataFrame, verdicts: DataFrame, version: str) -> DataFrame:
    """support and assessment from the last verdict line of the claim and prompt version; invalid values leave a claim as it is."""
    last = last_wins(verdicts.where(F.col("prompt_version") == version), ["claim_id"], ["line"]).select("claim_id", F.col("support").alias("_support"))
    valid = F.when(F.col("_support").isin("supported", "partial", "unsupported", "unverifiable"), F.col("_support"))
    worst = F.when(F.col("quote_floor") == "Yellow", "CLOSE")
    out = claims.join(last, "claim_id", "left").withColumn("support", valid)
    return out.withColumn("assessment", F.when(valid.isNotNull() & rules.assessable(F.col("opinion_file"), F.col("cl_status")), rules.color(F.col("cl_status"), valid, worst))).drop("_support")


def findings(claims: DataFrame) -> DataFrame:
    """claim_id, lane and badge: the model behind the report."""
    lane: Column = rules.lane(F.col("cl_status"), F.col("assessment"), F.col("opinion_file"))
    return claims.withColumn("lane", lane).withColumn("badge", rules.badge(F.col("lane"), F.lit(None).cast("string"), F.col("cl_status")))


def full(claims: DataFrame, results: DataFrame, files: DataFrame, opinions: DataFrame, cited_lists: DataFrame, courts: DataFrame, verdicts: DataFrame, version: str) -> DataFrame:
    """The whole chain. What both quotes and cross-checks read is cut once."""
    merged = cut(link_files(merge(claims, results), files))
    checked = cut(crosscheck(check_quotes(merged, opinions), cited_lists, courts))
    return findings(apply_verdicts(triage(checked), verdicts, version))
