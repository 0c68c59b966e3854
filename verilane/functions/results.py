"""Results of the cascade as stored JSON and as the shape that a front end reads. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import STATUSES

#: Values that a stored result may hold. Fixed values.
STAGES = ["citation_lookup", "opinion_search", "recap_document_search", "recap_docket_search", "plain_docket_search", "caption_investigation"]
VERDICTS = ["resolved", "no_match", "partial", "errored", "skipped"]
TEXT_SOURCES = ["opinion_plain_text", "opinion_html", "recap_document"]
WARNINGS = [
    "silent_partial_verification", "cl_display_name_data_bug", "court_mismatch_noted", "date_close_not_exact", "name_formatting_noise", "unparseable_citation",
    "extraction_contamination_detected", "cl_duplicate_clusters", "wrong_page_number", "name_unverified", "cite_contradicted",
]
GATES = ["no_not_found", "no_wrong_case", "no_verification_incomplete", "no_partial_verification", "require_primary_reporter_resolved", "no_cite_unconfirmed"]

#: A stored result. Free-form objects are maps of strings.
SCHEMA = (
    "citation_as_written string, "
    "parsed_citation struct<raw_text:string,case_name:string,plaintiff:string,defendant:string,volume:string,reporter:string,page:string,court:string,year:int,month:int,day:int,"
    "docket_number:string,is_westlaw:boolean,wl_number:string,ecf_document_number:string>, "
    "status string, final_ids struct<cluster_id:long,opinion_id:long,docket_id:long,recap_document_id:long,absolute_url:string,text_source:string>, "
    "resolution_path array<struct<stage:string,query:map<string,string>,raw_response_summary:map<string,string>,verdict:string,confidence:double,notes:string,elapsed_ms:long>>, "
    "warnings array<struct<category:string,message:string,details:map<string,string>>>, "
    "gates_failed array<struct<gate:string,reason:string,details:map<string,string>>>, timing map<string,double>, cache_hit boolean"
)


def stored(result: Column) -> Column:
    """A result struct as JSON, nulls kept."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def loaded(value: Column) -> Column:
    """The result in stored JSON; null, a miss, if a needed key isn't there or a value is none of the known ones. Optional lists come back empty."""
    own = F.from_json(value, SCHEMA)
    known = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    every = lambda name, rule: F.coalesce(F.forall(own[name], rule), F.lit(True))
    good = (
        own["citation_as_written"].isNotNull() & known(own["status"], STATUSES)
        & (own["final_ids"]["text_source"].isNull() | known(own["final_ids"]["text_source"], TEXT_SOURCES))
        & every("resolution_path", lambda e: known(e["stage"], STAGES) & known(e["verdict"], VERDICTS))
        & every("warnings", lambda w: known(w["category"], WARNINGS) & w["message"].isNotNull())
        & every("gates_failed", lambda g: known(g["gate"], GATES) & g["reason"].isNotNull())
    )
    filled = reduce(lambda c, name: c.withField(name, F.coalesce(own[name], F.array())), ("resolution_path", "warnings", "gates_failed"), own)
    return F.when(F.coalesce(good, F.lit(False)), filled.withField("cache_hit", F.coalesce(own["cache_hit"], F.lit(False))))


def _resolving(result: Column) -> Column:
    """The last stage that resolved or partly did."""
    return F.try_element_at(F.filter(result["resolution_path"], lambda e: e["verdict"].isin("resolved", "partial")), F.lit(-1))


def diagnostics(warnings: Column, notes: Column) -> Column:
    """category and message of every warning, then each of the notes between semicolons as info; blank notes are left out."""
    said = F.transform(F.split(F.coalesce(notes, F.lit("")), "; "), lambda n: F.trim(n))
    infos = F.transform(F.filter(said, lambda n: n != ""), lambda n: F.struct(F.lit("info").alias("category"), n.alias("message")))
    return F.concat(F.coalesce(F.transform(warnings, lambda w: F.struct(w["category"].alias("category"), w["message"].alias("message"))), F.array()), infos)


def shape(result: Column) -> Column:
    """What a front end reads of a result; court and date are the cited ones."""
    stage = _resolving(result)
    parsed = result["parsed_citation"]
    return F.struct(
        result["citation_as_written"].alias("input_citation"), result["citation_as_written"].alias("citation_as_written"), result["status"].alias("status"), stage["confidence"].alias("confidence"),
        result["final_ids"]["absolute_url"].alias("matched_url"), parsed["court"].alias("matched_court"), parsed["year"].cast("string").alias("matched_date"),
        diagnostics(result["warnings"], stage["notes"]).alias("diagnostics"), F.nullif(stage["notes"], F.lit("")).alias("stage_notes"),
    )
