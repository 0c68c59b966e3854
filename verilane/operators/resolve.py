"""The resolution cascade over tables: exact location, then opinions by name, then dockets for what is left.

Inputs. citations: ord and parsed (a struct as parse_citation gives it). clusters: cluster_id, case_name, court_id, date_filed, citations
(array of "volume reporter page"). and, where known, case_name_full, docket_case_name and opinion_text.
dockets: docket_id, case_name, court_id, date_filed, docket_number. documents, if known: as operators.dockets takes them. Each stage sees only what the stages
before have not resolved; candidates are found through shared distinctive name tokens, so no stage compares all pairs. Every
ranking ends in an id, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilane.functions import courts, names, rules, text
from verilane.functions.similarity import with_name_similarity

from verilane.sources.session import cut

from .dockets import docket_pairs, is_opinion, name_pairs, share_a_token, with_best_document, with_rows
from .relational import first_wins, pending


DOCUMENT = "struct<document_id:long,description:string,date_filed:string,page_count:int,is_free:boolean>"
#: Characters of an opinion that hold its caption. Fixed value.
HEAD = 500
#: Fields of a parsed citation that no stage reads, and those that nothing reads after a candidate is scored.
UNREAD, COMPARED = ("raw_text", "is_westlaw", "ecf_document_number"), ("case_name", "plaintiff", "defendant", "docket_number")
#: What the stages read of a record.
OF_CLUSTERS, OF_DOCKETS = ("cluster_id", "case_name", "court_id", "date_filed", "citations"), ("docket_id", "case_name", "court_id", "date_filed", "docket_number")


def location_key(volume: Column, reporter: Column, page: Column) -> Column:
    return F.when(volume.isNotNull() & reporter.isNotNull() & page.isNotNull(), F.concat_ws("|", volume, F.regexp_replace(F.lower(reporter), r"[\s.]", ""), page))


def exact_lookup(citations: DataFrame, clusters: DataFrame) -> DataFrame:
    """ord and the first cluster on record at the cited location."""
    record = clusters.withColumn("_c", F.explode("citations")).withColumn("_r", text.record_cite(F.col("_c")))
    keyed = record.withColumn("_key", location_key(*(F.nullif(F.col(f"_r.{k}"), F.lit("")) for k in ("volume", "reporter", "page")))).drop("_c", "_r", "citations", "court_id", "date_filed")
    p = F.col("parsed")
    asked = citations.withColumn("_key", location_key(p["volume"], p["reporter"], p["page"])).where(F.col("_key").isNotNull())
    return first_wins(asked.join(keyed, "_key"), ["ord"], [F.col("cluster_id")])


def _parties(rule, caption: Column) -> Column:
    p = F.col("parsed")
    return rule(p["case_name"], p["plaintiff"], p["defendant"], caption)


def scored(pairs: DataFrame, record: Column, docket: Column) -> DataFrame:
    """pairs with score and cite_check."""
    p = F.col("parsed")
    cited = F.when(p["volume"].isNotNull() & p["reporter"].isNotNull() & p["page"].isNotNull(), F.concat_ws(" ", p["volume"], p["reporter"], p["page"]))
    check = rules.cite_check(cited, p["reporter"], record)
    docket_hit = F.coalesce(text.docket_number(p["docket_number"]) == text.docket_number(docket), F.lit(False))
    contradicted = p["docket_number"].isNotNull() & F.coalesce(text.docket_number(p["docket_number"]) != text.docket_number(docket), F.lit(False))
    date = rules.date_share(p["year"], p["month"], p["day"], F.col("date_filed"))
    facts = pairs.withColumn("cite_check", check).withColumn("_date", date).withColumn("_docket", docket_hit).withColumn("_contra", contradicted)
    facts = facts.withColumn("_parties", _parties(names.party_overlap, F.col("case_name")))
    # the similarity is worked out once and then read by the score
    ready = with_name_similarity(facts, p["case_name"], F.col("case_name"), "name_sim").withColumn("parsed", p.dropFields(*COMPARED))
    ready = cut(ready.drop("citations", "docket_number", "date_filed", "_state"))
    score = rules.candidate_score(
        p["court"], p["year"], F.col("name_sim"), F.coalesce(F.col("_court") == F.col("court_id"), F.lit(False)), F.coalesce(F.col("_date"), F.lit(0.0)),
        F.col("_docket"), F.col("cite_check") == "CORROBORATED", F.col("_parties"), F.col("_contra"),
    )
    return ready.withColumn("score", score).drop("_date", "_parties", "_contra").withColumnRenamed("_docket", "docket_corroborated")


def with_captions(clusters: DataFrame) -> DataFrame:
    """clusters with every source of a caption, null where there is none; of an opinion's text only its head goes on."""
    for c in ("case_name_full", "docket_case_name", "opinion_text"):
        if c not in clusters.columns:
            clusters = clusters.withColumn(c, F.lit(None).cast("string"))
    return clusters.withColumn("opinion_head", F.left("opinion_text", F.lit(HEAD))).drop("opinion_text")


def resolve(citations: DataFrame, clusters: DataFrame, dockets: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """ord, status, cluster_id, docket_id, document_id, matched_name, score, stage and warning of every citation.

    A hit by location is VERIFIED_PARTIAL where the citation has no name or the cluster no caption. Under another name it is VERIFIED with a
    warning if any caption of the record shows both parties, else WRONG_CASE. Dockets are federal, so a state court's
    citation doesn't reach them. A citation with a location or a WL number that names a federal court is NOT_FOUND, without ids, if the best
    candidate is of another court. A docket is scored by its best document's date; it is VERIFIED_VIA_RECAP if that document is the cited opinion, else
    VERIFIED_DOCKET_ONLY. A docket without documents has its score discounted unless its number is the cited one.
    """
    p = F.col("parsed")
    citations = cut(citations.select("ord", p.dropFields(*UNREAD).alias("parsed"), courts.court_id(p["court"]).alias("_court"), courts.is_state_citation(p["court"], p["reporter"]).alias("_state")))  # else every use of a field would parse the text again
    lookup = exact_lookup(citations, with_captions(clusters)).withColumn("_ok", _parties(names.lookup_name_match, F.col("case_name")))
    hits = names.caption_hits(p["case_name"], p["plaintiff"], p["defendant"], {c: F.col(c) for c in names.CAPTION_SOURCES})
    shown = F.when(F.col("_ok"), False).otherwise(F.size(hits) > 0).alias("_shown")
    lookup = cut(lookup.select("ord", p["case_name"].alias("_cited"), "cluster_id", "case_name", "_ok", shown))  # the hits are worked out once
    differs = F.when(names.formatting_only(F.col("_cited"), F.col("case_name")), "name_formatting_noise").otherwise("cl_display_name_data_bug")
    unnamed = (F.coalesce("_cited", F.lit("")) == "") | (F.coalesce("case_name", F.lit("")) == "")
    done = lookup.select(
        "ord", F.when(unnamed, "VERIFIED_PARTIAL").when(F.col("_ok") | F.col("_shown"), "VERIFIED").otherwise("WRONG_CASE").alias("status"), "cluster_id", F.lit(None).cast("long").alias("docket_id"), F.lit(None).cast("long").alias("document_id"), F.col("case_name").alias("matched_name"),
        F.lit(1.0).alias("score"), F.lit("citation_lookup").alias("stage"), F.when(unnamed, "name_unverified").when(F.col("_shown"), differs).alias("warning"),
    )
    left = pending(citations, done, ["ord"])
    anchored = left.where(p["court"].isNotNull() | p["year"].isNotNull())
    clusters, dockets = clusters.select(*OF_CLUSTERS), dockets.select(*OF_DOCKETS)
    opinions = with_rows(name_pairs(anchored, clusters, "cluster_id", rules.temporal_gate), anchored, clusters, "cluster_id").where(share_a_token(p["case_name"], F.col("case_name")))
    best = first_wins(scored(opinions, F.col("citations"), F.lit(None).cast("string")), ["ord"], [F.desc("score"), F.col("cluster_id")])
    credible = best.where(F.col("score") >= rules.STOPS_CASCADE)
    deeper = pending(anchored, credible, ["ord"]).where(~F.col("_state"))
    recap = docket_pairs(deeper, dockets)
    recap = with_best_document(recap, documents) if documents is not None else recap.withColumn("document", F.lit(None).cast(DOCUMENT))
    recap = recap.withColumn("date_filed", F.when(F.col("document").isNotNull(), F.col("document.date_filed")).otherwise(F.col("date_filed")))
    bare = scored(recap, F.array().cast("array<string>"), F.col("docket_number"))
    kept = F.col("document").isNotNull() | F.col("docket_corroborated")
    bare = bare.withColumn("score", F.when(kept, F.col("score")).otherwise(F.round(F.col("score") * rules.DOCKET_ONLY_FACTOR, 4)))
    best = best.withColumn("document", F.lit(None).cast(DOCUMENT))
    shape = lambda df, cluster, docket, stage, at: df.select("ord", "parsed", "_court", "court_id", "score", "cite_check", "docket_corroborated", "document", cluster.cast("long").alias("cluster_id"), docket.cast("long").alias("docket_id"), F.col("case_name").alias("matched_name"), F.lit(stage).alias("stage"), F.lit(at).alias("_at"))
    none = F.lit(None)
    pool = shape(best, F.col("cluster_id"), none, "opinion_search", 1).unionByName(shape(bare, none, F.col("docket_id"), "recap_docket_search", 2))
    pool = pool.withColumn("stage", F.when((F.col("_at") == 2) & F.col("docket_corroborated"), "recap_document_search").otherwise(F.col("stage")))
    top = first_wins(pool, ["ord"], [F.desc("score"), F.col("_at"), F.coalesce("cluster_id", "docket_id")])
    raw = F.when(F.col("score") < rules.RESOLVES, "NOT_FOUND").when(F.col("_at") == 1, "VERIFIED").when(is_opinion(p, F.col("document")), "VERIFIED_VIA_RECAP").otherwise("VERIFIED_DOCKET_ONLY")
    top = cut(top)
    has_cite = (p["volume"].isNotNull() & p["reporter"].isNotNull() & p["page"].isNotNull()) | p["wl_number"].isNotNull()
    elsewhere = has_cite & F.col("_court").isNotNull() & F.coalesce(F.col("court_id") != F.col("_court"), F.lit(True))
    fallback = top.where(~elsewhere).withColumn("_raw", raw).select(
        "ord", rules.demoted(F.col("_raw"), has_cite, F.col("cite_check"), F.col("docket_corroborated")).alias("status"), "cluster_id", "docket_id",
        F.when(F.col("_raw") == "VERIFIED_VIA_RECAP", F.col("document.document_id")).cast("long").alias("document_id"), "matched_name", "score", "stage",
        rules.demotion_warning(F.col("_raw"), has_cite, F.col("cite_check")).alias("warning"),
    )
    found = done.unionByName(fallback)
    no = F.lit(False)
    status = rules.promoted(F.coalesce("status", F.lit("NOT_FOUND")), no, no, p["court"], p["year"])
    out = citations.select("ord", "parsed").join(found, "ord", "left").withColumn("status", status)
    lost = F.col("status").isin("VERIFICATION_INCOMPLETE", "INSUFFICIENT_DATA")
    for c in ("cluster_id", "docket_id", "document_id"):
        out = out.withColumn(c, F.when(~lost, F.col(c)))
    return out.drop("parsed")
