"""Queries of name rules and screening signals over inline rows; the SQL holds outcomes derived by hand from the rules, or states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilane.functions import names
from verilane.operators import signals

from .fixtures import Fixture

QUERIES: dict = {}
SQL: dict = {}


def _given(name: str, made: Fixture, run) -> None:
    fields = [f.split(" ")[0] for f in made.ddl.split(", ")]
    QUERIES[name] = lambda spark, d: run(made.frame(spark))
    SQL[name] = f"SELECT {', '.join(fields)} FROM {made.sql}"


PARTIES = Fixture("case_name string, plaintiff string, defendant string, caption string, overlap boolean, lenient boolean", [
    ("Hogan v. AT&T", "Hogan", "AT&T", "U.S. ex rel. Green v. Washington", False, False), ("Fink v. Gomez", "Fink", "Gomez", "David M. Fink v. James H. Gomez, Director", True, True), ("Thompson v. Best", "Thompson", "Best", "Thompson v. Thompson", False, True),
    ("United States v. Koch", "United States", "Koch", "United States v. Ricky Koch", True, True), ("Jones v. Doe", "Jones", "Doe", "Jones v. Smith", True, True), ("NLRB v. Acme", "NLRB", "Acme", "National Labor Relations Board v. Acme Corp.", True, True), ("In re Wright", None, None, "Estate of Wright", True, True),
    ("Koch v. United States", "Koch", "United States", "Ricky Koch v. Tote", True, False), (None, None, None, "Anything v. Else", True, True), ("State v. Miller", "State", "Miller", "State v. Moore", False, False),
])
_given("party_overlap", PARTIES, lambda df: df.withColumn("overlap", names.party_overlap(F.col("case_name"), F.col("plaintiff"), F.col("defendant"), F.col("caption"))).withColumn("lenient", names.lookup_name_match(F.col("case_name"), F.col("plaintiff"), F.col("defendant"), F.col("caption"))))
_given("caption_formatting", Fixture("a string, b string, same boolean", [("Acme Corporation v. Doe", "ACME CORP. v. Doe", True), ("Orange County", "Orange Cnty", True), ("A v. B", "A v. C", False), ("", "", False), (None, "x", False)]), lambda df: df.withColumn("same", names.formatting_only(F.col("a"), F.col("b"))))
_given("name_keys", Fixture("name string, key string", [("Smith Inc. v. Jones", "smith|jones"), ("In re X", "in re x"), ("O'Neil v Lee", "o'neil|lee")]), lambda df: df.withColumn("key", names.first_words_key(F.col("name"))))
_given("squash_anchors", Fixture("name string, body string, found boolean", [("Mr. Cotton v. Acme Corp.", "see Cot ton v. A cme C orp. there", True), ("Lee v. Poe", "other words", False), ("A v. B", "a v. b", False)]), lambda df: df.withColumn("found", names.anchored_in(F.col("name"), F.col("body"))))

BRIEFS = [
    ("d1", "The Ninth Circuit held so. Smith v. Jones, 12 F.3d 345 (2d Cir. 1999). Smith v Jones, 99 F.3d 1 (1999)."), ("d2", "Certainly! Cal. UCC applies. Doe v. Roe, 1 U.S. 2 (1900); Lee v. Poe, 3 U.S. 4 (1901). Later text."),
    ("d3", "TABLE OF AUTHORITIES Adam v. Bell, 1 F.3d 2 INTRODUCTION Carr v. Dunn, 3 F.3d 4 holds."), ("d4", "Plain words only."), ("d5", "Held in 1 U.S. 2; 3 U.S. 4 and 5 F.3d 6."),
]
#: For the signals alone.
MORE_BRIEFS = [
    ("d6", "The Federal Circuit was quoted there, as elsewhere (9th Cir. 1999)."), ("d7", "The Ninth Circuit and the Second Circuit agree (9th Cir. 2001)."), ("d8", "The D.C. Circuit agrees (D.C. Cir. 2001). Roe v. Lane, 2019 WL 55 (2019). Roe v. Lane, 2020 WL 66 (2020)."),
    ("d9", "Held (Cal., 2010) there. Roe v. Lane, 2019 WL 55 (2019). Roe v. Lane, 7 F.3d 8 (1999)."),
]
_FIRED = Fixture("doc string, signal string", [
    ("d1", "court_contradiction"), ("d1", "style_variance"), ("d1", "authority_drift"), ("d2", "statute_grammar"), ("d2", "preamble"), ("d3", "toa_body_diff"), ("d6", "court_contradiction"), ("d7", "court_contradiction"), ("d9", "style_variance"), ("d9", "authority_drift"),
])
_METRICS = Fixture("doc string, n_cites int, words int, cite_density double, string_cite_rate double, has_toa boolean, cite_prop_cv double", [
    ("d1", 2, 21, 95.238, 0.0, False, 0.0), ("d2", 2, 20, 100.0, 0.0, False, 0.0), ("d3", 2, 17, 117.647, 0.0, True, 0.0), ("d4", 0, 3, 0.0, 0.0, False, 0.0), ("d5", 3, 12, 250.0, 1.0, False, 0.0),
])


def screening_signals(spark, d):
    return signals.screen(spark.createDataFrame(BRIEFS + MORE_BRIEFS, "doc string, body string"), "doc", "body")


def brief_metrics(spark, d):
    return signals.metrics(spark.createDataFrame(BRIEFS, "doc string, body string"), "doc", "body")


QUERIES |= {"screening_signals": screening_signals, "brief_metrics": brief_metrics}
SQL |= {"screening_signals": f"SELECT * FROM {_FIRED.sql}", "brief_metrics": f"SELECT * FROM {_METRICS.sql}"}
