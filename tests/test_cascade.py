"""The resolution cascade over a worked example, whose outcomes were derived by hand from the rules, and its docket half."""

from pyspark.sql import functions as F

from verilane.functions.parse import parse_citation
from verilane.operators import dockets, resolve

ASK = [
    (1, "Obergefell v. Hodges, 576 U.S. 644 (2015)"), (2, "Marbury v. Whitlock, 576 U.S. 644 (2015)"), (3, "Thornton v. Whitfield, 99 F.3d 12 (2d Cir. 1996)"), (4, "Kessler v. Brandt, No. 14-cv-2524 (N.D. Cal. 2016)"), (5, "Nobody v. Nothing, 1 X.Y. 2"), (6, "Ghost v. Phantom, 44 F.3d 55 (1995)"),
    (7, "(2015), 576 U.S. 644"), (8, "Roe v. Poe, 610 F.2d 12 (5th Cir. 1980)"), (9, "Hall v. Small, 99 N.E.2d 5 (Ind. 2001)"), (10, "Karsten v. Wolfram, 77 F.3d 9 (2d Cir. 1999)"),
    (11, "Ricky Koch v. Tote Services, 12 F.4th 34 (5th Cir. 2021)"), (12, "Lindqvist v. Marrow, 13 F.4th 35 (1st Cir. 2021)"),
]
CLUSTERS = [(10, "Obergefell v. Hodges", "scotus", "2015-06-26", ["576 U.S. 644", "135 S. Ct. 2584"]), (20, "Thornton v. Whitfield", "ca2", "1996-04-02", ["88 F.3d 77"]), (30, "Thornton v. Whitfield", "ca9", "2015-01-01", ["700 F.3d 1"]), (40, None, "ca5", "1980-01-01", ["610 F.2d 12"]), (50, "Karsten v. Wolfram", "ca9", "1999-05-05", ["180 F.3d 20"]), (60, "In re Maritime Claims", "ca5", "2021-02-03", ["12 F.4th 34"]), (70, "Estate of P.", "ca1", "2021-02-03", ["13 F.4th 35"])]
#: What else is known of some clusters: the full caption, and the opinion's text.
CAPTIONS = {60: ("Ricky Koch v. Tote Services, Inc.", None), 70: (None, "United States Court of Appeals. LINDQVIST, Appellant, v. MARROW, Appellee. Before the panel."), 10: ("James Obergefell v. Richard Hodges", "Syllabus")}
DOCKETS = [(700, "Kessler v. Brandt", "cand", "2014-06-01", "3:14-cv-02524-WHO"), (701, "Kessler v. Brandt", "cand", "2024-06-01", "24-cv-1"), (702, "Hall v. Small", "insd", "2001-03-03", "1:01-cv-00044")]
RESOLVED = [
    (1, "VERIFIED", 10, None, "citation_lookup", None), (2, "WRONG_CASE", 10, None, "citation_lookup", None), (3, "CITE_UNCONFIRMED", 20, None, "opinion_search", "cite_contradicted"), (4, "VERIFIED_DOCKET_ONLY", None, 700, "recap_document_search", None), (5, "INSUFFICIENT_DATA", None, None, None, None), (6, "NOT_FOUND", None, None, None, None),
    (7, "VERIFIED_PARTIAL", 10, None, "citation_lookup", "name_unverified"), (8, "VERIFIED_PARTIAL", 40, None, "citation_lookup", "name_unverified"), (9, "NOT_FOUND", None, None, None, None), (10, "NOT_FOUND", None, None, None, None),
    (11, "VERIFIED", 60, None, "citation_lookup", "cl_display_name_data_bug"), (12, "VERIFIED", 70, None, "citation_lookup", "cl_display_name_data_bug"),
]


def cites_of(spark, rows):
    return spark.createDataFrame(rows, "ord int, citation string").withColumn("parsed", parse_citation(F.col("citation")))


def tables(spark):
    rows = [(*r, *CAPTIONS.get(r[0], (None, None))) for r in CLUSTERS]
    clusters = spark.createDataFrame(rows, "cluster_id long, case_name string, court_id string, date_filed string, citations array<string>, case_name_full string, opinion_text string")
    return clusters, spark.createDataFrame(DOCKETS, "docket_id long, case_name string, court_id string, date_filed string, docket_number string")


def test_worked_example(spark):
    out = resolve.resolve(cites_of(spark, ASK), *tables(spark))
    got = sorted(tuple(r) for r in out.select("ord", "status", "cluster_id", "docket_id", "stage", "warning").collect())
    assert got == sorted(RESOLVED)


DOCS = "docket_id long, document_id long, description string, date_filed string, page_count int, is_free boolean"


def test_documents_refine_a_docket(spark):
    asked = [(1, "Kessler v. Brandt, No. 14-cv-2524 (N.D. Cal. Mar. 5, 2016)"), (2, "Kessler v. Brandt, 3:14-cv-02524-WHO (N.D. Cal. 2016)"), (3, "Kessler v. Brandt, No. 24-cv-1 (N.D. Cal. 2025)"), (4, "Kessler v. Brandt, No. 24-cv-1 (N.D. Cal. 1985)"), (5, "Kessler v. Brandt (N.D. Cal. 2016)"), (6, "Other v. Name, No. 14-cv-2524 (N.D. Cal. 2016)")]
    papers = [(700, 1, "ORDER setting hearing", "2016-03-05", 2, None), (700, 2, "OPINION on motion to dismiss", "2016-03-10", 20, None), (700, 3, "MOTION FOR reconsideration of opinion", "2016-03-05", 40, None), (700, 4, None, None, None, None), (701, 5, "NOTICE OF appeal", "2025-01-01", 1, None), (999, 6, "OPINION", "2016-03-05", 9, True)]
    out = resolve.resolve(cites_of(spark, asked), *tables(spark), spark.createDataFrame(papers, DOCS))
    got = {r.ord: (r.status, r.docket_id, r.document_id, r.stage) for r in out.collect()}
    assert got[1] == ("VERIFIED_DOCKET_ONLY", 700, None, "recap_document_search")  # the order of that very day ranks first, and is no opinion
    assert got[2] == ("VERIFIED_DOCKET_ONLY", 700, None, "recap_document_search")  # the year alone: the opinion is likelier, but June is far from it
    assert got[3] == ("VERIFIED_DOCKET_ONLY", 701, None, "recap_document_search")
    assert got[4][0] == "NOT_FOUND" and got[6][0] == "NOT_FOUND"  # too old for any docket; a number without a shared name
    assert got[5][:3] == ("VERIFIED_DOCKET_ONLY", 700, None) and got[5][3] == "recap_docket_search"
    free = [(*p[:5], True) if p[1] in (1, 2) else p for p in papers]
    better = resolve.resolve(cites_of(spark, asked), *tables(spark), spark.createDataFrame(free, DOCS))
    assert {r.ord: (r.status, r.document_id) for r in better.where("ord in (1, 2)").collect()} == {1: ("VERIFIED_DOCKET_ONLY", None), 2: ("VERIFIED_VIA_RECAP", 2)}


def test_best_document_against_a_loop(spark):
    import random

    from verilane.functions import rules, text

    rng = random.Random(5)
    kinds = ["OPINION", "ORDER", "MOTION TO COMPEL", "NOTICE OF FILING", "letter", None, "REPORT AND RECOMMENDATION", "stipulation and order"]
    papers = [(rng.randrange(6), k, rng.choice(kinds), rng.choice([f"20{rng.randrange(10, 20)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", None, "bad"]), rng.choice([None, 1, 5, 60, 90]), rng.choice([True, False, None])) for k in range(200)]
    asked = [(k, f"Kessler v. Brandt (N.D. Cal. {rng.choice(['', 'Mar. ', 'Mar. 5, '])}20{rng.randrange(10, 20)})") for k in range(30)]
    pairs = cites_of(spark, asked).crossJoin(spark.range(7).withColumnRenamed("id", "docket_id"))
    docs = spark.createDataFrame(papers, DOCS)
    got = {(r.ord, r.docket_id): r.document and r.document.document_id for r in dockets.with_best_document(pairs, docs).collect()}
    p, day = F.col("parsed"), F.col("date_filed")
    cited = (p["year"], p["month"], p["day"])
    free = F.coalesce("is_free", F.lit(False))
    each = pairs.join(docs, "docket_id").select(
        "ord", "docket_id", "document_id", (text.is_substantive(F.lower(F.coalesce("description", F.lit("")))) | free).alias("a"), F.coalesce(rules.date_share(*cited, day), F.lit(0.0)).alias("b"),
        F.coalesce(rules.date_proximity(*cited, day), F.lit(0.0)).alias("c"), text.opinion_tier(F.coalesce("description", F.lit("")), free).alias("d"), F.least(F.coalesce("page_count", F.lit(0)), F.lit(50)).alias("e"),
    )
    want = {}
    for r in each.collect():
        key = (r.a, r.b, r.c, r.d, r.e, -r.document_id)
        want[(r.ord, r.docket_id)] = max(want.get((r.ord, r.docket_id), key), key)
    assert got == {k: (-want[k][5] if k in want else None) for k in got} and len(got) == 30 * 7


def test_orders_a_hundred_thousand_apart_keep_their_locations(spark, tmp_path):
    from datetime import datetime

    from verilane.plans import catalog

    rows = [(k, 7, "F", datetime(1996, 5, 4), "1-URGENT") for k in (5, 100_005, 200_005)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp, l_quantity double, l_tax double"
    spark.createDataFrame([(5, 1, "R", datetime(1996, 5, 6), 9.0, 0.01)], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["resolve_cascade"](spark, str(tmp_path)).select("ord", "status", "cluster_id").collect()
    assert sorted(map(tuple, got)) == [(k, "VERIFIED", k) for k, *_ in rows]


def test_what_no_stage_reads_is_not_written(spark):
    import glob
    import os
    import random

    # an opinion's text of 300 kB, found by name: no candidate carries it
    rng = random.Random(3)
    long = ["%0300000x" % rng.getrandbits(1_200_000) for _ in range(4)]
    rows = [(k, "Thornton v. Whitfield", "ca2", "1996-04-02", [f"{80 + k} F.3d 77"], None, t) for k, t in enumerate(long)]
    clusters = spark.createDataFrame(rows, "cluster_id long, case_name string, court_id string, date_filed string, citations array<string>, docket_case_name string, opinion_text string")
    folder = spark.sparkContext._jsc.sc().getCheckpointDir
    written = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{folder().get().removeprefix('file:')}/**/part-*", recursive=True)} if folder().isDefined() else {}
    before = written()
    out = resolve.resolve(cites_of(spark, [(3, "Thornton v. Whitfield, 99 F.3d 12 (2d Cir. 1996)")]), clusters, tables(spark)[1])
    assert [(r.status, r.cluster_id) for r in out.collect()] == [("CITE_UNCONFIRMED", 0)]
    fresh = [n for f, n in written().items() if f not in before]
    assert fresh and sum(fresh) < 20_000
