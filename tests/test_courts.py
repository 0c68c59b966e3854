from pyspark.sql import functions as F

from verilane.functions import courts


def test_federal_courts_and_state_citations(spark):
    rows = [
        ("S.D. N.Y.", "F.3d", "nysd", True, False), ("nysd", None, "nysd", True, False), ("Bankr. D. Del.", None, "deb", True, False), ("2d Cir.", "F.2d", "ca2", True, False), ("D. Mass.", "WL", "mad", True, False),
        ("N.D.W. Va.", None, "wvnd", True, False), ("C.D. Cal.", None, "cacd", True, False), ("U.S.", "U.S.", "scotus", True, False), ("Ind.", "N.E.2d", None, False, True), ("indctapp", None, None, False, True),
        (None, "P.3d", None, False, True), (None, "Cal. App. 5th", None, False, True), (None, "S. Ct.", None, False, False), (None, "F. Supp. 2d", None, False, False), (None, None, None, False, False), ("nysb", None, None, True, False),
    ]
    frame = spark.createDataFrame(rows, "court string, reporter string, id string, federal boolean, state boolean")
    got = frame.select("court", "reporter", courts.court_id(F.col("court")).alias("id"), F.coalesce(courts.is_federal(F.col("court")), F.lit(False)).alias("federal"), courts.is_state_citation(F.col("court"), F.col("reporter")).alias("state"))
    assert [tuple(r) for r in got.collect()] == rows
    states = frame.limit(1).select(courts.reporter_states(F.lit("N.E.2d")), courts.reporter_states(F.lit("Kan.")), courts.reporter_states(F.lit("F.3d"))).first()
    assert states[0] == ["ill", "ind", "mass", "ny", "ohio"] and states[1] == ["kan"] and states[2] == []
    assert len(set(courts.court_keys().values())) == 14 + sum(len(d) or 1 for _, _, d in courts.DISTRICTS)
