"""Queries of the domain rules over inline rows, which both engines read alike, and of operators over a worked example.

Where SQL can state the rule, it does; where the rule is a long chain of rewrites, the SQL holds the published expected values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilane.functions import courts, rules, similarity, text
from verilane.functions.parse import parse_citation
from verilane.operators import relational as rel

QUERIES: dict = {}
SQL: dict = {}
#: Published values: a query over the rows and the rows; some of the rules have queries over tables besides, in spellings.
VECTORS: dict = {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "CAST([" + ", ".join(map(_sql, v)) + "] AS VARCHAR[])"
    return "'" + str(v).replace("'", "''") + "'"


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


class Fixture:
    """Rows for both engines: frame() in Spark, and sql for a FROM clause in DuckDB."""

    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl, self.rows = ddl, rows
        fields = [f.strip().split(" ") for f in ddl.split(", ")]
        body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
        casts = ", ".join(f"CAST({n} AS {_TYPES[t]}) AS {n}" for n, t in fields)
        self.sql = f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(n for n, _ in fields)}))"

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)


class Mixed:
    """A row for every order: its key as the first column, and in each other column one of the values that the rows have there, by the key, so that the
    columns meet in all sorts of combinations. frame() in Spark, and sql for a FROM clause in DuckDB."""

    STEPS = (1, 2, 3, 5, 7, 11, 13, 17, 19, 23)

    def __init__(self, ddl: str, rows: list[tuple]):
        self.fields = [f.strip().split(" ") for f in ddl.split(", ")]
        self.values = [list(dict.fromkeys(tuple(r[k]) if isinstance(r[k], list) else r[k] for r in rows)) for k in range(len(self.fields))]
        key = "o_orderkey" if self.fields[0][1] in ("int", "long") else "'c' || o_orderkey"
        parts = [f"CAST([{', '.join(map(_sql, own))}] AS {_TYPES[kind]}[])[o_orderkey // {step} % {len(own)} + 1] AS {name}" for (name, kind), own, step in zip(self.fields[1:], self.values[1:], self.STEPS, strict=False)]
        self.sql = f"(SELECT {key} AS {self.fields[0][0]}, {', '.join(parts)} FROM orders)"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("o_orderkey")
        first = key if self.fields[0][1] in ("int", "long") else F.concat(F.lit("c"), key.cast("string"))
        one = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
        at = lambda own, step: F.get(own, (F.floor(key / step) % F.size(own)).cast("int"))
        cells = [at(F.array(*map(one, own)).cast(f"array<{kind}>"), step).alias(name) for (name, kind), own, step in zip(self.fields[1:], self.values[1:], self.STEPS, strict=False)]
        return spark.read.parquet(f"{sf_dir}/orders.parquet").select(first.alias(self.fields[0][0]), *cells)


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def expected(name: str, ddl: str, rows: list[tuple], rule) -> None:
    """A query that applies rule to the first columns; the last one is the published value, which the SQL returns."""
    fields = [f.strip().split(" ")[0] for f in ddl.split(", ")]
    made = Fixture(ddl, rows)

    def run(spark, d):
        return made.frame(spark).withColumn(fields[-1], rule(*map(F.col, fields[:-1])))

    VECTORS[name] = (run, rows)
    QUERIES[name], SQL[name] = run, f"SELECT {', '.join(fields)} FROM {made.sql}"


#: Published vectors. Fixed values.
expected("docket_norm", "number string, normal string", [
    ("2:17-cv-00012676", "17-cv-12676"), ("20-CV-00155-WHO", "20-cv-155"), ("C15-1228", "15-cv-1228"), ("CR15-1228", "15-cr-1228"), ("C 09-02727 WHA", "9-cv-2727"), ("CV 09-04302 LHK", "9-cv-4302"), ("03 C 7956", "3-cv-7956"),
    ("C-12-6320", "12-cv-6320"), ("20-20720-Civ", "20-cv-20720"), ("24-61529-CIV", "24-cv-61529"), ("1:10-23641-CIV", "10-cv-23641"), ("2:24-CV-00326-JPH-MJD", "24-cv-326"), ("24-cv-00953-DC-", "24-cv-953"), (None, None),
], text.docket_number)
expected("reporter_family", "reporter string, family string", [
    ("N.E.3d", "ne"), ("N.E.2d", "ne"), ("N.E.", "ne"), ("So. 3d", "so"), ("So. 2d", "so"), ("P.2d", "p"), ("P.3d", "p"), ("S.W.3d", "sw"), ("U.S.", "us"), ("S. Ct.", "sct"), ("L. Ed. 2d", "led"), ("F. Supp. 3d", "fsupp"), ("F. Supp.", "fsupp"),
    ("F.3d", "f"), ("F.4th", "f"), ("Cal.App.5th", "calapp"), ("Wn.2d", "wn"), ("WL", "wl"), ("VT", "vt"), (None, ""),
], text.reporter_family)
expected("docket_shaped", "candidate string, shaped boolean", [
    ("14-cv-2524", True), ("4:06-CV-43", True), ("24 Civ. 5026", True), ("03 C 7956", True), ("C 09-02727", True), ("12345", True), ("3", False), ("7 v. Acme Corp.", False), ("L.P.", False), ("1:2", True),
], text.docket_shaped)
expected("name_forms", "citation string, name string", [
    ("Waitz, 255 Ga. 474 (1986)", "Waitz"), ("Barlow, 59 B.R. 707", "Barlow"), ("Jager, 344 B.R. 349 (Bankr. D. Colo. 2006)", "Jager"), ("Citation 849 F. Supp. 1206 (N.D. Ind. 1994)", None), ("(La. App. 4 Cir. 10/30/13), 127 So.3d 156", None),
    ("127 So.3d 156", None), ("Obergefell v. Hodges, 576 U.S. 644 (2015)", "Obergefell v. Hodges"), ("Chetal v. AmeriCredit Corp., No. C 09-02727 WHA, 2011 WL 2560243 (N.D. Cal. 2011)", "Chetal v. AmeriCredit Corp."),
], lambda c: parse_citation(c)["case_name"])
expected("name_normalize", "name string, normal string", [
    ("In the Matter of Smith", "in re smith"), ("People v. Jones", "state v jones"), ("U.S. v. Roe & Co.", "united states v roe and company"), ("Acme,  Limited v. Doe, Petitioner", "acme v doe"), ("Dep’t of Fire", "department of fire"), ("Growth L.P. v. Commonwealth", "growth lp v state"),
], text.name_key)
expected("quote_normalize", "quote string, normal string", [
    ("“[T]he law … is clear”", '"the law is clear"'), ("it [sic] was .... so", "it was so"), ("‘plain’", "'plain'"), ("a\n  b [emphasis added]", "a b"),
], text.quote_key)
expected("ocr_fold", "raw string, folded string", [("modern tumrn", "modem tumm"), ("1O0 and O5 but Oslo", "100 and 05 but Oslo"), ("2l and l9 all", "21 and 19 all")], text.ocr_folded)
expected("safe_names", "name string, file string", [("Smith v. Jones, Inc.", "Smith_v_Jones_Inc"), ("In re  O'Neil", "In_re_O_Neil"), ("__a--b__", "a--b")], text.safe_file_name)
expected("surnames", "party string, surname string", [("Daou Systems, Inc.", "Daou"), ("Gomez,", "Gomez"), ("None", ""), ("", "")], text.surname)

CITES = Fixture("cite string", [
    ("Roe v. Wade, 410 U.S. 113, 153 (1973)",), ("Smith v. Jones, 12 F.3d 345, at 350-51 (2d Cir. 1999)",), ("Doe v. Roe, 7 N.E.2d  9",), ("In re X, 2018 WL 301424 (S.D.N.Y. Mar. 5, 2018)",), ("none",), ("Bryant v. Co., 597 So. 2d 22, 24 n.3 (1992)",),
])


@query(rf"""SELECT cite, trim(regexp_replace(cite, ',\s+(?:at\s+)?\d+(?:\s*[-–]\s*\d+)?\s*(\(|$)', ' \1', 'g')) AS stripped, regexp_replace(lower(trim(regexp_replace(cite, ',\s+(?:at\s+)?\d+(?:\s*[-–]\s*\d+)?\s*(\(|$)', ' \1', 'g'))), '\s+', ' ', 'g') AS match_key FROM {CITES.sql}""")
def pinpoint_strip(spark, d):
    return CITES.frame(spark).select("cite", text.strip_pinpoint(F.col("cite")).alias("stripped"), text.match_key(F.col("cite")).alias("match_key"))


_B = r"^(.+?),\s*(\d+)\s+([A-Z][A-Za-z0-9. '']*?)\s+(\d+)"


@query(rf"""SELECT cite, regexp_replace(lower(regexp_extract(cite, '{_B}', 1)), '[^a-z0-9]', '', 'g') AS name_norm, regexp_extract(cite, '{_B}', 2) AS volume, lower(regexp_replace(regexp_extract(cite, '{_B}', 3), '[\s.]', '', 'g')) AS reporter, regexp_extract(cite, '{_B}', 4) AS page,
regexp_extract(cite, '\((?:[^()]*?\s)?(\d{{4}})\)', 1) AS year FROM {CITES.sql} WHERE regexp_matches(cite, '{_B}')""")
def base_cite(spark, d):
    return CITES.frame(spark).withColumn("b", text.base_cite(F.col("cite"))).where("b is not null").select("cite", "b.*")


@query(rf"""SELECT cite, CASE WHEN regexp_matches(cite, '(\d{{4}})\s+WL\s+(\d+)') THEN regexp_extract(cite, '(\d{{4}})\s+WL\s+(\d+)', 1) || '|wl|' || regexp_extract(cite, '(\d{{4}})\s+WL\s+(\d+)', 2)
WHEN regexp_matches(cite, '(\d+)\s+([A-Z][A-Za-z0-9.'' ]*?)\s+(\d+)') THEN regexp_extract(cite, '(\d+)\s+([A-Z][A-Za-z0-9.'' ]*?)\s+(\d+)', 1) || '|' || regexp_replace(lower(regexp_extract(cite, '(\d+)\s+([A-Z][A-Za-z0-9.'' ]*?)\s+(\d+)', 2)), '[\s.]', '', 'g') || '|' || regexp_extract(cite, '(\d+)\s+([A-Z][A-Za-z0-9.'' ]*?)\s+(\d+)', 3) END AS core FROM {CITES.sql}""")
def core_key(spark, d):
    return CITES.frame(spark).select("cite", text.core_key(F.col("cite")).alias("core"))


PARSED = Fixture("raw_text string, plaintiff string, defendant string, volume string, reporter string, page string, court string, year int, month int, day int, docket_number string, is_westlaw boolean, wl_number string, ecf_document_number string", [
    ("Obergefell v. Hodges, 576 U.S. 644 (2015)", "Obergefell", "Hodges", "576", "U.S.", "644", None, 2015, None, None, None, False, None, None),
    ("Smith v. Jones, 12 F.3d 345 (2d Cir. 1999)", "Smith", "Jones", "12", "F.3d", "345", "2d Cir.", 1999, None, None, None, False, None, None),
    ("Doe v. Acme, No. 14-cv-2524, 2016 WL 4131149 (N.D. Cal. Aug. 3, 2016)", "Doe", "Acme", None, None, None, "N.D. Cal.", 2016, 8, 3, "14-cv-2524", True, "4131149", None),
    ("Lee v. Poe (2022) 76 Cal.App.5th 685", "Lee", "Poe", "76", "Cal.App.5th", "685", None, 2022, None, None, None, False, None, None),
    ("Roe v. Doe, 2:20-cv-1882, ECF No. 42 (Feb. 5, 2026 SDNY)", "Roe", "Doe", None, None, None, "SDNY", 2026, 2, 5, "2:20-cv-1882", False, None, "42"),
])


def parsed_vectors(spark, d):
    names = [f.split(" ")[0] for f in PARSED.ddl.split(", ")]
    return PARSED.frame(spark).select(parse_citation(F.col("raw_text")).alias("p")).select(*[F.col(f"p.{n}") for n in names])


_SEATS = [(code, state, letter) for code, state, divisions in courts.DISTRICTS for letter in divisions or [""]]
_SEAT = "[" + ", ".join(f"struct_pack(code := '{c}', state := '{s}', letter := '{x}')" for c, s, x in _SEATS) + "]"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS way, {_SEAT}[o_orderkey % {len(_SEATS)} + 1] AS s FROM orders)
SELECT o_orderkey, CASE way WHEN 4 THEN NULL WHEN 3 THEN s.code || lower(s.letter) || 'b' ELSE s.code || lower(s.letter) || 'd' END AS id FROM o""")
def court_lookup(spark, d):
    """Every order names a district court: as it is printed, without points and blanks, by its id, as its bankruptcy court, or as a court that isn't federal."""
    seats = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("state"), F.lit(x).alias("letter")) for c, s, x in _SEATS])
    own = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 5).alias("way"), F.get(seats, (F.col("o_orderkey") % len(_SEATS)).cast("int")).alias("s"))
    printed = F.concat(F.when(F.col("s.letter") != "", F.concat("s.letter", F.lit("."))).otherwise(""), F.lit("D. "), F.col("s.state"))
    said = (
        F.when(F.col("way") == 0, printed)
        .when(F.col("way") == 1, F.translate(printed, ". ", ""))
        .when(F.col("way") == 2, F.concat("s.code", F.lower("s.letter"), F.lit("d")))
        .when(F.col("way") == 3, F.concat(F.lit("Bankr. "), printed))
        .otherwise(F.concat("s.state", F.lit(" Ct. App.")))
    )
    return own.select("o_orderkey", courts.court_id(said).alias("id"))


DOCS = Mixed("id int, descr string, pages int, free boolean, filed string, wl boolean", [
    (1, "opinion and order", 12, True, "2018-03-05", False), (2, "motion to dismiss", 9, True, "2018-03-05", False), (3, "proposed order", 3, False, "2018-03-06", False), (4, "order granting motion", 7, True, "2017-01-01", False), (5, "memorandum opinion", 4, False, "2018-03-19", False),
    (6, "memorandum opinion", 4, False, "2018-03-20", False), (7, "minute order", 30, True, "2018-03-05", True), (8, "exhibit", 2, False, None, True), (9, "report and recommendation", 20, False, "bad", False), (10, "notice of ruling", 6, True, "2018-03-05", False), (11, "decree", 60, False, "2018-02-20", False),
])


def _like(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _begins(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{w}')" for w in words) + ")"


_NEAR = "coalesce(abs(date_diff('day', DATE '2018-03-05', TRY_CAST(filed AS DATE))) <= 14, false)"


@query(f"""SELECT id, NOT {_begins('descr', text.NOT_SUBSTANTIVE_PREFIXES)} AND {_like('descr', text.SUBSTANTIVE_WORDS)} AS substantive,
CASE WHEN {_like('descr', text.LIKELY_OPINION_WORDS)} THEN CASE WHEN free THEN 3 ELSE 2 END WHEN {_like('descr', text.ORDER_WORDS)} THEN CASE WHEN free THEN 2 ELSE 1 END WHEN free THEN 1 ELSE 0 END AS tier, least(pages, 50) AS pages,
{_NEAR} AS near, CASE WHEN starts_with(descr, 'motion to ') OR starts_with(descr, 'motion for ') THEN false WHEN {_like('descr', text.PROCEDURAL_WORDS)} THEN false WHEN wl THEN true WHEN {_like('descr', text.OPINION_WORDS)} AND {_NEAR} THEN true ELSE pages >= 5 AND free END AS is_opinion FROM {DOCS.sql}""")
def docket_documents(spark, d):
    near = rules.within_days(F.lit(2018), F.lit(3), F.lit(5), F.col("filed"))
    c = F.col("descr")
    return DOCS.frame(spark, d).select("id", text.is_substantive(c).alias("substantive"), text.opinion_tier(c, F.col("free")).alias("tier"), F.least("pages", F.lit(50)).alias("pages"), near.alias("near"), rules.is_cited_opinion(c, near, F.col("wl"), F.col("pages"), F.col("free")).alias("is_opinion"))


@query(f"""WITH s AS (SELECT *, NOT {_begins('descr', text.NOT_SUBSTANTIVE_PREFIXES)} AND {_like('descr', text.SUBSTANTIVE_WORDS)} AS substantive FROM {DOCS.sql})
SELECT y, m, coalesce(bool_or((substantive OR free) AND TRY_CAST(left(filed, 4) AS INTEGER) = y AND (m IS NULL OR TRY_CAST(substring(filed, 6, 2) AS INTEGER) = m)), false) AS has_match FROM s, (VALUES (2018, 3), (2018, NULL), (2016, NULL), (2018, 2)) AS q(y, m) GROUP BY y, m""")
def recap_date_match(spark, d):
    """Whether any ruling or free document is of the year and, where it is known, the month asked for; of the documents only their different months are kept."""
    asked = spark.createDataFrame([(2018, 3), (2018, None), (2016, None), (2018, 2)], "y int, m int")
    dated = DOCS.frame(spark, d).where(text.is_substantive(F.col("descr")) | F.col("free")).select(rules.year_of(F.col("filed")).alias("y"), rules.month_of(F.col("filed")).alias("month")).distinct()
    hit = F.bool_or(F.col("month").isNotNull() & F.col("m").isNull() | F.coalesce(F.col("month") == F.col("m"), F.lit(False)))
    return asked.join(dated, "y", "left").groupBy("y", "m").agg(F.coalesce(hit, F.lit(False)).alias("has_match"))


SCORES = Mixed("id int, court string, year int, sim double, court_hit boolean, date double, docket boolean, cite boolean, parties boolean, contra boolean", [
    (1, "ca2", 1999, 0.9, True, 1.0, False, False, True, False), (2, None, 1999, 0.9, False, 0.9, False, True, True, False), (3, "ca2", None, 0.5, True, 0.0, True, False, True, False), (4, None, None, 0.8, False, 0.0, False, False, True, False),
    (5, "ca2", 1999, 1.0, True, 1.0, False, False, False, False), (6, "ca2", 1999, 1.0, True, 1.0, True, False, False, False), (7, "ca2", 1999, 1.0, True, 1.0, False, False, True, True), (8, "ca2", 1999, 0.3, False, 0.5, False, True, False, False),
])


@query(f"""WITH w AS (SELECT *, CASE WHEN court IS NULL THEN 0.2 ELSE 0 END + CASE WHEN year IS NULL THEN 0.2 ELSE 0 END AS r FROM {SCORES.sql}),
t AS (SELECT *, (0.5 + r * 0.5 / 0.6) * sim * CASE WHEN parties OR cite THEN 1 ELSE 0.25 END + CASE WHEN court IS NOT NULL AND court_hit THEN 0.2 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 0.2 * date ELSE 0 END
+ CASE WHEN docket THEN 0.05 + r * 0.05 / 0.6 ELSE 0 END + CASE WHEN cite THEN 0.05 + r * 0.05 / 0.6 ELSE 0 END AS s FROM w)
SELECT id, round(CASE WHEN (NOT parties OR contra) AND NOT cite AND NOT docket THEN least(s, 0.39) ELSE s END, 4) AS score, round(CASE WHEN (NOT parties OR contra) AND NOT cite AND NOT docket THEN least(s, 0.39) ELSE s END, 4) >= 0.40 AS resolves FROM t""")
def candidate_score(spark, d):
    c = F.col
    out = SCORES.frame(spark, d).select("id", rules.candidate_score(c("court"), c("year"), c("sim"), c("court_hit"), c("date"), c("docket"), c("cite"), c("parties"), c("contra")).alias("score"))
    return out.withColumn("resolves", F.col("score") >= rules.RESOLVES)


CHECKS = Mixed("id int, cited string, reporter string, record array<string>, status string, docket_ok boolean", [
    (1, "601 U.S. 346", "U.S.", ["601 U.S. 346", "144 S. Ct. 967"], "VERIFIED", False), (2, "601 U.S. 999", "U.S.", ["601 U.S. 346"], "VERIFIED", False), (3, "144 S. Ct. 1", "S. Ct.", ["601 U.S. 346"], "VERIFIED", False), (4, "12 F.3d 1", "F.3d", [], "VERIFIED", False),
    (5, None, None, ["1 U.S. 1"], "VERIFIED", False), (6, "9 N.E.2d 4", "N.E.2d", ["8 N.E.3d 77"], "VERIFIED", False), (7, "5 F.4th 6", "F.4th", [], "VERIFIED_DOCKET_ONLY", False), (8, "5 F.4th 6", "F.4th", [], "VERIFIED_DOCKET_ONLY", True), (9, "5 F.4th 6", "F.4th", [], "VERIFIED_VIA_RECAP", False), (10, "5 F.4th 6", "F.4th", [], "NOT_FOUND", False),
])
_REPORTER = r"regexp_extract(r, '^\s*\d+\s+(.+?)\s+\S+\s*$', 1)"
_FAM = r"regexp_replace(regexp_replace(lower({}), '[\s.]', '', 'g'), '(2d|3d|4th|5th|6th|7th|8th|9th|10th)$', '')"


@query(rf"""WITH c AS (SELECT *, CASE WHEN cited IS NULL THEN 'NO_CITE_IN_INPUT' WHEN contains(lower(array_to_string(record, ', ')), lower(cited)) OR contains(regexp_replace(lower(array_to_string(record, ', ')), '\.\s+', '.', 'g'), regexp_replace(lower(cited), '\.\s+', '.', 'g')) THEN 'CORROBORATED' WHEN len(record) = 0 THEN 'NOT_ON_RECORD'
WHEN len(list_filter(record, lambda r: {_FAM.format(_REPORTER)} = {_FAM.format('reporter')})) > 0 THEN 'CONTRADICTED' ELSE 'NOT_ON_RECORD' END AS cite_check FROM {CHECKS.sql})
SELECT id, cite_check, CASE WHEN cited IS NOT NULL AND ((status = 'VERIFIED' AND cite_check = 'CONTRADICTED') OR (status = 'VERIFIED_DOCKET_ONLY' AND NOT docket_ok)) THEN 'CITE_UNCONFIRMED' ELSE status END AS new_status,
CASE WHEN cited IS NULL THEN NULL WHEN status = 'VERIFIED' AND cite_check = 'CONTRADICTED' THEN 'cite_contradicted' WHEN status = 'VERIFIED' AND cite_check = 'NOT_ON_RECORD' THEN 'cite_not_on_record' WHEN status IN ('VERIFIED_VIA_RECAP', 'VERIFIED_DOCKET_ONLY') THEN 'cite_not_on_record' END AS warning FROM c""")
def cite_check(spark, d):
    own = CHECKS.frame(spark, d).withColumn("cite_check", rules.cite_check(F.col("cited"), F.col("reporter"), F.col("record")))
    has = F.col("cited").isNotNull()
    return own.select("id", "cite_check", rules.demoted(F.col("status"), has, F.col("cite_check"), F.col("docket_ok")).alias("new_status"), rules.demotion_warning(F.col("status"), has, F.col("cite_check")).alias("warning"))


PROMOTE = Mixed("id int, status string, errored boolean, resolved boolean, court string, year int", [
    (1, "NOT_FOUND", True, False, None, None), (2, "NOT_FOUND", True, True, None, None), (3, "NOT_FOUND", False, False, None, None), (4, "NOT_FOUND", False, False, "ca2", None), (5, "NOT_FOUND", False, False, None, 1999), (6, "VERIFIED", True, False, None, None), (7, "WRONG_CASE", True, False, None, None),
])


@query(f"SELECT id, CASE WHEN status <> 'NOT_FOUND' THEN status WHEN errored AND NOT resolved THEN 'VERIFICATION_INCOMPLETE' WHEN court IS NULL AND year IS NULL THEN 'INSUFFICIENT_DATA' ELSE status END AS final FROM {PROMOTE.sql}")
def status_promotions(spark, d):
    c = F.col
    return PROMOTE.frame(spark, d).select("id", rules.promoted(c("status"), c("errored"), c("resolved"), c("court"), c("year")).alias("final"))


CLAIMS = Mixed("claim_id string, cited_case string, opinion_file string, status string, worst string, floor string, quoted string, flags string, assessment string, label string, diagnostics string", [
    ("m-01", "A v. B, 1 U.S. 1, 3 (1990)", "opinions/a.txt", "VERIFIED", "VERBATIM", "", "[]", "", "Green", "", ""), ("m-02", "C v. D, 2 F.3d 4 (1995)", "", "NOT_FOUND", "NO_OPINION", "", "", "", "", "", ""), ("m-03", "E v. F, 9 P.2d 8", "opinions/e.txt", "WRONG_CASE", "", "", "", "", "", "", "Name Mismatch: x"),
    ("m-04", "G v. H, 9 P.3d 8", "opinions/g.txt", "VERIFIED", "CLOSE", "Yellow", '["q"]', "", "Red", " Misread ", ""), ("m-05", "I v. J, 5 U.S. 5", "opinions/i.txt", "CITE_UNCONFIRMED", "VERBATIM", "", "[]", "", "Red", "mine", ""), ("m-06", "K v. L, 6 U.S. 5", "opinions/k.txt", "VERIFIED_PARTIAL", "NO_QUOTES", "", None, None, None, None, None),
    ("m-07", "M v. N, 6 U.S. 7", "opinions/m.txt", "VERIFIED", "VERBATIM", "", "[]", '{"x":1}', "yellow", "", "name mismatch"), ("m-08", "O v. P, 6 U.S. 8", "", "VERIFIED_DOCKET_ONLY", "NO_OPINION", "", "[]", "", "Red", "", ""),
])


@query(f"""SELECT claim_id, CASE WHEN coalesce(opinion_file, '') = '' OR status = 'WRONG_CASE' THEN '' WHEN worst IN ('FABRICATED', 'CLOSE') THEN 'full' WHEN trim(coalesce(floor, '')) <> '' THEN 'full' WHEN trim(coalesce(quoted, '')) NOT IN ('', '[]') THEN 'full' WHEN trim(coalesce(flags, '')) <> '' THEN 'full'
WHEN status NOT IN ('VERIFIED', 'VERIFIED_PARTIAL', 'VERIFIED_VIA_RECAP', 'VERIFIED_DOCKET_ONLY') THEN 'full' ELSE 'fast' END AS track FROM {CLAIMS.sql}""")
def triage_track(spark, d):
    c = F.col
    return CLAIMS.frame(spark, d).select("claim_id", rules.triage_track(c("opinion_file"), c("status"), c("worst"), c("floor"), c("quoted"), c("flags")).alias("track"))


_BADGE = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.BADGES.items()) + " END"


@query(f"""WITH l AS (SELECT *, CASE WHEN status = 'WRONG_CASE' THEN 'Red' WHEN status = 'CITE_UNCONFIRMED' THEN 'CheckCite' WHEN status IN ('NOT_FOUND', 'INSUFFICIENT_DATA', 'VERIFICATION_INCOMPLETE') AND coalesce(opinion_file, '') = '' THEN 'Gray'
WHEN lower(trim(coalesce(assessment, ''))) = 'green' THEN 'Green' WHEN lower(trim(coalesce(assessment, ''))) = 'red' THEN 'Red' ELSE 'Yellow' END AS lane FROM {CLAIMS.sql})
SELECT claim_id, lane, CASE lane WHEN 'Green' THEN 'Supported' WHEN 'Gray' THEN '' WHEN 'CheckCite' THEN '{rules.BADGES["CITE_UNCONFIRMED"]}' ELSE coalesce(nullif(trim(label), ''), {_BADGE}, CASE lane WHEN 'Red' THEN 'Not supported by cited case' ELSE 'Overstated -- case partially supports' END) END AS badge FROM l""")
def report_lanes(spark, d):
    own = CLAIMS.frame(spark, d).withColumn("lane", rules.lane(F.col("status"), F.col("assessment"), F.col("opinion_file")))
    return own.select("claim_id", "lane", rules.badge(F.col("lane"), F.col("label"), F.col("status")).alias("badge"))


@query(f"""SELECT count(*) AS total, count_if(contains(lower(coalesce(diagnostics, '')), 'name mismatch')) AS name_mismatches, count_if(status = 'NOT_FOUND') AS not_found, count_if(coalesce(opinion_file, '') = '' AND status NOT IN ('NOT_FOUND', '')) AS no_opinion FROM {CLAIMS.sql}""")
def metadata_flags(spark, d):
    c = F.col
    return CLAIMS.frame(spark, d).agg(F.count("*").alias("total"), F.count_if(F.lower(F.coalesce(c("diagnostics"), F.lit(""))).contains("name mismatch")).alias("name_mismatches"), F.count_if(c("status") == "NOT_FOUND").alias("not_found"), F.count_if((F.coalesce(c("opinion_file"), F.lit("")) == "") & ~c("status").isin("NOT_FOUND", "")).alias("no_opinion"))


PINS = Fixture("id int, cite string, body string", [
    (1, "A v. B, 1 U.S. 100, 105 (1990)", "x *100 y *101 z *104"), (2, "A v. B, 1 U.S. 100, 103 (1990)", "x *100 y *101 z *104"), (3, "A v. B, 1 U.S. 100, 900 (1990)", "x *100 y *101"), (4, "C v. D, 2 F.3d 4, 5 n.7", "see n. 7 and *4 *5 *6"), (5, "C v. D, 2 F.3d 4 n.8", "footnote 80 only"), (6, "junk", "*1 *2 *3"),
])
_BQ = r"^.+?,\s*\d+\s+[A-Z][A-Za-z0-9. '']*?\s+\d+"


@query(rf"""WITH p AS (SELECT *, TRY_CAST(regexp_extract(cite, '{_BQ}\s*,\s*(\d+)', 1) AS INTEGER) AS pin, list_transform(regexp_extract_all(body, '\*\s?(\d{{1,5}})\b', 1), lambda s: CAST(s AS INTEGER)) AS stars, nullif(regexp_extract(cite, '(?i)\bn\.\s*(\d+)', 1), '') AS note, regexp_matches(cite, '{_BQ}') AS ok FROM {PINS.sql})
SELECT id, CASE WHEN ok AND pin IS NOT NULL AND len(stars) >= 3 AND (pin < list_min(stars) OR pin > list_max(stars)) THEN pin END AS pinpoint, CASE WHEN ok AND note IS NOT NULL AND NOT regexp_matches(body, '(?i)(n\.\s*' || note || '\b|footnote\s+' || note || '\b|\[fn?' || note || '\])') THEN note END AS footnote_missing FROM p""")
def pincite_flag(spark, d):
    base = r"^.+?,\s*\d+\s+[A-Z][A-Za-z0-9. ']*?\s+\d+"
    own = PINS.frame(spark).withColumn("ok", F.col("cite").rlike(base)).withColumn("pin", F.regexp_extract("cite", base + r"\s*,\s*(\d+)", 1).try_cast("int"))
    own = own.withColumn("stars", F.transform(F.regexp_extract_all("body", F.lit(r"\*\s?(\d{1,5})\b"), F.lit(1)), lambda s: s.cast("int"))).withColumn("note", F.nullif(F.regexp_extract("cite", r"(?i)\bn\.\s*(\d+)", 1), F.lit("")))
    outside = F.col("ok") & (F.size("stars") >= 3) & ((F.col("pin") < F.array_min("stars")) | (F.col("pin") > F.array_max("stars")))
    shown = F.regexp_like("body", F.concat(F.lit(r"(?i)(n\.\s*"), "note", F.lit(r"\b|footnote\s+"), "note", F.lit(r"\b|\[fn?"), "note", F.lit(r"\])")))
    return own.select("id", F.when(outside, F.col("pin")).alias("pinpoint"), F.when(F.col("ok") & ~shown, F.col("note")).alias("footnote_missing"))


AUDIT = Mixed("id int, quick string, whole string, notes string, warning string", [
    (1, "VERIFIED", None, None, None), (2, "NOT_FOUND", "VERIFIED_VIA_RECAP", "found by RECAP doc", None), (3, "NOT_FOUND", "VERIFIED", "opinion", None), (4, "NOT_FOUND", "NOT_FOUND", "", None), (5, None, None, None, None), (6, "WRONG_CASE", "CITE_UNCONFIRMED", None, "recap_gap"),
])
_LOC = "('VERIFIED', 'VERIFIED_PARTIAL', 'VERIFIED_VIA_RECAP', 'VERIFIED_DOCKET_ONLY', 'CITE_UNCONFIRMED')"


@query(f"SELECT id, CASE WHEN quick IN {_LOC} THEN 'citation-lookup' WHEN whole IS NULL OR whole NOT IN {_LOC} THEN 'no_match' WHEN contains(lower(coalesce(notes, '') || coalesce(warning, '')), 'recap') THEN 'RECAP' ELSE 'opinion-search' END AS path FROM {AUDIT.sql}")
def audit_path(spark, d):
    hint = F.lower(F.concat(F.coalesce("notes", F.lit("")), F.coalesce("warning", F.lit("")))).contains("recap")
    path = F.when(F.col("quick").isin(*rules.LOCATED), "citation-lookup").when(~F.coalesce(F.col("whole").isin(*rules.LOCATED), F.lit(False)), "no_match").when(hint, "RECAP").otherwise("opinion-search")
    return AUDIT.frame(spark, d).select("id", path.alias("path"))


LEGACY = Fixture("old string", [("VERIFIED",), ("LIKELY_REAL",), ("POSSIBLE_MATCH",), ("NOT_FOUND",), ("",), ("WRONG_CASE",), (None,)])


@query(f"SELECT old, CASE WHEN old IN ('LIKELY_REAL', 'POSSIBLE_MATCH') THEN 'VERIFIED' ELSE nullif(old, '') END AS status FROM {LEGACY.sql}")
def legacy_status(spark, d):
    """Old names are mapped, blanks are null, and an unknown name raises."""
    known = F.col("old").isin(*rules.STATUSES)
    mapped = F.when(F.coalesce("old", F.lit("")) == "", None).when(F.col("old").isin("LIKELY_REAL", "POSSIBLE_MATCH"), "VERIFIED").when(known, F.col("old")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), "old")).cast("string"))
    return LEGACY.frame(spark).select("old", mapped.alias("status"))


FIELDS = Mixed("id int, plain_text string, html_with_citations string, html string, xml_harvard string, local_path string, download_url string", [
    (1, "text", "<p>h</p>", None, None, "pdf/2018/a.pdf", None), (2, "  ", "<p>h</p>", "x", None, "txt/a", "http://x/a.pdf"), (3, None, None, " ", "<x>q</x>", None, "http://x/a.html"), (4, None, None, None, None, None, None),
])


@query(rf"""SELECT id, CASE WHEN trim(plain_text) <> '' THEN 'plain_text' WHEN trim(html_with_citations) <> '' THEN 'html_with_citations' WHEN trim(html) <> '' THEN 'html' WHEN trim(xml_harvard) <> '' THEN 'xml_harvard' END AS field,
CASE WHEN trim(plain_text) <> '' THEN plain_text WHEN trim(html_with_citations) <> '' THEN trim(regexp_replace(html_with_citations, '<[^>]+>', ' ', 'g')) WHEN trim(html) <> '' THEN trim(regexp_replace(html, '<[^>]+>', ' ', 'g')) WHEN trim(xml_harvard) <> '' THEN trim(regexp_replace(xml_harvard, '<[^>]+>', ' ', 'g')) END AS text,
CASE WHEN starts_with(local_path, 'pdf/') THEN local_path WHEN NOT regexp_matches(lower(download_url), '\.(html?|xml)$') THEN download_url END AS pdf FROM {FIELDS.sql}""")
def opinion_text(spark, d):
    """The first field with text, its markup stripped, and where the print is."""
    own = FIELDS.frame(spark, d).withColumn("f", text.first_text(["plain_text", "html_with_citations", "html", "xml_harvard"]))
    body = F.when(F.col("f.field") == "plain_text", F.col("f.text")).otherwise(F.trim(F.regexp_replace(F.col("f.text"), "<[^>]+>", " ")))
    pdf = F.when(F.col("local_path").startswith("pdf/"), F.col("local_path")).when(~F.lower("download_url").rlike(r"\.(html?|xml)$"), F.col("download_url"))
    return own.select("id", F.col("f.field").alias("field"), body.alias("text"), pdf.alias("pdf"))


VERDICTS = Fixture("line int, claim_id string, prompt_version string, support string, cost double", [
    (1, "c1", "v1", "supported", 0.5), (2, "c2", "v1", "partial", 0.0), (3, "c1", "v1", "unsupported", 0.25), (4, "c1", "v2", "partial", 0.0), (5, "c9", "v1", "supported", 0.1), (6, "c3", "v1", "bogus", 0.0),
])
ASKED_CLAIMS = Fixture("claim_id string, floor string", [("c1", ""), ("c2", "Yellow"), ("c3", ""), ("c4", "Yellow")])


@query(f"""WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, prompt_version ORDER BY line DESC) AS rn FROM {VERDICTS.sql}) WHERE rn = 1 AND prompt_version = 'v1')
SELECT c.claim_id, CASE WHEN support IN ('supported', 'partial', 'unsupported', 'unverifiable') THEN support END AS support, CASE support WHEN 'supported' THEN CASE floor WHEN 'Yellow' THEN 'Yellow' ELSE 'Green' END WHEN 'partial' THEN 'Yellow' WHEN 'unsupported' THEN 'Red' END AS assessment, v.claim_id IS NULL AS pending FROM {ASKED_CLAIMS.sql} c LEFT JOIN v USING (claim_id)""")
def apply_assessments(spark, d):
    """Verdicts on claims by claim and prompt version, the last line winning; values outside the enumeration leave a row untouched."""
    last = rel.last_wins(VERDICTS.frame(spark), ["claim_id", "prompt_version"], ["line"]).where("prompt_version = 'v1'").select("claim_id", "support").withColumn("seen", F.lit(True))
    joined = ASKED_CLAIMS.frame(spark, d).join(last, "claim_id", "left")
    valid = F.when(F.col("support").isin("supported", "partial", "unsupported", "unverifiable"), F.col("support"))
    colour = F.when(valid.isNotNull(), rules.color(F.lit("VERIFIED"), valid, F.when(F.col("floor") == "Yellow", "CLOSE")))
    return joined.select("claim_id", valid.alias("support"), colour.alias("assessment"), F.col("seen").isNull().alias("pending"))


PACKED = Fixture("job string, claim_ids array<string>, payload string, cost double", [
    ("j1", ["c1", "c2"], '{"verdicts":[{"claim_id":"c1","support":"partial"},{"claim_id":"zz","support":"x"},{"claim_id":"c2","support":"supported"}]}', 0.4), ("j2", ["c3"], '{"verdicts":[{"claim_id":"c3","support":"unsupported"}]}', 0.1), ("j3", ["c4"], "broken", 0.1),
])


@query(f"""WITH e AS (SELECT job, claim_ids, cost, unnest(from_json(CASE WHEN json_valid(payload) THEN json_extract(payload, '$.verdicts') END, '[{{"claim_id":"VARCHAR","support":"VARCHAR"}}]')) AS v, generate_subscripts(from_json(CASE WHEN json_valid(payload) THEN json_extract(payload, '$.verdicts') END, '[{{"claim_id":"VARCHAR","support":"VARCHAR"}}]'), 1) AS pos FROM {PACKED.sql}),
k AS (SELECT *, list_contains(claim_ids, v.claim_id) AS known FROM e) SELECT job, v.claim_id AS claim_id, v.support AS support, known, CASE WHEN known AND row_number() OVER (PARTITION BY job, known ORDER BY pos) = 1 THEN cost ELSE 0.0 END AS cost FROM k""")
def fanout_packed(spark, d):
    """One row for each packed verdict; unknown ids are marked, and the cost goes to the first known one of a job."""
    listed = PACKED.frame(spark).withColumn("v", F.from_json("payload", "verdicts array<struct<claim_id string, support string>>")["verdicts"])
    rows = listed.select("job", "claim_ids", "cost", F.posexplode("v").alias("pos", "v")).withColumn("known", F.expr("array_contains(claim_ids, v.claim_id)"))
    marked = rel.top_k(rows, ["job", "known"], [F.col("pos")], 1 << 30, "at")
    return marked.select("job", "v.claim_id", "v.support", "known", F.when(F.col("known") & (F.col("at") == 1), F.col("cost")).otherwise(0.0).alias("cost"))


USAGE = Fixture("id int, model string, tok_in long, tok_out long, cache_new long, cache_read long, batch boolean", [(1, "large", 1000000, 1000, 0, 0, False), (2, "small", 5000, 5000, 1000, 9000, True), (3, "other", 10, 10, 0, 0, False)])


@query(f"SELECT id, round((tok_in * i + cache_new * i * 1.25 + cache_read * i * 0.1 + tok_out * o) / 1e6 * CASE WHEN batch THEN 0.5 ELSE 1 END, 8) AS cost FROM (SELECT *, CASE model WHEN 'large' THEN 5.0 WHEN 'small' THEN 1.0 ELSE 0 END AS i, CASE model WHEN 'large' THEN 25.0 WHEN 'small' THEN 5.0 ELSE 0 END AS o FROM {USAGE.sql})")
def cost_accounting(spark, d):
    rate = lambda a, b: F.when(F.col("model") == "large", a).when(F.col("model") == "small", b).otherwise(0.0)
    i, o = rate(5.0, 1.0), rate(25.0, 5.0)
    total = (F.col("tok_in") * i + F.col("cache_new") * i * 1.25 + F.col("cache_read") * i * 0.1 + F.col("tok_out") * o) / 1e6
    return USAGE.frame(spark).select("id", F.round(total * F.when(F.col("batch"), 0.5).otherwise(1.0), 8).alias("cost"))


FLAGS = Fixture("claim_id string, flags string", [
    ("c1", '{"toa_mismatch":{"variants":["597 So. 2d 1","97 So. 2d 1"]}}'), ("c2", '{"court_mismatch":{"cited_id":"nysd","matched_id":"ca2","matched":"Second Circuit"}}'), ("c3", '{"pincite_flag":{"pinpoint":"9","star_range":[1,5],"footnote_missing":"3"}}'), ("c4", "not json"), ("c5", ""),
])


@query(f"""WITH j AS (SELECT claim_id, CASE WHEN json_valid(flags) THEN CAST(flags AS JSON) END AS f FROM {FLAGS.sql} WHERE flags <> '')
SELECT claim_id, unnest(list_filter([CASE WHEN json_extract(f, '$.toa_mismatch.variants') IS NOT NULL THEN 'TOA/body citation mismatch: ' || array_to_string(CAST(json_extract(f, '$.toa_mismatch.variants') AS VARCHAR[]), ' vs ') END,
CASE WHEN json_extract(f, '$.court_mismatch') IS NOT NULL THEN 'Court mismatch: brief cites ' || json_extract_string(f, '$.court_mismatch.cited_id') || ', CL match is ' || json_extract_string(f, '$.court_mismatch.matched_id') || ' (' || json_extract_string(f, '$.court_mismatch.matched') || ')' END,
CASE WHEN json_extract_string(f, '$.pincite_flag.pinpoint') IS NOT NULL THEN 'Pincite ' || json_extract_string(f, '$.pincite_flag.pinpoint') || ' outside the opinion''s star-pagination range ' || json_extract_string(f, '$.pincite_flag.star_range[0]') || '-' || json_extract_string(f, '$.pincite_flag.star_range[1]') END,
CASE WHEN json_extract_string(f, '$.pincite_flag.footnote_missing') IS NOT NULL THEN 'Footnote n.' || json_extract_string(f, '$.pincite_flag.footnote_missing') || ' not found in the opinion text' END], lambda x: x IS NOT NULL)) AS line FROM j""")
def crosscheck_lines(spark, d):
    schema = "toa_mismatch struct<variants array<string>>, court_mismatch struct<cited_id string, matched_id string, matched string>, pincite_flag struct<pinpoint string, star_range array<int>, footnote_missing string>"
    own = FLAGS.frame(spark).withColumn("f", F.from_json("flags", schema))
    court, pin = F.col("f.court_mismatch"), F.col("f.pincite_flag")
    lines = F.array(
        F.when(F.size("f.toa_mismatch.variants") > 0, F.concat(F.lit("TOA/body citation mismatch: "), F.array_join("f.toa_mismatch.variants", " vs "))),
        F.when(court.isNotNull(), F.concat(F.lit("Court mismatch: brief cites "), F.coalesce(court["cited_id"], F.lit("?")), F.lit(", CL match is "), F.coalesce(court["matched_id"], F.lit("?")), F.coalesce(F.concat(F.lit(" ("), court["matched"], F.lit(")")), F.lit("")))),
        F.when(pin["pinpoint"].isNotNull(), F.concat(F.lit("Pincite "), pin["pinpoint"], F.lit(" outside the opinion's star-pagination range "), F.coalesce(pin["star_range"][0].cast("string"), F.lit("?")), F.lit("-"), F.coalesce(pin["star_range"][1].cast("string"), F.lit("?")))),
        F.when(pin["footnote_missing"].isNotNull(), F.concat(F.lit("Footnote n."), pin["footnote_missing"], F.lit(" not found in the opinion text"))),
    )
    return own.select("claim_id", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))


SEVERITY = Fixture("batch int, status string", [(1, "VERIFIED"), (1, "NOT_FOUND"), (2, "VERIFIED"), (3, "WRONG_CASE"), (3, "VERIFICATION_INCOMPLETE")])


@query(f"SELECT batch, max(CASE status WHEN 'VERIFIED' THEN 0 WHEN 'NOT_FOUND' THEN 1 WHEN 'WRONG_CASE' THEN 1 ELSE 2 END) AS code, array_to_string(list(status ORDER BY status), '; ') AS statuses FROM {SEVERITY.sql} GROUP BY batch")
def exit_severity(spark, d):
    code = F.when(F.col("status").isin(*rules.LOCATED), 0).when(F.col("status").isin("NOT_FOUND", "WRONG_CASE"), 1).otherwise(2)
    return SEVERITY.frame(spark).groupBy("batch").agg(F.max(code).alias("code"), F.array_join(F.array_sort(F.collect_list("status")), "; ").alias("statuses"))


NAMES = Fixture("a string, b string", [("Fink v. Gomez", "David M. Fink v. James H. Gomez, Director"), ("In re Wright", "In re Wright, Minors"), ("Smith v. Jones", "Brown v. Board"), ("", "x")])


@query(None)
def name_similarity_4f(spark, d):
    return similarity.with_name_similarity(NAMES.frame(spark), F.col("a"), F.col("b"), "similarity")


@query(None)
def seq_ratio(spark, d):
    """Neighbouring part names of each brand, so blocked."""
    own = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", "p_name")
    first = rel.first_wins(own, ["p_brand"], [F.col("p_partkey")]).select("p_brand", F.col("p_name").alias("other"))
    return own.join(first, "p_brand").select("p_partkey", F.round(similarity.seq_ratio(F.col("p_name"), F.col("other")), 6).alias("ratio"))
