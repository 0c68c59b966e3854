"""Small operators of the offline tooling: adjudication, bookkeeping, coverage, prompts and citation repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilane.functions import abbreviations, rules, text

from .fixtures import Fixture, Mixed
from .fixtures import QUERIES as FIXTURE_QUERIES
from .fixtures import SQL as FIXTURE_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


@query(f"SELECT path, count(*) AS n FROM ({FIXTURE_SQL['audit_path']}) GROUP BY path")
def audit_histogram(spark, d):
    return FIXTURE_QUERIES["audit_path"](spark, d).groupBy("path").agg(F.count("*").alias("n"))


_FOUND = Fixture("id int, cite string, verdict string", [(1, "Roe v. Wade, 410 U.S. 113", "fake"), (2, "A v. B, 12 F.3d 4", "fake"), (3, "C v. D, 2019 WL 55", "fake")])
_RULED = Fixture("core string, ruling string", [("410|us|113", "drop"), ("12|f3d|4", "real")])


@query(f"SELECT id, CASE id WHEN 2 THEN 'real' ELSE verdict END AS verdict FROM {_FOUND.sql} WHERE id <> 1")
def adjudication(spark, d):
    """Rulings by core key: some rows are dropped, some relabelled, the rest stay. The rulings are a short list."""
    joined = _FOUND.frame(spark).withColumn("core", text.core_key(F.col("cite"))).join(F.broadcast(_RULED.frame(spark)), "core", "left")
    return joined.where(~F.coalesce(F.col("ruling") == "drop", F.lit(False))).select("id", F.coalesce("ruling", "verdict").alias("verdict"))


_STAGES = Fixture("ord int, stage string, verdict string, score double", [(1, "citation_lookup", "no_match", None), (2, "opinion_search", None, 0.3), (3, "recap_docket_search", "resolved", 0.7)])


@query(f"SELECT stage, coalesce(verdict, 'errored') AS verdict, CASE WHEN verdict IN ('resolved', 'partial') THEN score END AS confidence FROM {_STAGES.sql}")
def stage_trace(spark, d):
    """A stage that ended without a verdict has failed; only a stage that resolved has a confidence."""
    v = F.coalesce("verdict", F.lit("errored"))
    path = F.array_sort(F.collect_list(F.struct("ord", "stage", v.alias("verdict"), F.when(v.isin("resolved", "partial"), F.col("score")).alias("confidence"))))
    return _STAGES.frame(spark).groupBy().agg(path.alias("path")).select(F.explode("path").alias("p")).select("p.stage", "p.verdict", "p.confidence")


_JOBS = Fixture("job string, claim string, done boolean, failed boolean", [("j1", "c1", True, False), ("j1", "c2", False, False), ("j2", "c3", False, True), ("j3", "c4", True, False)])


@query(f"SELECT count(DISTINCT job) AS jobs, count(DISTINCT CASE WHEN failed THEN job END) AS failures, count_if(NOT done AND NOT failed) AS pending, count_if(failed) AS dropped FROM {_JOBS.sql}")
def run_bookkeeping(spark, d):
    return _JOBS.frame(spark).agg(F.countDistinct("job").alias("jobs"), F.countDistinct(F.when(F.col("failed"), F.col("job"))).alias("failures"), F.count_if(~F.col("done") & ~F.col("failed")).alias("pending"), F.count_if("failed").alias("dropped"))


_WANTED = Fixture("abbrev string, whole string", [("Dep't", "Department"), ("Educ.", "Education"), ("Ry.", "Railway"), ("Bd.", "Board")])


@query(f"SELECT count(*) AS total, count_if(abbrev <> 'Ry.') AS covered, round(count_if(abbrev <> 'Ry.') / count(*), 4) AS ratio FROM {_WANTED.sql}")
def abbreviation_coverage(spark, d):
    """An abbreviation is covered if the rules turn it into its long form."""
    c = abbreviations.written_out(F.concat(F.lit("Smith v. Test "), "abbrev"))
    hit = c.contains(F.col("whole")) & ~c.contains(F.col("abbrev"))
    return _WANTED.frame(spark).agg(F.count("*").alias("total"), F.count_if(hit).alias("covered"), F.round(F.count_if(hit) / F.count("*"), 4).alias("ratio"))


_PROMPTS = Fixture("id int, template string, claim string", [(1, "<!-- version: v2 -->\nCheck {claim} twice: {claim}", "A v. B"), (2, "no header {claim}", "C")])


@query(f"SELECT id, replace(template, '{{claim}}', claim) AS prompt, nullif(regexp_extract(template, '^<!-- version: (\\S+) -->', 1), '') AS version FROM {_PROMPTS.sql}")
def prompt_render(spark, d):
    return _PROMPTS.frame(spark).select("id", F.replace("template", F.lit("{claim}"), F.col("claim")).alias("prompt"), F.nullif(F.regexp_extract("template", r"^<!-- version: (\S+) -->", 1), F.lit("")).alias("version"))


_REPLY = Fixture("id int, reply string, support string", [(1, 'I say {"support": "partial"} and {"support": "x"}', "partial"), (2, "none", None), (3, "{bad}", None)])


@query(f"SELECT id, support FROM {_REPLY.sql}")
def first_verdict_object(spark, d):
    return _REPLY.frame(spark).select("id", F.from_json(F.regexp_extract("reply", r"(\{[^{}]*\})", 1), "support string")["support"].alias("support"))


_WL = Mixed("id int, volume string, reporter string", [(1, "2025", "WL"), (2, "12", "WL"), (3, "2025", "F.3d"), (4, None, "WL")])


@query(f"SELECT id, CASE WHEN reporter = 'WL' AND regexp_matches(volume, '^\\d{{4}}$') THEN volume END AS year FROM {_WL.sql}")
def wl_year(spark, d):
    return _WL.frame(spark, d).select("id", F.when((F.col("reporter") == "WL") & F.col("volume").rlike(r"^\d{4}$"), F.col("volume")).alias("year"))


_NUMBERS = Mixed("id int, cite string", [(1, "No. 1:20-cv-00012"), (2, "2019 WL 55"), (3, "Case No. 20-cr-7"), (4, "12 F.3d 4"), (5, "plain")])
_REPORTERS = r"\b(?:U\.S\.|F\.\s*\d|F\.\s*Supp|S\.\s*Ct|L\.\s*Ed|Cal\.|N\.Y\.|A\.\s*\d|P\.\s*\d)"
_ONLY = r"^(?:No\.\s*|Case\s+No\.\s*)?\d+[:\-]?\d*-(?:cv|cr|mc|md|mj|po)-\d"


@query(rf"SELECT id, NOT (contains(cite, 'WL') OR contains(cite, 'LEXIS') OR regexp_matches(cite, '{_REPORTERS}')) AND regexp_matches(trim(cite), '{_ONLY}') AS docket_only FROM {_NUMBERS.sql}")
def docket_only_strings(spark, d):
    c = F.col("cite")
    return _NUMBERS.frame(spark, d).select("id", (~(c.contains("WL") | c.contains("LEXIS") | c.rlike(_REPORTERS)) & F.trim(c).rlike(_ONLY)).alias("docket_only"))


_CAPTIONS = Mixed("id int, caption string", [(1, "Smith v. Jones"), (2, "In re Vessel"), (3, "(PC) Doe v. State"), (4, "In the Matter of the Complaint of X"), (5, "Acme vs. Roe"), (6, None), (7, "Solo")])


@query(f"SELECT id, coalesce(NOT (starts_with(l, '(pc)') OR starts_with(l, 'in re ') OR starts_with(l, 'in the matter') OR starts_with(l, 'complaint of')) AND (contains(l, ' v. ') OR contains(l, ' v ') OR contains(l, ' vs. ')), false) AS ordinary FROM (SELECT id, lower(trim(caption)) AS l FROM {_CAPTIONS.sql})")
def ordinary_captions(spark, d):
    """Two-party captions; limitation petitions, miscellaneous actions and tagged prisoner cases don't count."""
    low = F.lower(F.trim("caption"))
    return _CAPTIONS.frame(spark, d).select("id", F.coalesce(~text.starts_with_any(low, ["(pc)", "in re ", "in the matter", "complaint of"]) & text.any_of(low, [" v. ", " v ", " vs. "]), F.lit(False)).alias("ordinary"))


_PAGES = Fixture("id int, page string, cite string, whole string", [
    (1, "as held in Smith v. Jones, 12 F.3d 4, and so on", "12 F.3d 4", "Smith v. Jones, 12 F.3d 4"), (2, "compare In re Acme, 5 B.R. 6 (1990)", "5 B.R. 6", "In re Acme, 5 B.R. 6"), (3, "nothing before 7 U.S. 8", "7 U.S. 8", None),
])


@query(f"SELECT id, whole FROM {_PAGES.sql}")
def citation_from_context(spark, d):
    """The name before a location in its page: In re first, then the two sides."""
    own = _PAGES.frame(spark).withColumn("_b", F.expr("left(page, instr(page, cite) - 1)"))
    words = r"[A-Z][A-Za-z.']*(?: [A-Z][A-Za-z.']*)*"
    take = lambda p: F.nullif(F.regexp_extract("_b", p, 1), F.lit(""))
    return own.select("id", F.concat(F.coalesce(take(rf"(In re {words}),\s*$"), take(rf"({words} v\. {words}),\s*$")), F.lit(", "), F.col("cite")).alias("whole"))


_JUNK = Fixture("name string", [("HJSA No. 3, L.P.",), ("Doe v. Acme, No. 14-cv-2524",), ("Local No. 7 v. Acme Corp.",), ("Lee v. Poe, Case No. 12345",), ("HJSA No. 3, L.P. v. Doe, No. 14-cv-2524",), ("A v. B, No. 2:10-cv-1, No. 99-123",), ("Plain v. Name",)])
_LABEL = r",?\s*(?:Case\s+)?No\.\s+"


@query(rf"""WITH m AS (SELECT name, m, trim(regexp_replace(m, '^{_LABEL}', '', 'i')) AS own FROM (SELECT name, unnest(regexp_extract_all(name, '(?i){_LABEL}[^,()]+')) AS m FROM {_JUNK.sql})),
shaped AS (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY m) AS rn FROM m WHERE regexp_matches(own, '\d') AND (length(own) >= 4 OR regexp_matches(own, '[-:/]')) AND len(list_filter(regexp_split_to_array(own, '\s+'), lambda t: regexp_matches(regexp_replace(t, '\.+$', ''), '^[a-z][A-Za-z]*$'))) = 0)
SELECT n.name, replace(replace(n.name, coalesce(a.m, '\x01'), ''), coalesce(b.m, '\x01'), '') AS clean FROM {_JUNK.sql} n LEFT JOIN shaped a ON a.name = n.name AND a.rn = 1 LEFT JOIN shaped b ON b.name = n.name AND b.rn = 2""")
def docket_junk(spark, d):
    """A docket number goes from a name only if it has a docket number's shape; a number that is part of the name stays."""
    return _JUNK.frame(spark).select("name", text.without_docket_junk(F.col("name")).alias("clean"))


_QUEUE = Fixture("claim string, opinion string, status string, seen boolean", [("c1", "o1", "VERIFIED", False), ("c2", "o1", "VERIFIED", True), ("c3", "o2", "WRONG_CASE", False), ("c4", "", "VERIFIED", False), ("c5", "o2", "VERIFIED", False), ("c6", "o2", "VERIFIED", False)])


@query(f"SELECT opinion, array_to_string(list(claim ORDER BY claim), ';') AS claims, count(*) AS n FROM {_QUEUE.sql} WHERE opinion <> '' AND status <> 'WRONG_CASE' AND NOT seen GROUP BY opinion")
def packed_jobs(spark, d):
    """One job for each opinion with the claims that still wait, in order."""
    open_ = _QUEUE.frame(spark).where(rules.assessable(F.col("opinion"), F.col("status")) & ~F.col("seen"))
    return open_.groupBy("opinion").agg(F.array_join(F.array_sort(F.collect_list("claim")), ";").alias("claims"), F.count("*").alias("n"))
