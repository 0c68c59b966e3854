"""Rules of strings over all orders: each order is a case, cited in the ways that a rule must tell apart, and its SQL says what its columns make of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilane.functions import text
from verilane.functions.parse import parse_citation

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


_REPORTERS = ["F.3d", "F. Supp. 2d", "U.S.", "N.E.2d", "Cal. App. 5th"]
_FAMILIES = ["f", "fsupp", "us", "ne", "calapp"]
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
#: A case for each order: the word that is its own, its location, and its docket's number.
_CASE = f"""c AS (SELECT o_orderkey AS k, translate(lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), '0123456789', 'bcdfghjklm') AS w, CAST(o_custkey % 900 + 1 AS VARCHAR) AS volume, {_list(_REPORTERS)}[o_orderkey % 5 + 1] AS reporter,
{_list(_FAMILIES)}[o_orderkey % 5 + 1] AS family, CAST(o_orderkey % 1000 + 1 AS VARCHAR) AS page, o_orderdate AS day, CAST(year(o_orderdate) AS INTEGER) AS y, (year(o_orderdate) % 100) || '-cv-' || o_orderkey AS docket FROM orders)"""


def cases(spark, d):
    """k, w, volume, reporter, page and day of every order."""
    at = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words)).cast("int"))
    own = T(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("day"))
    return own.select(
        F.col("o_orderkey").alias("k"), F.translate(F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), "0123456789", "bcdfghjklm").alias("w"), (F.col("o_custkey") % 900 + 1).cast("string").alias("volume"),
        at(_REPORTERS).alias("reporter"), (F.col("o_orderkey") % 1000 + 1).cast("string").alias("page"), "day",
    )


def _name():
    return F.concat(F.lit("P"), "w", F.lit(" v. D"), "w")


def _year():
    return F.date_format("day", "yyyy")


def _way(n, *said):
    out = F.when(F.col("k") % n == 0, said[0])
    for k, one in enumerate(said[1:], 1):
        out = out.when(F.col("k") % n == k, one)
    return out


@query(f"""WITH {_CASE} SELECT k, CASE WHEN k % 7 = 6 THEN 'P' || w ELSE 'P' || w || ' v. D' || w END AS case_name, CASE WHEN k % 7 <> 6 THEN 'P' || w END AS plaintiff, CASE WHEN k % 7 <> 6 THEN 'D' || w END AS defendant,
CASE WHEN k % 7 NOT IN (1, 4) THEN volume END AS volume, CASE WHEN k % 7 NOT IN (1, 4) THEN reporter END AS reporter, CASE WHEN k % 7 NOT IN (1, 4) THEN page END AS page, CASE k % 7 WHEN 0 THEN '2d Cir.' WHEN 1 THEN 'S.D.N.Y.' WHEN 4 THEN 'N.D. Cal.' WHEN 5 THEN 'SDNY' END AS court,
y AS year, CASE WHEN k % 7 IN (1, 4, 5) THEN CAST(month(day) AS INTEGER) END AS month, CASE WHEN k % 7 IN (1, 4, 5) THEN CAST(day(day) AS INTEGER) END AS day, CASE WHEN k % 7 IN (1, 4) THEN strftime(day, '1:%y-cv-') || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INTEGER), '0') END AS docket_number,
k % 7 = 4 AS is_westlaw, CASE WHEN k % 7 = 4 THEN CAST(k + 1 AS VARCHAR) END AS wl_number FROM c""")
def parse_citations(spark, d):
    """Every order cited in one of seven styles and parsed again."""
    number = F.format_string("1:%s-cv-%05d", F.date_format("day", "yy"), F.col("k"))
    located = F.concat_ws(" ", "volume", "reporter", "page")
    full = F.date_format("day", "MMM. d, yyyy")
    said = _way(
        7, F.concat(_name(), F.lit(", "), located, F.lit(" (2d Cir. "), _year(), F.lit(")")), F.concat(_name(), F.lit(", No. "), number, F.lit(" (S.D.N.Y. "), full, F.lit(")")),
        F.concat(_name(), F.lit(", "), located, F.lit(" ("), _year(), F.lit(")")), F.concat(_name(), F.lit(" ("), _year(), F.lit(") "), located),
        F.concat(_name(), F.lit(", No. "), number, F.lit(", "), _year(), F.lit(" WL "), (F.col("k") + 1).cast("string"), F.lit(" (N.D. Cal. "), full, F.lit(")")),
        F.concat(_name(), F.lit(", "), located, F.lit(" ("), full, F.lit(" SDNY)")), F.concat(F.lit("P"), "w", F.lit(", "), located, F.lit(" ("), _year(), F.lit(")")),
    )
    p = parse_citation(said)
    names = "case_name plaintiff defendant volume reporter page court year month day docket_number is_westlaw wl_number".split()
    return cases(spark, d).select("k", p.alias("p")).select("k", *[F.col(f"p.{n}") for n in names])


def _cited(pin, reporter="reporter"):
    return F.concat(_name(), F.lit(", "), F.concat_ws(" ", "volume", reporter, "page"), pin, F.lit(" ("), F.when(F.col("k") % 2 == 0, "2d Cir. ").otherwise(""), _year(), F.lit(")"))


def _tight():
    return F.replace("reporter", F.lit(". "), F.lit("."))


def _pin():
    return _way(4, F.lit(""), F.lit(", 12"), F.lit(", at 12-14"), F.lit(",  7–9"))


_PLAIN = "'P' || w || ' v. D' || w || ', ' || volume || ' ' || reporter || ' ' || page || ' (' || CASE WHEN k % 2 = 0 THEN '2d Cir. ' ELSE '' END || y || ')'"


@query(f"WITH {_CASE} SELECT k, {_PLAIN} AS stripped, lower({_PLAIN}) AS match_key FROM c")
def pinpoint_strip(spark, d):
    """Pages within a case go, in four spellings, and what is left is the key under which citations meet."""
    return cases(spark, d).select("k", text.strip_pinpoint(_cited(_pin())).alias("stripped"), text.match_key(_cited(_pin())).alias("match_key"))


@query(f"WITH {_CASE} SELECT k, 'p' || w || 'vd' || w AS name_norm, volume, regexp_replace(lower(reporter), '[ .]', '', 'g') AS reporter, page, CAST(y AS VARCHAR) AS year FROM c")
def base_cite(spark, d):
    """Reporters are written without blanks: the rule takes a number after a blank for the page."""
    return cases(spark, d).select("k", text.base_cite(_cited(_pin(), _tight())).alias("b")).select("k", "b.*")


@query(f"WITH {_CASE} SELECT k, CASE WHEN k % 3 = 0 THEN y || '|wl|' || (k + 1) WHEN k % 3 = 1 THEN volume || '|' || regexp_replace(lower(reporter), '[ .]', '', 'g') || '|' || page END AS core FROM c")
def core_key(spark, d):
    """By WL number, by location, and of what has neither."""
    said = _way(3, F.concat(_name(), F.lit(", "), _year(), F.lit(" WL "), (F.col("k") + 1).cast("string")), _cited(_pin(), _tight()), _name())
    return cases(spark, d).select("k", text.core_key(said).alias("core"))


def _docket(shift):
    """A docket's number in one of six spellings; shift chooses another one."""
    year, two = F.date_format("day", "yy"), F.col("k").cast("string")
    ways = [
        F.concat(F.lit("1:"), year, F.lit("-cv-000"), two), F.concat(year, F.lit("-CV-"), two, F.lit("-JCC")), F.concat(F.lit("C "), year, F.lit("-0"), two, F.lit(" WHA")),
        F.concat(year, F.lit(" C "), two), F.concat(F.lit("2:"), year, F.lit("-0"), two, F.lit("-CIV")), F.concat(F.lit("CV "), year, F.lit("-"), two),
    ]
    return _way(6, *(ways[(k + shift) % 6] for k in range(6)))


@query(f"WITH {_CASE} SELECT k, docket AS normal FROM c")
def docket_norm(spark, d):
    return cases(spark, d).select("k", text.docket_number(_docket(0)).alias("normal"))


@query(f"WITH {_CASE} SELECT k, k % 4 <> 3 AS same FROM c")
def docket_post_filter(spark, d):
    """A number in two spellings is one docket; a fourth of the rows compare with another docket's number, or with none."""
    own = cases(spark, d).withColumn("number", _docket(0)).withColumn("again", _docket(1))
    other = F.when(F.col("k") % 4 != 3, F.col("again")).when(F.col("k") % 8 == 3, F.concat(F.lit("77-cv-"), F.col("k").cast("string")))
    return own.select("k", F.coalesce(text.docket_number(F.col("number")) == text.docket_number(other), F.lit(False)).alias("same"))


@query(f"WITH {_CASE} SELECT k, family FROM c")
def reporter_family(spark, d):
    """Reporters of all series, with and without their blanks and points."""
    spelt = _way(2, F.col("reporter"), F.replace("reporter", F.lit(". "), F.lit(".")))
    return cases(spark, d).select("k", text.reporter_family(spelt).alias("family"))


@query(f"WITH {_CASE} SELECT k, CASE WHEN k % 4 = 3 THEN '' ELSE 'P' || w END AS surname, 'P' || w || '_v_D' || w || '_Inc' AS file FROM c")
def surnames(spark, d):
    """The first word of a party's name, and a caption as a file's name."""
    party = _way(4, F.concat(F.lit(" P"), "w", F.lit(" Systems, Inc.")), F.concat(F.lit("P"), "w", F.lit(",")), F.concat(F.lit("P"), "w"), F.lit("None"))
    return cases(spark, d).select("k", text.surname(party).alias("surname"), text.safe_file_name(F.concat(_name(), F.lit(", Inc."))).alias("file"))
