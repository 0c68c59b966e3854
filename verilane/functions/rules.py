"""Dates, scores and classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OPINION_WORDS, PROCEDURAL_WORDS, any_of, reporter_family

#: Outcome taxonomy and the sets used as predicates. Fixed values.
LOCATED = ["VERIFIED", "VERIFIED_PARTIAL", "VERIFIED_VIA_RECAP", "VERIFIED_DOCKET_ONLY", "CITE_UNCONFIRMED"]
CLEAN = ["VERIFIED", "VERIFIED_PARTIAL", "VERIFIED_VIA_RECAP", "VERIFIED_DOCKET_ONLY"]
UNLOCATABLE = ["NOT_FOUND", "INSUFFICIENT_DATA", "VERIFICATION_INCOMPLETE"]
STATUSES = [*LOCATED, "WRONG_CASE", *UNLOCATABLE]
#: Weights of the candidate score and its limits. Fixed values.
WEIGHTS = {"name": 0.50, "court": 0.20, "date": 0.20, "docket": 0.05, "cite": 0.05}
RESOLVES, STOPS_CASCADE, CAPPED, PARTY_FACTOR, DOCKET_ONLY_FACTOR = 0.40, 0.50, 0.39, 0.25, 0.6
TEMPORAL_YEARS, ERA_FLOOR = 5, 1990
VERBATIM_ABOVE, CLOSE_FROM, FLOOR_BELOW = 0.85, 0.60, 0.75
BADGES = {
    "WRONG_CASE": "Case mismatch -- cite resolves to a different case",
    "CITE_UNCONFIRMED": "Check cite -- case found by name, cited location unconfirmed",
    "VERIFIED_PARTIAL": "Verified -- parallel cite only",
    "VERIFIED_VIA_RECAP": "Verified via RECAP",
    "VERIFIED_DOCKET_ONLY": "Docket only -- no opinion text",
    "VERIFICATION_INCOMPLETE": "Verification incomplete -- infrastructure error",
    "INSUFFICIENT_DATA": "Insufficient data -- citation lacks court and year",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def year_of(iso: Column) -> Column:
    """The year of an ISO string, null if it has none. Malformed strings never raise."""
    return F.substring(iso, 1, 4).try_cast("int")


def month_of(iso: Column) -> Column:
    return F.when(F.length(iso) >= 7, F.substring(iso, 6, 2).try_cast("int"))


def day_of(iso: Column) -> Column:
    return F.when(F.length(iso) >= 10, F.substring(iso, 9, 2).try_cast("int"))


# --- gates: true means that the candidate stays


def temporal_gate(candidate_year: Column, cited_year: Column) -> Column:
    """Symmetric; an unknown year passes."""
    return ~F.coalesce(F.abs(candidate_year - cited_year) > TEMPORAL_YEARS, F.lit(False))


def filing_gate(filing_year: Column, cited_year: Column) -> Column:
    """One-sided: an opinion can't come long before its case was filed, but may come at any time after."""
    return ~F.coalesce(filing_year - cited_year > TEMPORAL_YEARS, F.lit(False))


def era_gate(cited_year: Column) -> Column:
    return ~F.coalesce(cited_year < ERA_FLOOR, F.lit(False))


def name_gate(cited: Column, candidate: Column) -> Column:
    """cited and candidate are token arrays; a name without distinctive tokens passes."""
    return (F.size(cited) == 0) | F.arrays_overlap(cited, candidate)


def within_days(year: Column, month: Column, day: Column, iso: Column, days: int = 14) -> Column:
    """Whether a full date lies within so many days of a cited date whose month and day may be missing (June, 15th)."""
    cited = F.expr("cast(null as date)") if year is None else F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(6)), F.coalesce(day, F.lit(15))))
    filed = F.when(F.length(iso) >= 10, F.try_to_date(F.substring(iso, 1, 10)))
    return F.coalesce(F.abs(F.datediff(cited, filed)) <= days, F.lit(False))


def is_cited_opinion(desc: Column, in_window: Column, wl_in_cluster: Column, pages: Column, free: Column) -> Column:
    """Whether a docket's document is the cited opinion; the order of the checks decides."""
    own = F.lower(F.ltrim(F.coalesce(desc, F.lit(""))))
    return (
        F.when(own.startswith("motion to ") | own.startswith("motion for "), False)
        .when(any_of(own, PROCEDURAL_WORDS), False)
        .when(wl_in_cluster, True)
        .when(any_of(own, OPINION_WORDS) & in_window, True)
        .otherwise((pages >= 5) & free)
    )


# --- dates


def date_share(year: Column, month: Column, day: Column, iso: Column) -> Column:
    """The share of the date weight that a candidate's date earns."""
    y, m, d = year_of(iso), month_of(iso), day_of(iso)
    same_year = F.when(month.isNull() | m.isNull(), 1.0).when(m != month, 0.75).when(day.isNotNull() & (d == day), 1.0).otherwise(0.9)
    return F.when(y == year, same_year).when(F.abs(y - year) == 1, 0.5).otherwise(0.0)


def date_proximity(year: Column, month: Column, day: Column, iso: Column) -> Column:
    """A tie-breaker: nearer dates of the cited year rank higher."""
    y, m, d = year_of(iso), month_of(iso), day_of(iso)
    same_month = F.when(day.isNotNull() & d.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.abs(day - d) / 31.0)).otherwise(0.5)
    in_year = F.when(month.isNull() | m.isNull(), 0.0).when(m == month, same_month).otherwise(F.greatest(F.lit(0.0), 0.3 - F.abs(month - m) / 12.0))
    return F.when(y == year, in_year).otherwise(0.0)


def date_ranges(year: Column, month: Column, day: Column) -> Column:
    """Ranges to look in, one after another: the day, a month more or less within the year, the year."""
    iso = lambda m, d: F.format_string("%d-%02d-%02d", year, m, d)
    low, high = F.greatest(month - 1, F.lit(1)), F.least(month + 1, F.lit(12))
    one = lambda k, label, lo, hi: F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), lo.alias("lo"), hi.alias("hi"))
    last = F.dayofmonth(F.last_day(F.make_date(year, high, F.lit(1))))
    parts = [
        F.when(month.isNotNull() & day.isNotNull(), one(1, "exact date", iso(month, day), iso(month, day))),
        F.when(month.isNotNull(), one(2, "month range", iso(low, F.lit(1)), iso(high, last))),
        F.when(year.isNotNull(), one(3, "year range", iso(F.lit(1), F.lit(1)), iso(F.lit(12), F.lit(31)))),
    ]
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


# --- scores


def weights(court: Column, year: Column) -> dict[str, Column]:
    """The weights in force: those of a missing court or year go to name, docket and cite in proportion."""
    spare = F.when(court.isNull(), WEIGHTS["court"]).otherwise(0.0) + F.when(year.isNull(), WEIGHTS["date"]).otherwise(0.0)
    base = WEIGHTS["name"] + WEIGHTS["docket"] + WEIGHTS["cite"]
    grown = {k: F.lit(WEIGHTS[k]) + spare * WEIGHTS[k] / base for k in ("name", "docket", "cite")}
    return grown | {"court": F.when(court.isNull(), 0.0).otherwise(WEIGHTS["court"]), "date": F.when(year.isNull(), 0.0).otherwise(WEIGHTS["date"])}


def candidate_score(court: Column, year: Column, name_sim: Column, court_hit: Column, date: Column, docket_hit: Column, cite_hit: Column, parties: Column, docket_contradicted: Column) -> Column:
    """The composite score of a candidate, capped where parties or docket speak against it and nothing for it; four digits."""
    w = weights(court, year)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    name = w["name"] * name_sim * F.when(parties | cite_hit, 1.0).otherwise(PARTY_FACTOR)
    total = name + w["court"] * one(court_hit) + w["date"] * date + w["docket"] * one(docket_hit) + w["cite"] * one(cite_hit)
    capped = F.when((~parties | docket_contradicted) & ~cite_hit & ~docket_hit, F.least(total, F.lit(CAPPED))).otherwise(total)
    return F.round(capped, 4)


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    return F.when(mad == 0, 0.0).otherwise((x - median) / (1.4826 * mad))


# --- outcomes


def cite_check(cited: Column, reporter: Column, record: Column) -> Column:
    """How a cited location (null: none) stands to the citations on record, an array of "volume reporter page"."""
    tight = lambda c: F.regexp_replace(F.lower(c), r"\.\s+", ".")
    joined = F.concat_ws(", ", record)
    hit = F.lower(joined).contains(F.lower(cited)) | tight(joined).contains(tight(cited))
    pattern = r"^\s*\d+\s+(.+?)\s+\S+\s*$"
    witness = F.exists(record, lambda r: reporter_family(F.regexp_extract(r, pattern, 1)) == reporter_family(reporter))
    return F.when(cited.isNull(), "NO_CITE_IN_INPUT").when(hit, "CORROBORATED").when(F.trim(joined) == "", "NOT_ON_RECORD").when(witness, "CONTRADICTED").otherwise("NOT_ON_RECORD")


def demoted(status: Column, has_cite: Column, check: Column, docket_corroborated: Column) -> Column:
    """The status after the check of the cited location."""
    return (
        F.when(has_cite & (status == "VERIFIED") & (check == "CONTRADICTED"), "CITE_UNCONFIRMED")
        .when(has_cite & (status == "VERIFIED_DOCKET_ONLY") & ~docket_corroborated, "CITE_UNCONFIRMED")
        .otherwise(status)
    )


def demotion_warning(status: Column, has_cite: Column, check: Column) -> Column:
    """The warning that goes with it; null if there is none."""
    return (
        F.when(~has_cite, None)
        .when((status == "VERIFIED") & (check == "CONTRADICTED"), "cite_contradicted")
        .when((status == "VERIFIED") & (check == "NOT_ON_RECORD"), "cite_not_on_record")
        .when(status.isin("VERIFIED_VIA_RECAP", "VERIFIED_DOCKET_ONLY"), "cite_not_on_record")
    )


def promoted(status: Column, any_errored: Column, any_resolved: Column, court: Column, year: Column) -> Column:
    """Not found becomes incomplete if a stage failed and none resolved, then insufficient if court and year are unknown."""
    first = F.when((status == "NOT_FOUND") & any_errored & ~any_resolved, "VERIFICATION_INCOMPLETE").otherwise(status)
    return F.when((first == "NOT_FOUND") & court.isNull() & year.isNull(), "INSUFFICIENT_DATA").otherwise(first)


def color(existence: Column, support: Column, quote_worst: Column) -> Column:
    """Report colour from the three axes."""
    return (
        F.when(existence.isin(*UNLOCATABLE), "Gray")
        .when(existence == "WRONG_CASE", "Red")
        .when(existence == "CITE_UNCONFIRMED", "CheckCite")
        .when(support == "unsupported", "Red")
        .when(support == "partial", "Yellow")
        .when(support == "supported", F.when(quote_worst.isin("CLOSE", "FABRICATED"), "Yellow").otherwise("Green"))
        .otherwise("Gray")
    )


def lane(status: Column, assessment: Column, opinion_file: Column) -> Column:
    """Report lane where there is an assessment instead of a support axis."""
    own = F.lower(F.trim(F.coalesce(assessment, F.lit(""))))
    return (
        F.when(status == "WRONG_CASE", "Red")
        .when(status == "CITE_UNCONFIRMED", "CheckCite")
        .when(status.isin(*UNLOCATABLE) & (F.coalesce(opinion_file, F.lit("")) == ""), "Gray")
        .when(own == "green", "Green")
        .when(own == "red", "Red")
        .otherwise("Yellow")
    )


def badge(lane_: Column, own_label: Column, status: Column) -> Column:
    """The label of a finding's card under its lane."""
    table = F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv])
    return (
        F.when(lane_ == "Green", "Supported")
        .when(lane_ == "Gray", "")
        .when(lane_ == "CheckCite", BADGES["CITE_UNCONFIRMED"])
        .otherwise(
            F.coalesce(
                F.nullif(F.trim(own_label), F.lit("")), F.try_element_at(table, status),
                F.when(lane_ == "Red", "Not supported by cited case").otherwise("Overstated -- case partially supports"),
            )
        )
    )


def quote_bucket(similarity: Column) -> Column:
    """By the unrounded similarity."""
    return F.when(similarity > VERBATIM_ABOVE, "VERBATIM").when(similarity >= CLOSE_FROM, "CLOSE").otherwise("FABRICATED")


def quote_floors(result: Column, similarity: Column) -> Column:
    """Whether a quote keeps its claim from green."""
    return (result == "FABRICATED") | ((result == "CLOSE") & (similarity < FLOOR_BELOW))


def assessable(opinion_file: Column, status: Column) -> Column:
    return (F.coalesce(opinion_file, F.lit("")) != "") & ~F.coalesce(status == "WRONG_CASE", F.lit(False))


def triage_track(opinion_file: Column, status: Column, quote_worst: Column, quote_floor: Column, quoted: Column, flags: Column) -> Column:
    """full, fast, or empty where a claim isn't assessed at all."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(~assessable(opinion_file, status), "")
        .when(F.coalesce(quote_worst, F.lit("")).isin("FABRICATED", "CLOSE"), "full")
        .when(blank(quote_floor) != "", "full")
        .when(~blank(quoted).isin("", "[]"), "full")
        .when(blank(flags) != "", "full")
        .when(~F.coalesce(status, F.lit("")).isin(*CLEAN), "full")
        .otherwise("fast")
    )
