"""Screening signals of a document, one row for each that fires, and its metrics. Citations are found by location patterns, not by a grammar."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilane.functions.names import anchored_in, first_words_key

#: Circuits as prose names them and as a parenthesis abbreviates them. Fixed values.
CIRCUITS = {
    "First": "1st", "Second": "2d", "Third": "3d", "Fourth": "4th", "Fifth": "5th", "Sixth": "6th", "Seventh": "7th",
    "Eighth": "8th", "Ninth": "9th", "Tenth": "10th", "Eleventh": "11th", "D.C.": "D.C.", "Federal": "Fed.",
}
#: States whose courts are at times set off by a comma. Fixed values.
COMMA_COURTS = ["Cal", "N.Y", "Tex", "Fla", "Ill", "Mass", "Wash"]
#: How far after a circuit's name its parenthesis may stand, in characters.
REACH = 350
_NAME = r"[A-Z][A-Za-z'.&-]*(?: [A-Z][A-Za-z'.&-]*){0,4} v\.? [A-Z][A-Za-z'.&-]*(?: [A-Z][A-Za-z'.&-]*){0,4}"
_LOCATION = r"(\d+ (?:U\.S\.|S\. Ct\.|F\.(?:2d|3d|4th)|F\. Supp\. ?(?:2d|3d)?|WL) \d+)"
_CITE = rf"({_NAME}), {_LOCATION}"
#: States, codes that they don't have under that name, and whether a section number follows. Fixed values.
WRONG_CODES = [("Cal", "UCC", False), ("NY", "UCC", True)]
#: Headings with which a brief's body begins. Fixed values.
BODY_HEADINGS = ["MEMORANDUM OF POINTS", "INTRODUCTION", "PRELIMINARY STATEMENT", "STATEMENT OF", "ARGUMENT", "TO ALL PARTIES"]
#: Leaked framing of generated text. Fixed values.
PREAMBLES = [
    "here is a court-ready", "here is a", "you can insert", "you can paste", "i hope this helps", "let me know if", "as an ai", "i cannot provide", "certainly!", "here's a", "feel free to", "calibrated for", "i've drafted", "below is a", "note: this", "disclaimer:", "as a large language model",
]


def wrong_code(text: Column) -> Column:
    """Whether a state's code is cited by a name that the state doesn't use, with or without points and blanks."""
    spaced = lambda word: "[. ]*".join(word if word.isupper() else [word])
    section = r"[. ]*§ *\d+-\d+"
    return text.rlike("|".join(rf"\b{spaced(state)}[. ]*{spaced(code)}" + (section if numbered else r"\b") for state, code, numbered in WRONG_CODES))


#: Months in full. Fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def monthly_claim(text: Column) -> Column:
    """rate, total, months, flagged and implied of a claim of a monthly rate, a total and the months it is for; null if text makes none.

    What stands before "per month" ends in the rate; after it come the total and, behind "from", two months with their years. The total is flagged if it differs from
    the rate times the months, both ends included, by more than one rate and a twentieth of the product.
    """
    # each step is worked out once, then read by the next
    then = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    amount = lambda c, before: F.replace(F.regexp_extract(c, before + r"\$(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("long")

    def read(sides):
        rest = F.get(sides, F.lit(1))
        words = F.split(F.get(F.split(rest, r"\bfrom\s+", 2), F.lit(1)), r"[\s,.;]+")
        return F.struct(amount(F.get(sides, F.lit(0)), "(?s).*").alias("rate"), amount(rest, "").alias("total"), words.alias("words"))

    def counted(p):
        month = lambda k: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.get(p["words"], F.lit(k))), F.lit(0).cast("long"))
        year = lambda k: F.get(p["words"], F.lit(k)).try_cast("int")
        months = F.when(F.get(p["words"], F.lit(2)) == "to", (year(4) - year(1)) * 12 + month(3) - month(0) + 1).cast("int")
        return F.struct(p["rate"].alias("rate"), p["total"].alias("total"), months.alias("months"))

    def reckoned(q):
        rate, total, months = q["rate"], q["total"], q["months"]
        want = rate * months
        flagged = (rate > 0) & (months > 0) & (F.abs(want - total) > F.greatest(rate.cast("double"), 0.05 * want))
        made = F.struct(rate.alias("rate"), total.alias("total"), months.alias("months"), flagged.alias("flagged"), F.round(F.try_divide(total, rate), 1).alias("implied"))
        return F.when(rate.isNotNull() & total.isNotNull() & months.isNotNull(), made)

    return then(then(then(F.split(F.lower(text), r"(?:/ *|\bper\s+)month", 2), read), counted), reckoned)


def cited(text: Column) -> Column:
    """(name, cite) of every location with a name before it."""
    names, cites = (F.regexp_extract_all(text, F.lit(_CITE), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, cites, lambda n, c: F.struct(n.alias("name"), c.alias("cite")))


def sentences(text: Column) -> Column:
    """Sentences end in a point or semicolon before a capital or parenthesis."""
    return F.split(text, r"(?<=[.;])\s+(?=[A-Z(])")


def court_contradiction(text: Column) -> Column:
    """Prose names a circuit, and the first parenthesis within reach names another. Every mention is tried by itself, so one may lie in another's reach."""
    found = F.lit(False)
    for word, short in CIRCUITS.items():
        others = "|".join(re.escape(x) for x in CIRCUITS.values() if x != short)
        found = found | text.rlike(rf"(?s)\b{re.escape(word)}\s+Circuit\b(?:(?!\((?:{'|'.join(map(re.escape, CIRCUITS.values()))})\s*Cir\.).){{0,{REACH}}}\((?:{others})\s*Cir\.")
    return found


def authority_drift(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Names that carry different reporter locations, or one and a WL number, within one document; WL numbers alone don't drift."""
    rows = docs.select(key, F.explode(cited(F.col(text))).alias("c")).select(key, first_words_key(F.col("c.name")).alias("case_key"), F.col("c.cite").alias("cite"))
    groups = rows.groupBy(key, "case_key").agg(F.array_sort(F.collect_set("cite")).alias("cites"))
    printed = F.size(F.filter("cites", lambda x: ~x.contains(" WL ")))
    return groups.where((printed > 1) | ((printed == 1) & (F.size("cites") > 1)))


def style_variance(text: Column) -> Column:
    """Both v and v. between names, or a court set off from its year by a comma."""
    sides = lambda v: text.rlike(rf"[A-Z][\w'’]+\s+{v}\s+[A-Z]")
    return (sides("v") & sides(r"v\.")) | text.rlike(rf"\((?:{'|'.join(map(re.escape, COMMA_COURTS))})\.*,\s+\d{{4}}\)")


def toa_difference(text: Column) -> Column:
    """(only_toa, only_body): names of the table of authorities and of the body that the other side doesn't hold; null without a table."""
    table, heading = r"(?i:TABLE\s+OF\s+AUTHORITIES)", "|".join(h.replace(" ", r"\s+") for h in BODY_HEADINGS)
    parts = rf"(?s){table}(.*?)((?:{heading}).*)"
    toa, body = (F.regexp_extract(text, parts, k) for k in (1, 2))
    lacking = lambda a, b: F.array_sort(F.array_distinct(F.filter(F.transform(cited(a), lambda c: c["name"]), lambda n: ~anchored_in(n, b))))
    return F.when(text.rlike(parts), F.struct(lacking(toa, body).alias("only_toa"), lacking(body, toa).alias("only_body")))


def screen(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and signal of everything that fires."""
    c = F.col(text)
    toa = toa_difference(c)
    plain = {
        "court_contradiction": court_contradiction(c), "statute_grammar": wrong_code(c), "style_variance": style_variance(c), "arithmetic": F.coalesce(monthly_claim(c)["flagged"], F.lit(False)),
        "toa_body_diff": F.coalesce((F.size(toa["only_toa"]) > 0) | (F.size(toa["only_body"]) > 0), F.lit(False)), "preamble": F.exists(F.array(*map(F.lit, PREAMBLES)), lambda p: F.lower(c).contains(p)),
    }
    fired = docs.select(key, F.explode(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in plain.items()]), lambda s: s.isNotNull())).alias("signal"))
    return fired.unionByName(authority_drift(docs, key, text).select(key, F.lit("authority_drift").alias("signal")).distinct())


def metrics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbers of citations and words, their density per thousand words, string citations, and how evenly sentences cite."""
    located = lambda c: F.regexp_extract_all(c, F.lit(_LOCATION), F.lit(1))
    per = F.filter(F.transform(sentences(F.col(text)), lambda s: F.size(F.array_distinct(located(s)))), lambda n: n > 0)
    own = docs.select(key, F.size(located(F.col(text))).alias("n_cites"), F.greatest(F.size(F.split(F.trim(F.col(text)), r"\s+")), F.lit(1)).alias("words"), per.alias("_per"), F.col(text).rlike(r"(?i)TABLE\s+OF\s+AUTHORITIES").alias("has_toa"))
    n = F.size("_per")
    mean = F.aggregate("_per", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate("_per", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return own.select(
        key, "n_cites", "words", F.round(1000 * F.col("n_cites") / F.col("words"), 3).alias("cite_density"), F.when(n > 0, F.round(F.size(F.filter("_per", lambda x: x >= 2)) / n, 3)).otherwise(0.0).alias("string_cite_rate"),
        "has_toa", F.when(n > 0, F.round(spread / mean, 3)).otherwise(0.0).alias("cite_prop_cv"),
    )
