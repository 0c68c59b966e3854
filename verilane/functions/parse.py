"""A citation string to a struct, as one column expression.

The string is taken apart in three ways, each by structure and not by one pattern for each style:

- Locations: a number, the reporter's words and another number. One whose reporter is WL gives the WL number and the year, the first of
  the others gives volume, reporter and page.
- Parentheses: the words of each are sorted into year, month, day and the rest, which is the court, so court and date may come in either
  order. The first parenthesis with a year counts, a parenthesised year before a location first of all.
- The head: what stands before the first comma and number, or before the first parenthesis that holds a year, docket numbers taken out.
  It is a pair of parties, a matter, or, before a location, a surname.

Where several parts name a year the WL number's wins. Reporter spellings aren't corrected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import docket_shaped, squeeze, without_docket_junk

#: Months in full; a word is one if it begins one with three letters or more. Fixed values.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: How matters without two parties begin. Fixed values.
MATTERS = ["in re ", "ex parte ", "matter of ", "in the matter of ", "estate of ", "marriage of "]
#: What stands before the number of a document in its docket, without points. Fixed values.
DOCUMENT_LABELS = ["ecf no", "dkt no", "dkt", "doc"]
#: Case types of federal dockets written without "No.". Fixed values.
CASE_TYPES = ["cv", "cr", "bk", "md", "mc", "mj"]
#: The longest surname that stands for a case, in characters.
LONGEST_SURNAME = 42

_REPORTER_WORD = r"(?:[A-Z][\w.'’&]*|\d(?:d|st|th)\b\.?)"
_LOCATION = rf"\b(\d{{1,4}})\s+([A-Z][\w.'’&]*(?:\s+{_REPORTER_WORD}){{0,5}})\s+(\d{{1,9}})(?![\w-])"
_HEAD_ENDS = r",\s+(?=\d)|\s*(?=\([^()]*(?<!\d)\d{4}(?!\d))"


def _group(c: Column, pattern: str) -> Column:
    """The only group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _locations(c: Column) -> Column:
    first, reporter, last = (F.regexp_extract_all(c, F.lit(_LOCATION), F.lit(k)) for k in (1, 2, 3))
    return F.transform(first, lambda x, i: F.struct(x.alias("volume"), squeeze(reporter[i]).alias("reporter"), last[i].alias("page")))


def _month(word: Column) -> Column:
    """The month that a word names, 1 to 12, else null."""
    plain = F.rtrim(F.lower(word), F.lit(".,"))
    plain = F.when(plain == "sept", "sep").otherwise(plain)
    at = F.array_max(F.transform(F.array(*map(F.lit, MONTH_NAMES)), lambda m, i: F.when((F.length(plain) >= 3) & m.startswith(plain), i + 1)))
    return at.cast("int")


def _dated(inside: Column) -> Column:
    """court, year, month and day of what a parenthesis holds."""
    words = F.filter(F.split(F.trim(inside), r"\s+"), lambda w: w != "")
    is_year = lambda w: w.rlike(r"^\d{4}$")
    is_day = lambda w: w.rlike(r"^\d{1,2},?$")
    court = F.array_join(F.filter(words, lambda w: ~is_year(w) & ~is_day(w) & _month(w).isNull()), " ")
    month = F.get(F.filter(F.transform(words, _month), lambda m: m.isNotNull()), F.lit(0))
    day = F.get(F.filter(words, is_day), F.lit(0))
    return F.struct(
        F.when(court.rlike("[A-Za-z]"), court).alias("court"), F.get(F.filter(words, is_year), F.lit(0)).cast("int").alias("year"),
        month.alias("month"), F.when(month.isNotNull(), F.rtrim(day, F.lit(",")).cast("int")).alias("day"),
    )


def _docket(c: Column) -> Column:
    """What follows the first "No." if it is shaped like a docket number, else a federal number that stands alone."""
    labelled = F.trim(_group(c, r"\b[Nn][Oo]\.\s+([^,()]+)"))
    bare = F.filter(F.regexp_extract_all(c, F.lit(r"\b\d{1,2}:\d\d-[A-Za-z]{2}-\d+"), F.lit(0)), lambda d: F.lower(F.split(d, "-")[1]).isin(CASE_TYPES))
    return F.coalesce(F.when(docket_shaped(labelled), labelled), F.get(bare, F.lit(0)))


def parse_citation(c: Column) -> Column:
    found = _locations(c)
    is_wl = lambda x: x["reporter"] == "WL"
    wl, printed = F.get(F.filter(found, is_wl), F.lit(0)), F.get(F.filter(found, lambda x: ~is_wl(x)), F.lit(0))
    dated = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1)), _dated), lambda p: p["year"].isNotNull())
    date = F.get(F.filter(dated, lambda p: p["court"].isNotNull()), F.lit(0))
    bare_year = F.get(dated, F.lit(0))["year"]
    year = F.coalesce(wl["volume"].cast("int"), _group(c, r"\((\d{4})\)\s+\d").cast("int"), date["year"], bare_year)
    when = F.coalesce(date, F.get(dated, F.lit(0)))

    own = F.regexp_replace(F.ltrim(c, F.lit("([ ")), r"^of\s+", "")
    plain = without_docket_junk(own)
    pieces = F.split(plain, _HEAD_ENDS, 2)
    ended = (F.size(pieces) > 1) | (plain != own)
    head = squeeze(F.rtrim(pieces[0], F.lit(", ")))
    sides = F.split(head, r"\s+v\.?\s+", 2)
    paired = (F.size(sides) == 2) & (F.trim(sides[0]) != "") & (F.trim(F.get(sides, F.lit(1))) != "")
    plaintiff, defendant = F.when(paired, F.trim(sides[0])), F.when(paired, F.trim(F.get(sides, F.lit(1))))
    begins = F.lower(head)
    matter = ended & F.exists(F.array(*map(F.lit, MATTERS)), lambda m: begins.startswith(m))
    alone = printed.isNotNull() & ended & (F.length(head) <= LONGEST_SURNAME) & head.rlike(r"^[A-Z][A-Za-z.'’& -]*$") & F.get(pieces, F.lit(1)).rlike(r"^\d")
    name = F.when(paired, F.concat_ws(" v. ", plaintiff, defendant)).when(matter | alone, head)
    document = _group(F.regexp_replace(F.lower(c), r"\.(?=\s)", ""), rf"\b(?:{'|'.join(DOCUMENT_LABELS)})\s+(\d+(?:-\d+)?)\b")
    return F.struct(
        c.alias("raw_text"), name.alias("case_name"), plaintiff.alias("plaintiff"), defendant.alias("defendant"), printed["volume"].alias("volume"), printed["reporter"].alias("reporter"),
        printed["page"].alias("page"), date["court"].alias("court"), year.alias("year"), when["month"].alias("month"), when["day"].alias("day"), _docket(c).alias("docket_number"),
        wl.isNotNull().alias("is_westlaw"), wl["page"].alias("wl_number"), document.alias("ecf_document_number"),
    )
