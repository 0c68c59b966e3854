"""Courts: ids of federal courts from their abbreviations, and the states of reporters. All as column expressions.

District courts are built by rule: the id is the state's code, the letter of the division and d; the abbreviation the division and the state's.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Appellate courts by their ids.
APPELLATE = {
    "scotus": ["U.S.", "SCOTUS"], "ca1": ["1st Cir."], "ca2": ["2d Cir.", "2nd Cir."], "ca3": ["3d Cir.", "3rd Cir."], "ca4": ["4th Cir."], "ca5": ["5th Cir."], "ca6": ["6th Cir."], "ca7": ["7th Cir."],
    "ca8": ["8th Cir."], "ca9": ["9th Cir."], "ca10": ["10th Cir."], "ca11": ["11th Cir."], "cadc": ["D.C. Cir."], "cafc": ["Fed. Cir."],
}
#: Each state's code, its abbreviation, and the divisions of its district court (none: one district).
DISTRICTS = [
    ("al", "Ala.", "NMS"), ("ak", "Alaska", ""), ("az", "Ariz.", ""), ("ar", "Ark.", "EW"), ("ca", "Cal.", "NECS"), ("co", "Colo.", ""), ("ct", "Conn.", ""), ("de", "Del.", ""), ("dc", "D.C.", ""), ("fl", "Fla.", "NMS"),
    ("ga", "Ga.", "NMS"), ("gu", "Guam", ""), ("hi", "Haw.", ""), ("id", "Idaho", ""), ("il", "Ill.", "NCS"), ("in", "Ind.", "NS"), ("ia", "Iowa", "NS"), ("ks", "Kan.", ""), ("ky", "Ky.", "EW"), ("la", "La.", "EMW"),
    ("me", "Me.", ""), ("md", "Md.", ""), ("ma", "Mass.", ""), ("mi", "Mich.", "EW"), ("mn", "Minn.", ""), ("ms", "Miss.", "NS"), ("mo", "Mo.", "EW"), ("mt", "Mont.", ""), ("ne", "Neb.", ""), ("nv", "Nev.", ""),
    ("nh", "N.H.", ""), ("nj", "N.J.", ""), ("nm", "N.M.", ""), ("ny", "N.Y.", "NSEW"), ("nc", "N.C.", "EMW"), ("nd", "N.D.", ""), ("oh", "Ohio", "NS"), ("ok", "Okla.", "NEW"), ("or", "Or.", ""), ("pa", "Pa.", "EMW"),
    ("pr", "P.R.", ""), ("ri", "R.I.", ""), ("sc", "S.C.", ""), ("sd", "S.D.", ""), ("tn", "Tenn.", "EMW"), ("tx", "Tex.", "NSEW"), ("ut", "Utah", ""), ("vt", "Vt.", ""), ("va", "Va.", "EW"), ("vi", "V.I.", ""),
    ("wa", "Wash.", "EW"), ("wv", "W. Va.", "NS"), ("wi", "Wis.", "EW"), ("wy", "Wyo.", ""),
]
#: The states whose courts each regional reporter prints.
REGIONS = {
    "A.": ["conn", "del", "dc", "me", "md", "nh", "nj", "pa", "ri", "vt"], "N.E.": ["ill", "ind", "mass", "ny", "ohio"], "N.W.": ["iowa", "mich", "minn", "neb", "nd", "sd", "wis"],
    "P.": ["alaska", "ariz", "cal", "colo", "haw", "idaho", "kan", "mont", "nev", "nm", "okla", "or", "utah", "wash", "wyo"], "S.E.": ["ga", "nc", "sc", "va", "wva"], "S.W.": ["ark", "ky", "mo", "tenn", "tex"], "So.": ["ala", "fla", "la", "miss"],
}


def _key(s: str) -> str:
    return re.sub(r"[\s.]", "", s).lower()


def court_keys() -> dict[str, str]:
    """Every abbreviation without spaces and points, and every id itself, with the court's id."""
    out = {_key(a): cid for cid, own in APPELLATE.items() for a in own}
    for code, state, divisions in DISTRICTS:
        for letter in divisions or [""]:
            out[_key(f"{letter}d{state}")] = f"{code}{letter.lower()}d"
    return out | {cid: cid for cid in out.values()}


def _looked_up(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def court_id(court: Column) -> Column:
    """The id of a federal court from its abbreviation or id; a bankruptcy court is its district's with b for d; null for any other court."""
    bankr = court.rlike(r"(?i)^\s*Bankr\.?\s+")
    found = _looked_up(F.lower(F.regexp_replace(F.regexp_replace(court, r"(?i)^\s*Bankr\.?\s+", ""), r"[\s.]", "")), court_keys())
    return F.when(bankr, F.when(found.endswith("d"), F.concat(F.regexp_replace(found, "d$", ""), F.lit("b")))).otherwise(found)


def is_federal(court: Column) -> Column:
    """Whether a court, by abbreviation or id, is a federal one. False for null."""
    own = F.regexp_replace(court, "b$", "d")  # a bankruptcy court's id
    return court_id(court).isNotNull() | court_id(own).isNotNull()


def reporter_states(reporter: Column) -> Column:
    """The states of a reporter without regard to its series: those of a regional one, or of one that begins with a state's abbreviation; else an empty array."""
    family = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(reporter, F.lit("")), r"[\s.]", "")), r"(2d|3d|\dth)$", "")
    regional = {_key(r): s for r, s in REGIONS.items()}
    table = F.create_map(*[x for r, own in regional.items() for x in (F.lit(r), F.array(*map(F.lit, own)))])
    states = sorted((_key(state) for _, state, _ in DISTRICTS), key=len, reverse=True)
    own = F.regexp_extract(family, rf"^({'|'.join(states)})(?:(?:app|appct|appdiv|ct|dec|rptr|super|supp|crim|st|s|div|lexis)*)$", 1)
    return F.coalesce(F.try_element_at(table, family), F.when(own != "", F.array(own)), F.array().cast("array<string>"))


def is_state_citation(court: Column, reporter: Column) -> Column:
    """Whether a citation is of a state's court, which no federal docket holds: by a court that isn't federal, or by its reporter."""
    return F.coalesce(court.isNotNull() & ~is_federal(court), F.lit(False)) | (F.size(reporter_states(reporter)) > 0)


def search_params(court: Column, reporter: Column, year: Column) -> Column:
    """court_id, filed_after and filed_before of a search: the court's id or the reporter's only state, and a year on either side."""
    states = reporter_states(reporter)
    place = F.coalesce(court_id(court), F.when(F.size(states) == 1, F.get(states, F.lit(0))))
    day = lambda y, end: F.concat((y).cast("string"), F.lit(end))
    return F.struct(place.alias("court_id"), day(year - 1, "-01-01").alias("filed_after"), day(year + 1, "-12-31").alias("filed_before"))


def on_record(volume: Column, reporter: Column, page: Column, citations: Column) -> Column:
    """Whether a record's citations hold a location. True where nothing can be said: no whole location, or no citations at all."""
    flat = lambda c: F.translate(F.lower(c), ". ", "")
    held = F.exists(citations, lambda c: flat(c).contains(F.lower(volume)) & flat(c).contains(flat(reporter)) & flat(c).contains(F.lower(page)))
    located = reduce(lambda a, b: a & b, (F.coalesce(c, F.lit("")) != "" for c in (volume, reporter, page)))
    return F.when(located & (F.coalesce(F.size(citations), F.lit(0)) > 0), F.coalesce(held, F.lit(False))).otherwise(True)
