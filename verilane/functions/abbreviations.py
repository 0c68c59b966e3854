"""Abbreviations of case names and their long forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that are written out before a search, in order. Fixed values.
SEARCH = {
    "Cnty": "County", "Cty": "County", "Dep't": "Department", "Dept": "Department", "Comm'n": "Commission", "Comm'r": "Commissioner", "Comm": "Commission", "Bd": "Board", "Div": "Division", "Dist": "District", "Off": "Office", "Ofc": "Office",
    "Ass'n": "Association", "Assn": "Association", "Coop": "Cooperative",
    "Adm'r": "Administrator", "Admin": "Administrator", "Exec": "Executive", "Dir": "Director", "Sec'y": "Secretary", "Treas": "Treasurer", "Atty": "Attorney", "Gen": "General",
    "Univ": "University", "Coll": "College", "Sch": "School", "Educ": "Education", "Hosp": "Hospital", "Med": "Medical", "Ctr": "Center",
    "Ins": "Insurance", "Info": "Information", "Sols": "Solutions", "Sol": "Solution", "Fin": "Finance", "Mfg": "Manufacturing", "Serv": "Service", "Servs": "Services", "Transp": "Transportation", "Util": "Utility", "Pub": "Public",
    "Nat'l": "National", "Natl": "National", "Int'l": "International", "Intl": "International", "Nw": "Northwest", "Sw": "Southwest", "Cath": "Catholic", "Ch": "Church",
    "Inst": "Institute", "Acad": "Academic", "Rts": "Rights", "Sys": "System", "Lab'ys": "Laboratories", "Labs": "Laboratories", "Pol": "Political", "Envtl": "Environmental", "Indus": "Industrial", "Tech": "Technology",
    "Mgmt": "Management", "Prods": "Products", "Pharm": "Pharmaceutical", "Elec": "Electric", "Telecomms": "Telecommunications", "Just": "Justice", "Petrol": "Petroleum", "Reg'l": "Regional", "Regl": "Regional", "Cmty": "Community", "Hous": "Housing",
    "Ala": "Alabama", "Ariz": "Arizona", "Ark": "Arkansas", "Cal": "California", "Colo": "Colorado", "Conn": "Connecticut", "Del": "Delaware", "Fla": "Florida", "Haw": "Hawaii", "Ida": "Idaho", "Ill": "Illinois", "Ind": "Indiana",
    "Kan": "Kansas", "Mich": "Michigan", "Minn": "Minnesota", "Miss": "Mississippi", "Mont": "Montana", "Neb": "Nebraska", "Nev": "Nevada", "Okla": "Oklahoma", "Ore": "Oregon", "Tenn": "Tennessee", "Tex": "Texas", "Wash": "Washington",
    "Wis": "Wisconsin", "Wyo": "Wyoming",
}
#: What is written out for a comparison of names besides, and the one of the above that isn't. Fixed values.
COMPARED_TOO = {
    "inc": "incorporated", "corp": "corporation", "ltd": "limited", "llc": "limited liability company", "co": "company", "assoc": "association", "bros": "brothers", "dr": "doctor", "jr": "junior", "sr": "senior",
    "st": "street", "mt": "mount", "ft": "fort", "institutional": "institute", "am": "america", "american": "america", "fed": "federal", "munic": "municipal", "town": "township", "vlg": "village", "secy": "secretary",
    "fbi": "federal bureau of investigation", "epa": "environmental protection agency", "ky": "kentucky", "vt": "vermont",
}
NOT_COMPARED = ["comm"]

COMPARED = {k.lower(): v.lower() for k, v in SEARCH.items() if k.lower() not in NOT_COMPARED} | COMPARED_TOO


def pattern(short: str) -> str:
    """A whole word. A point after it goes only if a word follows the point at once, as word boundaries have it; before a blank it stays."""
    return rf"\b{short}\b" if "'" in short else rf"\b{short}\.?\b"


def written_out(name: Column) -> Column:
    """A case name with the search abbreviations, in any case, written out."""
    out = F.translate(name, "‘’", "''")
    for short, long in SEARCH.items():
        out = F.regexp_replace(out, "(?i)" + pattern(short), long)
    return out


def compared(name: Column, besides: dict[str, str] | None = None) -> Column:
    """A lower-case name with the abbreviations of a comparison, and other words besides, written out: words with apostrophes as they stand, else their parts."""
    table = F.create_map(*[F.lit(x) for pair in (COMPARED | (besides or {})).items() for x in pair])
    found = lambda w: F.try_element_at(table, w)
    parts = lambda w: F.array_join(F.transform(F.split(w, "'"), lambda x: F.coalesce(found(x), x)), "'")
    pieces = F.regexp_extract_all(name, F.lit(r"[\w']+|[^\w']+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.coalesce(found(w), parts(w))), "")
