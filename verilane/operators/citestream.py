"""The citations of a document as a stream: full ones, short forms, back-references, and what each of them stands for.

A full citation is a name and a location (volume, reporter, page). A short form repeats volume and reporter with "at", a back-reference a party's name with "supra";
both stand for the last full citation before them with that volume and reporter, or that party. "Id." stands for what the citation before it stands for.

References are resolved by as-of joins: full citations and references of one key are put together and ordered, and the last full one before a reference is read by a
window; no pair of positions is compared. Keys lie within a document, so no task holds more than one document's citations of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a reporter after its first, and how the four kinds are written.
_REPORTER = r"[A-Z][A-Za-z.]*(?: ?(?:2d|3d|\dth|[A-Z][a-z]*\.))*"
_PARTY = r"[A-Z][\w.'’&-]*(?: (?:[A-Z&][\w.'’&-]*|of|the|and|in|for|ex|rel\.))*"
FULL = rf"(?:({_PARTY}) v\. )({_PARTY}), (\d+) ({_REPORTER}) (\d+)"
SHORT = rf"(\d+) ({_REPORTER}),? at \d+"
SUPRA = rf"({_PARTY}), supra"
ID = r"\bId\."
#: Words before a citation that belong to no party's name. Fixed values.
SIGNALS = ["see", "in", "re", "cf.", "e.g.", "accord", "citing", "quoting", "compare", "but", "contra", "under", "per", "also"]
_ANY = rf"{FULL}|{SHORT}|{SUPRA}|{ID}"


def citations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord (from 0 in the order of the text), kind (full, short, supra or id), cite (of a full one), and found, the citation's own words."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).alias("ord", "found"))
    f = F.col("found")
    kind = F.when(f.rlike(rf"^(?:{ID})$"), "id").when(f.endswith(", supra"), "supra").when(f.rlike(rf"^(?:{SHORT})$"), "short").otherwise("full")
    out = found.withColumn("kind", kind)
    part = lambda pattern, k: F.regexp_extract(f, pattern, k)
    is_full = F.col("kind") == "full"
    first = lambda c: F.get(F.filter(F.split(F.lower(c), " "), lambda w: ~w.isin(*SIGNALS)), F.lit(0))
    located = lambda pattern, at: F.concat_ws("|", F.lit("at"), part(pattern, at), F.regexp_replace(part(pattern, at + 1), r"[\s.]", ""))
    keys = (
        F.when(is_full, F.array_distinct(F.array(located(FULL, 3), F.concat(F.lit("name|"), first(part(FULL, 1))), F.concat(F.lit("name|"), first(part(FULL, 2))))))
        .when(F.col("kind") == "short", F.array(located(SHORT, 1)))
        .when(F.col("kind") == "supra", F.array(F.concat(F.lit("name|"), first(part(SUPRA, 1)))))
        .otherwise(F.array().cast("array<string>"))
    )
    return out.withColumn("keys", keys).withColumn("cite", F.when(is_full, F.concat_ws(" ", part(FULL, 3), part(FULL, 4), part(FULL, 5))))


def resolved(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, kind, target (the location that the citation stands for; null if it names none before it) and again (whether it was cited before)."""
    own = citations(docs, key, text)
    by_key = Window.partitionBy(key, "_k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    asked = own.select(key, "ord", "kind", "cite", F.explode("keys").alias("_k")).withColumn("_last", F.last("cite", ignorenulls=True).over(by_key))
    named = asked.where(F.col("kind").isin("short", "supra")).select(key, "ord", "_last")
    joined = own.select(key, "ord", "kind", "cite").join(named, [key, "ord"], "left").withColumn("_own", F.coalesce("cite", "_last"))
    # a struct is never null, so that Id. after an unresolved citation stays unresolved
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    antecedent = F.last(F.when(F.col("kind") != "id", F.struct("_own")), ignorenulls=True).over(before)
    out = joined.withColumn("target", F.when(F.col("kind") == "id", antecedent["_own"]).otherwise(F.col("_own")))
    place = F.row_number().over(Window.partitionBy(key, "target").orderBy("ord"))
    return out.select(key, "ord", "kind", "target", (F.col("target").isNotNull() & (place > 1)).alias("again"))


def rates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: citations, those of each kind, unresolved ones, different targets, and how many repeat a target or are followed by a parenthetical, per citation."""
    stream = resolved(docs, key, text)
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("full", "short", "supra", "id")]
    counted = stream.groupBy(key).agg(F.count("*").alias("n_cites"), *kinds, F.count_if(F.col("target").isNull()).alias("unresolved"), F.countDistinct("target").alias("targets"), F.count_if("again").alias("_again"))
    said = docs.select(key, F.size(F.regexp_extract_all(text, F.lit(r"\([a-z]+ing\b[^()]*\)"), F.lit(0))).alias("_said"))
    joined = counted.join(said, key)
    return joined.withColumn("repeat_rate", F.round(F.col("_again") / F.col("n_cites"), 3)).withColumn("parenthetical_rate", F.round(F.col("_said") / F.col("n_cites"), 3)).drop("_again", "_said")
