"""Sinks. Files are written by Spark's committers; only a report, which is small by nature, is put together on the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = ("Red", "Yellow", "CheckCite", "Green", "Gray")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Null as an empty cell; arrays joined by "; "."""
    flat = [F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def write_ndjson(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def merged_manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A manifest after an update: new entries win, others stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def distinct_names(df: DataFrame, base: str, order: list[str]) -> DataFrame:
    """name: base, and from its second use on with " (n)" after it; a base may be used by any number of rows."""
    from verilane.operators.ranges import numbered

    own, at = numbered(df, [base], [F.col(c) for c in order], "_use"), F.col("_use")
    return own.withColumn("name", F.when(at == 1, F.col(base)).otherwise(F.format_string("%s (%d)", F.col(base), at))).drop("_use")


def stamp(spark, path: str, verb: str, **counts: int) -> None:
    """Append a run's stamp to the log table."""
    row = spark.createDataFrame([(verb, {k: int(v) for k, v in counts.items()})], "verb string, counts map<string,long>")
    row.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def report_html(findings: DataFrame, title: str, at_most: int = 20_000) -> str:
    """The cards by lane, worst first. A report of more than at_most cards is refused rather than cut."""
    rows = findings.select("claim_id", "cited_case", "lane", "badge").orderBy("claim_id").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} findings don't fit one report")
    parts = [f"<!DOCTYPE html><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for lane in LANES:
        own = [r for r in rows if r.lane == lane]
        cards = "".join(f'<article class="{lane.lower()}"><h3>{escape(r.cited_case or "")}</h3><span>{escape(r.badge or "")}</span></article>' for r in own)
        parts.append(f"<section><h2>{lane} ({len(own)})</h2>{cards}</section>")
    return "".join(parts)


#: Columns of a batch's result file and of the list of flagged results, in order. Fixed values.
RESULT_COLUMNS = ["citation", "status", "matched_cluster_id", "matched_docket_id", "matched_url", "matched_case_name", "matched_court_id", "matched_date_filed", "confidence", "diagnostics_json"]
FLAG_COLUMNS = ["timestamp", "citation", "status", "confidence", "matched_url", "matched_case_name", "matched_court", "matched_date", "matched_description", "diagnostics"]


def result_rows(results: DataFrame) -> DataFrame:
    """The ten columns of a batch file as strings, from citation, status, cluster_id, docket_id, url, matched_name, court, year, score and diagnostics.

    What isn't known is empty, a missing score 0.0, missing diagnostics an empty list.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).cast("string")
    own = [blank(c) for c in ("citation", "status", "cluster_id", "docket_id", "url", "matched_name", "court", "year")] + [score, F.coalesce(F.to_json("diagnostics"), F.lit("[]"))]
    return results.select(*[c.alias(n) for c, n in zip(own, RESULT_COLUMNS, strict=True)])


def append_flags(flags: DataFrame, path: str) -> None:
    """Append flagged results with the time of writing; columns that flags lacks are empty, others aren't written."""
    have = [F.current_timestamp().cast("string").alias(c) if c == "timestamp" else (F.col(c) if c in flags.columns else F.lit("").alias(c)) for c in FLAG_COLUMNS]
    write_csv(flags.select(*have), path, "append")


def append_unless_contained(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """Of new, the rows whose key no old entry (column entry) contains, each key once, the first under order.

    All keys are looked for in one scan of the entries; see operators.passages.
    """
    from verilane.operators.passages import passages_in
    from verilane.operators.relational import first_wins

    held = passages_in(new.select(F.col(key).alias("_needle")).where(F.length(key) > 0).distinct(), old.select(F.col("entry").alias("_entry")), "_needle", "_entry").select(F.col("_needle").alias(key)).distinct()
    return first_wins(new.where(F.length(key) > 0).join(held, key, "left_anti"), [key], order)
