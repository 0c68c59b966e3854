"""Readers. Strings stay strings, blanks become null, and every row-bearing frame can carry its place as ord."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilane.functions.text import visible_text

#: Suffixes whose bytes are text. Others need a decoder that isn't part of this engine.
TEXT_SUFFIXES = ("txt", "md", "html", "htm")


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all strings, blanks as null. A missing column is an error, an unknown one is carried."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One citation a line; blank lines and lines that begin with # are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("line")).where((line != "") & ~line.startswith("#"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines; costs and times that aren't there are 0, lines that don't parse are left out."""
    schema = "claim_id string, prompt_version string, model string, elapsed_s double, cost_usd double, fields map<string,string>"
    own = spark.read.schema(schema).json(path)
    return own.where("claim_id is not null").fillna(0.0, ["elapsed_s", "cost_usd"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, body and error of every file: what can't be read as text becomes a row with an error, not a failure."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    suffix = F.lower(F.substring_index("file", ".", -1))
    text = F.decode("content", "UTF-8")
    known = suffix.isin(*TEXT_SUFFIXES)
    return raw.select("file", F.when(known, F.when(suffix.isin("html", "htm"), visible_text(text)).otherwise(text)).alias("body"), F.when(~known, F.concat(F.lit("unsupported file type: "), suffix)).alias("error"))


def read_cells(spark: SparkSession, manifests: str, texts: str) -> DataFrame:
    """Manifest lines joined to the text files named by their slug; a row without its text is left out."""
    rows = spark.read.json(manifests)
    bodies = spark.read.text(texts, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("slug"), F.col("value").alias("body"))
    return rows.join(bodies, "slug")


def replay(calls: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded responses of calls, by call_key; a call that was never recorded raises when its row is read."""
    out = calls.join(recorded.select("call_key", "response", F.lit(True).alias("_known")), "call_key", "left")
    miss = F.raise_error(F.concat(F.lit("no recorded response for "), "call_key")).cast("string")
    return out.withColumn("response", F.when(F.col("_known"), F.col("response")).otherwise(miss)).drop("_known")
