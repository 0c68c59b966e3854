"""What the operators of this subpackage share: reading, checkpoints, folds and Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with this remainder of crc32(doc_id) by FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2
#: A batch that crosses to Python has at most this many rows and about this many bytes, so that long texts stay bounded. What a task holds of it,
#: on both sides and in arrays of 64-bit numbers, is several times as much.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Slices of a stratum within which sampled rows are ranked.
SLICES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out evenly: only small inputs are, large ones stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows kept for testing; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with bounded batches. A lost task is run again from its input split; nothing outlives it."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what must outlive an executor. A folder of our own only in local mode, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of a column one by one; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def sampled(df: DataFrame, strata: list[str], at_most: int, salt: int) -> DataFrame:
    """At most at_most rows of each stratum, chosen by a hash of doc_id, so the same rows at every run and layout.

    Thresholds come from two small aggregations: one bounds the hash so that somewhat more than enough rows pass, the other counts
    those by slices of the hash, so that slices are taken whole up to the one in which the bound falls. Rows are ranked within a
    slice, so no stratum is gathered in one task. Rows whose stratum is null aren't sampled.
    """
    from pyspark.sql import Window

    key = (F.xxhash64(F.col("doc_id"), F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("_u")
    keyed = df.withColumn("_u", key)
    sizes = keyed.groupBy(*strata).agg(F.count("*").alias("_n"))
    wanted = sizes.withColumn("_cut", F.least(1.3 * at_most / F.col("_n") + 20.0 / F.col("_n"), F.lit(1.0))).drop("_n")
    kept = keyed.join(F.broadcast(wanted), strata).where("_u <= _cut").withColumn("_slice", F.floor(SLICES * F.col("_u") / F.col("_cut")))
    counts = kept.groupBy(*strata, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_slice")) - F.col("_n")
    taken = counts.withColumn("_before", before).where(F.col("_before") < at_most).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*strata, "_slice").orderBy("_u", "doc_id"))
    ranked = kept.join(F.broadcast(taken), [*strata, "_slice"]).withColumn("_r", F.col("_before") + rank)
    return ranked.where(F.col("_r") <= at_most).drop("_u", "_cut", "_slice", "_before", "_r")
