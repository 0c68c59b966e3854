"""Evaluation and outlier screening: confusion, transitions, medians and deviations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilane.functions.rules import robust_z

#: A cell with fewer rows has no leave-one-out rate; a score at or above this is an outlier. Fixed values.
LEAST_CELL, OUTLIER = 3, 3.5


#: Shares of a cell between which its median lies for certain, and the sketch's accuracy: ranks are right to this part of the cell.
BETWEEN, ACCURACY = (0.49, 0.51), 1000


def exact_median(df: DataFrame, cell: list[str], x: Column, out: str) -> DataFrame:
    """cell, out (the exact median of x, nulls left out) and n (the number of values), in bounded memory whatever a cell holds.

    A sketch of fixed size gives two values of each cell between which its median lies; then only the values between them are counted one by one and ordered,
    with all smaller ones as one number.
    """
    own = df.select(*cell, x.cast("double").alias("_x")).where("_x is not null")
    sketch = own.groupBy(*cell).agg(F.percentile_approx("_x", list(BETWEEN), ACCURACY).alias("_q"), F.count("_x").alias("n"))
    ends = sketch.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(cell)], "n", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(cell)))
    near = own.join(ends, same).where(F.col("_x") <= F.col("_high"))
    counted = near.groupBy(*cell, "n", F.when(F.col("_x") >= F.col("_low"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*cell).orderBy(F.col("_v").asc_nulls_first()))
    placed = counted.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto")), F.col("_v")))
    both = (at(F.floor((F.col("n") + 1) / 2)) + at(F.ceil((F.col("n") + 1) / 2))) / 2
    return placed.groupBy(*cell, "n").agg(both.alias(out)).select(*cell, out, "n")


def _in_cells(df: DataFrame, cells: DataFrame, cell: list[str]) -> DataFrame:
    """df joined to its cells; null cells are cells."""
    named = cells.withColumnsRenamed({c: f"_k{k}" for k, c in enumerate(cell)})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(cell)))
    return df.join(named, same).drop(*[f"_k{k}" for k in range(len(cell))])


def median_mad(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Per cell the median, the median absolute deviation and the number of values, all exact."""
    centre = exact_median(df, cell, F.col(value), "median")
    apart = _in_cells(df.where(F.col(value).isNotNull()), centre.drop("n"), cell)
    mads = exact_median(apart, cell, F.abs(F.col(value) - F.col("median")), "mad").drop("n")
    return _in_cells(centre, mads, cell).select(*cell, "median", "mad", "n")


def z_scores(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """df with z, its robust deviation within its cell, and outlier."""
    out = _in_cells(df, median_mad(df, cell, value), cell)
    return out.withColumn("z", robust_z(F.col(value), F.col("median"), F.col("mad"))).withColumn("outlier", F.abs("z") >= OUTLIER)


def _places(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Different values of each cell with start, the place of the first of them in order, and n, the size of the cell."""
    counted = df.groupBy(*cell, value).agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy(*cell).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("start", F.coalesce(F.sum("_c").over(order), F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*cell)))


def _without_one(df: DataFrame, cell: list[str], value: str, out: str) -> DataFrame:
    """Per value of each cell, out: the median of the others when one such value is left out.

    The others' place k is the cell's place k before the value and k + 1 from it on, so four order statistics of a cell give all medians.
    """
    placed = _places(df, cell, value)
    places = {"l": F.floor((F.col("n") - 2) / 2), "u": F.floor((F.col("n") - 1) / 2)}
    at = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("start") + F.col("_c")), F.col(value)))
    stats = placed.groupBy(*cell).agg(*[at(places[p] + j).alias(f"_{p}{j}") for p in places for j in (0, 1)])
    joined = placed.join(stats, cell)
    pick = lambda p: F.when(F.col("start") > places[p], F.col(f"_{p}0")).otherwise(F.col(f"_{p}1"))
    return joined.withColumn(out, (pick("l") + pick("u")) / 2).select(*cell, value, "_c", "n", out)


def leave_one_out(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Per cell how many rows are outliers against the median and deviation of the cell's other rows.

    Exact and linear: a cell has at most three medians with one row left out, and as many deviations for each of them, all read
    from order statistics of counted values.
    """
    counted = df.where(F.col(value).isNotNull()).select(*cell, F.col(value).cast("double").alias("_x")).groupBy(*cell, "_x").agg(F.count("*").alias("_c"))
    own = _without_one(counted, cell, "_x", "_m").where(F.col("n") >= LEAST_CELL)
    medians = own.select(*cell, "_m").distinct()
    apart = counted.join(medians, cell).withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
    mads = _without_one(apart, [*cell, "_m"], "_d", "_mad").select(*cell, "_m", "_d", "_mad")
    scored = own.withColumn("_d", F.abs(F.col("_x") - F.col("_m"))).join(mads, [*cell, "_m", "_d"])
    out = (F.col("_mad") > 0) & (F.abs(robust_z(F.col("_x"), F.col("_m"), F.col("_mad"))) >= OUTLIER)
    tail = F.sum(F.when(out, F.col("_c")).otherwise(0))
    return scored.groupBy(*cell).agg(F.sum("_c").alias("n"), tail.alias("n_tail"), (tail / F.sum("_c")).alias("tail_rate"))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return df.groupBy(truth.alias("expected"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def firing_matrix(df: DataFrame, stratum: str, signals: dict[str, Column], bad: str) -> DataFrame:
    """Per signal its firing rate among bad and other strata, and what that says."""
    long = df.select(stratum, F.explode(F.map_from_arrays(F.array(*map(F.lit, signals)), F.array(*[F.coalesce(c, F.lit(False)) for c in signals.values()]))).alias("signal", "fired"))
    rates = long.groupBy("signal").agg(
        F.count_if(F.col("fired") & (F.col(stratum) == bad)).alias("bad_fired"), F.count_if(F.col(stratum) == bad).alias("bad_n"),
        F.count_if(F.col("fired") & (F.col(stratum) != bad)).alias("good_fired"), F.count_if(F.col(stratum) != bad).alias("good_n"),
    )
    verdict = F.when((F.col("bad_fired") > 0) & (F.col("good_fired") == 0), "SEPARATES").when(F.col("bad_fired") + F.col("good_fired") > 0, "FIRES").otherwise("silent")
    return rates.withColumn("verdict", verdict)
