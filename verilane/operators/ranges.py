"""Joins by interval and by prefix as equi-joins, numbering without a task for each key, and runs of consecutive numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verilane.sources.session import cut


def in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, stop: str) -> DataFrame:
    """Every point with every span of its keys that holds it: start <= point < stop, all whole numbers.

    A span of a length of at most 2^k lies in one or two bins of that width, and a point in one of each width that occurs, so the join is one of equal
    keys, width and bin: two rows a span, as many a point as there are widths (at most 64, most often a few), whatever the spans' lengths and
    however they overlap. Empty spans, nulls and points outside all spans give no row; spans are shorter than 2^63. Columns of both sides must differ but for keys.
    """
    shifted = lambda c, k: F.call_function("shiftright", F.col(c).cast("long") if isinstance(c, str) else c, k)
    size = (F.col(stop) - F.col(start)).cast("long")
    # the number of binary digits of the last offset within a span
    sized = spans.where(F.col(start) < F.col(stop)).withColumn("_k", F.when(size == 1, 0).otherwise(F.length(F.bin(size - 1))))
    binned = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(shifted(start, F.col("_k")), shifted(F.col(stop).cast("long") - 1, F.col("_k"))))))
    widths = sorted(r[0] for r in sized.select("_k").distinct().collect())  # at most 64
    if not widths:
        return points.join(spans, keys).limit(0)
    asked = points.where(F.col(point).isNotNull()).withColumn("_k", F.explode(F.array(*map(F.lit, widths)))).withColumn("_bin", shifted(point, F.col("_k")))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))
    return asked.join(binned, [*keys, "_k", "_bin"]).where(inside).drop("_k", "_bin")


def longest_prefix(rows: DataFrame, prefixes: DataFrame, text: str, prefix: str) -> DataFrame:
    """rows with the columns of the longest prefix that text begins with; null where there is none. prefixes: each one once.

    A row asks for its own beginnings of the lengths that occur, so the join is one of equal strings. Rows are told apart by a number of their own.
    """
    lengths = sorted(r[0] for r in prefixes.where(F.col(prefix).isNotNull()).select(F.length(prefix)).distinct().collect())
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    asked = numbered.select("_row", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.length(text) >= n, F.left(text, F.lit(n))) for n in lengths]))).alias(prefix))
    found = asked.join(prefixes, prefix).groupBy("_row").agg(F.max_by(F.struct(*prefixes.columns), F.length(prefix)).alias("_best"))
    return numbered.join(found, "_row", "left").select(*rows.columns, "_best.*")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with name, each row's number (from 1) within its keys by order, for keys with any number of rows.

    Rows are dealt out by ranges of keys and order, numbered within a range, and moved up by what the ranges before hold of their key. Without
    keys all rows are one sequence. Rows alike in keys and order are numbered in the order in which they are read.
    """
    sort = [F.col(k) for k in keys] + order
    dealt = df.withColumn("_read", F.monotonically_increasing_id())
    dealt = cut(cut(dealt).repartitionByRange(*sort, "_read").withColumn("_range", F.spark_partition_id()))
    within = [*[F.col(k) for k in keys], F.col("_range")]
    sizes = dealt.groupBy(*within).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each key and range: as few as keys and ranges together
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order, "_read")))
    same = F.col("_range") == F.col("_range2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    placed = local.join(before.withColumnsRenamed({"_range": "_range2"} | {k: f"_key_{k}" for k in keys}), same)
    return placed.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).select(*df.columns, name)


def number_runs(lines: DataFrame, keys: list[str], at: str, number: Column) -> DataFrame:
    """keys, n_lines, numbered, steps (numbers after another one of the keys), by_one (steps of one), runs and longest (runs of numbers that go up by one).

    Gaps and islands: a number that isn't its predecessor's successor begins a run. number is null where a line has none; lines without one end no run.
    """
    own = lines.select(*keys, F.col(at).alias("_at"), number.alias("_number"))
    ordered = Window.partitionBy(*keys).orderBy("_at")
    have = own.where("_number is not null").withColumn("_before", F.lag("_number").over(ordered))
    fresh = F.when(F.col("_number") == F.col("_before") + 1, 0).otherwise(1)
    runs = have.withColumn("_run", F.sum(fresh).over(ordered)).groupBy(*keys, "_run").agg(F.count("*").alias("_size"))
    runs = runs.groupBy(*keys).agg(F.sum("_size").alias("numbered"), F.count("*").alias("runs"), F.max("_size").alias("longest"))
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n_lines"))
    out = sizes.join(runs, keys, "left").fillna(0, ["numbered", "runs", "longest"])
    # every run but the first begins with a step that isn't one
    steps = F.greatest(F.col("numbered") - 1, F.lit(0))
    return out.withColumn("steps", steps).withColumn("by_one", F.when(F.col("numbered") > 0, F.col("numbered") - F.col("runs")).otherwise(0))


#: A page has a gutter of line numbers if it has so many lines, at least these shares of them are numbered and of the steps are one. Fixed values.
GUTTER_PAGE, GUTTER_LINES, GUTTER_STEPS = 5, 0.6, 0.5


def has_gutter(runs: DataFrame) -> DataFrame:
    """runs, as number_runs gives them, with gutter."""
    many = (F.col("n_lines") >= GUTTER_PAGE) & (F.col("numbered") >= GUTTER_LINES * F.col("n_lines"))
    return runs.withColumn("gutter", many & (F.col("by_one") >= GUTTER_STEPS * F.col("steps")))


def without_gutters(lines: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """number_runs and gutter of every page, and its text: a page with a gutter loses the numbers and flows on as one line, others keep their lines. A page's lines fit a row."""
    number = F.regexp_extract(line, r"^(\d{1,2})\s", 1)
    runs = has_gutter(number_runs(lines, keys, at, number.try_cast("int")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(line).alias("line"))))
    pages = lines.groupBy(*keys).agg(F.transform(rows, lambda r: r["line"]).alias("_lines"))
    flowing = F.array_join(F.transform("_lines", lambda x: F.regexp_replace(x, r"^\d{1,2}\s", "")), " ")
    joined = runs.join(pages, keys)
    return joined.withColumn("text", F.when(F.col("gutter"), flowing).otherwise(F.array_join("_lines", "\n"))).drop("_lines")
