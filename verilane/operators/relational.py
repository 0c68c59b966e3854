"""Ordering, joins and set operators. Every order is total, so results don't depend on how rows were laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank(keys: list, order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows of each key, the first under order."""
    return top_k(df, keys, order, 1)


def last_wins(df: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """Of the rows of each key, the last by the ordinal columns, the first of which decides first."""
    return top_k(df, keys, [F.desc(c) for c in ordinal], 1)


def top_k(df: DataFrame, keys: list, order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before it shuffles."""
    out = df.withColumn(rank or "_rank", _rank(keys, order)).where(F.col(rank or "_rank") <= k)
    return out if rank else out.drop("_rank")


def first_seen(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Different values of key with the ordinal at which each was first seen."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ordinal).alias(ordinal))


def merge_last_wins(left: DataFrame, right: DataFrame, key: str, ordinal: list[str]) -> DataFrame:
    """left joined to the last row of right for its key; every row of left stays, once."""
    return left.join(last_wins(right, [key], ordinal), key, "left")


def pending(claims: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Claims without a result yet."""
    return claims.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(old: DataFrame, new: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of new, the rows whose keys aren't in old; the first of each key within the batch."""
    return pending(first_wins(new, keys, [F.col(ordinal)]), old, keys)


def positional_join(left: DataFrame, right: DataFrame, at: str, equal: dict[str, str]) -> DataFrame:
    """left with the row of right at the same place. equal names columns of left and of right that must agree on every row.

    A place that one side lacks or holds twice, and a row whose columns disagree, raises when it is read: rows that have shifted against each
    other must not be joined. Null equals null. Other columns of right that left has too aren't taken.
    """
    taken = [c for c in right.columns if c not in left.columns]
    own = lambda df, mark: df.withColumn(mark, F.count(F.lit(1)).over(Window.partitionBy(at)))
    theirs = own(right.select(at, *[F.col(c).alias(f"_g_{c}") for c in equal.values()], *[c for c in taken if c != at]), "_right")
    joined = own(left, "_left").join(theirs, at, "full_outer")
    good = (F.coalesce("_left", F.lit(0)) == 1) & (F.coalesce("_right", F.lit(0)) == 1)
    for a, b in equal.items():
        good = good & F.col(a).eqNullSafe(F.col(f"_g_{b}"))
    place = F.coalesce(F.col(at).cast("string"), F.lit("null"))
    checked = F.when(good, F.col(at)).otherwise(F.raise_error(F.concat(F.lit("rows don't agree at place "), place)).cast(left.schema[at].dataType))
    return joined.withColumn(at, checked).select(*left.columns, *[c for c in taken if c != at])


def cache_split(items: DataFrame, cache: DataFrame, key: str, usable: Column) -> DataFrame:
    """items with hit: whether the cache holds a usable entry for the key."""
    hits = cache.where(usable).select(key).distinct().withColumn("hit", F.lit(True))
    return items.join(hits, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: change is gained, lost, changed or same; values are null-safe compared."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(1).alias("_a"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(1).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    change = F.when(F.col("_a").isNull(), "gained").when(F.col("_b").isNull(), "lost").when(same, "same").otherwise("changed")
    return joined.withColumn("change", change).drop("_a", "_b")


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str], ordinal: str) -> DataFrame:
    """base with the columns of the first change of each key, where there is one and it isn't null."""
    one = first_wins(changes, [key], [F.col(ordinal)]).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(one, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return joined
