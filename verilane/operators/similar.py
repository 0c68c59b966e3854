"""Exact similarity join of texts as sets of word shingles: inverted lists of prefixes, length filter, verification.

Words are the runs of bytes outside ASCII white space of the lower-cased text, shingles so many consecutive words (fewer words: all of them; no word: no
shingle). Two texts are alike if the Jaccard similarity of their sets of shingles, by 64-bit hashes, is at least a threshold.

Candidates (prefix filter). All sets are ordered by one order of the tokens. Sets of x and y tokens that are alike share at least t x and at least t y of
them, so each one's first x - ceil(t x) + 1 tokens hold one that the other's first ones hold too: only prefixes are joined, and every pair that is
alike meets in one of their lists. That is so for any order; the better one has rare tokens first, which keeps the lists short. Here the tokens that a
bounded sample finds frequent come last, by how often, all others first, by their hash. The sample is too small to see a passage that few texts in ten thousand quote, and
those are the more the larger the table is; so the tokens that come first are counted over all texts, somewhat beyond the prefixes, and those of more than CROWD texts move behind the ones
that fewer have. Prefixes then end before they come to a passage's tokens, unless a text has little else. Sample and counts shape the order alone: they never decide what is found.
Of a common token the places in both sets count: behind them there must be room for all that the sets must share.
Prefixes must also share so many tokens that, with all that stands behind them, the sets could be alike; the pairs left are verified on whole sets.

Equal texts are one row, told apart by their MD5. `pairs` gives all pairs of different texts that are alike. `groups` gives what chains of such pairs
connect, without all pairs of a crowd: first each text of a list is compared with one pivot of the list, the text whose prefix has the most frequent tokens; after that, only pairs that no chain connects yet
are compared, and of each list those with at least one text outside the list's largest part. Every pair that is alike is either connected or
compared, so the result is exact. A crowd of near copies costs as many comparisons as it has texts; a text that no pivot reaches meets all the texts of its lists,
most of which the shared prefixes rule out.

Scale. What is shuffled are a set's digest and prefix once, a row for each token of a prefix, the texts once or twice to fetch the candidates' ones, and
the tokens of each candidate once; of all pairs of a crowd (`pairs`) each carries what tells its texts from a common third one. Lists are counted by aggregation and joined by keys that skew handling can split. Repeated rows and hot texts collapse within each
task before the shuffle. Nulls: a null text has no shingle and is in no pair. Texts without a shingle are in no pair and are groups of their own.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from verilane.operators.components import component_labels
from verilane.sources.session import cut

WORDS, ALIKE = 5, "0.8"
#: Rows of the sample that finds frequent tokens, the most tokens taken for frequent, and how often they are in the sample at least.
SAMPLE_ROWS, FREQUENT, OFTEN = 8_000, 200_000, 4
#: Texts among whose first tokens one may be before it moves back, and the most tokens that move: the most frequent ones.
CROWD, MOVED = 8, 200_000
#: Rows and bytes of a batch that crosses to Python.
_ROWS, _BYTES = "2000", str(4 << 20)
#: Bits of a text's number; its partition is in those above the 33rd.
_PLACES = 55


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles, ascending."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(own))
    out = np.full(len(own) - n + 1, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):  # a polynomial of the words' hashes, mixed after each step
            out = (out ^ own[k : len(own) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix(tokens: np.ndarray, alike: Fraction, frequent: np.ndarray, counts: np.ndarray, beyond: int = 0) -> tuple[np.ndarray, int]:
    """The first tokens in the order, as many as must hold one of any set that is alike, and the share of frequent ones in 255ths. frequent is ascending.

    beyond: so many halves of the prefix more.
    """
    keep = len(tokens) - -(-alike.numerator * len(tokens) // alike.denominator) + 1 if len(tokens) else 0
    keep = min(len(tokens), keep + keep * beyond // 2)
    if not len(frequent) or not keep:
        return tokens[:keep], 0
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = np.where(frequent[at] == tokens, counts[at], 0)
    order = np.lexsort((tokens, often))[:keep]
    return tokens[order], int(np.count_nonzero(often[order]) * 255 // keep)


def _map(df: DataFrame, function, schema: str) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BYTES)
    return df.mapInArrow(function, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def most_frequent(counts: DataFrame, at_most: int) -> list[Row]:
    """token and n of about at_most tokens, those of the largest n, ascending by token. counts: token and n.

    Only these come to the driver: an ORDER BY with a limit would send it that many rows from each partition. Where the bound falls among tokens of one n, those stay
    whose last 16 bits are small enough; tokens are hashes, so that is a share of them.
    """
    counts, cut_at, share, left = cut(counts), 0, 1 << 16, at_most
    for n, k in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        if k > left:
            cut_at, share = n, (left << 16) // k
            break
        left -= k
    return sorted(counts.where((F.col("n") > cut_at) | ((F.col("n") == cut_at) & (F.pmod("token", F.lit(1 << 16)) < share))).select("token", "n").collect())


def _frequent(texts: DataFrame, words: int, alike: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many texts have, ascending, and how many of a sample do (where these are too few to tell, a share by all texts). texts: t, text."""
    every = max(1, texts.count() // SAMPLE_ROWS)

    def tokens(batches):
        for batch in batches:
            own = [shingles(x.as_py() or b"", words) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], ["token"])

    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).select("text")
    often = _map(some, tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = most_frequent(often, FREQUENT)
    frequent, counts = np.array([r.token for r in rows], np.int64), np.array([r.n for r in rows], np.float64)

    def ahead(batches):
        for batch in batches:
            first: dict[bytes, int] = {}
            for k, t in enumerate(batch.column(0).to_pylist()):
                first.setdefault(t, k)  # copies within a batch count once; others only move tokens further back
            own = [prefix(shingles(batch.column(1)[k].as_py() or b"", words), alike, frequent, counts, 1)[0] for k in first.values()]
            tokens = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[np.isin(tokens, frequent, invert=True)])], ["token"])

    many = _map(texts, ahead, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    moved = most_frequent(many, MOVED)
    tokens = np.concatenate([frequent, np.array([r.token for r in moved], np.int64)])
    counts = np.concatenate([counts, np.array([r.n / every for r in moved], np.float64)])
    order = np.argsort(tokens)
    return tokens[order], counts[order]


class TextSets:
    """The different texts of a table as sets. any_id tells rows apart as well as it can, so that a text's copies needn't meet."""

    def __init__(self, docs: DataFrame, text: str = "text", any_id: str | None = None, words: int = WORDS, alike: str = ALIKE, folded: Column | None = None):
        """folded: the text whose words count, lower-cased as a rule."""
        self.words, self.alike = words, Fraction(alike)
        self.rows = docs.select(digest(F.col(text)).alias("t"), (F.col(any_id).cast("string") if any_id else F.lit(None).cast("string")).alias("i"), (F.lower(text) if folded is None else folded).cast("binary").alias("text"))
        frequent, counts = _frequent(self.rows.select("t", "text"), words, self.alike)
        alike_, words_ = self.alike, words

        def signed(batches):
            for batch in batches:
                first: dict[bytes, int] = {}
                for k, t in enumerate(batch.column(0).to_pylist()):
                    first.setdefault(t, k)  # copies within a batch are read once
                sizes, prefixes, weights = [], [], []
                for k in first.values():
                    own = shingles(batch.column(2)[k].as_py() or b"", words_)
                    sizes.append(len(own))
                    tokens, weight = prefix(own, alike_, frequent, counts)
                    prefixes.append(tokens)
                    weights.append(weight)
                pick = pa.array(list(first.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(sizes, pa.int32()), pa.array(weights, pa.int64()), _lists(prefixes)], ["t", "i", "n", "weight", "prefix"])

        marked = _map(self.rows, signed, "t binary, i string, n int, weight long, prefix array<long>")
        one = marked.groupBy("t").agg(F.min("i").alias("i"), F.any_value("n").alias("n"), F.any_value("weight").alias("weight"), F.any_value("prefix").alias("prefix"))
        #: s (a number of the text's own), t, i (the smallest of its rows'), n, weight and prefix.
        self.sets = cut(one.withColumn("s", F.monotonically_increasing_id()))

    def lists(self) -> DataFrame:
        """token, s, n and pos (the token's place in the prefix) of every prefix token that several sets have, with pivot, the one of them whose prefix is the least its own."""
        rows = self.sets.select("s", "n", "weight", F.posexplode("prefix").alias("pos", "token"))
        central = F.shiftleft("weight", _PLACES) + F.col("s")  # one long, so that the aggregation stays one of hashes
        several = rows.groupBy("token").agg(F.count("*").alias("many"), F.max(central).alias("pivot")).where("many > 1")
        return rows.drop("weight").join(several.select("token", F.col("pivot").bitwiseAND(F.lit((1 << _PLACES) - 1)).alias("pivot")), "token")

    def near(self, x: Column, y: Column) -> Column:
        """Whether sets of x and y tokens can be alike."""
        return (F.least(x, y) * F.lit(self.alike.denominator)) >= (F.greatest(x, y) * F.lit(self.alike.numerator))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of different pairs (a, b) of numbers those that are alike, with shared and total, the sizes of intersection and union."""
        texts, tokens = self._texts, self._tokens
        # of a pair, the text of b is fetched with the pair and travels as tokens to the one of a, which many pairs may share
        own = tokens(texts(pairs.join(self.sets.select(F.col("s").alias("b"), "t", F.col("i").alias("own")), "b").select("a", "b", "t", "own")), "a long, b long", "y")
        shared = tokens(texts(self.sets.join(pairs.select(F.col("a").alias("s")).distinct(), "s").select(F.col("s").alias("a"), "t", F.col("i").alias("own"))), "a long", "x").distinct()
        both = own.join(shared, "a").withColumn("shared", F.size(F.array_intersect("x", "y"))).withColumn("total", F.size("x") + F.size("y") - F.col("shared"))
        return both.where(F.col("shared") * F.lit(self.alike.denominator) >= F.col("total") * F.lit(self.alike.numerator)).select("a", "b", "shared", "total").distinct()

    def _by_centres(self, pairs: DataFrame) -> DataFrame:
        """What verified gives, for pairs that form crowds: whole sets travel once for each text and centre, pairs carry what differs from their centre.

        The centre c of a pair is the smallest partner of a, or a itself. Whatever c is, a and b differ in just the tokens in which one of them alone differs from c, so the
        sizes of both sets and of these differences give those of intersection and union.
        """
        centres = pairs.select(F.col("a").alias("s"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("s"), F.col("a").alias("o"))).groupBy("s").agg(F.min("o").alias("o"))
        centred = cut(pairs.join(centres.select(F.col("s").alias("a"), F.least("s", "o").alias("c")), "a").select("a", "b", "c"))
        about = cut(centred.select(F.col("a").alias("s"), "c").unionByName(centred.select(F.col("b").alias("s"), "c")).distinct())
        named = about.select("s", F.lit(False).alias("central")).unionByName(about.select(F.col("c").alias("s"), F.lit(True).alias("central"))).groupBy("s").agg(F.max("central").alias("central"))
        sets = cut(self._tokens(self._texts(self.sets.join(named, "s").select("s", "central", "t", F.col("i").alias("own"))), "s long, central boolean", "x"))
        differ = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
        ways = about.join(sets, "s").join(sets.where("central").select(F.col("s").alias("c"), F.col("x").alias("y")), "c").select("s", "c", F.size("x").alias("n"), differ.alias("d"))
        ways = cut(ways)
        ends = [ways.select(F.col("s").alias(s), "c", F.col("n").alias(f"n_{s}"), F.col("d").alias(f"d_{s}")) for s in ("a", "b")]
        both = centred.join(ends[0], ["a", "c"]).join(ends[1], ["b", "c"])
        apart = F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))
        both = both.withColumn("shared", ((F.col("n_a") + F.col("n_b") - apart) / 2).cast("int")).withColumn("total", F.col("n_a") + F.col("n_b") - F.col("shared"))
        return both.where(F.col("shared") * F.lit(self.alike.denominator) >= F.col("total") * F.lit(self.alike.numerator)).select("a", "b", "shared", "total").distinct()

    def _texts(self, named: DataFrame) -> DataFrame:
        """named (with t and own, a text's digest and one of its rows' id) with the text instead."""
        return self.rows.join(named, self.rows["i"].eqNullSafe(named["own"]) & (self.rows["t"] == named["t"])).select(*[named[c] for c in named.columns if c not in ("t", "own")], "text")

    def _tokens(self, named: DataFrame, schema: str, out: str) -> DataFrame:
        """named with the text's tokens instead of the text. Repeated rows of a task give one row."""
        words = self.words

        def made(batches):
            seen: set[tuple] = set()
            for batch in batches:
                keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
                fresh = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
                arrays = [shingles(batch.column(batch.num_columns - 1)[k].as_py() or b"", words) for k in fresh]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(fresh, pa.int64())) for c in batch.columns[:-1]), _lists(arrays)], [*batch.schema.names[:-1], out])

        return _map(named, made, f"{schema}, {out} array<long>")

    def pairs(self) -> DataFrame:
        """All pairs of different texts that are alike: their digests t1 and t2, shared and total."""
        rows = self.sets.select("s", "n", F.posexplode("prefix").alias("pos", "token"))
        lists = cut(rows.join(rows.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token"), "token").select("token", "s", "n", "pos"))
        left, right = lists.select("token", F.col("s").alias("a"), F.col("n").alias("x"), F.col("pos").alias("i")), lists.select("token", F.col("s").alias("b"), F.col("n").alias("y"), F.col("pos").alias("j"))
        met = left.join(right, "token").where((F.col("a") < F.col("b")) & self.near(F.col("x"), F.col("y")) & self._leads()).select("a", "b").distinct()
        found = self._by_centres(cut(self._hopeful(cut(met))))
        names = self.sets.select("s", "t")
        return found.join(names.select(F.col("s").alias("a"), F.col("t").alias("t1")), "a").join(names.select(F.col("s").alias("b"), F.col("t").alias("t2")), "b").select("t1", "t2", "shared", "total")

    def links(self, known: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) of numbers that are alike and connect all that pairs that are alike connect. known: pairs to be tried as well."""
        lists = cut(self.lists())
        stars = lists.where("s <> pivot").select(F.col("pivot").alias("a"), F.col("s").alias("b")).distinct()
        if known is not None:
            stars = stars.unionByName(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        found = cut(self.verified(cut(self._of_like_size(stars))).select("a", "b"))
        mixed = self._mixed(lists.select("token", "s", "n", "pos"), found)
        # all pairs of one text outside the list's largest part and any text of another part
        outside = mixed.where("root <> main").select("token", F.col("s").alias("a"), F.col("n").alias("x"), F.col("pos").alias("i"), F.col("root").alias("r"))
        inside = mixed.select("token", F.col("s").alias("b"), F.col("n").alias("y"), F.col("pos").alias("j"), F.col("root").alias("q"), (F.col("root") == F.col("main")).alias("within"))
        met = outside.join(inside, "token").where((F.col("r") != F.col("q")) & (F.col("within") | (F.col("a") < F.col("b"))) & self.near(F.col("x"), F.col("y")) & self._leads())
        rest = cut(self._hopeful(cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())))
        return found.unionByName(self.verified(rest).select("a", "b"))

    def _mixed(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """Rows of the lists in which several parts that found connects meet, with root, their part, and main, the list's largest part."""
        own = lists.join(component_labels(found).withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
        parts = own.groupBy("token", "root").agg(F.count("*").alias("k"))
        main = parts.groupBy("token").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.count("*").alias("n_parts")).where("n_parts > 1").select("token", "main")
        return cut(own.join(main, "token"))

    def _leads(self) -> Column:
        """Whether a common token (place i of x tokens, place j of y tokens) can be the first one that two sets share which are alike.

        Such sets share at least t / (1 + t) (x + y) tokens. Both have theirs in the same order, so all of them stand at the first one's places or behind.
        """
        t = self.alike
        return F.least(F.col("x") - F.col("i"), F.col("y") - F.col("j")) * (t.numerator + t.denominator) >= (F.col("x") + F.col("y")) * t.numerator

    def _hopeful(self, pairs: DataFrame) -> DataFrame:
        """Of different pairs (a, b) those whose prefixes share enough tokens for the sets to be alike.

        Of two sets, the one whose prefix ends first in the order shares with the other its common prefix tokens and at most all that stands behind its prefix.
        Prefixes are compared by four bytes of each token: tokens that differ may look alike, so no pair is ruled out that whole tokens would keep.
        """
        t = self.alike
        behind = lambda n: F.floor((n * t.numerator + (t.denominator - 1)) / t.denominator) - 1
        brief = F.transform("prefix", lambda x: (F.pmod(x, F.lit(1 << 32)) - (1 << 31)).cast("int"))
        ends = [self.sets.select(F.col("s").alias(s), F.col("n").alias(n), F.size("prefix").alias(f"k{s}"), brief.alias(f"p{s}")) for s, n in (("a", "x"), ("b", "y"))]
        both = pairs.join(ends[0], "a").join(ends[1], "b")
        common = F.least(F.col("ka") - F.size(F.array_except("pa", "pb")), F.col("kb") - F.size(F.array_except("pb", "pa")))
        most = common + F.greatest(behind(F.col("x")), behind(F.col("y")))
        return both.where(most * (t.numerator + t.denominator) >= (F.col("x") + F.col("y")) * t.numerator).select("a", "b")

    def _of_like_size(self, pairs: DataFrame) -> DataFrame:
        ends = self.sets.select(F.col("s").alias("a"), F.col("n").alias("x")), self.sets.select(F.col("s").alias("b"), F.col("n").alias("y"))
        return pairs.join(ends[0], "a").join(ends[1], "b").where(self.near(F.col("x"), F.col("y"))).select("a", "b")

    def groups(self, known: DataFrame | None = None) -> DataFrame:
        """t and root of every text: texts that chains of pairs that are alike connect have one root, the smallest t of them."""
        labels = component_labels(self.links(known)).withColumnRenamed("node", "s")
        rooted = cut(self.sets.select("s", "t").join(labels, "s", "left").withColumn("root", F.coalesce("root", "s")))
        least = rooted.groupBy("root").agg(F.min("t").alias("first"))
        return rooted.join(least, "root").select("t", F.col("first").alias("root"))


def digest(text: Column) -> Column:
    """What tells texts apart: the MD5 of the text, null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def set_pairs(sets: DataFrame, key: str, tokens: str, alike: str, block: list[str] | None = None) -> DataFrame:
    """All pairs a < b of keys of a block whose token arrays have a Jaccard similarity of at least alike, with shared and total. Keys are unique.

    For short sets, in columns only: tokens are ordered by how many sets of the block have them, each set keeps the prefix that must hold a common one,
    prefixes are joined under the length filter, and pairs are verified on whole sets. Empty sets are in no pair.
    """
    block, least = block or [], Fraction(alike)
    own = cut(sets.select(*block, F.col(key).alias("a"), F.array_distinct(tokens).alias("x")).where(F.size("x") > 0))
    each = own.select(*block, "a", F.size("x").alias("n"), F.explode("x").alias("token"))
    counts = each.groupBy(*block, "token").agg(F.count("*").alias("k"))
    ordered = each.join(counts, [*block, "token"]).groupBy(*block, "a", "n").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * least.numerator / least.denominator - 1e-9).cast("int") + 1
    lists = cut(ordered.select(*block, "a", "n", F.explode(F.slice("o", F.lit(1), keep)).alias("o")).where("o.k > 1").select(*block, "a", "n", F.col("o.token").alias("token")))
    near = (F.least("n", "m") * F.lit(least.denominator)) >= (F.greatest("n", "m") * F.lit(least.numerator))
    met = lists.join(lists.withColumnsRenamed({"a": "b", "n": "m"}), [*block, "token"]).where((F.col("a") < F.col("b")) & near).select(*block, "a", "b").distinct()
    both = met.join(own, [*block, "a"]).join(own.withColumnsRenamed({"a": "b", "x": "y"}), [*block, "b"])
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y"))).withColumn("total", F.size("x") + F.size("y") - F.col("shared"))
    return both.where(F.col("shared") * F.lit(least.denominator) >= F.col("total") * F.lit(least.numerator)).select(*block, "a", "b", "shared", "total")
