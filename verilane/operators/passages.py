"""Which texts hold which of many passages: one scan of the texts, whatever the number of passages.

Every passage gives one anchor, a piece of at most ANCHOR characters, to an Aho-Corasick automaton; a text is read once and each anchor found is
checked against the passages that it stands for, at its place. Of three pieces of a passage the one that the fewest passages share is its anchor.

Scale. Passages go to the driver and the automaton to every worker only while they are below CHARACTERS, which is counted first. Beyond that,
passages with an inner word (a whole word wherever the passage occurs) are joined to the texts' words by the longest of them, so neither side is held
in one place, and those without one are looked for by automata of CHARACTERS each. A worker builds an automaton once.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilane.sources.session import cut

ANCHOR, CHARACTERS = 32, 12 << 20
#: Passages themselves, which are checked at the places found, have at most this many characters.
HELD = 16 << 20
_BUILT: dict[str, tuple] = {}


def anchors(passages: list[str]) -> list[tuple[int, int]]:
    """Start and end of each passage's anchor."""
    spans = []
    for p in passages:
        n = min(len(p), ANCHOR)
        spans.append({(at, at + n) for at in (0, (len(p) - n) // 2, len(p) - n)})
    shared = Counter(p[a:b] for p, own in zip(passages, spans, strict=True) for a, b in own)
    return [min(own, key=lambda s, p=p: (shared[p[s[0] : s[1]]], s)) for p, own in zip(passages, spans, strict=True)]


def automaton(passages: list[str]) -> tuple[ahocorasick.Automaton, dict[int, list[tuple[int, int, int]]]]:
    """Anchors. One that is a whole passage and no other's anchor has that passage's number, so that short passages cost no object each; any other one
    a number from len(passages) on, of its size, its passages' numbers and where in them it begins."""
    by_anchor: dict[str, int | list[tuple[int, int, int]]] = {}
    for k, (a, b) in enumerate(anchors(passages)):
        word = passages[k][a:b]
        before = by_anchor.get(word)
        if before is None and b - a == len(passages[k]):
            by_anchor[word] = k
            continue
        own = before if isinstance(before, list) else [] if before is None else [(b - a, before, 0)]
        own.append((b - a, k, a))
        by_anchor[word] = own
    out, others = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
    for word, own in by_anchor.items():
        if isinstance(own, list):
            others[len(passages) + len(others)] = own
            own = len(passages) + len(others) - 1
        out.add_word(word, own)
    by_anchor.clear()
    out.make_automaton()
    return out, others


def first_places(machine: ahocorasick.Automaton, others: dict[int, list[tuple[int, int, int]]], passages: list[str], text: str) -> dict[int, int]:
    """By number, the place from 0 of the first occurrence of each passage that text holds."""
    found: dict[int, int] = {}
    for end, number in machine.iter(text):
        if number < len(passages):
            if number not in found:
                found[number] = end + 1 - len(passages[number])
            continue
        for size, k, offset in others[number]:
            if k not in found:
                start = end + 1 - size - offset
                if start >= 0 and text.startswith(passages[k], start):
                    found[k] = start
    return found


def _by_automaton(passages: DataFrame, texts: DataFrame, key: str, passage: str, text: str) -> DataFrame:
    spark = texts.sparkSession
    words = sorted(passages.toArrow().column(0).to_pylist())
    if not words:
        return texts.select(key, F.lit("").alias(passage), F.lit(1).alias("at")).limit(0)
    shared, name = spark.sparkContext.broadcast(words), uuid.uuid4().hex

    def find(batches):
        own = shared.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = (*automaton(own), own)
        for batch in batches:
            rows, numbers, places = [], [], []
            for k, x in enumerate(batch.column(1)):
                for number, at in first_places(*_BUILT[name], x.as_py() or "").items():
                    rows.append(k)
                    numbers.append(number)
                    places.append(at + 1)
            # the passages themselves, so that what is found needs no join
            held = pa.array([own[n] for n in numbers], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), held, pa.array(places, pa.int32())], [key, passage, "at"])

    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return texts.select(key, text).mapInArrow(find, f"{key} {dict(texts.dtypes)[key]}, {passage} string, at int")


def _by_word(passages: DataFrame, texts: DataFrame, key: str, passage: str, text: str) -> DataFrame:
    parts = F.split(F.col(passage), " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("_word"))
    candidates = words.join(passages.withColumn("_word", longest), "_word").select("_key", passage).distinct()  # a key may have several texts
    held = texts.select(key, text).join(candidates, F.col(key).eqNullSafe(F.col("_key")))
    return held.withColumn("at", F.expr(f"locate(`{passage}`, `{text}`)")).where("at > 0").select(key, passage, "at")


def occurrences(passages: DataFrame, texts: DataFrame, key: str, passage: str = "needle", text: str = "haystack", at_once: int = CHARACTERS, held: int = HELD) -> DataFrame:
    """key, passage and at, the place (from 1) of its first occurrence, for every different passage that a text holds.

    Nothing holds an empty or null passage, and a null text holds nothing. Texts are told apart by key; rows of one key each count.
    """
    different = passages.select(passage).where(F.length(passage) > 0).distinct()
    inner = F.size(F.split(F.col(passage), " ")) > 2
    size = F.sum(F.least(F.length(passage), F.lit(ANCHOR)))
    taken = {r["inner"]: r for r in different.groupBy(inner.alias("inner")).agg(size.alias("anchors"), F.sum(F.length(passage)).alias("all")).collect()}
    if sum(r["anchors"] for r in taken.values()) <= at_once and sum(r["all"] for r in taken.values()) <= held:
        return _by_automaton(different, texts, key, passage, text)
    # without passages of inner words the texts' words aren't read at all
    parts = [_by_word(different.where(inner), texts, key, passage, text)] if True in taken else []
    if False in taken:
        short, blocks = different.where(~inner), max(-(-taken[False]["anchors"] // at_once), -(-taken[False]["all"] // held))
        parts += [_by_automaton(short.where(F.pmod(F.xxhash64(passage), F.lit(blocks)) == block), texts, key, passage, text) for block in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def passages_in(passages: DataFrame, texts: DataFrame, passage: str = "needle", text: str = "haystack", key: str | None = None) -> DataFrame:
    """Pairs of rows in which a text holds a passage. key names a column of texts that tells them apart; without one they are numbered."""
    if key is None:
        return passages_in(passages, cut(texts.withColumn("_text_no", F.monotonically_increasing_id())), passage, text, "_text_no").drop("_text_no")
    found = occurrences(passages, texts, key, passage, text).select(F.col(key).alias("_key"), F.col(passage).alias("_passage")).distinct()
    held = texts.join(found, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(text).contains(F.col("_passage"))).drop("_key")
    return held.join(passages, F.col("_passage") == F.col(passage)).select(*texts.columns, *passages.columns)
