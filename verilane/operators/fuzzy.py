"""Quotes that texts hold with some words changed, added or left out, among all texts.

A quote of n words is held with k edits if some run of a text's words is k word insertions, deletions and replacements away from it. Seeds: an edit touches at most
GRAM of the quote's word GRAM-grams, so of its d different ones at least d - GRAM k stand in the text as they are. With k at most (d - 1) / GRAM that is one or
more: all grams of all quotes are looked for in one scan of the texts, and only pairs that share enough of them are aligned. The bound loses no pair.

Alignment is word by word, the text's beginning and end free, a row of the table at a time in numpy. Quotes of fewer than GRAM words must be held as they are. Words
are runs of characters other than white space of the lower-cased text. A null or empty quote or text is in no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import occurrences

GRAM = 3


def edit_distance(quote: list[str], text: list[str]) -> tuple[int, int]:
    """The fewest word edits between quote and a run of text, and where the first run with so few ends (as a number of words of text)."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(quote))}
    own, steps = np.array([ids[w] for w in quote]), np.arange(len(quote) + 1)
    row = steps.copy()  # row[i]: edits between the first i words of the quote and the best run that ends here
    best, at = int(row[-1]), 0
    for k, word in enumerate(text, 1):
        swapped = row[:-1] + (own != ids.get(word, -1))
        row = np.concatenate([[0], np.minimum(swapped, row[1:] + 1)])
        row = np.minimum.accumulate(row - steps) + steps  # words of the quote left out
        if row[-1] < best:
            best, at = int(row[-1]), k
    return best, at


def _aligned(batches):
    for batch in batches:
        edits, ends = [], []
        for quote, text in zip(batch.column(2), batch.column(3), strict=True):
            found = edit_distance(quote.as_py().split(" "), text.as_py().split(" "))
            edits.append(found[0])
            ends.append(found[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(edits, pa.int32()), pa.array(ends, pa.int32())], ["_q", "_t", "most", "edits", "end"])


def fuzzy_quotes(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str, quote: str, text: str, share: float = 0.2) -> DataFrame:
    """quote_key, text_key, words (of the quote), edits and end of every quote that a text holds with at most share of its words edited (and at most what the seeds can prove)."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    own = quotes.select(F.col(quote_key).alias("_q"), flat(quote).alias("_quote")).where("_quote <> ''").withColumn("_w", F.split("_quote", " "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - GRAM + 1), lambda i: F.array_join(F.slice("_w", i, F.lit(GRAM)), " ")))
    own = own.withColumn("_grams", F.when(F.size("_w") >= GRAM, grams).otherwise(F.array("_quote")))
    most = F.least(F.floor(F.size("_w") * share + 1e-9), F.floor((F.size("_grams") - 1) / GRAM)).cast("int")
    own = own.withColumn("most", F.greatest(most, F.lit(0))).withColumn("_need", F.size("_grams") - GRAM * F.col("most"))
    held = texts.select(F.col(text_key).alias("_t"), flat(text).alias("_text")).where("_text <> ''")
    each = own.select("_q", "_need", F.explode("_grams").alias("_gram"))
    # grams are found as substrings too, which only adds candidates
    met = occurrences(each.select("_gram"), held, "_t", "_gram", "_text").join(each, "_gram").groupBy("_q", "_t", "_need").agg(F.countDistinct("_gram").alias("_n")).where("_n >= _need")
    pairs = met.select("_q", "_t").join(own.select("_q", "_quote", "most"), "_q").join(held, "_t").select("_q", "_t", "_quote", "_text", "most")
    kinds = dict(pairs.dtypes)
    found = pairs.mapInArrow(_aligned, f"_q {kinds['_q']}, _t {kinds['_t']}, most int, edits int, end int").where("edits <= most")
    words = own.select("_q", F.size("_w").alias("words"))
    return found.join(words, "_q").select(F.col("_q").alias(quote_key), F.col("_t").alias(text_key), "words", "edits", "end")
