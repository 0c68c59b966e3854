"""Fuzzy quotes against alignment of every quote with every text."""

import random

from verilane.operators import fuzzy


def plain(quote, text):
    """Word edits between quote and its best run of text, by the whole table."""
    row = list(range(len(quote) + 1))
    best = row[-1]
    for word in text:
        new = [0]
        for i, own in enumerate(quote, 1):
            new.append(min(row[i - 1] + (own != word), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_every_pair(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    quotes = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 12, 25])))) for k in range(30)] + [(90, None), (91, " "), (92, "w1 w1 w1 w1 w1 w1 w1 w1")]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for k in range(20)]
    for k in range(20, 70):
        own = rng.choice([q for _, q in quotes[:30]]).split()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = rng.choice([[], ["new"], [rng.choice(words)]])
        texts.append((k, "Before  the " + " ".join(own).upper() + "\nafter it"))
    texts += [(100, None), (101, ""), (102, "w1 w1 w1 w1 w1 x w1 w1 w1"), (103, "w1")]
    got = {(r.q, r.t): r.edits for r in fuzzy.fuzzy_quotes(spark.createDataFrame(quotes, "q int, a string"), spark.createDataFrame(texts, "t int, b string").repartition(3), "q", "t", "a", "b").collect()}
    want = {}
    for q, a in quotes:
        own = (a or "").lower().split()
        grams = {tuple(own[k : k + 3]) for k in range(len(own) - 2)} or {tuple(own)}
        most = max(0, min(int(len(own) * 0.2 + 1e-9), (len(grams) - 1) // 3))
        for t, b in texts:
            text = (b or "").lower().split()
            if own and text and plain(own, text) <= most:
                want[q, t] = plain(own, text)
    assert got == want and any(want.values())
    for q, t in list(want)[:20]:
        assert fuzzy.edit_distance(dict(quotes)[q].lower().split(), dict(texts)[t].lower().split())[0] == want[q, t]
