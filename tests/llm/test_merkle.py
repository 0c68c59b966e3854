import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from verilane.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    by = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row, strict=True))
    return digest("".join("-" if by[f] is None else f"{len(str(by[f]).encode())}:{by[f]}" for f in merkle.FIELDS))


def plain_tree(leaves, fan):
    """The root, and for each leaf its steps of siblings before and after."""
    paths, level = [[] for _ in leaves], [(x, [k]) for k, x in enumerate(leaves)]
    while len(level) > 1:
        runs = [level[k : k + fan] for k in range(0, len(level), fan)]
        for run in runs:
            for k, (_, below) in enumerate(run):
                for leaf in below:
                    paths[leaf].append(("".join(x[0] for x in run[:k]), "".join(x[0] for x in run[k + 1 :])))
        level = [(digest("".join(x[0] for x in run)), [b for x in run for b in x[1]]) for run in runs]
    return level[0][0], paths


def plain(rows, fan):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(((row[0] is not None, row[0] or 0), plain_leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        own = sorted(groups[name], key=lambda x: x[:2])
        trees.append((own, *plain_tree([x[1] for x in own], fan)))
    root, tops = plain_tree([t[1] for t in trees], fan)
    return sorted(
        (str(x[2][0]), x[1], t[1], root, digest("".join(a + b for a, b in path + top)))
        for t, top in zip(trees, tops, strict=True) for x, path in zip(t[0], t[2], strict=True)
    )


def rows_of(n):
    out = [(k, f"Text {k}" if k % 7 else None, "en" if k % 3 else None, ("hot" if k % 3 == 0 else f"s{k % 5}"), k if k % 4 else None) for k in range(n)]
    out += [(1000, "", "", "", 0), (1001, "é漢" * 50, "zh", "ž", 100), (None, "no id", "en", "hot", 5), (None, None, None, None, None), (1002, "x" * 200_000, "en", None, 200_000), (3, "other text", "en", "hot", 10)]
    return out + [(6, "Twice", "en", "hot", 5)] * 40


@pytest.mark.parametrize("fan", [3, 16])
def test_equal_to_a_plain_tree(spark, fan):
    rows = rows_of(120)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit(1), "at": F.lit("clash"), "digest": F.lit("clash"), "_part": F.lit(0), "tags": F.create_map(F.lit("a"), F.lit(1))}).repartition(5)
    made = merkle.manifest(docs, fan=fan)
    got = sorted(tuple(str(x) for x in r) for r in made.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path"))).collect())
    assert got == plain(rows, fan)
    assert made.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert made.where(merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_the_query_equals_its_sql_and_finds_what_was_tampered_with(spark, tmp_path):
    spark.createDataFrame(rows_of(90), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = merkle.query(spark, str(tmp_path))
    want = con.execute(merkle.ORACLE_SQL)
    names = [x[0] for x in want.description]
    got = sorted((tuple(r) for r in found.select(*names).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    changed = {r.doc_id for r in found.where("not verified").collect()}
    assert changed and all(k is not None for k in changed)


@pytest.mark.parametrize("rows", [[], [(1, "alone", "en", "s", 5)], [(1, "a", "en", "s", 1), (2, "b", "en", "t", 1)]])
def test_empty_and_lone(spark, rows):
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(str(x) for x in r) for r in made.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path"))).collect())
    assert got == (plain(rows, 16) if rows else [])
