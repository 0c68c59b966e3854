"""Readers, sinks, streams, the claims chain and operators that need more than one table."""

import json

import pytest
from pyspark.sql import functions as F

from verilane.functions import recover, rules, similarity, text
from verilane.operators import claims as verbs
from verilane.operators import passages
from verilane.operators import relational as rel
from verilane.operators import screening
from verilane.plans import fixtures
from verilane.sources import readers, session, sinks
from verilane.streaming import verdicts


def test_every_status_has_a_color_and_a_lane(spark):
    rows = spark.createDataFrame([(s,) for s in rules.STATUSES], "s string")
    out = rows.select(rules.color(F.col("s"), F.lit("supported"), F.lit("VERBATIM")), rules.lane(F.col("s"), F.lit(None), F.lit(""))).collect()
    assert all(c in sinks.LANES and lane in sinks.LANES for c, lane in out)


def test_score_without_court_or_year_moves_its_weight(spark):
    w = {k: c.alias(k) for k, c in rules.weights(F.lit(None).cast("string"), F.lit(None).cast("int")).items()}
    row = spark.range(1).select(*w.values()).first()
    assert abs(sum(row) - 1) < 1e-9 and abs(row["name"] - 0.8333) < 1e-4


def test_name_similarity_and_ratio(spark):
    out = {(r.a, r.b): r.similarity for r in fixtures.name_similarity_4f(spark, "").collect()}
    assert out["Fink v. Gomez", "David M. Fink v. James H. Gomez, Director"] == 0.85
    assert out["In re Wright", "In re Wright, Minors"] < 0.85 and out["Smith v. Jones", "Brown v. Board"] < 0.4 and out["", "x"] == 0
    frame = spark.createDataFrame([("abcd", "bcde")], "a string, b string")
    assert frame.select(similarity.seq_ratio(F.col("a"), F.col("b"))).first()[0] == 0.75
    assert str(frame.withColumn("u", similarity.seq_ratio(F.col("a"), F.col("b"))).where("u > 0.1")._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1


def test_quotes(spark):
    text = "The court held that the law is entirely clear on this point. Nothing else follows."
    rows = [("the law is entirely clear", "VERBATIM"), ("the law was entirely clear on this point", "CLOSE"), ("pigs may fly over distant quiet mountains", "FABRICATED")]
    frame = spark.createDataFrame([(q, text, want) for q, want in rows], "q string, t string, want string")
    out = frame.select("want", similarity.verify_quote(F.col("q"), F.col("t")).alias("v")).collect()
    assert all(r.v.result == r.want for r in out) and out[0].v.similarity == 1.0


def test_quoted_spans_keep_their_digits(spark):
    frame = spark.createDataFrame([('say " two words " and "1 is the one" and "one"',), (None,)], "t string")
    assert [r.s for r in frame.select(text.quoted_spans(F.col("t")).alias("s")).collect()] == [["two words", "1 is the one"], []]


def test_merge_takes_the_last_row_whatever_the_layout(spark):
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.range(500).select((F.col("id") % 40).alias("k"), F.col("id").alias("ord"))
    want = {(k, k + 40 * ((499 - k) // 40) if k < 40 else None) for k in range(50)}
    assert {tuple(r) for r in rel.merge_last_wins(left, right, "k", ["ord"]).select("k", "ord").collect()} == want
    assert rel.merge_last_wins(left, right.repartition(7, "ord"), "k", ["ord"]).count() == 50


def test_passages_with_short_and_missing_words(spark):
    needles = spark.createDataFrame([(1, "b c d e f"), (2, "xyz"), (3, "q b c d e fgh"), (4, "")], "i int, needle string")
    texts = spark.createDataFrame([(1, "ab c d e fg"), (2, "wxyz"), (3, "q b c d e fghi"), (4, "")], "t int, haystack string")
    assert {(r.i, r.t) for r in passages.passages_in(needles, texts).collect()} == {(1, 1), (2, 2), (3, 3), (1, 3)}


def test_leave_one_out_against_a_loop(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(rng.choice("abc"), float(rng.choice([1, 2, 3, 4, 5, 90, rng.randint(1, 50)]))) for _ in range(120)] + [("d", 1.0), ("d", 2.0), ("e", 5.0), ("e", 5.0), ("e", 9.0)]
    out = {r.c: (r.n, r.n_tail) for r in screening.leave_one_out(spark.createDataFrame(rows, "c string, x double"), ["c"], "x").collect()}
    want = {}
    for cell in {c for c, _ in rows}:
        own = [x for c, x in rows if c == cell]
        if len(own) < 3:
            continue
        tail = 0
        for k, x in enumerate(own):
            rest = own[:k] + own[k + 1 :]
            med = statistics.median(rest)
            mad = statistics.median([abs(y - med) for y in rest])
            tail += mad > 0 and abs((x - med) / (1.4826 * mad)) >= 3.5
        want[cell] = (len(own), tail)
    assert out == want


def test_claims_chain(spark):
    claims = spark.createDataFrame([
        ("m-01", "Roe v. Doe, 5 F.3d 10, 12 (2d Cir. 1999)", '["the law is clear"]'), ("m-02", "Lee v. Poe, 7 F.3d 1 (9th Cir. 2000)", "[]"), ("m-03", "Nobody v. None, 1 U.S. 1 (1800)", '["x y"]'),
    ], "claim_id string, cited_case string, quoted_text string")
    results = spark.createDataFrame([
        (1, "Roe v. Doe, 5 F.3d 10 (2d Cir. 1999)", "NOT_FOUND", "", "", "", "", ""), (2, "Roe v. Doe, 5 F.3d 10 (2d Cir. 1999)", "VERIFIED", "https://x/opinion/1/roe-v-doe/", "Roe v. Doe", "Second", "ca2", ""),
        (3, "Lee v. Poe, 7 F.3d 1 (9th Cir. 2000)", "VERIFIED", "https://x/2/lee-v-poe/", "Lee v. Poe", "Second Circuit", "ca2", ""), (4, "Nobody v. None, 1 U.S. 1 (1800)", "NOT_FOUND", "", "", "", "", ""),
    ], "ord int, citation string, status string, cl_url string, matched_name string, matched_court string, matched_court_id string, syllabus string")
    files = spark.createDataFrame([("Roe_v_Doe.txt", 1), ("Lee_v_Poe.txt", 2)], "file string, ord int")
    opinions = spark.createDataFrame([("opinions/Roe_v_Doe.txt", "<p>So the   law is clear.</p>", False), ("opinions/Lee_v_Poe.txt", "Text", False)], "opinion_file string, body string, was_ocrd boolean")
    lists = spark.createDataFrame([(1, "Roe v. Doe, 5 F.3d 10"), (2, "Roe v. Doe, 55 F.3d 10")], "ord int, line string")
    courts = spark.createDataFrame([("2d Cir.", "ca2"), ("9th Cir.", "ca9")], "abbrev string, id string")
    given = spark.createDataFrame([(1, "m-01", "v1", "partial"), (2, "m-01", "v1", "supported"), (3, "m-02", "v1", "bogus")], "line int, claim_id string, prompt_version string, support string")
    out = {r.claim_id: r for r in verbs.full(claims, results, files, opinions, lists, courts, given, "v1").collect()}
    one, two, three = (out[f"m-0{k}"] for k in (1, 2, 3))
    assert (one.cl_status, one.opinion_file, one.quote_check_worst, one.quote_floor, one.triage_track, one.lane) == ("VERIFIED", "opinions/Roe_v_Doe.txt", "VERBATIM", "", "full", "Green")
    assert json.loads(one.crosscheck_flags) == {"toa_mismatch": {"variants": ["Roe v. Doe, 5 F.3d 10", "Roe v. Doe, 55 F.3d 10"]}}
    assert json.loads(two.crosscheck_flags)["court_mismatch"]["matched_id"] == "ca2" and two.assessment is None and two.lane == "Yellow" and two.quote_check_worst == "NO_QUOTES"
    assert (three.opinion_file, three.quote_check_worst, three.triage_track, three.lane, three.badge) == ("", "NO_OPINION", "", "Gray", "")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('citation,note\n"Roe, ""x"" v. Doe", \n,b\n')
    rows = readers.read_csv(spark, str(tmp_path / "c.csv"), ["citation"]).collect()
    assert [tuple(r) for r in rows] == [('Roe, "x" v. Doe', None), (None, "b")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "c.csv"), ["absent"])
    (tmp_path / "l.txt").write_text("# head\n\n a \nb\n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    (tmp_path / "v.jsonl").write_text('{"claim_id":"c1","prompt_version":"v1","fields":{"support":"partial"}}\n\nbroken\n')
    verdict = readers.read_verdicts(spark, str(tmp_path / "v.jsonl")).collect()
    assert len(verdict) == 1 and verdict[0].cost_usd == 0 and verdict[0].fields["support"] == "partial"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.html").write_text("<p>x&nbsp;y</p>")
    (tmp_path / "docs/b.pdf").write_bytes(b"%PDF")
    by = {r.file.rsplit("/", 1)[1]: (r.body, r.error) for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert by == {"a.html": ("x y", None), "b.pdf": (None, "unsupported file type: pdf")}
    sinks.write_csv(spark.createDataFrame([(1, ["a", "b"], None)], "i int, w array<string>, n string"), str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out")).first().w == "a; b"
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in sinks.merged_manifest(old, new, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    names = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "base string, o int")
    assert [r.name for r in sinks.distinct_names(names, "base", ["o"]).orderBy("o").collect()] == ["x", "x (2)", "y"]
    calls, recorded = spark.createDataFrame([("k1",)], "call_key string"), spark.createDataFrame([("k1", "r")], "call_key string, response string")
    assert readers.replay(calls, recorded).first().response == "r"
    with pytest.raises(Exception, match="no recorded response"):
        readers.replay(calls, recorded.limit(0)).collect()
    page = sinks.report_html(spark.createDataFrame([("c1", "A & B", "Red", "bad")], "claim_id string, cited_case string, lane string, badge string"), "T")
    assert "A &amp; B" in page and "Red (1)" in page


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, rows in enumerate(([(1, "c1", "partial"), (2, "c1", "supported")], [(3, "c2", "partial"), (4, "c1", "unsupported")])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"claim_id": c, "prompt_version": "v1", "support": s, "line": n}) for n, c, s in rows))
        verdicts.last_verdicts(verdicts.verdict_stream(spark, str(source)), str(tmp_path / "ck"), target).awaitTermination()
    assert {(r.claim_id, r.support) for r in verdicts.current(spark, target).collect()} == {("c1", "unsupported"), ("c2", "partial")}
    events = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value")
    assert verdicts.windowed_counts(events).first().n == 1



def test_strict_names_and_guarded_positions(spark):
    rows = [("Smith v. Jones", "Jones", "Smith v. Jones", True), ("Smith v. Jones", "Jones", "Smith v. Quackenbush", False), ("In re Doe", None, "In re Doe", True), (None, None, "X v. Y", True), ("Smith v. Jones", "Jones", None, False)]
    frame = spark.createDataFrame(rows, "n string, d string, c string, want boolean")
    assert all(r.got == r.want for r in frame.withColumn("got", similarity.strict_name_match(F.col("n"), F.col("d"), F.col("c"))).collect())
    left, right = spark.createDataFrame([(1, "a"), (2, None)], "o int, k string"), spark.createDataFrame([(1, "a", 5), (2, None, 6)], "o int, j string, v int")
    assert {tuple(r) for r in rel.positional_join(left, right, "o", {"k": "j"}).select("o", "k", "v").collect()} == {(1, "a", 5), (2, None, 6)}
    shifted = spark.createDataFrame([(1, "b", 5), (2, None, 6)], "o int, j string, v int")
    for other in (shifted, right.where("o = 1"), right.unionByName(right)):
        with pytest.raises(Exception, match="don't agree at place"):
            rel.positional_join(left, other, "o", {"k": "j"}).collect()


def test_cells_stamps_rows_and_appends(spark, tmp_path, monkeypatch):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("body a")
    (tmp_path / "m.jsonl").write_text('{"slug":"a","n":1}\n{"slug":"lost","n":2}\n')
    assert [(r.slug, r.n, r.body) for r in readers.read_cells(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "texts")).collect()] == [("a", 1, "body a")]
    for n in (1, 2):
        sinks.write_ndjson(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "nd"))
        sinks.stamp(spark, str(tmp_path / "log"), "merge", rows=n)
    assert {r.n for r in spark.read.json(str(tmp_path / "nd")).collect()} == {1, 2}
    assert {(r.verb, r.counts["rows"]) for r in spark.read.json(str(tmp_path / "log")).collect()} == {("merge", 1), ("merge", 2)}
    assert sinks.json_rows(spark.createDataFrame([(1, "x")], "a int, b string")).first().value == '{"a":1,"b":"x"}'
    old, new = spark.createDataFrame([("c1", "v1")], "c string, v string"), spark.createDataFrame([(1, "c1", "v1"), (3, "c2", "v1"), (2, "c2", "v1"), (4, "c1", "v2")], "o int, c string, v string")
    assert {r.o for r in rel.append_new(old, new, ["c", "v"], "o").collect()} == {2, 4}
    result = spark.sql("SELECT 'A v. B' AS citation, 'VERIFIED' AS status, 7L AS cluster_id, CAST(NULL AS BIGINT) AS docket_id, '/o/7' AS url, CAST(NULL AS STRING) AS matched_name, 'ca2' AS court, 1999 AS year, CAST(NULL AS DOUBLE) AS score, array(struct('info' AS category, 'm' AS message)) AS diagnostics")
    row = sinks.result_rows(result)
    assert row.columns == sinks.RESULT_COLUMNS and tuple(row.first()) == ("A v. B", "VERIFIED", "7", "", "/o/7", "", "ca2", "1999", "0.0", '[{"category":"info","message":"m"}]')
    for _ in range(2):
        sinks.append_flags(result.select("citation", "status", F.lit("z").alias("other")), str(tmp_path / "flags"))
    flags = spark.read.csv(str(tmp_path / "flags"), header=True)
    assert flags.columns == sinks.FLAG_COLUMNS and flags.count() == 2 and flags.first().citation == "A v. B"
    monkeypatch.delenv(session.CACHE_VARIABLE, raising=False)
    assert session.cache_path() == session.CACHE_FILE and session.cache_path("/x/") == f"/x/{session.CACHE_FILE}"
    monkeypatch.setenv(session.CACHE_VARIABLE, "/y")
    assert session.cache_path() == f"/y/{session.CACHE_FILE}"


def test_json_repair():
    assert json.loads(recover.repaired('x {"a": "he said "no", and left", "b": [1, 2')) == {"a": 'he said "no", and left', "b": [1, 2]}
    assert recover.repaired("prose only") is None and recover.repaired(None) is None and recover.repaired("{bad}") is None and recover.repaired("{}") is None
    assert json.loads(recover.repaired('{"a": "cut in the midd')) == {"a": "cut in the midd"}
