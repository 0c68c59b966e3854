"""Names in their context, passages, search parameters, stored results and guarded joins, with computing SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilane.functions import abbreviations, courts, recover, results, text
from verilane.operators import relational as rel
from verilane.sources import sinks

from .fixtures import Fixture
from .tables import T

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


_PHRASES = text.SIGNAL_PHRASES + text.PROCEDURAL_PHRASES + text.COURT_PHRASES
_LIST = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"


def _cleaned(c: str) -> str:
    out = f"trim({c})"
    for p in _PHRASES:
        out = f"regexp_replace({out}, '\\b{p.replace('.', '[.]')}\\b', '', 'gi')"
    out = f"regexp_replace(regexp_replace({out}, ',\\s*\\d+\\s+[A-Za-z.]+\\s+\\d+', '', 'g'), '\\[\\d+\\s+[A-Z]', '', 'g')"
    return f"trim(trim(regexp_replace({out}, '\\s+', ' ', 'g')), ' ,;:')"


_DIRTY_SQL = f"SELECT p_partkey, concat({_LIST}[p_partkey % 44 + 1], ' ', p_name, ' v. ', p_brand, CASE p_partkey % 3 WHEN 0 THEN ', 31 Wn.d 343' WHEN 1 THEN ' [21 U.S.' ELSE ' ;, ' END) AS dirty FROM part"


@query(f"SELECT p_partkey, {_cleaned('dirty')} AS clean FROM ({_DIRTY_SQL})")
def contamination_cleaner(spark, d):
    """Part names as parties, each with a listed phrase before it and a location, a bracket or punctuation after it."""
    k, own = F.col("p_partkey"), T(spark, d, "part")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (k % len(_PHRASES)).cast("int"))
    tail = F.when(k % 3 == 0, ", 31 Wn.d 343").when(k % 3 == 1, " [21 U.S.").otherwise(" ;, ")
    return own.select("p_partkey", text.without_contamination(F.concat(phrase, F.lit(" "), "p_name", F.lit(" v. "), "p_brand", tail)).alias("clean"))


_SHORT = list(abbreviations.SEARCH)
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_SHORT_SQL = "[" + ", ".join(map(_QUOTED, _SHORT)) + "]"
_TAIL_SQL = "CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN concat(chr(39), 'rs ') ELSE '.Co ' END"
_ABBREV_SQL = f"SELECT p_partkey, concat({_SHORT_SQL}[p_partkey % {len(_SHORT)} + 1], '. of ', p_name, ' v. ', upper({_SHORT_SQL}[p_partkey * 7 % {len(_SHORT)} + 1]), {_TAIL_SQL}, p_type) AS name FROM part"


def _written_out(c: str) -> str:
    for short, long in abbreviations.SEARCH.items():
        c = f"regexp_replace({c}, {_QUOTED(abbreviations.pattern(short))}, '{long}', 'gi')"
    return c


@query(f"SELECT p_partkey, {_written_out('name')} AS expanded FROM ({_ABBREV_SQL})")
def abbreviation_expansion(spark, d):
    """Part names between abbreviated parties: with a point, a plural after an apostrophe, or a word right after the point."""
    k, own = F.col("p_partkey"), F.array(*map(F.lit, _SHORT))
    at = lambda n: F.get(own, (n % len(_SHORT)).cast("int"))
    tail = F.when(k % 3 == 0, ".").when(k % 3 == 1, "'rs ").otherwise(".Co ")
    name = F.concat(at(k), F.lit(". of "), "p_name", F.lit(" v. "), F.upper(at(k * 7)), tail, "p_type")
    return T(spark, d, "part").select("p_partkey", abbreviations.written_out(name).alias("expanded"))


_NEAR = "CASE " + " ".join(f"WHEN strpos(after, '{p}') BETWEEN 1 AND 50 THEN strpos(after, '{p}') - 1" for p in text.PROCEDURAL_PHRASES + text.SIGNAL_PHRASES) + " END"
_CONTEXT_SQL = f"SELECT p_partkey, p_name AS name, concat('as ', p_name, ' (', p_brand, ') ', {_LIST}[p_partkey % 44 + 1], ' ', p_type) AS context FROM part"


@query(f"""SELECT p_partkey, {_cleaned("coalesce(substr(context, pos, length(name) + gap), name)")} AS shown FROM (SELECT *, {_NEAR} AS gap FROM (SELECT *, strpos(context, name) AS pos, lower(substr(context, strpos(context, name) + length(name), 100)) AS after FROM ({_CONTEXT_SQL})))""")
def name_in_context(spark, d):
    """Part names read on in a made-up context up to a listed phrase."""
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % len(_PHRASES)).cast("int"))
    context = F.concat(F.lit("as "), "p_name", F.lit(" ("), "p_brand", F.lit(") "), phrase, F.lit(" "), "p_type")
    return T(spark, d, "part").select("p_partkey", text.name_in_context(F.col("p_name"), context).alias("shown"))


@query("""WITH a AS (SELECT doc_id, text, length(text) AS n, greatest(length(text) // 2, 1) AS mid FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, greatest(mid - 80, 1) AS s, least(mid + 40 + 80, n + 1) AS e FROM a),
c AS (SELECT *, regexp_replace(substr(text, s, e - s), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS p FROM b),
f AS (SELECT *, CASE WHEN s > 1 AND strpos(p, '. ') BETWEEN 2 AND 80 THEN substr(p, strpos(p, '. ') + 2) ELSE p END AS q FROM c),
g AS (SELECT *, length(q) - length(regexp_extract(q, '^(?s:(.*))\\. ', 1)) - 1 AS behind, regexp_matches(q, '(?s)^.*\\. ') AS has FROM f)
SELECT doc_id, regexp_replace(CASE WHEN e <= n AND has AND behind < 79 AND length(q) - behind > 1 THEN left(q, length(q) - behind) ELSE q END, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS passage FROM g""".replace("\\\\", "\\"))
def sentence_passage(spark, d):
    """The sentences around forty characters in the middle of each document."""
    at = F.greatest(F.floor(F.length("text") / 2), F.lit(1))
    return T(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", text.sentence_passage(F.col("text"), at, F.lit(40)).alias("passage"))


_COURTS = [("2d Cir.", "ca2"), ("N.D. Cal.", "cand"), ("Bankr. S.D.N.Y.", "nysb"), ("Ind. Ct. App.", None), (None, None)]
_REPORTERS = [("F.3d", None), ("Cal. App. 4th", "cal"), ("N.E.2d", None), (None, None), ("Wash. 2d", "wash"), ("P.3d", None), ("Tex.", "tex")]
_pick = lambda rows, k: "[" + ", ".join("NULL" if r[k] is None else f"'{r[k]}'" for r in rows) + "]"


@query(f"""SELECT o_orderkey, coalesce({_pick(_COURTS, 1)}[o_orderkey % 5 + 1], {_pick(_REPORTERS, 1)}[o_orderkey % 7 + 1]) AS court_id, concat(year(o_orderdate) - 1, '-01-01') AS filed_after, concat(year(o_orderdate) + 1, '-12-31') AS filed_before FROM orders""")
def search_params(spark, d):
    """Court and date range of a search; the orders' years with courts and reporters by key."""
    at = lambda rows: F.get(F.array(*[F.lit(r[0]) for r in rows]), (F.col("o_orderkey") % len(rows)).cast("int"))
    return T(spark, d, "orders").select("o_orderkey", courts.search_params(at(_COURTS), at(_REPORTERS), F.year("o_orderdate")).alias("s")).select("o_orderkey", "s.*")


_HELD = Fixture("id int, volume string, reporter string, page string, record string", [
    (1, "201", "A.D.3d", "83", "201 A.D.3d 83|5 N.Y. 6"), (2, "201", "A.D.3d", "84", "201 A.D.3d 83"), (3, None, "A.D.3d", "83", "1 U.S. 1"), (4, "1", "U.S.", "1", None), (5, "9", "S. Ct.", "7", "9 S.Ct. 7"), (6, "", "F.3d", "1", "2 F.3d 2"),
])


@query(f"""SELECT id, CASE WHEN coalesce(volume, '') = '' OR coalesce(reporter, '') = '' OR coalesce(page, '') = '' OR record IS NULL THEN true
ELSE len(list_filter(string_split(lower(translate(record, '. ', '')), '|'), lambda c: contains(c, volume) AND contains(c, lower(translate(reporter, '. ', ''))) AND contains(c, page))) > 0 END AS present FROM {_HELD.sql}""")
def primary_on_record(spark, d):
    return _HELD.frame(spark).select("id", courts.on_record(F.col("volume"), F.col("reporter"), F.col("page"), F.split("record", r"\|")).alias("present"))


_STORED = Fixture("id int, value string", [
    (1, '{"citation_as_written":"A v. B","status":"VERIFIED","final_ids":{"cluster_id":7,"absolute_url":"/o/7/"},"resolution_path":[{"stage":"citation_lookup","verdict":"resolved","confidence":1.0,"notes":"by location;  ; exact","elapsed_ms":3}],"warnings":[{"category":"name_formatting_noise","message":"Inc"}]}'),
    (2, '{"citation_as_written":"C v. D","status":"BOGUS"}'), (3, '{"status":"NOT_FOUND"}'), (4, "no json"), (5, None), (6, '{"citation_as_written":"E v. F","status":"NOT_FOUND","warnings":[{"category":"new_kind","message":"x"}]}'),
    (7, '{"citation_as_written":"G v. H","status":"NOT_FOUND","resolution_path":[{"stage":"opinion_search","verdict":"no_match"}]}'), (8, '{"citation_as_written":"I v. J","status":"WRONG_CASE","final_ids":{"text_source":"paper"}}'),
])
_J = "json_extract_string(v, '$.{}')"


@query(f"""WITH j AS (SELECT id, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS v FROM {_STORED.sql}), good AS (SELECT * FROM j WHERE {_J.format('citation_as_written')} IS NOT NULL
AND {_J.format('status')} IN ('VERIFIED', 'NOT_FOUND', 'WRONG_CASE') AND coalesce({_J.format('final_ids.text_source')}, 'recap_document') = 'recap_document' AND coalesce({_J.format('warnings[0].category')}, 'name_formatting_noise') = 'name_formatting_noise')
SELECT j.id, g.id IS NOT NULL AS hit, json_extract_string(g.v, '$.citation_as_written') AS input_citation, json_extract_string(g.v, '$.status') AS status, CASE WHEN json_extract_string(g.v, '$.resolution_path[0].verdict') = 'resolved' THEN CAST(json_extract_string(g.v, '$.resolution_path[0].confidence') AS DOUBLE) END AS confidence,
CASE WHEN g.id = 1 THEN 'name_formatting_noise: Inc|info: by location|info: exact' WHEN g.id IS NOT NULL THEN '' END AS diagnostics FROM j LEFT JOIN good g ON g.id = j.id""")
def stored_results(spark, d):
    """Stored results read again, written and read once more, in a front end's shape; what can't be read is a miss."""
    once = _STORED.frame(spark).withColumn("r", results.loaded(F.col("value"))).withColumn("r", results.loaded(results.stored(F.col("r"))))
    own = once.select("id", F.col("r").isNotNull().alias("hit"), F.when(F.col("r").isNotNull(), results.shape(F.col("r"))).alias("s"))
    lines = F.array_join(F.transform("s.diagnostics", lambda x: F.concat(x["category"], F.lit(": "), x["message"])), "|")
    return own.select("id", "hit", "s.input_citation", "s.status", "s.confidence", lines.alias("diagnostics"))


_ENTRIES = Fixture("entry string", [("**Roe v. Wade, 410 U.S. 113 (1973)** Source: a.pdf",), ("2019 WL 55",), ("",)])
_FRESH = Fixture("ord int, citation string", [(1, "Roe v. Wade, 410 U.S. 113"), (2, "A v. B, 12 F.3d 4"), (3, "A v. B, 12 F.3d 4"), (4, "WL 55"), (5, "2019 WL 555"), (6, ""), (7, None)])


@query(f"SELECT citation, min(ord) AS ord FROM {_FRESH.sql} n WHERE citation <> '' AND NOT EXISTS (SELECT 1 FROM {_ENTRIES.sql} e WHERE contains(e.entry, n.citation)) GROUP BY citation")
def triage_append(spark, d):
    """Triage items are appended unless the list's text holds their citation already."""
    return sinks.append_unless_contained(_ENTRIES.frame(spark), _FRESH.frame(spark), "citation", [F.col("ord")]).select("citation", "ord")


@query("SELECT o_orderkey, o_custkey, o_orderkey % 7 AS verdict FROM orders")
def guarded_positions(spark, d):
    """Two copies of the orders joined by place; the customers must agree on every row."""
    own = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    judged = own.select("o_orderkey", F.col("o_custkey").alias("cited"), (F.col("o_orderkey") % 7).alias("verdict"))
    return rel.positional_join(own, judged, "o_orderkey", {"o_custkey": "cited"}).select("o_orderkey", "o_custkey", "verdict")


_REPLIES = Fixture("id int, reply string, a int", [
    (1, '{"a":1}', 1), (2, 'Sure: ```json\n{"a":2}\n``` done', 2), (3, 'noise {"a":3} more', 3), (4, "nothing", None), (5, "[1]", None), (6, '{"a":', None), (7, '{"a":7, "why":"he said "no" twice"}', 7),
    (8, '{"a":8, "why":{"x":[1, 2', 8), (9, 'text {"why":"cut in the midd', None), (10, None, None), (11, '{"why":"a \\"b\\" c","a":11,', 11),
])


@query(f"SELECT id, a FROM {_REPLIES.sql}")
def json_recovery(spark, d):
    """The first object among the whole reply, its fenced block, its outermost braces and the repaired reply; the SQL holds values by hand."""
    return _REPLIES.frame(spark).select("id", F.from_json(recover.json_object(F.col("reply")), "a int")["a"].alias("a"))
