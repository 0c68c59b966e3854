"""Further queries: sources and lookups on driver tables, text rules, and corpus tooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from verilane.functions import rules, text
from verilane.operators import relational as rel
from verilane.operators import signals
from verilane.sources.readers import replay
from verilane.sources.sinks import distinct_names, merged_manifest

from .fixtures import Fixture, Mixed
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


# --- sources and lookups


@query("""SELECT l_orderkey, l_linenumber, l_partkey, place AS at_ FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31') WHERE place <= 200""")
def docket_entries(spark, d):
    """A scan bounded by dates that stops after 200 entries of each docket; the dates are pushed to the file."""
    own = T(spark, d, "lineitem").where("l_shipdate between timestamp_ntz'1994-01-01' and timestamp_ntz'1996-12-31'")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return rel.top_k(own, ["l_returnflag", F.year("l_shipdate")], order, 200, "at_").select("l_orderkey", "l_linenumber", "l_partkey", "at_")


@query("""SELECT o_orderkey, coalesce(c_name, 'unknown') AS c_name, n_name, r_name, p.l_partkey AS first_part FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) p ON p.l_orderkey = o_orderkey AND p.rn = 1""")
def text_with_metadata(spark, d):
    """Four point reads in a row as left joins, with the first non-empty part by position."""
    first = rel.first_wins(T(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("first_part")), ["o_orderkey"], [F.col("l_linenumber"), F.col("first_part")]).drop("l_linenumber")
    out = T(spark, d, "orders").select("o_orderkey", "o_custkey").join(T(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(T(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(T(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(first, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("c_name"), "n_name", "r_name", "first_part")


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS hits, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'building' AND year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY c_custkey""")
def opinion_search(spark, d):
    """Candidates by an equality key with a date range around the cited year."""
    who = T(spark, d, "customer").where(F.lower("c_mktsegment") == "building").select("c_custkey")
    orders = T(spark, d, "orders").where(F.year("o_orderdate").between(1994, 1996))
    return who.join(orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("hits"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"))


@query("""SELECT doc_id, 'r' || (doc_id % 5) AS response FROM documents""")
def cassette_replay(spark, d):
    """Calls answered from recorded responses; a call without one would raise."""
    docs = T(spark, d, "documents").select("doc_id", F.concat(F.lit("get:"), F.col("doc_id").cast("string")).alias("call_key"))
    recorded = docs.select("call_key", F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("response"))
    return replay(docs, recorded).select("doc_id", "response")


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS origin FROM documents""")
def manifest_merge(spark, d):
    old = T(spark, d, "documents").select("doc_id", F.lit("old").alias("origin"))
    return merged_manifest(old, T(spark, d, "labels").select("doc_id", F.lit("new").alias("origin")).distinct(), "doc_id")


@query("""WITH f AS (SELECT doc_id, source || '-' || lang AS base, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, CASE WHEN rn = 1 THEN base ELSE base || ' (' || rn || ')' END AS name FROM f""")
def download_names(spark, d):
    own = T(spark, d, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("base"))
    return distinct_names(own, "base", ["doc_id"]).select("doc_id", "name")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('s' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 2""")
def even_sample(spark, d):
    return rel.top_k(T(spark, d, "documents"), ["lang", "source"], [F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), F.col("doc_id")], 2).select("lang", "doc_id")


@query("""SELECT CASE WHEN a.doc_id IS NULL THEN 'gained' WHEN b.doc_id IS NULL THEN 'lost' ELSE 'common' END AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) a FULL JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') b ON a.doc_id = b.doc_id GROUP BY 1""")
def gained_lost_common(spark, d):
    """Set operations: what only one side has, and what both have."""
    a, b = T(spark, d, "labels").where("quality = 1").select("doc_id"), T(spark, d, "documents").where("lang = 'en'").select("doc_id")
    sides = [("lost", a.subtract(b)), ("gained", b.subtract(a)), ("common", a.intersect(b))]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n") for name, df in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH e AS (SELECT user_id, list(struct_pack(stage := event_type, v := value) ORDER BY ts, event_id) AS path FROM events GROUP BY user_id),
h AS (SELECT user_id, list_filter(path, lambda x: x.stage = 'purchase') AS won, len(path) AS n FROM e) SELECT user_id, n, round(won[len(won)].v, 6) AS headline FROM h""")
def headline_confidence(spark, d):
    """The value of the last stage that resolved, whoever won."""
    path = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value")))
    own = T(spark, d, "events").groupBy("user_id").agg(path.alias("path"))
    won = F.filter("path", lambda x: x["event_type"] == "purchase")
    return own.select("user_id", F.size("path").alias("n"), F.round(F.try_element_at(won, F.lit(-1))["value"], 6).alias("headline"))


# --- text rules

_NOTES = Mixed("id int, note string", [(1, "Items|a || Cases|b|c ||  "), (2, "Only"), (3, ""), (4, "X|real case is Y, instead")])


@query(f"""SELECT id, trim(split_part(c, '|', 1)) AS category, trim(CASE WHEN contains(c, '|') THEN substring(c, strpos(c, '|') + 1) ELSE '' END) AS description FROM (SELECT id, unnest(string_split(note, '||')) AS c FROM {_NOTES.sql}) WHERE trim(c) <> ''""")
def double_bar_items(spark, d):
    chunks = _NOTES.frame(spark, d).select("id", F.explode(F.split("note", r"\|\|")).alias("c")).where(F.trim("c") != "")
    at = F.instr("c", "|")
    return chunks.select("id", F.trim(F.substring_index("c", "|", 1)).alias("category"), F.trim(F.when(at > 0, F.substr("c", at + 1)).otherwise("")).alias("description"))


_MARKS = r"unrelated|actually|instead|correct citation|in fact|different case|existing case"


@query(rf"""WITH m AS (SELECT doc_id, strpos(lower(text), 'instead') AS p, strpos(text, ' the ') AS q FROM documents) SELECT doc_id, p > 0 AND q > p AS real_contrast, regexp_matches(lower(d.text), '{_MARKS}') AS spans_prose, regexp_matches(text, '^[0-9]') AS incomplete FROM m JOIN documents d USING (doc_id)""")
def contrast_markers(spark, d):
    """A span after the first marker is the court's own correction."""
    at, span = F.instr(F.lower("text"), "instead"), F.instr("text", " the ")
    return T(spark, d, "documents").select("doc_id", ((at > 0) & (span > at)).alias("real_contrast"), F.lower("text").rlike(_MARKS).alias("spans_prose"), F.col("text").rlike("^[0-9]").alias("incomplete"))


_REFS = Mixed("id int, ref string", [
    (1, "Smith v. Jones, No. 1:20-cv-1 (S.D.N.Y. 2020)"), (2, "Smith v. Jones, 12 F.3d 4 (2d Cir. 1999)"), (3, "ECF No. 12 at 3"), (4, "Smith v. Jones, No. 5"), (5, "plain words"), (6, "Doe v. Roe, 2019 WL 5"),
])
_REP, _FED = r"\d+\s+(F\.|U\.S\.|S\. ?Ct\.|WL)", r"\((S|N|E|W|C|M)?\.?D\.\s*[A-Z]"


@query(rf"""SELECT id, CASE WHEN regexp_matches(ref, '{_REP}') THEN 'has_reporter_or_wl' WHEN contains(ref, ' v. ') AND regexp_matches(ref, '{_FED}') THEN 'docket_only' WHEN contains(ref, ' v. ') THEN 'no_court' WHEN contains(ref, 'ECF') OR contains(ref, 'Dkt.') THEN 'internal' ELSE 'other' END AS kind FROM {_REFS.sql}""")
def docket_reference_kinds(spark, d):
    c = F.col("ref")
    versus = c.contains(" v. ")
    return _REFS.frame(spark, d).select("id", F.when(c.rlike(_REP), "has_reporter_or_wl").when(versus & c.rlike(_FED), "docket_only").when(versus, "no_court").when(c.contains("ECF") | c.contains("Dkt."), "internal").otherwise("other").alias("kind"))


_DESCR = Mixed("id int, descr string", [(1, "BRIEF in support of motion"), (2, "Motion to extend time"), (3, "COMPLAINT filed"), (4, "Letter"), (5, None), (6, "Amended complaint and memorandum of law")])


@query(f"""SELECT id, CASE WHEN regexp_matches(lower(descr), 'brief|memorandum of law') THEN 'merits_brief' WHEN contains(lower(descr), 'motion') THEN 'procedural_motion' WHEN regexp_matches(lower(descr), 'complaint|answer') THEN 'pleading' END AS doc_type FROM {_DESCR.sql}""")
def doc_types(spark, d):
    """First hit in order of precedence."""
    low = F.lower("descr")
    return _DESCR.frame(spark, d).select("id", F.when(low.rlike("brief|memorandum of law"), "merits_brief").when(low.contains("motion"), "procedural_motion").when(low.rlike("complaint|answer"), "pleading").alias("doc_type"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 900 + 100 AS rate, CAST(o_orderkey % 30 + 1 AS INTEGER) AS months, o_orderkey % 4 AS k FROM orders), t AS (SELECT *, rate * months + k * rate AS total FROM o)
SELECT o_orderkey, rate, total, months, abs(rate * months - total) > greatest(rate, 0.05 * rate * months) AS flagged, round(total / rate, 1) AS implied FROM t WHERE k < 3""")
def monthly_rates(spark, d):
    """A claim of every order in words: a rate, a total and the months, read again and reckoned up. A fourth of them names no months."""
    own = T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 900 + 100).alias("r"), (F.col("o_orderkey") % 30 + 1).cast("int").alias("n"), (F.col("o_orderkey") % 4).alias("k"), F.trunc("o_orderdate", "month").alias("a"))
    named = lambda c: F.date_format(c, "MMMM yyyy")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    period = F.when(F.col("k") < 3, F.concat(F.lit(" from "), named("a"), F.lit(" to "), named(F.add_months("a", F.col("n") - 1)), F.lit("."))).otherwise(".")
    said = F.concat(F.lit("The tenant pays "), money(F.col("r")), F.when(F.col("k") == 1, "/month").otherwise(" per month"), F.lit(" and owes "), money(F.col("r") * F.col("n") + F.col("k") * F.col("r")), period)
    return own.select("o_orderkey", F.inline(F.filter(F.array(signals.monthly_claim(said)), lambda c: c.isNotNull())))  # a filter on the claim would read every claim twice


@query("""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, left(regexp_extract(text, '^([^.!?]*[.!?])', 1), 220) AS teaser FROM documents""")
def card_text(spark, d):
    """The whole text escaped; only the teaser has a limit."""
    esc = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return T(spark, d, "documents").select("doc_id", esc.alias("escaped"), F.left(F.regexp_extract("text", "^([^.!?]*[.!?])", 1), F.lit(220)).alias("teaser"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, length(coalesce(string_agg(regexp_replace(line, '^\s*[0-9]{1,2}\s+', ''), chr(10) ORDER BY pos), '')) AS kept FROM l WHERE NOT regexp_matches(line, '^\s*$') AND NOT regexp_matches(line, '^Case [0-9]') GROUP BY doc_id""")
def line_cleanup(spark, d):
    """Gutter numbers, headers and blank lines go; the others keep their order."""
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\s*$") & ~x.rlike("^Case [0-9]"))
    own = T(spark, d, "documents").withColumn("l", F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*[0-9]{1,2}\s+", ""))).where(F.size("l") > 0)
    return own.select("doc_id", F.length(F.array_join("l", "\n")).cast("long").alias("kept"))


# --- rows of the quality-control table

_QC = Mixed("id int, qc_status string, v_status string, is_westlaw string, year string, case_name string", [
    (1, "rerun", "VERIFIED", "TRUE", "2022", "A v. B"), (2, "ignore", None, "no", "1999", "C v. D"), (3, None, None, "yes", "x", "v."), (4, None, "NOT_FOUND", "0", "2021", "E v. F"), (5, None, "", "1", "2000", "None v. None x"), (6, "approved", None, None, "2023", "G v. H"),
])


@query(f"""SELECT id, qc_status IS NOT DISTINCT FROM 'rerun' OR (coalesce(qc_status, '') NOT IN ('duplicate', 'ignore', 'investigate', 'data') AND coalesce(v_status, '') = '') AS actionable, upper(coalesce(is_westlaw, '')) IN ('TRUE', '1', 'YES') AS unpublished,
coalesce(TRY_CAST(year AS INTEGER) >= 2021, false) AS post2020, upper(coalesce(is_westlaw, '')) IN ('TRUE', '1', 'YES') OR coalesce(TRY_CAST(year AS INTEGER) >= 2021, false) AS hard, case_name IN ('', 'v.') OR starts_with(case_name, 'None v. None') AS skipped FROM {_QC.sql}""")
def qc_filters(spark, d):
    c = lambda n: F.coalesce(n, F.lit(""))
    wl = F.upper(c("is_westlaw")).isin("TRUE", "1", "YES")
    late = F.coalesce(F.col("year").try_cast("int") >= 2021, F.lit(False))
    open_ = ~c("qc_status").isin("duplicate", "ignore", "investigate", "data") & (c("v_status") == "")
    return _QC.frame(spark, d).select("id", ((c("qc_status") == "rerun") | open_).alias("actionable"), wl.alias("unpublished"), late.alias("post2020"), (wl | late).alias("hard"), (F.col("case_name").isin("", "v.") | F.col("case_name").startswith("None v. None")).alias("skipped"))


_OVER = Mixed("id int, parsed_name string, given_name string, parsed_year int, given_year string", [(1, "A v. B", "", 1999, "2001"), (2, "A v. B", "X v. Y", 1999, "bad"), (3, None, " Z ", None, None)])


@query(f"SELECT id, coalesce(nullif(trim(given_name), ''), parsed_name) AS case_name, coalesce(TRY_CAST(trim(given_year) AS INTEGER), parsed_year) AS year FROM {_OVER.sql}")
def metadata_override(spark, d):
    """What a row states wins over what was parsed, if it isn't blank or malformed."""
    return _OVER.frame(spark, d).select("id", F.coalesce(F.nullif(F.trim("given_name"), F.lit("")), "parsed_name").alias("case_name"), F.coalesce(F.trim("given_year").try_cast("int"), "parsed_year").alias("year"))


_STAND = Mixed("id int, cite string, name string, hint string, year string", [(1, "650 F.2d at 321", "A v. B", "2d Cir.", "1981"), (2, "22 F.4th 450, 459", "C v. D", "", "2022"), (3, "2019 WL 5", "E v. F", "S.D.N.Y.", ""), (4, "WL 5", "G", "", ""), (5, "12 U.S. 3", "", "", "")])


@query(rf"""WITH s AS (SELECT *, CASE WHEN regexp_matches(cite, '\bat\b') AND NOT contains(cite, ',') THEN false WHEN contains(cite, 'WL') THEN regexp_matches(cite, '\d{{4}}\s+WL\s+\d+') ELSE regexp_matches(cite, '^\d+\s+[A-Za-z. 0-9]+?\s+\d+') END AS standalone FROM {_STAND.sql})
SELECT id, standalone, CASE WHEN standalone AND name <> '' THEN name || ', ' || cite || CASE WHEN hint || year = '' THEN '' ELSE ' (' || trim(hint || ' ' || year) || ')' END END AS citation FROM s""")
def standalone_cites(spark, d):
    """Short forms are rejected; the others are put together with name, court and year."""
    c = F.col("cite")
    full = c.rlike(r"^\d+\s+[A-Za-z. 0-9]+?\s+\d+")
    short = c.rlike(r"\bat\b") & ~c.contains(",")
    alone = F.when(short, F.lit(False)).when(c.contains("WL"), c.rlike(r"\d{4}\s+WL\s+\d+")).otherwise(full)
    paren = F.concat_ws(" ", F.nullif("hint", F.lit("")), F.nullif("year", F.lit("")))
    whole = F.concat(F.concat_ws(", ", "name", "cite"), F.when(paren == "", "").otherwise(F.concat(F.lit(" ("), paren, F.lit(")"))))
    return _STAND.frame(spark, d).select("id", alone.alias("standalone"), F.when(alone & (F.col("name") != ""), whole).alias("citation"))


_DIAG = Mixed("id int, message string, score double", [(1, "Year 1999 could be verified", 0.9), (2, "Court mismatch", 0.5), (3, None, 0.86), (4, "Court mismatch", 0.2), (5, None, 0.1)])


@query(f"""SELECT id, CASE WHEN score < 0.40 THEN message WHEN message IS NULL THEN 'We identified a ' || w || ' match.' WHEN ends_with(message, 'could be verified') THEN message || '. However, we identified a ' || w || ' match.' ELSE message || ', but we identified a ' || w || ' match.' END AS message
FROM (SELECT *, CASE WHEN score >= 0.85 THEN 'likely' ELSE 'possible' END AS w FROM {_DIAG.sql})""")
def diagnostics_wording(spark, d):
    w, m = F.when(F.col("score") >= 0.85, "likely").otherwise("possible"), F.col("message")
    said = F.when(m.isNull(), F.concat(F.lit("We identified a "), w, F.lit(" match."))).when(m.endswith("could be verified"), F.concat(m, F.lit(". However, we identified a "), w, F.lit(" match."))).otherwise(F.concat(m, F.lit(", but we identified a "), w, F.lit(" match.")))
    return _DIAG.frame(spark, d).select("id", F.when(F.col("score") < rules.RESOLVES, m).otherwise(said).alias("message"))


_COUNTS = Mixed("id int, status string, cluster long, wanted long", [(1, "VERIFIED", 1, 1), (2, "VERIFIED", 2, 3), (3, "CITE_UNCONFIRMED", 1, None), (4, "NOT_FOUND", None, 4), (5, "VERIFICATION_INCOMPLETE", None, 5), (6, None, None, 6)])


@query(f"""SELECT count(*) AS total, count_if(status IN {tuple(rules.CLEAN)!r}) AS found, count_if(cluster = wanted) AS cluster_match, count_if(status = 'CITE_UNCONFIRMED') AS check_cite, count_if(status = 'VERIFICATION_INCOMPLETE') AS incomplete, count_if(status IS NULL) AS errors, count_if(status = 'NOT_FOUND') AS not_found FROM {_COUNTS.sql}""")
def baseline_counts(spark, d):
    s = F.col("status")
    return _COUNTS.frame(spark, d).agg(F.count("*").alias("total"), F.count_if(s.isin(*rules.CLEAN)).alias("found"), F.count_if(F.col("cluster") == F.col("wanted")).alias("cluster_match"), F.count_if(s == "CITE_UNCONFIRMED").alias("check_cite"), F.count_if(s == "VERIFICATION_INCOMPLETE").alias("incomplete"), F.count_if(s.isNull()).alias("errors"), F.count_if(s == "NOT_FOUND").alias("not_found"))
