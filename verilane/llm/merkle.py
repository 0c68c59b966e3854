"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups, with an inclusion proof for every row.

Contract. A row's leaf is the SHA-256, in lower-case hexadecimal, of its fields one after another: `-` for a null, else the value's UTF-8
bytes, a colon and the value (integers in decimal). The leaves of a group ascend by the order column. While several nodes remain, every FAN
consecutive ones (the last run may be shorter, even one) become the SHA-256 of their digests as text. What remains, a lone leaf itself, is the group's
subroot. The subroots by group (null first, then by UTF-8 bytes) become the root in the same way. A row's proof are the digests of its siblings,
run by run from the leaf to the root, each run from left to right.

Method. Nodes of a level are partitioned by group and parent index; a full-frame ordered collect_list gives every node the run it belongs to, which is
the parent's preimage and holds the siblings. The first node of each run carries the parent on, so that parents are single before the next level.

Scale. Positions within a group come from a range partitioning by group and order: rows are numbered within a partition and moved up by what the
partitions before hold of their group, so a group with a third of all rows is numbered by many tasks. Texts are read once and leave the first stage as digests. Each level has a FAN-th of the nodes of the level below, and a window
never holds more than FAN of them. The driver holds the size of the largest group and the root.

Nulls and ties: a null order value comes before all others; rows alike in group and order stand by their leaves; a repeated row is a leaf of its own.
Empty texts are values of no bytes. Only the named fields are read, whatever other columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's checksum this divides are tampered with in the query.
TAMPER_EVERY = 5
_STEP = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    said = (F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields)
    return F.sha2(F.concat(*said), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings of its path give."""
    return F.aggregate(path, digest, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows, which have g, with at, each one's place in its group by order from 0, and n, the group's size. rows are read several times."""
    # the last key tells repeated rows apart, so that no key outgrows a partition
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.repartitionByRange("g", *order, "_salt").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("g", "_part").agg(F.count("*").alias("k"))
    own = Window.partitionBy("g")
    sizes = sizes.withColumn("n", F.sum("k").over(own)).withColumn("before", F.sum("k").over(own.orderBy("_part")) - F.col("k"))
    sizes = checkpointed(sizes.select("g", "_part", "n", "before"))
    within = Window.partitionBy("_part", "g").orderBy(*order, "_salt")
    local = dealt.withColumn("at", F.row_number().over(within).cast("long") - 1)
    # by part and group, as the window is: neither side has a hot key
    placed = local.join(sizes, ["_part", "g"]).withColumn("at", F.col("at") + F.col("before"))
    return placed.drop("before", "_part", "_salt")


def _with_runs(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes (g, at, n, digest) of groups with several nodes, with parent, and as step the digests left and right of each in its run."""
    run = Window.partitionBy("g", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = nodes.where("n > 1").withColumn("parent", F.floor(F.col("at") / fan)).withColumn("run", F.collect_list("digest").over(run))
    own = (F.col("at") % fan).cast("int")
    step = F.struct(F.concat_ws("", F.slice("run", F.lit(1), own)).alias("left"), F.concat_ws("", F.slice("run", own + 2, F.lit(fan))).alias("right"))
    return listed.withColumn("step", step)


def _parents(runs: DataFrame, fan: int) -> DataFrame:
    """The nodes of the next level, each from the first node of its run."""
    firsts = runs.where(F.col("at") % fan == 0)
    return firsts.select("g", F.col("parent").alias("at"), F.ceil(F.col("n") / fan).alias("n"), F.sha2(F.concat_ws("", "run"), 256).alias("digest"))


class _Trees:
    """The trees over the groups of some leaves (g, at, n, digest, further columns)."""

    def __init__(self, leaves: DataFrame, fan: int):
        self.fan, self.levels = fan, [leaves]
        most = leaves.agg(F.max("n")).first()[0] or 0
        while most > 1:
            runs = _with_runs(self.levels[-1], fan)
            self.levels.append(checkpointed(_parents(runs, fan)))
            most = -(-most // fan)

    def subroots(self) -> DataFrame:
        """g and digest of what remains of each group."""
        out = [nodes.where("n = 1").select("g", "digest") for nodes in self.levels]
        while len(out) > 1:
            out = [out[k].unionByName(out[k + 1]) if k + 1 < len(out) else out[k] for k in range(0, len(out), 2)]
        return out[0]

    def paths(self, ends: DataFrame) -> DataFrame:
        """The leaves with path, and what else ends has. ends: g, tail (the path from the subroot on) and further columns for each group."""
        above, extra = None, [c for c in ends.columns if c not in ("g", "tail")]
        for nodes in reversed(self.levels):
            done = nodes.where("n = 1").join(ends, "g").withColumnRenamed("tail", "path")
            if above is not None:
                onward = above.select("g", F.col("at").alias("parent"), F.col("path").alias("tail"), *extra)
                more = _with_runs(nodes, self.fan).join(onward, ["g", "parent"]).withColumn("path", F.concat(F.array("step"), "tail"))
                done = done.unionByName(more.drop("parent", "run", "step", "tail"))
            above = done if nodes is self.levels[0] else checkpointed(done)
        return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", fan: int = FAN, carry: dict[str, Column] | None = None) -> DataFrame:
    """id (the order column), leaf, group, subroot, root and path of every row, and the columns of carry, worked out where the row is read."""
    carry = carry or {}
    name = F.col(group).cast("string")
    # a string that is never null and keeps the order: null, then by bytes
    key = F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name))
    first = checkpointed(docs.select(key.alias("g"), F.col(order).alias("id"), leaf([F.col(f) for f in fields]).alias("digest"), *[c.alias(f"carry_{k}") for k, c in carry.items()]))
    trees = _Trees(checkpointed(_numbered(first, ["id", "digest"])), fan)
    groups = checkpointed(trees.subroots().select(F.lit(0).alias("g"), F.col("g").alias("id"), "digest"))
    top = _Trees(checkpointed(_numbered(groups, ["id"])), fan)
    root = top.subroots().select("digest").first()
    end = docs.sparkSession.range(1).select(F.lit(0).alias("g"), F.array().cast(_STEP).alias("tail"))
    ends = checkpointed(top.paths(end).select(F.col("id").alias("g"), F.col("path").alias("tail"), F.col("digest").alias("subroot")))
    out = trees.paths(ends)
    said = F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias("group")
    return out.select("id", F.col("digest").alias("leaf"), said, "subroot", F.lit(root[0] if root else "").alias("root"), "path", *[F.col(f"carry_{k}").alias(k) for k in carry])


def query(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with every proof checked against rows of which some have been tampered with."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    tampered = F.when(hit, leaf([lower if f == "text" else F.col(f) for f in FIELDS]))
    made = manifest(docs, carry={"tampered": tampered})
    out = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_VALUE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(f) for f in FIELDS) + ")"
_LOWER = _LEAF.replace("text::VARCHAR", f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
#: Both trees as one forest: the groups' nodes, then those of the one tree over the subroots.
ORACLE_SQL = f"""
WITH RECURSIVE read AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, doc_id, source, leaf, CASE WHEN {_CRC} % {TAMPER_EVERY} = 0 THEN low ELSE leaf END AS own
  FROM (SELECT *, {_LEAF} AS leaf, {_LOWER} AS low FROM documents)
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM read
), tree AS (
  SELECT 0 AS level, g, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, g, pos // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, pos // {FAN}
), subs AS (SELECT g, digest, level AS height FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, g AS pos, (SELECT count(*) FROM subs) AS n, digest FROM subs
  UNION ALL
  SELECT any_value(level) + 1, pos // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY pos // {FAN}
), ups AS (
  SELECT r, 0 AS level, l.g, l.pos AS pos, s.height FROM leaves l JOIN subs s USING (g)
  UNION ALL
  SELECT r, level + 1, g, pos // {FAN}, height FROM ups WHERE level < height
), tops AS (
  SELECT r, 0 AS level, g AS pos FROM leaves
  UNION ALL
  SELECT r, level + 1, pos // {FAN} FROM tops WHERE level < (SELECT max(level) FROM top)
), steps AS (
  SELECT u.r, u.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < u.pos), '') AS lefts, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > u.pos), '') AS rights
  FROM ups u JOIN tree t ON t.g = u.g AND t.level = u.level AND t.pos // {FAN} = u.pos // {FAN} WHERE u.level < u.height GROUP BY u.r, u.level
  UNION ALL
  SELECT u.r, 1000 + u.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < u.pos), ''), coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > u.pos), '')
  FROM tops u JOIN top t ON t.level = u.level AND t.pos // {FAN} = u.pos // {FAN} WHERE u.level < (SELECT max(level) FROM top) GROUP BY u.r, u.level
), lists AS (SELECT r, list(struct_pack(l := lefts, o := '', r := rights) ORDER BY level) AS path FROM steps GROUP BY r
), folds AS (
  SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(l := '', o := own, r := ''), coalesce(path, [])), lambda a, s: struct_pack(l := '', o := sha256(s.l || a.o || s.r), r := '')).o AS folded_root
  FROM leaves JOIN subs s USING (g) LEFT JOIN lists USING (r)
)
SELECT *, folded_root = root AS verified FROM folds
"""
