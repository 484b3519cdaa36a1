"""Merkle manifest of a dataset: a digest and an inclusion proof for each row.

Rows become leaves, the leaves of a group (a source) in the order of their keys a tree of arity three, and the groups' roots one
more such tree, whose root stands for the whole dataset. While a level has more than one node, every three consecutive ones,
and what is left over of them, become the digest of their digests.

Positions come from a range partitioning and its counts. A tree is then cut into aligned blocks of ``3 ** DEPTH`` leaves, each
of which one call walks by recursion in postorder: a visit returns the digest of its subtree, and while it unwinds it appends the
siblings to the leaves below. The roots of a tree's blocks are the leaves of the next traversal, until one block holds them all.
So no group is larger than a block, however many rows a source has.

A proof is an array of (left, right): the digests of the siblings on either side, joined, from the leaf's level to the root.

Rows: a null key comes first in its group, and rows with one key go by digest; repeated rows are leaves of their own; null is a
group of its own, before all others; null values and empty texts have different digests. An empty table has no rows and no root. Other
columns of the table are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, saved, table

ARITY = 3
#: Levels of a block: 729 leaves.
DEPTH = 6
PROOF = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(*fields: Column) -> Column:
    """Lower-case hex sha256 of the fields, each as its byte count, a colon and its value; a null as a hyphen."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def folded(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf's digest leads to by its proof."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_digest(proof: Column | str) -> Column:
    """Digest of all siblings of a proof, from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@lru_cache(maxsize=64)
def _height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def walk(leaves: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of a block of ``levels`` levels, and the siblings of each of its leaves."""
    siblings: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def visit(level: int, start: int) -> str:
        if not level:
            return leaves[start]
        step = ARITY ** (level - 1)
        starts = range(start, min(start + ARITY * step, len(leaves)), step)
        digests = [visit(level - 1, a) for a in starts]
        for i, a in enumerate(starts):
            beside = "".join(digests[:i]), "".join(digests[i + 1 :])
            for leaf in siblings[a : a + step]:
                leaf.append(beside)
        return sha256("".join(digests).encode()).hexdigest()

    return visit(levels, 0), siblings


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, a row's number in its tree by ``order`` (from 0), and ``n``, the number of the tree's rows.

    Rows are dealt by range and sorted; a part's offset is the number of a tree's rows in the parts before, so that no tree has to
    fit in a task. ``order`` must tell all rows apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(c) for c in (tree, *order)]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged = saved(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged", codec="zstd")
    counts = ranged.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    own = Window.partitionBy(tree)
    before = F.sum("here").over(own.orderBy("part")) - F.col("here")
    # a row for each tree and part that has rows of it
    counts = counts.select(F.col(tree).alias("its"), F.col("part").alias("its_part"), (before - F.col("first")).alias("shift"), F.sum("here").over(own).alias("n"))
    placed = ranged.join(counts, F.col(tree).eqNullSafe(F.col("its")) & (F.col("part") == F.col("its_part")))
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def trees(rows: DataFrame, tree: str, digest: str, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (with ``pos`` and ``n`` of ``numbered``) with ``proof`` and ``top``, the digest of their tree; and tables to drop."""
    size = ARITY**depth
    kept = [c for c in rows.columns if c not in (tree, "n", "block")]
    kinds = dict(rows.dtypes)

    def traverse(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        n = batch.column("n")[0].as_py()
        digest_of_block, siblings = walk(batch.column(digest).to_pylist(), depth if n > size else _height(n))
        proof = pa.array([[{"left": a, "right": b} for a, b in s] for s in siblings], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        root = pa.array([digest_of_block, *[None] * (len(siblings) - 1)], pa.string())
        return pa.table([*(batch.column(c) for c in (tree, "n", "block", *kept)), proof, root], [tree, "n", "block", *kept, "proof", "block_root"])

    schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in (tree, "n", "block", *kept))
    blocks = rows.withColumn("block", F.floor(F.col("pos") / size)).groupBy(tree, "block")
    walked = saved(blocks.applyInArrow(traverse, f"{schema}, proof {PROOF}, block_root string"), "walked", codec="zstd")
    used = [walked]
    roots = walked.where("block_root IS NOT NULL").select(F.col(tree).alias("its"), F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("block_root").alias("digest"))
    done = roots.where("n = 1").select("its", "pos", F.array().cast(PROOF).alias("above"), F.col("digest").alias("top"))
    more = roots.where("n > 1")
    if not more.isEmpty():
        upper, also = trees(more, "its", "digest", depth)
        used += also
        done = done.union(upper.select("its", "pos", F.col("proof").alias("above"), "top"))
    done = done.select(F.col("its").alias("own_tree"), F.col("pos").alias("own_block"), "above", "top")
    joined = walked.join(done, F.col(tree).eqNullSafe(F.col("own_tree")) & (F.col("block") == F.col("own_block")))
    return joined.select(tree, *kept, F.concat("proof", "above").alias("proof"), "top"), used


def manifest(rows: DataFrame, group: str, key: str, digest: str, depth: int = DEPTH) -> DataFrame:
    """``rows`` with ``pos`` (in their group), ``subroot`` (their group's digest), ``root`` (the dataset's) and ``proof`` (from leaf to root).

    group, key: columns of any type with an order, digest: a row's leaf. No other column may be called like those that are added.
    """
    leaves = saved(rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    placed = numbered(leaves, group, [key, digest, "nth"]).drop("nth")
    found, used = trees(placed, group, digest, depth)
    groups = saved(found.where("pos = 0").select(F.col(group).alias("its_group"), F.col("top").alias("group_top"), F.lit(0).alias("dataset")), "groups")
    whole, also = trees(numbered(groups, "dataset", ["its_group"]), "dataset", "group_top", depth)
    tops = whole.select("its_group", F.col("proof").alias("above"), F.col("top").alias("root"))
    joined = found.join(tops, F.col(group).eqNullSafe(F.col("its_group")))
    out = saved(joined.select(*rows.columns, "pos", F.col("top").alias("subroot"), "root", F.concat("proof", "above").alias("proof")), "manifest", codec="zstd")
    dropped(leaves, groups, *used, *also)
    return out


def checked(rows: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """key, leaf, subroot, root, proof of ``known`` (a manifest of unique keys), with what became of each row.

    folded_root: where the row's digest leads now, null if it is gone; verified: whether that is the root. A row that isn't in the manifest
    has no proof and isn't verified.
    """
    now = rows.select(F.col(key).alias("its_key"), F.col(digest).alias("now"))
    both = known.join(now, F.col(key).eqNullSafe(F.col("its_key")), "full")
    root = folded("now", "proof")
    return both.select(F.coalesce(key, "its_key").alias(key), F.col(digest).alias("leaf"), "subroot", "root", "proof", root.alias("folded_root"), F.coalesce(root == F.col("root"), F.lit(False)).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampering = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    after = [F.when(tampering, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if f == "text" else F.col(f) for f in FIELDS]
    leaves = docs.select("doc_id", "source", row_digest(*map(F.col, FIELDS)).alias("leaf"), row_digest(*after).alias("after"))
    found = manifest(leaves, "source", "doc_id", "leaf").withColumn("folded_root", folded("after", "proof"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


MERKLE_SQL = """
WITH RECURSIVE told AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN doc_id IS NOT NULL AND list_reduce(
      list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(0 AS UBIGINT))),
        lambda c, i: xor(c >> 1, (c & 1) * CAST(3988292384 AS UBIGINT)))) & 1 = 1
    THEN replace(text, chr(10), '') ELSE text END AS after
  FROM documents
), parts AS (
  SELECT doc_id, source,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head, text, after
  FROM told
), digests AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN after IS NULL THEN '-' ELSE strlen(after) || ':' || after END) AS after
  FROM parts
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM digests
), nodes AS (
  SELECT source, 0 AS level, pos AS i, leaf AS d, n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n
), subroots AS MATERIALIZED (
  SELECT source, level AS height, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), above AS (
  SELECT 0 AS level, pos AS i, subroot AS d, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY level, i // 3, n
), chains AS MATERIALIZED (
  SELECT l.source, l.pos, x.level, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i < l.pos // CAST(3 ** x.level AS BIGINT)), '') AS before,
    coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i > l.pos // CAST(3 ** x.level AS BIGINT)), '') AS behind
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.i // 3 = l.pos // CAST(3 ** (x.level + 1) AS BIGINT)
  GROUP BY l.source, l.pos, x.level
  UNION ALL
  SELECT l.source, l.pos, s.height + x.level, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i < s.pos // CAST(3 ** x.level AS BIGINT)), ''),
    coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i > s.pos // CAST(3 ** x.level AS BIGINT)), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN above x ON x.n > 1 AND x.i // 3 = s.pos // CAST(3 ** (x.level + 1) AS BIGINT)
  GROUP BY l.source, l.pos, s.height + x.level
), folds AS (
  SELECT source, pos, CAST(0 AS BIGINT) AS level, after AS d FROM leaves
  UNION ALL
  SELECT f.source, f.pos, f.level + 1, sha256(c.before || f.d || c.behind)
  FROM folds f JOIN chains c ON c.source IS NOT DISTINCT FROM f.source AND c.pos = f.pos AND c.level = f.level
), ends AS (
  SELECT source, pos, max_by(d, level) AS folded_root FROM folds GROUP BY source, pos
), proofs AS (
  SELECT source, pos, sha256(string_agg(before || behind, '' ORDER BY level)) AS proof_sha256 FROM chains GROUP BY source, pos
)
SELECT l.doc_id, l.leaf, s.subroot, r.d AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.d AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
JOIN ends e ON e.source IS NOT DISTINCT FROM l.source AND e.pos = l.pos
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
JOIN above r ON r.n = 1
"""
