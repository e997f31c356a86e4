"""Merkle manifest of a dataset: one hash for all rows, and for each row the siblings that prove it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import documents, store
from shapeflow.operators.ranks import numbered_within

#: Children of a node.
FAN = 3
#: Levels that one exchange serves: their nodes live together, so messages between them stay in their task.
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the tree over all sources' subroots; the sources' own trees are numbered from 1.
TOP = 0
OUT = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"

Key = tuple[int, int, int]  # tree, level, place in the level


def hashed(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the value's count of UTF-8 bytes, a colon and the value."""
    own = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """Hash of a row's fields, with another text in place of its own."""
    return F.sha2(F.concat(*(field(text if text is not None and name == "text" else F.col(name)) for name in FIELDS)), 256)


def home(key: Key) -> int:
    """Where a node lives: with all nodes under the same node of the next level that STRIDE divides."""
    tree, level, at = key
    upto = -(-level // STRIDE) * STRIDE
    return hash((tree, upto, at // FAN ** (upto - level)))


def levels_above(n: int) -> int:
    """Supersteps until ``n`` nodes are one; one at least."""
    levels = 1
    while n > FAN**levels:
        levels += 1
    return levels


def to_parents(nodes: RDD, level: int, parts: int) -> RDD:
    """One superstep upwards: every node of a level sends (place in its run, hash, nodes of its level, what else it
    carries) to its parent; (parent, messages in order), three at most."""
    def send(own: Iterator) -> Iterator:
        for (tree, _, at), (digest, n, more) in own:
            yield (tree, level + 1, at // FAN), (at % FAN, digest, n, more)

    stays = level % STRIDE != 0
    return nodes.mapPartitions(send, stays).groupByKey(parts, home).mapValues(sorted_run)


def sorted_run(messages: Iterable[tuple]) -> list[tuple]:
    return sorted(messages, key=lambda m: m[0])


def completed(run: list[tuple]) -> tuple[str, int, None]:
    """A parent whose children have all come. A tree that has one node left passes it on as it is."""
    n = run[0][2]
    return (run[0][1] if n == 1 else hashed(m[1] for m in run)), -(-n // FAN), None


def climb(nodes: RDD, levels: int, parts: int) -> tuple[list[RDD], RDD]:
    """The runs of each level, and the one node of each tree that is left."""
    runs = []
    for level in range(levels):
        runs.append(to_parents(nodes, level, parts))
        nodes = runs[-1].mapValues(completed)
    return runs, nodes


def to_children(runs: RDD, paths: RDD, level: int, parts: int) -> RDD:
    """One superstep downwards: each parent hands its path on, with each child's siblings before it.
    (child, (path, child's hash, what else it carries)); paths come in (parent, (path, ...))."""
    def meet(own: Iterator) -> Iterator:
        for (tree, _, at), both in own:
            run, path = None, None
            for kind, value in both:
                run, path = (value, path) if kind == 0 else (run, value)
            for slot, digest, n, more in run:
                step = path if n == 1 else ((slot, tuple(m[1] for m in run if m[0] != slot)), path)
                yield (tree, level, at * FAN + slot), (step, digest, more)

    if (level + 1) % STRIDE == 0:
        paths = paths.partitionBy(parts, home)
    both = runs.mapValues(lambda run: (0, run)).union(paths.mapValues(lambda p: (1, p[0])))
    return both.groupByKey(parts, home).mapPartitions(meet, level % STRIDE != 0)


def descend(runs: list[RDD], paths: RDD, parts: int) -> RDD:
    for level in range(len(runs) - 1, -1, -1):
        paths = to_children(runs[level], paths, level, parts)
    return paths


def fold(digest: str, path: tuple) -> str:
    """The root that a leaf and its siblings lead to."""
    while path[1] is not None:
        (slot, siblings), path = path
        digest = hashed((*siblings[:slot], digest, *siblings[slot:]))
    return digest


def written(path: tuple) -> str:
    """A path as text: levels from the leaf up, parted by ``;``, each its run's hashes parted by ``,`` with ``*`` for the own one."""
    out = []
    while path[1] is not None:
        (slot, siblings), path = path
        out.append(",".join((*siblings[:slot], "*", *siblings[slot:])))
    return ";".join(out)


def manifest(leaves: DataFrame, key: Column, order: Column) -> DataFrame:
    """Root of all leaves, and each leaf's subroot, sibling path and verification.

    ``leaves`` has doc_id, leaf and claimed (the hash to be verified; null: the leaf itself). Leaves of one
    ``key`` (null first, else as text, bytewise) form a tree in ``order``; the trees' subroots form the tree above.

    Pregel-style supersteps over an RDD of nodes. Upwards, children message their parent, and a parent whose run is
    complete hashes it and forwards; downwards, parents broadcast sibling paths, and leaves fold the claimed hash
    along theirs. Nodes are placed by blocks of FAN**STRIDE leaves, so a tree of any size is dealt over all tasks, a
    task's groups hold FAN messages, and only each STRIDE-th superstep moves data. The loops' lengths follow the
    logarithm of the largest tree; shuffle files keep a lost executor from undoing earlier supersteps. Only that size,
    and the number of trees, reach the driver.

    Leaves that are alike in key and order (repeated rows) keep a place each; null keys form one tree. An empty table
    gives an empty result.
    """
    spark = leaves.sparkSession
    keyed = F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), key.cast("string")))
    rows = store(leaves.select("doc_id", "leaf", "claimed", keyed.alias("_tree"), order.alias("_by"), F.monotonically_increasing_id().alias("_row")), "leaves")
    placed = numbered_within(rows.withColumn("_order", F.struct("_by", "leaf", "_row")).drop("_by", "_row"), "_tree", "_order", "_place")
    trees = store(numbered_within(rows.groupBy("_tree").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), "_all", "_tree", "_number"), "trees")
    most, count = trees.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], OUT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = placed.join(trees.select("_tree", "_n", "_number"), "_tree").select("_number", "_place", "leaf", "_n", "doc_id", "claimed").rdd
    nodes = first.map(lambda r: ((r[0], 0, r[1] - 1), (r[2], r[3], (r[4], r[5]))))

    runs, subroots = climb(nodes, levels_above(most), parts)
    tops = subroots.map(lambda x: ((TOP, 0, x[0][0] - 1), (x[1][0], count, x[0])))
    top_runs, roots = climb(tops, levels_above(count), parts)

    ends = roots.mapValues(lambda x: ((x[0], None), x[0], None))  # a path ends in the root
    below = descend(top_runs, ends, parts)  # of each source: ((TOP, 0, place), (path, subroot, the subroot's key in its own tree))
    marked = below.map(lambda x: (x[1][2], (((None, x[1][1]), x[1][0]), None, None))).partitionBy(parts, home)
    paths = descend(runs, marked, parts)

    def verify(own: Iterator) -> Iterator[tuple]:
        for _, (path, leaf, (doc_id, claimed)) in own:
            path, subroot, root = without_mark(path)
            folded = fold(claimed if claimed is not None else leaf, path)
            yield doc_id, leaf, subroot, root, written(path), folded, folded == root

    return spark.createDataFrame(paths.mapPartitions(verify), OUT, verifySchema=False)


def without_mark(path: tuple) -> tuple[tuple, str, str]:
    """The path without the mark that holds the subroot, the subroot, and the root at the path's end."""
    steps, subroot = [], ""
    while path[1] is not None:
        step, path = path
        if step[0] is None:
            subroot = step[1]
        else:
            steps.append(step)
    end = path
    for step in reversed(steps):
        path = (step, path)
    return path, subroot, end[0]


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of the documents' fields. Where 2 divides the id's checksum, the claimed hash is that of the text without
    its line ends; rows without an id are not tampered with. Columns beyond FIELDS have no part in the hash."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    without = F.translate("text", "\n", "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_hash().alias("leaf"), F.when(even, leaf_hash(without)).alias("claimed"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(document_leaves(documents(spark, sf_dir)), F.col("source"), F.col("doc_id"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", ",;*", ""), 256).alias("proof_sha256"), "folded_root", "verified")


_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], "{0}")) + ")"
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf, CASE WHEN xor({_CRC.format("doc_id::VARCHAR")}, 4294967295::UBIGINT) % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, coalesce('1' || source, '0') AS tree FROM documents),
own AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM d
  UNION ALL
  SELECT tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY tree, level, pos // 3),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 3),
sides AS (  -- the run around each node, without it
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM own a JOIN own b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM above a JOIN above b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
up AS (
  SELECT doc_id, tree, 0 AS level, pos, coalesce(claimed, leaf) AS h, '' AS proof FROM d
  UNION ALL
  SELECT up.doc_id, up.tree, up.level + 1, up.pos // 3, sha256(s.l || up.h || s.r), up.proof || s.l || s.r FROM up JOIN sides s ON s.tree = up.tree AND s.level = up.level AND s.pos = up.pos),
met AS (SELECT u.doc_id, s.subroot, s.pos, u.h, u.proof FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS k FROM up) u JOIN sub s ON s.tree = u.tree WHERE k = 1),
over_all AS (
  SELECT doc_id, subroot, 0 AS level, pos, h, proof FROM met
  UNION ALL
  SELECT o.doc_id, o.subroot, o.level + 1, o.pos // 3, sha256(s.l || o.h || s.r), o.proof || s.l || s.r FROM over_all o JOIN sides s ON s.tree = '' AND s.level = o.level AND s.pos = o.pos),
folded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS k FROM over_all) WHERE k = 1)
SELECT d.doc_id, d.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM d JOIN folded f ON d.doc_id = f.doc_id, (SELECT h FROM above WHERE n = 1) r
"""
