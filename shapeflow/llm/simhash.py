"""SimHash near-deduplication through a segment-popcount grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches, store, whole_runs
from shapeflow.llm.components import components

SEED = 42
#: Most bits in which linked fingerprints differ. The grid below is made for this radius.
RADIUS = 4
SEGMENTS = 32  # of two bits each: counts 0, 1, 2
#: The three groups of segments; a table of the grid leaves out one of them.
GROUPS = tuple(sum(3 << 2 * s for s in range(*span)) for span in ((0, 11), (11, 22), (22, 32)))
#: A cell of more fingerprints than this is parted by blocks of bits, (lowest bit, width): one more than RADIUS.
DENSE, BLOCKS = 256, ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, width: int) -> int:
    """Bits set in over half the XXH64 hashes of the text's ``width``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[s:e], SEED) for s, e in zip(starts, stops)), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):  # bit 63 first
        counts += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long; null counts as empty, fingerprint 0."""
    small_batches(docs.sparkSession)
    schema = arrow_schema("doc_id long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, width) for x in byte_texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
            yield record_batch(schema, [batch.column("doc_id"), fps])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) for each cell that a fingerprint enters.

    A fingerprint becomes its vector of bit counts in SEGMENTS segments. Fingerprints that
    differ in at most 4 bits have vectors at Manhattan distance of at most 4. Of the three
    groups of segments, one holds at least 2 of a distance of 3 or 4, so in some two groups
    the vectors are within 2, and there some vector lies within 1 of both. Each of the three
    tables drops one group and puts a fingerprint into every cell within 1 of its vector.
    """
    x = fps.view(np.uint64)
    pairs = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    cells, owners = [], []
    for left_out in GROUPS:
        mask = np.uint64(~left_out & 0xFFFFFFFFFFFFFFFF)
        own = pairs & mask
        tag = np.uint64(left_out)  # all 3, never a count: tells the tables apart
        cells.append(own | tag)
        owners.append(x)
        for s in range(SEGMENTS):
            if left_out >> 2 * s & 1:
                continue
            step = np.uint64(1 << 2 * s)
            count = (own >> np.uint64(2 * s)) & np.uint64(3)
            for ok, moved in ((count < 2, own + step), (count > 0, own - step)):
                cells.append(moved[ok] | tag)
                owners.append(x[ok])
    return np.concatenate(cells).view(np.int64), np.concatenate(owners).view(np.int64)


def bit_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def spanning_links(own: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links among some fingerprints: each point found links what it reaches first.

    Every point meets every point that nothing has reached yet, so no link is lost. The cost
    is the number of points times that of the groups they form.
    """
    a, b = [], []
    todo = own
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            point = queue.pop()
            near = bit_difference(todo, np.full(1, point)) <= RADIUS
            if near.any():
                found = todo[near]
                a += [int(point)] * len(found)
                b += found.tolist()
                queue += found.tolist()
                todo = todo[~near]
    return a, b


def cell_links(own: np.ndarray) -> tuple[list, list]:
    """Links that join all near fingerprints of one cell.

    Two fingerprints that differ in at most RADIUS bits agree in one of RADIUS + 1 blocks of
    bits, so a dense cell is parted by each block's value in turn, and only points alike in a
    block meet: unrelated ones, however many, meet about one in 2 ** 13 others.
    """
    if len(own) <= DENSE:
        return spanning_links(own)
    a, b = [], []
    for low, width in BLOCKS:
        block = own.view(np.uint64) >> np.uint64(low) & np.uint64((1 << width) - 1)
        order = np.argsort(block, kind="stable")
        block = block[order]
        edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if e - s > 1:
                more = spanning_links(own[order[s:e]])
                a += more[0]
                b += more[1]
    return a, b


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that are within RADIUS bits, directly or through others."""
    cell_schema, link_schema = arrow_schema("cell long, fp long"), arrow_schema("a long, b long")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(cell_schema, list(grid_cells(batch.column("fp").to_numpy(zero_copy_only=False))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, fp in whole_runs(batches, "cell", "fp"):
            if len(cell) < 2:
                continue
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            sizes = np.diff(edge)
            two = edge[:-1][sizes == 2]
            near = two[bit_difference(fp[two], fp[two + 1]) <= RADIUS]
            a, b = fp[near].tolist(), fp[near + 1].tolist()
            for start, size in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                more = cell_links(fp[start : start + size])
                a += more[0]
                b += more[1]
            if a:
                yield record_batch(link_schema, [a, b])

    cells = distinct.select("fp").mapInArrow(enter, "cell long, fp long")
    # cells hold distinct fingerprints only: copies of a text, however many, are one point
    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(verify, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id among the rows that links lead to, the row included.

    ``width`` words make a shingle; fingerprints link at RADIUS or fewer differing bits, a
    similarity of 1 - 4 / 64 or more. Empty and null texts share fingerprint 0. Rows with
    equal fingerprints are one point; extra columns are ignored; an empty table gives an
    empty result; a null doc_id is never the smallest.
    """
    prints = store(fingerprints(docs, width), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = components(links(distinct))
    placed = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written first: a join of two plain exchanges is one that adaptive execution can split at a large component
    smallest = store(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    named = placed.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir), width=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
