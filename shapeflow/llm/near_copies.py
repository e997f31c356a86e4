"""One row of each group of near copies: five-word shingle sets, MinHash bands, exact check, and op5's fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeflow.llm import simhash
from shapeflow.llm.common import arrow_schema, byte_texts, record_batch, row_key, small_batches, store
from shapeflow.llm.components import components

SEED = 42
WIDTH = 5
#: Least Jaccard similarity of the shingle sets of linked texts, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Least hashes of a set; ROWS of them make a band. Texts of similarity 0.8 share none of the
#: bands with chance (1 - 0.8 ** 4) ** 25, 2 in a million.
BANDS, ROWS = 25, 4
#: Shingle hashes of the rows of a cell that one task compares (8 bytes each); cells with more are parted.
PART = 1 << 18
ROW = "_row_number"
#: Words of a shingle of the fingerprints, as in op5.
PRINT_WIDTH = 4
_RANDOM = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
_XOR, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles; of all its words if they are fewer than WIDTH."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    one, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    stops = ends[WIDTH - 1 :] or [len(joined)]
    return np.unique(np.fromiter((one(joined[s:e], SEED) for s, e in zip(starts, stops)), dtype=np.uint64, count=len(stops)))


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS numbers; two sets share one where all ROWS least hashes of a band agree. An empty set has none."""
    if not len(own):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(own), 1024):
        x = (own[i : i + 1024, None] ^ _XOR) * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        np.minimum(least, x.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def set_links(rows: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the sets: each one found links what it reaches first, as in simhash.cell_links."""
    a, b = [], []
    todo, (num, den) = list(range(len(rows))), SIMILAR
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and todo:
            at = queue.pop()
            own, sizes = sets[at], np.array([len(sets[i]) for i in todo])
            near = np.minimum(sizes, len(own)) * den >= np.maximum(sizes, len(own)) * num
            some = np.flatnonzero(near)
            if len(some):
                merged = np.concatenate([sets[todo[i]] for i in some])
                place = np.minimum(np.searchsorted(own, merged), len(own) - 1)
                starts = np.cumsum(sizes[some]) - sizes[some]
                both = np.add.reduceat((own[place] == merged).astype(np.int64), starts)
                near[some] = both * den >= (sizes[some] + len(own) - both) * num
            found = [i for i, x in zip(todo, near) if x]
            a += [rows[at]] * len(found)
            b += [rows[i] for i in found]
            queue += found
            todo = [i for i, x in zip(todo, near) if not x]
    return a, b


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(column lists) of each run of two rows or more with one key, from batches sorted by key."""
    held: list[list] | None = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for s, e in zip(edge[:-1], edge[1:]):
            part = [c[s:e] for c in columns]
            if held is not None and held[0][0] == part[0][0]:
                for x, y in zip(held, part):
                    x += y
            else:
                if held is not None and len(held[0]) > 1:
                    yield tuple(held)
                held = part
    if held is not None and len(held[0]) > 1:
        yield tuple(held)


def band_cells(first: DataFrame) -> DataFrame:
    """(cell, row, size, parts, part): rows of ``first`` (row, size, bands) that share a band; cells of the same rows are one.

    A band's rows are known by their number and two sums of hashes, which combine before the
    shuffle, so no task holds a band's rows. A cell has one part for each PART
    hashes of its sets, and each row belongs to one of them.
    """
    banded = first.select(F.explode(F.array_distinct("bands")).alias("band"), "row", "size")
    x, y = row_key("row")
    alike = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"), F.sum("size").alias("size")).filter("n > 1")
    chosen = store(alike.groupBy("n", "x", "y").agg(F.min("band").alias("band"), F.ceil(F.first("size") / PART).alias("parts")).select("band", "parts"), "bands")
    return store(banded.join(chosen, "band").select(F.col("band").alias("cell"), "row", "size", "parts", F.pmod(F.xxhash64("row"), "parts").alias("part")), "cells")


def _spread(cells: DataFrame) -> DataFrame:
    """Every row of ``cells`` once for each part of its cell."""
    return cells.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))


def links(first: DataFrame, numbered: DataFrame) -> DataFrame:
    """(a, b): links between rows of ``first`` (row, size, bands), one for each different shingle set, that join all similar ones, directly or through others.

    Rows that share a band are a cell. Only rows in cells have their sets made again, from
    ``numbered``, and meet them there exactly. Cells of more than PART hashes are dealt out in
    parts, and the cell's first row, its pivot, enters each; rows that the links so found
    don't join to their pivot then meet all parts, in blocks of the size of a part. So a task
    holds two parts at most. Rows that the pivot joins cost one comparison each; the others'
    blocks times the cell's parts grow with the square where a crowded cell holds many groups.
    """
    set_schema, link_schema = arrow_schema("row long, hashes binary"), arrow_schema("a long, b long")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(set_schema, [batch.column(ROW), [shingles(x).tobytes() for x in byte_texts(batch.column("text"))]])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, hashes in _runs(batches, "key"):
            a, b = set_links(rows, [np.frombuffer(x, dtype=np.uint64) for x in hashes])
            if a:
                yield record_batch(link_schema, [a, b])

    def meet(groups: DataFrame) -> DataFrame:
        sets = numbered.join(groups.select(F.col("row").alias(ROW)).distinct(), ROW, "left_semi").select(ROW, "text").mapInArrow(make, "row long, hashes binary")
        return groups.join(sets, "row").select("key", "row", "hashes").repartition("key").sortWithinPartitions("key", "row").mapInArrow(verify, "a long, b long")

    cells = band_cells(first)
    pivots = _spread(cells.filter("parts > 1").groupBy("cell", "parts").agg(F.min("row").alias("row")))
    dealt = cells.select("cell", "part", "row").union(pivots.filter(F.col("part") != F.pmod(F.xxhash64("row"), "parts")).select("cell", "part", "row"))
    near = store(meet(dealt.select(F.xxhash64("cell", "part").alias("key"), "row")), "near")
    parted = cells.filter("parts > 1")
    if parted.isEmpty():
        return near
    roots = store(components(near).select(F.col("node").alias("row"), "root"), "roots")
    rooted = lambda rows: rows.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    at = rooted(pivots).select("cell", "part", F.col("root").alias("pivot_root"))
    left = store(rooted(parted).join(at, ["cell", "part"]).filter("root <> pivot_root").select("cell", "parts", "part", "row", "size"), "left")
    blocks = _spread(store(left.groupBy("cell", "parts").agg(F.ceil(F.sum("size") / PART).alias("blocks")), "blocks")).drop("parts")
    asking = left.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), "blocks")).drop("part")
    asked = parted.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    key = F.xxhash64("cell", "part", "block").alias("key")
    return near.union(meet(_spread(asking).select(key, "row").union(asked.select(key, "row")).distinct()))


def print_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between rows of ``prints`` (row, fp), a row once for each of its fingerprints, that join all rows whose fingerprints are equal or within op5's radius."""
    prints = store(prints, "prints")
    first = store(prints.groupBy("fp").agg(F.min("row").alias("first")), "first-prints")
    equal = prints.join(first, "fp").filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    of = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}"))
    near = simhash.links(first).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.union(near)


def drop_copies(docs: DataFrame, by_prints: bool = False) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, of the first of equal ids, without an id only if none has one.

    Rows link where their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more; with ``by_prints`` also where op5 links them, by fingerprints of at most RADIUS differing bits: these
    weigh repeated shingles, so either finds pairs that the other doesn't. A group is what links lead to. Rows count each by itself, so repeated rows and rows
    without an id are copies like others. Texts without words (null too) are one group.
    """
    small_batches(docs.sparkSession)
    numbered = store(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    columns = "row long, doc_id long, size long, digest binary, bands binary, fp long"
    schema = arrow_schema(columns)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            sets = [shingles(x) for x in texts]
            prints = np.array([simhash.fingerprint(x, PRINT_WIDTH) if by_prints else 0 for x in texts], dtype=np.uint64).view(np.int64)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield record_batch(schema, [batch.column(ROW), batch.column("doc_id"), [len(x) for x in sets], digests, [bands(x).tobytes() for x in sets], prints])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.frombuffer(x, dtype=np.int64) for x in batch.column("bands").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("size"), pa.array(numbers, pa.list_(pa.int64()))], names=["row", "size", "bands"])

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    sketches = numbered.select(ROW, F.col("doc_id").cast("long"), "text").mapInArrow(sketch, columns)
    first = store(sketches.groupBy("digest").agg(F.min(order).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.collect_set("fp").alias("fps")).select("least", F.col("least.row").alias("row"), "size", "bands", "fps"), "shingle-sets")
    linked = links(first.select("row", "size", "bands").mapInArrow(unpack, "row long, size long, bands array<long>"), numbered)
    if by_prints:
        linked = linked.union(print_links(first.select("row", F.explode("fps").alias("fp"))))
    rooted = components(linked)
    placed = first.select("least", "row").join(rooted.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    kept = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").select(*docs.columns)
