"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, row_key, small_batches, store

#: Lines whose hashes choose a boundary together, and the share of places that are boundaries (1 in DIVISOR).
ROLL, DIVISOR = 2, 2
MIN_LINES, MAX_LINES = 2, 32
#: Lines with a word that a chunk needs for it to be removed.
TELLING_LINES = 2
_BASE, _WRAP = 0x100000001B3, (1 << 64) - 1


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first, behind last) line of each chunk.

    A rolling hash over the hashes of the last ROLL lines ends a chunk where it is divisible
    by DIVISOR and the chunk has MIN_LINES or more, so boundaries follow the content and
    fall into step again behind an insertion.
    """
    out, start, rolled = [], 0, 0
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    drop = pow(_BASE, ROLL, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * _BASE + h - (hashes[i - ROLL] * drop if i >= ROLL else 0)) & _WRAP
        size = i + 1 - start
        if size >= MAX_LINES or size >= MIN_LINES and (rolled >> 17) % DIVISOR == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def multi_line_chunks(text: bytes) -> list[tuple[int, bytes]]:
    """(number, content) of the chunks that may be removed: TELLING_LINES or more of their lines have a word."""
    lines = text.split(b"\n")
    return [(k, b"\n".join(lines[s:e])) for k, (s, e) in enumerate(chunk_bounds(lines)) if sum(1 for x in lines[s:e] if x.strip()) >= TELLING_LINES]


def _chunks(docs: DataFrame, contents: bool) -> DataFrame:
    ddl = "doc_id long, row_a long, row_b long, chunk int, digest string" + ", content binary" * contents
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_a", "row_b")))
            out = [(*key, k, hashlib.blake2b(c, digest_size=16).hexdigest(), c) for key, x in zip(keys, byte_texts(batch.column("text"))) for k, c in multi_line_chunks(x)]
            yield record_batch(schema, [[x[i] for x in out] for i in range(len(schema))])

    row_a, row_b = row_key("doc_id", "text")
    return docs.select(F.col("doc_id").cast("long"), row_a.alias("row_a"), row_b.alias("row_b"), "text").mapInArrow(run, ddl)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(row_a, row_b, chunk): each chunk that an earlier one (by doc_id, then row, then place) equals byte for byte.

    Chunks are grouped by digest and whole content; the aggregation combines within each task
    first, so a chunk that a third of all texts hold costs one row a task. Chunks find their
    group by digest alone, by content where one digest has several. A row without an id comes
    last, so that it never stands for rows with ids.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_a", "row_b", "chunk")
    groups = _chunks(docs, True).groupBy("digest", "content").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    known = store(groups.groupBy("digest").agg(F.count("*").alias("contents"), F.max("n").alias("n"), F.min("first").alias("first")).filter("n > 1"), "chunk-groups")
    later = ~((F.col("row_a") == F.col("first.row_a")) & (F.col("row_b") == F.col("first.row_b")) & (F.col("chunk") == F.col("first.chunk")))
    out = _chunks(docs, False).join(known.filter("contents = 1"), "digest").filter(later).select("row_a", "row_b", "chunk")
    shared = known.filter("contents > 1").select("digest")
    if shared.isEmpty():
        return out
    twins = _chunks(docs, True).join(shared, "digest")
    own = twins.groupBy("digest", "content").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    return out.union(twins.join(own, ["digest", "content"]).filter(later).select("row_a", "row_b", "chunk"))


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut from the text (the first of each stays), plus
    lines_before and lines_removed (instead of columns of these names). n_chars, where there is such a column, follows the new text.

    Null text stays null (no lines). A row is known by its id and whole text, so rows of one id
    with different texts, and rows without an id, are documents of their own; rows alike in
    both are one place, and all keep what one of them keeps. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    gone = repeated_chunks(docs).groupBy("row_a", "row_b").agg(F.array_sort(F.collect_set("chunk")).alias("_gone"))  # a document's chunks
    row_a, row_b = row_key("doc_id", "text")
    keyed = docs.select("*", row_a.alias("_row_a"), row_b.alias("_row_b"))
    joined = keyed.join(gone.withColumnsRenamed({"row_a": "_row_a", "row_b": "_row_b"}), ["_row_a", "_row_b"], "left").drop("_row_a", "_row_b")
    rest = [f for f in joined.schema.fields if f.name not in ("_gone", "lines_before", "lines_removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, removed = [], [], []
            for text, chunks in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("_gone").to_pylist()):
                lines = [] if text is None else text.split(b"\n")
                kept, lost = lines, set(chunks or ())
                if lost:
                    kept = [x for k, (s, e) in enumerate(chunk_bounds(lines)) if k not in lost for x in lines[s:e]]
                texts.append(None if text is None else b"\n".join(kept).decode("utf-8", "replace"))
                before.append(len(lines))
                removed.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int32()), pa.array(removed, pa.int32())], names=[*(f.name for f in rest), "lines_before", "lines_removed"])

    out = joined.select(*(f.name for f in rest), "_gone").mapInArrow(run, StructType([*rest, *StructType.fromDDL("lines_before int, lines_removed int").fields]))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_chunks(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
