"""Removal of repeated byte strings by column-wise suffix sorting of anchored segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, row_key, small_batches, store

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes of an anchor: each LENGTH-byte window has one, its leftmost gram of least hash.
GRAM = 16
SPAN = LENGTH - GRAM + 1
#: Bytes worked on at once in a task.
SLICE = 1 << 20
#: Most segments sorted together (under 10 MB).
COLLECTION = 20_000


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of each GRAM consecutive bytes."""
    x = b.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15) + (x[8:] ^ (x[8:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, gram hash) of each run of windows that share an anchor.

    Which gram of a window is its anchor follows from the window's bytes alone, so equal
    windows have equal anchors at equal distances.
    """
    parts = []
    windows = len(data) - LENGTH + 1
    for at in range(0, max(0, windows), SLICE):
        b = np.frombuffer(data, dtype=np.uint8, count=min(SLICE + LENGTH - 1, len(data) - at), offset=at)
        h = gram_hashes(b)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        runs = np.diff(np.concatenate((first, [len(place)])))
        parts.append((first + at, runs, place[first] + at, h[place[first]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with its texts as compressed bytes, for an exchange: about half the size of the engine's own compression."""
    fields = [StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([None if x is None else squeeze(x) for x in batch.column("text").cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if f.name == "text" else batch.column(f.name) for f in fields], names=[f.name for f in fields])

    return docs.mapInArrow(run, StructType(fields))


def unpacked(column: pa.Array) -> list[bytes | None]:
    open_up = zstandard.ZstdDecompressor().decompress
    return [None if x is None else open_up(x) for x in column.to_pylist()]


def digests(parts: list[bytes]) -> np.ndarray:
    """128-bit digests of some byte strings, as two columns of 64 bits."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), dtype=">i8").reshape(-1, 2).astype(np.int64)


def anchor_table(docs: DataFrame) -> DataFrame:
    """(a, b, key, high, low, start, windows, anchor): all anchors. high and low are a 128-bit digest that stands for all
    bytes of the anchor's windows and the anchor's place among them."""
    ddl = "a long, b long, key long, high long, low long, start int, windows int, anchor int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()), byte_texts(batch.column("text"))):
                start, runs, anchor, key = anchors_of(text)
                ends = (start + runs + LENGTH - 1).tolist()
                digest = digests([bytes((a - s,)) + text[s:e] for s, e, a in zip(start.tolist(), ends, anchor.tolist())])
                out.append((np.full(len(start), doc[0]), np.full(len(start), doc[1]), key, digest[:, 0], digest[:, 1], start, runs, anchor))
            if out:
                yield record_batch(schema, [np.concatenate(x).astype(np.int32 if i > 4 else np.int64) for i, x in enumerate(zip(*out))])

    return docs.mapInArrow(run, ddl)


def column_insertion(segments: list[bytes], tails: list[int]) -> list[np.ndarray]:
    """For each segment, whether each of its windows equals a window of another segment.

    The collection is aligned at the anchors' right ends (``tails``: bytes from the anchor to
    the segment's end). Each round inserts one symbol a segment, right to left: the suffix
    order is dealt anew by the inserted symbols, stably, and the common prefix of two
    neighbours grows by one symbol from the least of all between them. Once a suffix has
    LENGTH bytes, a common prefix of LENGTH with a neighbour marks it.
    """
    n, tail = len(segments), max(tails)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=n)
    shift = tail - np.array(tails, dtype=np.int64)  # rounds until the segment's own right end
    rounds = int((sizes + shift).max())
    flat, base = np.frombuffer(b"".join(segments), dtype=np.uint8), np.cumsum(sizes) - sizes
    marks = [np.zeros(max(0, s - LENGTH + 1), dtype=bool) for s in sizes.tolist()]
    order = np.arange(n)
    common = np.zeros(n, dtype=np.int64)  # with the one before in order; at 0 none
    for r in range(rounds):
        at = sizes - 1 - (r - shift)  # the symbol each segment inserts now
        live = (at >= 0) & (at < sizes)
        symbol = np.where(live, flat[np.clip(base + at, 0, len(flat) - 1)].astype(np.int64), -1)
        s = symbol.astype(np.int16)[order]
        dealt = np.argsort(s, kind="stable")
        s = s[dealt]
        # least common prefix over the old places between new neighbours
        left, right = dealt[:-1], dealt[1:]
        same = (s[1:] == s[:-1]) & (s[1:] >= 0)
        fresh = np.zeros(n, dtype=np.int64)
        if same.any():
            fresh[1:][same] = 1 + range_least(common, left[same] + 1, right[same])
        order, common = order[dealt], fresh
        if r + 1 >= LENGTH:
            hit = common >= LENGTH
            hit[:-1] |= common[1:] >= LENGTH
            for i in order[hit].tolist():
                marks[i][at[i]] = True
    return marks


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, by a table of powers of two."""
    span = last - first + 1
    out = values[first].copy()
    wide = np.flatnonzero(span > 1)
    if len(wide):
        level = np.floor(np.log2(span[wide])).astype(np.int64)
        table = values
        for k in range(1, int(level.max()) + 1):
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
            own = wide[level == k]
            if len(own):
                out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
    return out


def runs_of(mark: np.ndarray, start: int) -> list[tuple[int, int]]:
    """(first byte, behind last byte) covered by each run of marked windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    return [(start + a, start + b - 1 + LENGTH) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


SEGMENTS = "a long, b long, key long, start int, windows int, tail int, whole boolean, least int, most int, bytes binary"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(a, b, start, stop): byte spans covered by strings of LENGTH that start at another place too (spans may overlap).

    ``docs`` has a key of two longs for each row (a, b) and text. Equal windows share an anchor
    gram, so only anchors whose gram stands at two places or more matter. Of those:
    anchors with equal surroundings (128-bit digest) elsewhere are covered whole; where
    surroundings differ, one segment for each kind goes to its anchor's collection, which is
    sorted column by column. What is grouped is written before it is joined: a join of two
    plain exchanges is one that adaptive execution can split at a frequent gram.
    """
    anchors = store(anchor_table(docs), "anchors")
    digest, place = F.struct("high", "low"), F.struct("a", "b", "start")
    grams = anchors.groupBy("key").agg(F.count("*").alias("places"), F.min(digest).alias("_low"), F.max(digest).alias("_high"))
    keys = store(grams.filter("places > 1").select("key", (F.col("_low") == F.col("_high")).alias("alike")), "grams")
    found = store(anchors.join(keys, "key"), "found")
    mixed = found.filter("not alike")
    kinds = store(mixed.groupBy("key", "high", "low").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "kinds")
    columns = ["a", "b", "key", "start", "windows", "anchor"]
    suspects = store(
        found.filter("alike").select(*columns, F.lit(True).alias("whole"), F.lit(False).alias("send"))
        # a kind's first place stands for the kind
        .union(mixed.join(kinds, ["key", "high", "low"]).select(*columns, (F.col("copies") > 1).alias("whole"), (place == F.col("first")).alias("send"))),
        "suspects",
    )
    whole = suspects.filter("whole").select("a", "b", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("stop"))
    asked = suspects.filter("send").groupBy("a", "b").agg(F.collect_list(F.struct("key", "start", "windows", "anchor", "whole")).alias("asked"))  # a document's anchors
    schema = arrow_schema(SEGMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, text, wanted in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), unpacked(batch.column("text")), batch.column("asked").to_pylist()):
                for w in wanted:
                    stop = w["start"] + w["windows"] + LENGTH - 1
                    out.append((a, b, w["key"], w["start"], w["windows"], stop - w["anchor"], w["whole"], 0, SPAN, text[w["start"] : stop]))
            for i in range(0, len(out), 5000):
                yield record_batch(schema, list(zip(*out[i : i + 5000])))

    return whole.union(sorted_spans(store(packed(docs).join(asked, ["a", "b"]).mapInArrow(cut, SEGMENTS), "segments")))


def sorted_spans(segments: DataFrame) -> DataFrame:
    """The spans of windows that equal windows of another segment of the same key.

    A key of more segments than one collection holds is parted by the distance of windows
    from their anchor, half by half, until its parts fit. Equal windows have equal distances,
    and the narrower the distances, the more bytes around the anchor all windows of a
    segment share: these bytes enter the parts' keys. At one distance the key is the
    window itself, and only one kind is left.
    """
    out = None
    while True:
        crowded = store(segments.groupBy("key").count().filter(F.col("count") > COLLECTION).select("key"), "crowded")
        last = crowded.isEmpty()
        spans = collections_of(segments if last else segments.join(crowded, "key", "left_anti"))
        out = spans if out is None else out.union(spans)
        if last:
            return out
        segments, spans = halves(segments.join(crowded, "key", "left_semi"))
        out = out.union(spans)


def collections_of(segments: DataFrame) -> DataFrame:
    ddl = "a long, b long, start int, stop int"
    schema = arrow_schema(ddl)

    def collection(rows: list[tuple]) -> list[tuple]:
        marks = column_insertion([r[5] for r in rows], [r[4] for r in rows])
        return [(r[1], r[2], a, b) for r, mark in zip(rows, marks) if not r[6] for a, b in runs_of(mark, r[3])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(x).to_pylist() for x in ("key", "a", "b", "start", "tail", "bytes", "whole")))
            if len(held) >= COLLECTION:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:  # the last key's segments may go on
                    cut -= 1
                if cut and (spans := collection(held[:cut])):
                    yield record_batch(schema, list(zip(*spans)))
                held = held[cut:]
        if held and (spans := collection(held)):
            yield record_batch(schema, list(zip(*spans)))

    return segments.select("key", "a", "b", "start", "tail", "whole", "bytes").repartition("key").sortWithinPartitions("key", "a", "b", "start").mapInArrow(run, ddl)


def halves(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments parted at the middle of their distances from the anchor, one for each kind, and the spans of kinds with copies."""
    ddl = SEGMENTS + ", high long, low long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, start, windows, tail, whole, least, most, data in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "start", "windows", "tail", "whole", "least", "most", "bytes"))):
                anchor, middle = len(data) - tail, (least + most) // 2
                for low, high in ((least, middle), (middle, most)):  # windows at distances low to high - 1
                    first, last = max(0, anchor - high + 1), min(windows - 1, anchor - low)
                    if first <= last:
                        part = data[first : last + LENGTH]
                        shared = data[anchor - low : anchor + LENGTH - high + 1]
                        key = xxhash.xxh3_64_intdigest(shared, low * 256 + high) - (1 << 63)
                        out.append((a, b, key, start + first, last - first + 1, len(part) - anchor + first, whole, low, high, part))
            if out:
                digest = digests([bytes((len(r[9]) - r[5],)) + r[9] for r in out])
                yield record_batch(schema, [*zip(*out), digest[:, 0], digest[:, 1]])

    parts = store(segments.drop("high", "low").dropDuplicates(["key", "a", "b", "start"]).mapInArrow(run, ddl), "parts")
    place = F.struct("a", "b", "start")
    kinds = store(parts.groupBy("key", "high", "low").agg(F.count("*").alias("copies"), F.max("whole").alias("any_whole"), F.min(place).alias("first")), "part-kinds")
    met = store(parts.join(kinds, ["key", "high", "low"]), "met")
    spans = met.filter("copies > 1 and not whole").select("a", "b", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("stop"))
    stand = met.filter(place == F.col("first")).withColumn("whole", F.col("any_whole") | (F.col("copies") > 1))
    return stand.select(*(c.split()[0] for c in SEGMENTS.split(", "))), spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs``, texts packed, with _spans, each document's repeated spans.

    A row is known by 128 bits of hashes of its id and text, so ids may repeat or be null; rows
    alike in both share their spans, as each is a copy of the other.
    """
    a, b = row_key("doc_id", "text")
    spans = repeated_spans(docs.select(a.alias("a"), b.alias("b"), "text"))
    grouped = spans.groupBy("a", "b").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))  # a document's spans
    return packed(docs.select("*", a.alias("_a"), b.alias("_b"))).join(grouped.withColumnsRenamed({"a": "_a", "b": "_b"}), ["_a", "_b"], "left")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` without the bytes of repeated strings, plus n_bytes, n_removed, n_spans and kept_sha256.

    Every byte covered by a LENGTH-byte string that starts anywhere else too goes, from all
    its places; strings never cross rows; they are judged on the input. In the returned text,
    parts of a character that a cut left over go as well; kept_sha256 is over the bytes as cut.
    Null text counts as empty and stays null. n_chars follows where it exists. An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    joined = with_spans(docs)
    extra = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields
    rest = [f for f in docs.schema.fields if f.name not in {x.name for x in extra}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(unpacked(batch.column("text")), batch.column("_spans").to_pylist()):
                data, runs = text or b"", merged([(s["start"], s["stop"]) for s in spans or ()])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((None if text is None else kept.decode("utf-8", "ignore"), len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            text, *more = ([x[i] for x in out] for i in range(5))
            columns = [pa.array(text, pa.string()) if f.name == "text" else batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in zip(more, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=[f.name for f in (*rest, *extra)])

    out = joined.select(*(f.name for f in rest), "_spans").mapInArrow(run, StructType([*rest, *extra]))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
