"""Hierarchical multi-length packing of token ids into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches
from shapeflow.llm.merge_ranks import ranks_decide, word_encoder
from shapeflow.llm.tokenization import vocabulary_path, worker_table

WINDOW = 4096
#: Context sizes, short to long; each is a power of two, so a full sequence of any of them has no padding.
TIERS = (256, 1024, 4096)
DOCUMENT_END = 2
#: Tokens that a task gathers before it packs them.
POOL_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group int"


class Packer:
    """Packs a pool of documents; what can't fill a sequence waits for the next pool.

    A document's whole windows of the longest tier leave at once. The rest goes to the
    shortest tier that holds it, and each tier packs its pieces, long to short, each into the
    fullest open sequence that still takes it (best fit); sequences that become exactly full
    leave. The gaps of long windows are then closed with pieces of the emptiest short sequences,
    the gaps of a tier's other sequences with pieces of its own emptiest, cut where a gap ends;
    less than a sequence of each tier waits. At the end what waits is cut into tiers.
    """

    def __init__(self, base: int, groups: int, first_group: int = 0) -> None:
        self.next_id, self.groups, self.first_group = base, groups, first_group
        self.load = {t: [0] * groups for t in TIERS}  # tokens of each tier given to each step group
        self.waiting: list[tuple] = []  # (doc_id, ids, start, stop, doc_tokens)

    def emit(self, pieces: list[tuple], out: list[tuple]) -> None:
        length = sum(p[3] - p[2] for p in pieces)
        tier = next(t for t in TIERS if length <= t)
        load = self.load[tier]
        group = min(range(self.groups), key=lambda g: (load[g], (g - self.first_group) % self.groups))
        load[group] += length if length & (length - 1) == 0 else WINDOW
        offset = 0
        for doc_id, ids, start, stop, total in pieces:
            out.append((doc_id, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), total, self.next_id, offset, tier, group))
            offset += stop - start
        self.next_id += 1

    def pack(self, last: bool) -> list[tuple]:
        out: list[tuple] = []
        tiers: dict[int, list[tuple]] = {t: [] for t in TIERS}
        for doc_id, ids, start, stop, total in self.waiting:
            while stop - start >= WINDOW:
                self.emit([(doc_id, ids, start, start + WINDOW, total)], out)
                start += WINDOW
            if stop > start:
                tiers[next(t for t in TIERS if stop - start <= t)].append((doc_id, ids, start, stop, total))
        short = [(t, left, window) for t in TIERS[:-1] for left, window in self.best_fit(tiers[t], t, out)]
        short.sort(key=lambda x: x[1] / x[0])
        self.waiting = self.close(self.best_fit(tiers[WINDOW], WINDOW, out), short, out)
        for tier in TIERS[:-1]:
            self.waiting += self.close([(left, window) for t, left, window in short if t == tier], [], out)
        while self.waiting and last:
            self.waiting = self.run_out(out)
        return out

    def best_fit(self, pieces: list[tuple], size: int, out: list[tuple]) -> list[tuple[int, list]]:
        """Emits the sequences of ``size`` that become exactly full; (room, pieces) of the others, fullest first."""
        room: list[list] = [[] for _ in range(size + 1)]  # open sequences by what still fits
        used = 0  # bits of the rooms that have a sequence
        for p in sorted(pieces, key=lambda p: p[3] - p[2], reverse=True):
            need = p[3] - p[2]
            enough = used >> need
            if enough:
                fit = need + (enough & -enough).bit_length() - 1
                window = room[fit].pop()
                if not room[fit]:
                    used ^= 1 << fit
            else:
                fit, window = size, []
            window.append(p)
            if fit > need:
                room[fit - need].append(window)
                used |= 1 << fit - need
            else:
                self.emit(window, out)
        return [(r, w) for r in range(1, size + 1) for w in room[r]]

    def close(self, opened: list[tuple[int, list]], donors: list[tuple], out: list[tuple]) -> list[tuple]:
        """Emits open sequences, fullest first, filled with pieces of the donors' last, then of the emptiest of their own; returns what is left over."""
        pool: list[tuple] = []
        at, end = 0, len(opened)
        while at < end:
            left, window = opened[at]
            at += 1
            while left:
                if not pool:
                    if donors:
                        pool = donors.pop()[2]
                    elif end > at:
                        end -= 1
                        pool = opened[end][1]
                    else:
                        return window
                doc_id, ids, start, stop, total = pool.pop()
                take = min(left, stop - start)
                window.append((doc_id, ids, start, start + take, total))
                left -= take
                if start + take < stop:
                    pool.append((doc_id, ids, start + take, stop, total))
            self.emit(window, out)
        return pool

    def run_out(self, out: list[tuple]) -> list[tuple]:
        total = sum(p[3] - p[2] for p in self.waiting)
        window, at, left = [], 0, max((t for t in TIERS if t <= total), default=total)
        rest = list(self.waiting)
        while left:
            doc_id, ids, start, stop, tokens = rest[at]
            take = min(left, stop - start)
            window.append((doc_id, ids, start, start + take, tokens))
            left -= take
            if start + take < stop:
                rest[at] = (doc_id, ids, start + take, stop, tokens)
            else:
                at += 1
        self.emit(window, out)
        return rest[at:]


def pack_documents(docs: DataFrame, path: str | None = None, groups: int = 8) -> DataFrame:
    """Pieces of all documents: where each begins in its document, and where in which sequence.

    Each task packs its own partition, pool by pool, so nothing is shuffled and a lost task is
    made anew alike; at most the last sequence of a partition is padded (when the last
    tokens are fewer than the shortest tier and no power of two). Sequence ids hold the
    partition's number in their upper bits. ``step_group`` deals each tier's sequences over ``groups`` groups of nearly equal
    tokens: within a task a tier's groups differ by one sequence at most, and tasks start at different
    groups, so over the whole table they differ by one sequence a task at the very most. Null text counts as empty: one piece, the end
    token. Repeated rows are packed again; an empty table gives an empty result.
    """
    path = path or vocabulary_path()
    by_rank = ranks_decide(path)
    small_batches(docs.sparkSession)
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path, by_rank)
        table = worker_table(path, f"ids, {by_rank}", own.ids)
        part = TaskContext.get().partitionId()
        packer, pooled = Packer(part << 40, groups, part % groups), 0
        end = np.array([DOCUMENT_END], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                ids = np.frombuffer(b"".join(map(table.__getitem__, own.chunks(text))) + end, dtype="<u4")
                packer.waiting.append((doc_id, ids, 0, len(ids), len(ids)))
                pooled += len(ids)
                if pooled >= POOL_TOKENS:
                    yield record_batch(schema, list(zip(*packer.pack(False))) or [[]] * len(schema))
                    pooled = 0
        if rows := packer.pack(True):
            yield record_batch(schema, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
