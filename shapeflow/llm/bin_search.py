"""Best-fit packing of documents into as few sequences as possible, by swap-based local search."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches, store
from shapeflow.llm.merge_ranks import ranks_decide, word_encoder
from shapeflow.llm.tokenization import vocabulary_path, worker_table

WINDOW = 2048
DOCUMENT_END = 0
#: Pieces that one task packs together, about: what bounds its memory.
POOL = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", row long, sequence_id long, offset long"


class Fillings:
    """For every amount that underfull bins could give away, a bin that could do so and has the most room.

    ``most[y]`` is the most room of a bin that could give ``y`` away; entries that a change made stale are taken off
    when they come up.
    """

    def __init__(self) -> None:
        self.most = np.zeros(WINDOW + 1, dtype=np.int64)
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(WINDOW + 1)]

    def offer(self, amounts: set[int], room: int, bin_: int, version: int) -> None:
        for y in amounts:
            heapq.heappush(self.heaps[y], (-room, bin_, version))
            if room > self.most[y]:
                self.most[y] = room

    def partner(self, given: int, bins: Bins, donor: int) -> tuple[int, int] | None:
        """(bin, amount) such that the bin grows by as much as it has room for when it takes ``given`` for the amount."""
        top = min(given, WINDOW + 1)
        while True:
            fits = np.flatnonzero(self.most[1:top] >= np.arange(given - 1, given - top, -1))
            if not len(fits):
                return None
            y = int(fits[0]) + 1  # the least amount: the bin grows most
            heap, skipped, found = self.heaps[y], [], None
            while heap:
                room, b, version = heap[0]
                if bins.version[b] != version:
                    heapq.heappop(heap)
                elif b == donor:
                    skipped.append(heapq.heappop(heap))
                else:
                    found = b if -room >= given - y else None
                    break
            rest = -heap[0][0] if heap else 0
            for x in skipped:
                heapq.heappush(heap, x)
            self.most[y] = rest
            if found is not None:
                return found, y


class Bins:
    """Bins of piece lengths: best fit, long to short, then the local search."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = lengths
        self.items: list[list[int]] = []
        self.load: list[int] = []
        self.total = sum(lengths)
        self.best_fit()
        self.version = [0] * len(self.items)
        self.alive = len(self.items)

    def best_fit(self) -> None:
        room: list[list[int]] = [[] for _ in range(WINDOW + 1)]  # bins by what still fits
        used = 0  # bits of the rooms that have a bin
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            need = self.lengths[i]
            enough = used >> need
            if enough:
                fit = need + (enough & -enough).bit_length() - 1
                b = room[fit].pop()
                if not room[fit]:
                    used ^= 1 << fit
                self.items[b].append(i)
                self.load[b] += need
            else:
                fit, b = WINDOW, len(self.items)
                self.items.append([i])
                self.load.append(need)
            if fit > need:
                room[fit - need].append(b)
                used |= 1 << fit - need

    def changed(self, b: int) -> None:
        self.version[b] += 1
        room = WINDOW - self.load[b]
        if room and self.items[b]:
            own = {self.lengths[i] for i in self.items[b]}
            self.single.offer(own, room, b, self.version[b])
            self.double.offer(self.pair_sums(b), room, b, self.version[b])
            heapq.heappush(self.by_room[room], (b, self.version[b]))
            self.rooms |= 1 << room

    def pair_sums(self, b: int) -> set[int]:
        """Sums of two of a bin's pieces. Distinct lengths in a bin are 63 at most, so these are few whatever it holds."""
        own = sorted(self.lengths[i] for i in self.items[b])
        distinct = sorted(set(own))
        sums = {x + y for k, x in enumerate(distinct) for y in distinct[k + 1 :]}
        return sums | {2 * x for x, y in zip(own, own[1:]) if x == y}

    def roomiest_fit(self, need: int, donor: int) -> int | None:
        """The fullest bin but the donor that still takes ``need``."""
        enough = self.rooms >> need
        while enough:
            room = need + (enough & -enough).bit_length() - 1
            heap, skipped, found = self.by_room[room], None, None
            while heap:
                b, version = heap[0]
                if self.version[b] != version:
                    heapq.heappop(heap)
                elif b == donor:
                    skipped = heapq.heappop(heap)
                else:
                    found = b
                    break
            if skipped:
                heapq.heappush(heap, skipped)
            if found is not None:
                return found
            if not heap:
                self.rooms &= ~(1 << room)
            enough = self.rooms >> room + 1 << room + 1 - need
        return None

    def give(self, donor: int, out: list[int], other: int, back: list[int]) -> None:
        """The donor's pieces ``out`` against ``back`` of another bin."""
        for i in out:
            self.items[donor].remove(i)
        for i in back:
            self.items[other].remove(i)
        self.items[donor] += back
        self.items[other] += out
        moved = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
        self.load[donor] -= moved
        self.load[other] += moved
        self.changed(other)
        self.changed(donor)

    def pick(self, b: int, amount: int, two: bool) -> list[int]:
        """One piece, or two, of a bin that come to ``amount``."""
        seen: dict[int, int] = {}
        for i in self.items[b]:
            n = self.lengths[i]
            if not two and n == amount:
                return [i]
            if two and amount - n in seen:
                return [seen[amount - n], i]
            seen[n] = i
        raise AssertionError("no such pieces")

    def step(self, donor: int) -> bool:
        """One change that makes the donor emptier and a fuller bin fuller by as much, so squared fill rises."""
        own = sorted({self.lengths[i] for i in self.items[donor]}, reverse=True)
        for n in own:  # move a piece
            b = self.roomiest_fit(n, donor)
            if b is not None and self.load[b] + n > self.load[donor]:
                self.give(donor, self.pick(donor, n, False), b, [])
                return True
        for given, fillings, two_out, two_back in (
            *((n, self.single, False, False) for n in own), *((n, self.double, False, True) for n in own),
            *((n, self.single, True, False) for n in sorted(self.pair_sums(donor), reverse=True)),
        ):
            met = fillings.partner(given, self, donor)
            if met and self.load[met[0]] + given - met[1] > self.load[donor]:
                self.give(donor, self.pick(donor, given, two_out), met[0], self.pick(met[0], met[1], two_back))
                return True
        return False

    def search(self) -> None:
        """Empties bins, the emptiest first, until there are as few as the tokens fill or no exchange helps."""
        least = -(-self.total // WINDOW)
        if self.alive <= least:
            return
        self.single, self.double = Fillings(), Fillings()
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(WINDOW + 1)]
        self.rooms = 0
        for b in range(len(self.items)):
            self.changed(b)
        emptied = True
        while emptied and self.alive > least:
            emptied = False
            for donor in sorted((b for b in range(len(self.items)) if self.items[b] and self.load[b] < WINDOW), key=lambda b: (self.load[b], b)):
                while self.items[donor] and self.step(donor):
                    pass
                if not self.items[donor]:
                    emptied = True
                    self.alive -= 1
                    if self.alive <= least:
                        break

    def packed(self) -> list[list[int]]:
        return [x for x in self.items if x]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids with its end, cut into pieces of WINDOW; the last piece has what is left."""
    by_rank = ranks_decide(path)
    small_batches(docs.sparkSession)
    schema = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path, by_rank)
        table = worker_table(path, f"ids, {by_rank}", own.ids)
        end = np.array([DOCUMENT_END], dtype="<u4").tobytes()
        size = 4 * WINDOW
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                ids = b"".join(map(table.__getitem__, own.chunks(text))) + end
                out += [(doc_id, k // size, k // 4, len(own_ids) // 4, zlib.crc32(own_ids)) for k in range(0, len(ids), size) for own_ids in (ids[k : k + size],)]
            yield record_batch(schema, list(zip(*out)) or [[]] * len(schema))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack_pools(rows: DataFrame, pools: int, first: int, last: bool) -> DataFrame:
    """Packs each pool of pieces by itself. Sequences at most half full stay open (null sequence_id), but not in the ``last`` round."""
    schema = arrow_schema(PACKED)

    def packed(pool: int, own: list[tuple]) -> pa.RecordBatch:
        bins = Bins([r[3] for r in own])
        bins.search()
        out = []
        for k, items in enumerate(bins.packed()):
            offset, open_ = 0, not last and 2 * sum(own[i][3] for i in items) <= WINDOW
            for i in items:
                out.append((*own[i], None if open_ else (first + pool << 24) + k, offset))
                offset += own[i][3]
        return record_batch(schema, list(zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, own = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("pool", *schema.names[:6])]
            for number, *row in zip(*columns):
                if number != pool:
                    if own:
                        yield packed(pool, own)
                    pool, own = number, []
                own.append(tuple(row))
        if own:
            yield packed(pool, own)

    dealt = rows.withColumn("pool", F.pmod(F.xxhash64("row"), F.lit(pools)).cast("int"))
    return dealt.repartition(pools, "pool").sortWithinPartitions("pool", "row").mapInArrow(run, PACKED)


def pack_whole(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents and where in which sequence each lies; documents longer than WINDOW alone are cut.

    Whole windows are sequences of their own. The other pieces are dealt evenly over pools of about POOL pieces, each
    packed in one task: best fit, then a local search that empties bins by moving pieces to fuller bins, by exchanging one
    for one, and two for one either way, each time raising the sum of squared fills. A pool's sequences that are at most
    half full (hardly more than one) meet those of other pools in further rounds, while that makes pools far fewer. Pieces are
    written before they are dealt, so a task that is run again packs the same pool alike.

    Null text counts as empty: one piece, the end token. Repeated rows and rows without an id are packed like others;
    ties in length keep their order in the table. An empty table gives an empty result.
    """
    rows = store(pieces(docs, path or vocabulary_path()).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = rows.filter(F.col("length") == WINDOW).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    out, left, first, before = whole, rows.filter(F.col("length") < WINDOW), 0, None
    while True:
        pools = max(1, -(-left.count() // POOL))
        last = pools == 1 or before is not None and 2 * pools > before
        packed = pack_pools(left, pools, first, last)
        if last:
            return out.unionByName(packed).drop("row")
        packed = store(packed, "packed")
        out = out.unionByName(packed.filter(F.col("sequence_id").isNotNull()))
        left, first, before = packed.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset"), first + pools, pools


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(documents(spark, sf_dir))
