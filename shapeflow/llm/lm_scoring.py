"""Language-model scoring with quantised counts in a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, documents, record_batch, small_batches, store

#: Least count of a pair of words in the model. Pairs met once are as many as the corpus is long and tell nothing of the next text.
LEAST = 2
#: Share of its own relative frequency that a known pair keeps; the rest goes to single words.
DISCOUNT = 0.9
BLOCK_BYTES = 4096
HASHES = 6
#: Most levels: counts are below 2 to this power.
LEVELS = 60
#: Bits for each (n-gram, level) entry, and the most bytes of the whole filter: the broadcast's bound.
ENTRY_BITS = 12
FILTER_BYTES = 64 << 20
#: Most tokens whose exact counts travel to the workers, the most frequent ones; all others meet their counts in a join.
COMMON_TOKENS = 400_000
#: Tokens with their counts that a task gathers before it sums them up and hands them on.
TABLE_ENTRIES = 400_000
#: Bytes of texts whose words are numbered together.
TEXT_BYTES = 4 << 20
#: N-grams that a task gathers before it hands their counts on, and training tokens for each bucket of counts.
SLICE, BUCKET_TOKENS = 1 << 21, 1 << 20
START = np.uint64(0x5851F42D4C957F2D)


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 7 != 2


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)): the number of entries that stand for a count."""
    return np.floor(np.log2(counts)).astype(np.int64) + 1


class Plan(NamedTuple):
    """What the filter takes, and what its levels stand for.

    entries: of all n-grams in it. least: the least level of words and of pairs in it. share: what part of all pairs in
    the training texts its pairs are. means: for words and for pairs, the mean count of those of each level; at
    0, of the words that the filter leaves out (0 where it has all, and for pairs). counted: what part the pairs are that
    were counted, in the filter or not.
    """

    entries: int
    least: tuple[int, int]
    share: float
    means: tuple[np.ndarray, np.ndarray]
    counted: float


def blocks_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each n-gram, in the order of the n-grams, so that a sorted run of them fills blocks one after another."""
    return ((grams >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def places(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit and step of the HASHES bits that stand for a level of each n-gram in its block, of which 16 bits count: a block has 2 ** 15."""
    g = mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF))
    return g.astype(np.uint16), (g >> np.uint64(32)).astype(np.uint16) | np.uint16(1)


def bit_at(first: np.ndarray, step: np.ndarray, k: int) -> np.ndarray:
    return (first + step * np.uint16(k)) & np.uint16(BLOCK_BYTES * 8 - 1)


def levels(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Quantised counts by repeated membership probes: the number of levels found before the first miss."""
    base = blocks_of(grams, len(table) // BLOCK_BYTES) * BLOCK_BYTES
    out, alive, level = np.zeros(len(grams), dtype=np.int64), np.arange(len(grams)), 1
    while len(alive) and level <= LEVELS:
        first, step = places(grams, level)

        def found(k: int) -> np.ndarray:
            bit = bit_at(first, step, k)  # noqa: B023
            return table[base + (bit >> np.uint16(3))] >> (bit & np.uint16(7)).astype(np.uint8) & np.uint8(1)  # noqa: B023

        at = np.flatnonzero(found(0))  # most n-grams that are not there end at their first bit
        alive, grams, base, first, step = alive[at], grams[at], base[at], first[at], step[at]
        at = np.flatnonzero(np.bitwise_and.reduce([found(k) for k in range(1, HASHES)]))
        alive, grams, base = alive[at], grams[at], base[at]
        out[alive] = level
        level += 1
    return out


def false_count_rate(table: np.ndarray) -> float:
    """Chance that an n-gram that is not in the filter is found there: all HASHES bits of its block are set by others."""
    filled = np.bitwise_count(table.reshape(-1, BLOCK_BYTES)).sum(axis=1) / (BLOCK_BYTES * 8)
    return float((filled**HASHES).mean())


def slices(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.Table]:
    """The rows of batches in runs of about ``size`` bytes of text (TEXT_BYTES), one row at least; the last run may be shorter."""
    size = size or TEXT_BYTES
    own, held = [], 0
    for batch in batches:
        upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            end = min(batch.num_rows, max(at + 1, int(np.searchsorted(upto, upto[at] + size - held))))
            own.append(batch.slice(at, end - at))
            held += int(upto[end] - upto[at])
            at = end
            if held >= size:
                yield pa.Table.from_batches(own)
                own, held = [], 0
    if own:
        yield pa.Table.from_batches(own)


def count_steps(counts: DataFrame) -> tuple[int, int, int]:
    """Sum and number of all counts, and the least step above which there are COMMON_TOKENS at most. Steps are eight to a doubling."""
    rows = counts.groupBy(count_step().alias("step")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()  # eight rows a level at most
    above, held = -1, 0
    for r in rows:
        held += r["tokens"]
        if held > COMMON_TOKENS:
            above = r["step"]
            break
    return sum(r["n"] for r in rows), sum(r["tokens"] for r in rows), above


def count_step() -> Column:
    return F.floor(F.log2("n") * 8)


class Tokens(NamedTuple):
    """Tokens of some texts: each text's words and one end, the empty word.

    words: the distinct ones, the end last. numbers: each token's place in ``words``. starts: where each text's tokens start.
    """

    words: pa.Array
    numbers: np.ndarray
    starts: np.ndarray


def tokens_of(texts: pa.ChunkedArray) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.combine_chunks(), "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0  # blanks at an edge leave an empty piece
    upto = np.append(0, np.cumsum(real))[offsets - offsets[0]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    texts_before = np.arange(len(lists))
    numbers = np.full(int(upto[-1]) + len(lists), len(coded.dictionary), dtype=np.int64)
    word = np.ones(len(numbers), dtype=bool)
    word[upto[1:] + texts_before] = False
    numbers[word] = coded.indices.to_numpy()
    return Tokens(pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], type=pa.binary())]), numbers, upto[:-1] + texts_before)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows of ``docs``: words and one end (the empty string) for each text."""
    schema = arrow_schema("token binary, n long")

    def summed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return iter(pa.Table.from_batches(held, schema).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(schema.names).to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in slices(batches):
            words, numbers, _ = tokens_of(rows["text"])
            held.append(record_batch(schema, [words, np.bincount(numbers, minlength=len(words))]))
            if sum(x.num_rows for x in held) > TABLE_ENTRIES:
                yield from summed(held)
                held = []
        yield from summed(held)

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def single_grams(words: np.ndarray) -> np.ndarray:
    """64-bit codes of single words, from their hashes; the lowest bit is 0."""
    return mix(words) & ~np.uint64(1)


def pair_grams(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit codes of pairs; the lowest bit is 1."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words) | np.uint64(1)


def before_each(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each word of several texts laid one behind another; START before a text's first."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[starts] = START
    return out


def shifted(values: np.ndarray, starts: np.ndarray, first: float) -> np.ndarray:
    """The value of the word before each word; ``first`` before a text's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes for an exchange: bytes of one weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gram_counts(docs: DataFrame, tokens: int) -> DataFrame:
    """(gram, n): every word and every pair of words of every row, counted; pairs from LEAST on.

    Each task counts slices of its texts and hands on sorted runs, one for each range of codes,
    as differences. There are as many ranges as ``tokens`` asks for, so a range fits one task
    however large the corpus; a pair that a third of all texts hold is one number a slice.
    """
    bits = max(4, math.ceil(math.log2(max(1, tokens / BUCKET_TOKENS))))
    run_schema, schema = arrow_schema("bucket int, codes binary, counts binary"), arrow_schema("gram long, n long")

    def hand_on(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (codes >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        ranges = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        steps = [np.diff(codes[s:e], prepend=np.uint64(0)) for s, e in ranges]
        return record_batch(run_schema, [bucket[edge[:-1]].astype(np.int32), [squeezed(x) for x in steps], [squeezed(counts[s:e].astype(np.uint32)) for s, e in ranges]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rows in slices(batches):
            distinct, numbers, starts = tokens_of(rows["text"])
            words = word_hashes(distinct.to_pylist())[numbers]
            held += [single_grams(words), pair_grams(before_each(words, starts), words)]
            if sum(map(len, held)) >= SLICE:
                yield hand_on(held)
                held = []
        if held:
            yield hand_on(held)

    def merged(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        codes = np.concatenate([np.cumsum(unsqueezed(c, np.uint64), dtype=np.uint64) for c, _ in parts])
        codes, counts = counted(codes, np.concatenate([unsqueezed(n, np.uint32) for _, n in parts]).astype(np.int64))
        kept = (counts >= LEAST) | (codes & np.uint64(1) == 0)
        return record_batch(schema, [codes[kept].view(np.int64), counts[kept]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            for bucket, *part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "codes", "counts"))):
                if bucket != own:
                    if parts:
                        yield merged(parts)
                    own, parts = bucket, []
                parts.append(part)
        if parts:
            yield merged(parts)

    runs = docs.select("text").mapInArrow(run, "bucket int, codes binary, counts binary")
    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "gram long, n long")


def filter_plan(counts: DataFrame) -> Plan:
    """The filter's plan from counts of n-grams by level.

    All n-grams enter while their entries fit FILTER_BYTES. Beyond it, the least level of pairs rises until they do,
    then that of words, and the chance of a false count stays what ENTRY_BITS makes it. The counts of n-grams that are left out
    are looked up in a join (``open_scores``), so the bound changes no score. A scorer that has the filter alone gives words
    that are left out the mean of their counts, so chances still sum to one.
    """
    level = F.floor(F.log2("n")) + 1
    pair = F.col("gram").bitwiseAND(1) == 1
    rows = counts.groupBy(level.alias("level"), pair.alias("pair")).agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()  # two rows a level at most
    all_pairs = max(1, sum(r["n"] for r in rows if not r["pair"]))  # each token ends one pair
    top = max((r["level"] for r in rows), default=0)
    least = [1, 1]
    inside = lambda r: r["level"] >= least[r["pair"]]
    while (entries := sum(r["grams"] * r["level"] for r in rows if inside(r))) * ENTRY_BITS > FILTER_BYTES * 8:
        least[1 if least[1] <= top else 0] += 1
    means = np.zeros((2, LEVELS + 1))
    for r in rows:
        means[int(r["pair"]), r["level"]] = r["n"] / r["grams"]
    out = [r for r in rows if not r["pair"] and not inside(r)]
    means[0, 0] = sum(r["n"] for r in out) / max(1, sum(r["grams"] for r in out))
    part = lambda kept: sum(r["n"] for r in rows if r["pair"] and kept(r)) / all_pairs
    return Plan(entries, (least[0], least[1]), part(inside), (means[0], means[1]), part(lambda r: True))


def build_filter(counts: DataFrame, plan: Plan) -> np.ndarray:
    """The blocked Bloom filter over (gram, n).

    Tasks make the blocks of the n-grams they read, which are mostly whole runs of blocks, as counts lie in the order of
    n-grams; parts of one block meet in a task and are laid over each other, and the driver collects each block once:
    FILTER_BYTES at most, whatever the corpus holds.
    """
    blocks = max(1, -(-plan.entries * ENTRY_BITS // 8 // BLOCK_BYTES))
    least = np.array(plan.least)
    schema = arrow_schema("block long, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            grams, top = batch.column("gram").to_numpy().view(np.uint64), level_of(batch.column("n").to_numpy())
            inside = top >= least[(grams & np.uint64(1)).astype(np.int64)]
            grams, top = grams[inside], top[inside]
            block = blocks_of(grams, blocks)
            for level in range(1, int(top.max(initial=0)) + 1):
                at = np.flatnonzero(top >= level)
                at = at[np.argsort(block[at], kind="stable")]
                first, step = places(grams[at], level)
                bits = np.stack([bit_at(first, step, k) for k in range(HASHES)], axis=1)
                edge = np.flatnonzero(np.concatenate(([True], block[at][1:] != block[at][:-1], [True])))
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    own.setdefault(int(block[at[s]]), np.zeros(BLOCK_BYTES * 8, dtype=bool))[bits[s:e].ravel()] = True
            if len(own) > 64:  # blocks seldom come again
                yield record_batch(schema, [list(own), [np.packbits(x, bitorder="little").tobytes() for x in own.values()]])
                own = {}
        if own:
            yield record_batch(schema, [list(own), [np.packbits(x, bitorder="little").tobytes() for x in own.values()]])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, np.zeros(BLOCK_BYTES, dtype=np.uint8)
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                if block != at and at is not None:
                    yield record_batch(schema, [[at], [bits.tobytes()]])
                if block != at:
                    at, bits = block, np.zeros(BLOCK_BYTES, dtype=np.uint8)
                bits |= np.frombuffer(part, dtype=np.uint8)
        if at is not None:
            yield record_batch(schema, [[at], [bits.tobytes()]])

    parts = counts.mapInArrow(run, "block long, bits binary").repartition("block").sortWithinPartitions("block")
    table = np.zeros(blocks * BLOCK_BYTES, dtype=np.uint8)
    for r in parts.mapInArrow(over, "block long, bits binary").collect():
        table[r["block"] * BLOCK_BYTES : (r["block"] + 1) * BLOCK_BYTES] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table


class Scorer:
    """log10 probability of each token behind the token before it, from quantised counts.

    P1(w) = (c(w) + 1) / (N + V + 1). Behind a word u that training has:
    P(w | u) = DISCOUNT * c(u, w) / c(u) + (1 - DISCOUNT * s) * P1(w), where s is the share of all
    training pairs that the filter's pairs are. Behind an unknown word P1 alone holds. All counts c come from
    membership probes, and a level stands for the mean count of its words or pairs, so that what the filter holds sums
    to what the corpus does: P1 over all words and the unknown one sums to one (but for false counts), and
    P( | u) does so on average over the training texts' contexts.
    """

    def __init__(self, table: np.ndarray, plan: Plan, total: int, distinct: int) -> None:
        self.table, self.share, self.size, self.means = table, plan.share, total + distinct + 1, plan.means
        self.start = float(self.counts(word_hashes([b""]))[0])  # as many starts as ends

    def counts(self, words: np.ndarray) -> np.ndarray:
        return self.means[0][levels(self.table, single_grams(words))]

    def logs(self, words: np.ndarray, singles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``words`` are hashes and ``singles`` their counts, of texts laid one behind another."""
        pairs, back = np.unique(pair_grams(before_each(words, starts), words), return_inverse=True)
        return self.chances(self.means[1][levels(self.table, pairs)][back], shifted(singles, starts, self.start), singles)

    def chances(self, both: np.ndarray, before: np.ndarray, singles: np.ndarray) -> np.ndarray:
        alone = (singles + 1) / self.size
        known = DISCOUNT * np.minimum(1.0, both / np.maximum(before, 1)) + (1 - DISCOUNT * self.share) * alone
        return np.log10(np.where(before > 0, known, alone))


class OpenPairs(NamedTuple):
    """Pairs of texts for which the filter does not settle the score, each text's once.

    text: the text's place. times: how often it has the pair. pair: its code. before, word: codes of the words that the
    filter leaves out, else null. before_level, word_level: levels of those that it has, else 0.
    """

    text: np.ndarray
    times: np.ndarray
    pair: np.ndarray
    before: pa.Array
    word: pa.Array
    before_level: np.ndarray
    word_level: np.ndarray


def settled(scorer: Scorer, least: tuple[int, int], words: np.ndarray, level: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, OpenPairs]:
    """log10 probability of each token, 0 where counts that the filter leaves out are needed, and those pairs.

    ``words`` are hashes and ``level`` their levels in the filter. An n-gram is in the filter from the least level
    on, so one found below it is left out, or not there at all. A pair is counted from LEAST on: a word met less often has none.
    """
    first = int(levels(scorer.table, single_grams(word_hashes([b""])))[0])
    ahead = shifted(level, starts, first)
    codes = pair_grams(before_each(words, starts), words)
    pairs, back = np.unique(codes, return_inverse=True)
    both = levels(scorer.table, pairs)[back]
    no_word, no_before = level < least[0], ahead < least[0]
    possible = np.minimum(level, ahead) >= level_of(np.array([LEAST]))[0]
    if least[0] == 1:
        no_word[:] = no_before[:] = False
    opened = no_word | no_before | (possible & (both < least[1]))
    level, ahead = np.where(no_word, 0, level), np.where(no_before, 0, ahead)
    logs = np.where(opened, 0.0, scorer.chances(np.where(both < least[1], 0.0, scorer.means[1][both]), scorer.means[0][ahead], scorer.means[0][level]))
    at = np.flatnonzero(opened)
    text = np.searchsorted(starts, at, side="right") - 1
    keys, where, times = np.unique(text * len(pairs) + back[at], return_index=True, return_counts=True)
    at = at[where]
    ends = np.where(np.isin(at, starts), word_hashes([b""])[0], before_each(words, starts)[at])
    code = lambda hashes, out: pa.array(single_grams(hashes).view(np.int64), mask=~out)
    return logs, OpenPairs(keys // max(1, len(pairs)), times, codes[at].view(np.int64), code(ends, no_before[at]), code(words[at], no_word[at]), ahead[at], level[at])


def open_scores(pairs: DataFrame, counts: DataFrame, plan: Plan, size: int) -> DataFrame:
    """(row, score): what ``OpenPairs`` add to the score of each row, by the counts of the n-grams that the filter leaves out."""
    level = lambda n: F.length(F.bin(n))
    mean = lambda kind, at: F.get(F.array(*(F.lit(float(x)) for x in plan.means[kind])), at)
    is_pair = F.col("gram").bitwiseAND(1) == 1
    rest = counts.filter(level(F.col("n")) < F.when(is_pair, plan.least[1]).otherwise(plan.least[0]))

    def met(rows: DataFrame, key: str, kind: int, name: str) -> DataFrame:
        own = rest.filter(is_pair if kind else ~is_pair).select(F.col("gram").alias(key), mean(kind, level(F.col("n"))).alias(name))
        return rows.join(own, key, "left")

    n_before, n_word = mean(0, F.col("before_level")), mean(0, F.col("word_level"))
    if plan.least[0] == 1:
        rows = met(pairs.select("row", "times", "pair", "before_level", "word_level"), "pair", 1, "_both")
    else:  # where the filter has the word, the key is the pair's code, which is no word's: nulls would meet in one task
        rows = met(pairs.withColumns({c: F.coalesce(c, "pair") for c in ("before", "word")}), "pair", 1, "_both")
        rows = met(met(rows, "before", 0, "_before"), "word", 0, "_word")
        n_before, n_word = F.coalesce("_before", n_before), F.coalesce("_word", n_word)
    alone = (n_word + 1) / F.lit(float(size))
    known = DISCOUNT * F.least(F.lit(1.0), F.coalesce("_both", F.lit(0.0)) / F.greatest(n_before, F.lit(1.0))) + (1 - DISCOUNT * plan.counted) * alone
    return rows.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.when(n_before > 0, known).otherwise(alone))).alias("score"))


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    base_score: smoothed unigrams over words and an end, with exact counts: common tokens are
    summed in the tasks by a bounded table, all others meet their counts in a join on the
    token. score: log10 probability of the tokens under the Bloom-filter model; where the filter is too small for all
    n-grams, texts' pairs that it doesn't settle are written, and meet the counts left out in a join on the code. Null text counts
    as empty: one end token. Rows repeated with one id give one row each; rows without an id are scored like others; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = store(token_counts(training), "token-counts")
    total, distinct, above = count_steps(counts)
    often = counts.filter(count_step() > above).toArrow()  # COMMON_TOKENS at most
    common = spark.sparkContext.broadcast(dict(zip(often["token"].to_pylist(), often["n"].to_pylist())))
    grams = store(gram_counts(training, total), "gram-counts")
    plan = filter_plan(grams)
    least, whole = plan.least, plan.least == (1, 1)
    plan = plan._replace(share=plan.counted, means=(np.append(0.0, plan.means[0][1:]), plan.means[1]))  # the join has what the filter leaves out
    model = spark.sparkContext.broadcast((build_filter(grams, plan), plan, total, distinct))  # FILTER_BYTES at most
    ddl = "doc_id long, row long, token binary, times long, n_tokens long, n_known long, logs double, score double"
    ddl += "" if whole else ", pair long, before long, word long, before_level int, word_level int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, exact = Scorer(*model.value), common.value
        for part in slices(batches):
            ids, row_numbers = part["doc_id"].combine_chunks(), part["row"].to_numpy()
            words, numbers, starts = tokens_of(part["text"])
            known_words = words.to_pylist()
            hashes = word_hashes(known_words)
            level = levels(scorer.table, single_grams(hashes))
            logs = np.log10(np.fromiter(map(exact.get, known_words, repeat(0)), dtype=np.float64, count=len(words)) + 1)  # of each word: log of its exact count plus one if it is common, else 0
            sizes = np.diff(np.append(starts, len(numbers)))
            own = logs[numbers]
            if whole:
                of_tokens = scorer.logs(hashes[numbers], plan.means[0][level][numbers], starts)
            else:
                of_tokens, opened = settled(scorer, least, hashes[numbers], level[numbers], starts)
            score = np.add.reduceat(of_tokens, starts)
            known, base = np.add.reduceat((own > 0).astype(np.int64), starts), np.add.reduceat(own, starts)
            # one row of each text itself, under a token that no text has
            yield record_batch(schema, [
                ids, row_numbers, [b" %d" % r for r in row_numbers.tolist()], np.zeros(len(ids), dtype=np.int64), sizes, known, base, score,
                *(pa.nulls(len(ids), f.type) for f in list(schema)[8:])])
            # rarer tokens: one row for each text and token
            rare = np.flatnonzero(own == 0)
            keys, times = np.unique(np.repeat(np.arange(len(ids)), sizes)[rare] * len(words) + numbers[rare], return_counts=True)
            text, word = keys // len(words), keys % len(words)
            yield record_batch(schema, [pa.nulls(len(keys), pa.int64()), row_numbers[text], words.take(pa.array(word)), times, *(pa.nulls(len(keys), f.type) for f in list(schema)[4:])])
            if not whole and len(opened.text):
                blanks = [pa.nulls(len(opened.text), f.type) for f in list(schema)]
                yield record_batch(schema, [blanks[0], row_numbers[opened.text], blanks[2], opened.times, *blanks[4:8], *opened[2:]])

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, ddl)
    if not whole:
        rows = store(rows, "scored")
        opened = open_scores(rows.filter(F.col("pair").isNotNull()), grams, plan, total + distinct + 1)
        rows = rows.filter(F.col("pair").isNull()).select(*rows.columns[:8])
    met = rows.join(counts, "token", "left")
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("logs") + F.sum(F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") + 1)).otherwise(0.0))).alias("logs"), F.sum("score").alias("score"))
    if not whole:
        sums = sums.join(opened.withColumnRenamed("score", "_more"), "row", "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0)))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, docs.filter(in_training(F.col("doc_id"))))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
