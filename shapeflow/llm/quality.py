"""Quality rules: fixed rules first, then a calibrated n-gram classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches
from shapeflow.llm.ngram_model import MIX_B, char_codes, code_buckets, fit_logistic, fit_platt, sigmoid, word_codes

BITS = 18
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    words = text.split()
    joined = b" ".join(words)
    points = len(joined.decode("utf-8", "replace")) - max(0, len(words) - 1)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points, symbols, len(lines) - len(set(lines)), repeated_words(words, joined)


def repeated_words(words: list[bytes], joined: bytes) -> int:
    """Words covered by windows of WINDOW words that stand twice or more in the text.

    Hashes of windows find the texts that may have any; there windows are compared as bytes.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    places = np.flatnonzero(np.isin(keys, twice))
    seen: dict[bytes, list[int]] = {}
    for i in places.tolist():
        seen.setdefault(joined[starts[i] : ends[i + WINDOW - 1]], []).append(i)
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                step[i] += 1
                step[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(step)))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def feature_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character and of the word n-grams (words and pairs) of a whole text."""
    chars = code_buckets(char_codes(text), BITS - 1)
    w = word_codes(text.split())
    pairs = w[:-1] * MIX_B ^ w[1:]
    return chars, code_buckets(np.concatenate((w, pairs)), BITS - 1) + np.uint32(1 << (BITS - 1))


def raw_score(weights: np.ndarray, bias: float, text: bytes) -> float:
    """Mean weight of the character n-grams plus that of the word n-grams, plus the bias."""
    chars, words = feature_codes(text)
    return sum(float(weights[x].mean(dtype=np.float64)) * SCALE for x in (chars, words) if len(x)) + bias


#: Features are shares of a text's n-grams, scaled so that weights stay near one.
SCALE = 40.0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, seed: int = 0) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and calibration from at most ``max_rows`` labelled rows, the first by a hash of the id.

    Labels 1 are good rows. A fifth of the sample, by hash too, is held back for the
    calibration. Without rows of both labels the model accepts everything.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("target"))
    chosen = known.withColumn("rank", F.xxhash64("doc_id", F.lit(seed))).orderBy("rank", "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    ddl = "rank long, target int, buckets binary, shares binary"  # int32 and float32 arrays
    schema = arrow_schema(ddl)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text in byte_texts(batch.column("text")):
                both = [np.unique(x, return_counts=True) for x in feature_codes(text)]
                out[0].append(np.concatenate([k for k, _ in both]).astype(np.int32).tobytes())
                out[1].append(np.concatenate([c / max(1, c.sum()) * SCALE for _, c in both]).astype(np.float32).tobytes())
            yield record_batch(schema, [batch.column("rank"), batch.column("target").cast(pa.int32()), *out])

    rows = sorted(sample.mapInArrow(features, ddl).collect(), key=lambda r: (r["rank"], r["buckets"]))
    target = np.array([r["target"] for r in rows], dtype=np.float64)
    if not 0 < target.sum() < len(target):
        return np.zeros(1 << BITS, dtype=np.float32), 10.0, 1.0, 0.0
    row = np.repeat(np.arange(len(rows)), [len(r["buckets"]) // 4 for r in rows])
    buckets, shares = (np.frombuffer(b"".join(r[k] for r in rows), dtype=t) for k, t in (("buckets", np.int32), ("shares", np.float32)))
    del rows
    held = np.arange(len(target)) % 5 == 4
    inside = ~held[row]
    place = np.cumsum(~held) - 1
    weights, bias = fit_logistic(place[row[inside]], buckets[inside], shares[inside], target[~held], 1 << BITS)
    z = np.bincount(row, shares * weights[buckets], minlength=len(target)) + bias
    return weights, bias, *fit_platt(z[held], target[held])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float, float, float], threshold: float = 0.5) -> DataFrame:
    """doc_id, the rule counts, base_failed, score (probability of good) and kept, for each row of ``docs``.

    Null text counts as empty, which fails the rules. Rows are judged one by one, so repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS weights
    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    schema = arrow_schema(ddl)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, shift = shared.value
        for batch in batches:
            out = []
            for text in byte_texts(batch.column("text")):
                counts = rule_counts(text)
                failed = base_failed(counts[0], counts[4])
                score = sigmoid(slope * raw_score(weights, bias, text) + shift)
                out.append((*counts, failed, score, not failed and score >= threshold))
            yield record_batch(schema, [batch.column("doc_id"), *([x[i] for x in out] for i in range(8))])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, ddl)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small_batches(spark)
    return score_quality(docs, train(docs, documents(spark, sf_dir, "labels")))
