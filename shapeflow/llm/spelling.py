"""Spelling variants of words by anagram hashing."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches, store
from shapeflow.operators.ranks import numbered_within

#: Shortest words, fewest occurrences, and how much more frequent a word's form is.
LETTERS, TIMES, RATIO = 7, 2, 10
#: One occurrence of a word in a document in so many loses a letter.
SLIP = 31
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LETTERS)
#: A letter's value is this power of its code point.
POWER = 5
VALUE = {chr(k): k**POWER for k in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))}
#: Words that a task counts before it hands them on.
TABLE_ENTRIES = 400_000
#: Longer words are told apart by a polynomial hash, whose value without one letter takes one step.
LONG = 256
PRIME, BASE = (1 << 127) - 1, 0x1F3D5B79A8C6E4205B0F1E2D3C4B5A69
BASE_INVERSE = pow(BASE, -1, PRIME)


def slipped(doc_id: int | None, runs: Counter) -> Iterator[tuple[str, int]]:
    """The words of one document with their numbers: a run whose checksum SLIP divides loses a letter."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), start)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LETTERS:
            yield word, n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of LETTERS letters or more, counted in the tasks before it is shuffled."""
    schema = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                for word, n in slipped(doc_id, Counter(RUN.findall(text.lower().decode("utf-8", "replace")))):
                    own[word] += n
                if len(own) > TABLE_ENTRIES:
                    yield record_batch(schema, [list(own), list(own.values())])
                    own = Counter()
        yield record_batch(schema, [list(own), list(own.values())])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def anagram_value(word: str) -> int:
    """Sum of the letters' values; words of the same letters have the same."""
    return sum(map(VALUE.__getitem__, word))


def signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def anagram_keys(words: DataFrame) -> DataFrame:
    """(key, place, letter): each word under its own value (letter null) and under its value less each of its letters'.

    Two words that differ by an added or removed letter meet where the longer one leaves that letter out; two that
    differ by an exchange meet where each leaves its own letter out.
    """
    ddl = "key long, place long, letter string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, letters = [], [], []
            for place, word in zip(batch.column("place").to_pylist(), batch.column("word").to_pylist()):
                value, own = anagram_value(word), [None, *sorted(set(word))]
                keys += [signed(value - VALUE.get(x, 0)) for x in own]
                places += [place] * len(own)
                letters += own
            yield record_batch(schema, [keys, places, letters])

    return words.select("place", "word").mapInArrow(run, ddl)


def digest(word: str) -> bytes:
    """128 bits of a string of letters."""
    if len(word) <= LONG:
        return xxhash.xxh3_128_digest(word.encode("latin-1"))
    value, step = 0, 1
    for c in word:
        value, step = (value + ord(c) * step) % PRIME, step * BASE % PRIME
    return value.to_bytes(16, "big")


def digests_without(word: str, letters: set[str]) -> Iterator[tuple[int, bytes]]:
    """(position, digest of the word without the letter there) wherever it has one of ``letters``."""
    if len(word) - 1 <= LONG:
        for at, c in enumerate(word):
            if c in letters:
                yield at, digest(word[:at] + word[at + 1 :])
        return
    before, step = [0], 1
    for c in word:
        before.append((before[-1] + ord(c) * step) % PRIME)
        step = step * BASE % PRIME
    for at, c in enumerate(word):
        if c in letters:
            yield at, ((before[at] + (before[-1] - before[at + 1]) * BASE_INVERSE) % PRIME).to_bytes(16, "big")


def letter_orders(words: DataFrame) -> DataFrame:
    """(rest, position, place): digests of what is left of each word without one letter, for the letters that a key
    asks for; position -1 is the whole word."""
    ddl = "rest binary, position int, place long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests, positions, places = [], [], []
            for place, word, letters, whole in zip(*(batch.column(c).to_pylist() for c in ("place", "word", "letters", "whole"))):
                own = list(digests_without(word, set(letters)))
                if whole:
                    own.append((-1, digest(word)))
                rests += [x for _, x in own]
                positions += [x for x, _ in own]
                places += [place] * len(own)
            yield record_batch(schema, [rests, positions, places])

    return words.mapInArrow(run, ddl)


def near_words(words: DataFrame) -> DataFrame:
    """(place, n_near, best) of each word that has near words: how many, and the place of the first of them.

    Keys are counted first, and only those where words can meet bring their words back: by a join on the counted key,
    so that however many anagrams share a key, they neither come into one task nor meet each other. Their letters'
    order is then verified by what is left without the letter: words alike in that, and in its position, differ by an
    exchange there (as many as the alphabet has letters at most); a word that equals what is left of another lacks one letter.
    """
    keys = anagram_keys(words)
    cells = keys.groupBy("key").agg(F.count("letter").alias("without"), (F.count("*") - F.count("letter")).alias("whole"))
    met = keys.join(cells.filter("without > 1 OR without > 0 AND whole > 0").select("key"), "key")
    asked = met.groupBy("place").agg(F.collect_set("letter").alias("letters"), F.max(F.col("letter").isNull()).alias("whole"))
    rests = store(letter_orders(asked.join(words.select("place", "word"), "place").select("place", "word", "letters", "whole")), "letter-orders")

    exchanged = rests.filter("position >= 0").groupBy("rest", "position").agg(F.array_sort(F.collect_list("place")).alias("own")).filter("size(own) > 1")
    member = exchanged.select("own", F.explode("own").alias("place"))
    by_exchange = member.select("place", (F.size("own") - 1).cast("long").alias("n_near"), F.when(F.get("own", F.lit(0)) == F.col("place"), F.get("own", F.lit(1))).otherwise(F.get("own", F.lit(0))).alias("best"))

    longer = rests.filter("position >= 0").select("rest", F.col("place").alias("longer")).distinct()
    pairs = rests.filter("position < 0").select("rest", F.col("place").alias("shorter")).join(longer, "rest")
    ways = F.explode(F.array(F.struct(F.col("shorter").alias("place"), F.col("longer").alias("best")), F.struct(F.col("longer").alias("place"), F.col("shorter").alias("best"))))
    by_letter = pairs.select(ways.alias("w")).select("w.place", F.lit(1).cast("long").alias("n_near"), "w.best")
    return by_exchange.union(by_letter).groupBy("place").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """(place, form, root) of links (place, form), each to a word at least RATIO times as frequent, ``most`` at most.

    Each round doubles the length of the links that roots have followed, so the rounds' number is that of the
    logarithm of the longest chain, which RATIO bounds.
    """
    own = store(links.withColumn("root", F.col("form")), "spelling-links")
    longest = max(1, math.ceil(math.log(max(2, most / TIMES), RATIO)))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = own.select(F.col("place").alias("root"), F.col("root").alias("_further"))
        own = store(own.join(further, "root", "left").select("place", "form", F.coalesce("_further", "root").alias("root")), "spelling-links")
    return own


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of LETTERS letters or more that occurs TIMES times or more.

    Words are numbered by falling frequency, then in code-point order, so a word's form is its near word of the
    smallest number, if that is RATIO times as frequent. Null and empty texts have no words; a row without an id
    has an empty one before the colon of its checksums; repeated rows count again. Words that differ in one letter are
    told by 128-bit digests of what they share. An empty table, or one without such words, gives an empty result.
    """
    small_batches(docs.sparkSession)
    counted = word_counts(docs).filter(F.col("n") >= TIMES).select("word", "n", F.struct((-F.col("n")).alias("n"), "word").alias("_order"), F.lit(0).alias("_all"))
    words = store(numbered_within(counted, "_all", "_order", "place").select("place", "word", "n"), "spelling-words")
    near = store(near_words(words), "near-words")
    best = words.select(F.col("place").alias("best"), F.col("n").alias("form_n"), F.col("word").alias("form"))
    linked = store(near.join(words.select("place", "n"), "place").join(best, "best").filter(F.col("form_n") >= RATIO * F.col("n")).select("place", "best", "form", "form_n"), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(linked.select("place", F.col("best").alias("form")), most).select("place", F.col("root").alias("_root"))
    named = ends.join(words.select(F.col("place").alias("_root"), F.col("word").alias("root")), "_root").select("place", "root")
    forms = linked.select("place", "form", "form_n").join(named, "place")
    out = words.join(near.select("place", "n_near"), "place", "left").join(forms, "place", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
rests AS (SELECT word, n, p, left(word, p::INT) || substr(word, p::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM rests a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM rests a JOIN words w ON a.rest = w.word),
near AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min((-other_n, other)) AS best FROM pairs GROUP BY word),
forms AS (SELECT word, best[2] AS form, -best[1] AS form_n FROM near WHERE -best[1] >= 10 * n),
chain AS (
  SELECT word, form AS place FROM forms
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.place),
ends AS (SELECT word, place AS root FROM chain WHERE place NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(near.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN near ON near.word = w.word LEFT JOIN forms f ON f.word = w.word LEFT JOIN ends e ON e.word = w.word
"""
