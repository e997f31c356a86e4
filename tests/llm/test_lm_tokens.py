import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapeflow.llm import lm_scoring


def odd_texts():
    r = random.Random(1)
    letters = [chr(c) for c in range(40)] + list("AZaz") + ["é", "\x85", " ", " ", "İ", "Σ", "日", " "]
    return [None, "", " ", "\t a  B\x0b\x0c\r\n c "] + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(2000)]


def test_tokens_are_those_of_bytes():
    texts = odd_texts()
    for column in (pa.chunked_array([texts]), pa.chunked_array([pa.array(texts[:9]).slice(2), pa.array(["x", *texts[9:]]).slice(1)])):
        want, starts = [], []
        for x in column.to_pylist():
            starts.append(len(want))
            want += [*(x or "").encode().lower().split(), b""]
        words, numbers, at = lm_scoring.tokens_of(column)
        names = words.to_pylist()
        assert [names[i] for i in numbers] == want and at.tolist() == starts and len(set(names)) == len(names)


@pytest.mark.parametrize("size", [1, 50, 1000, 10**9])
def test_slices_keep_all_rows(size):
    texts = odd_texts()
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "row"])
    parts = list(lm_scoring.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 9)]), size))
    assert [x for p in parts for x in p["row"].to_pylist()] == [*range(len(texts)), *range(3, 12)]
    assert max(len("".join(x or "" for x in p["text"].to_pylist()[:-1]).encode()) for p in parts) < size


def test_the_most_frequent_tokens_travel(spark, monkeypatch):
    """A count's share of the corpus as the bound left most of the room unused, so many rows of text and token met counts in the join."""
    monkeypatch.setattr(lm_scoring, "COMMON_TOKENS", 300)
    counts = spark.range(1, 1001).select((10_000 / F.col("id")).cast("long").alias("n"))
    total, distinct, above = lm_scoring.count_steps(counts)
    travel = counts.filter(lm_scoring.count_step() > above)
    assert (total, distinct) == (counts.agg(F.sum("n")).first()[0], 1000) and 250 < travel.count() <= 300
    assert counts.filter(F.col("n") > total / 300).count() < 100
    assert travel.agg(F.min("n")).first()[0] > counts.filter(lm_scoring.count_step() <= above).agg(F.max("n")).first()[0]
    assert lm_scoring.count_steps(counts.filter("n < 0")) == (0, 0, -1)
