"""Near copies against all pairs' shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shapeflow.llm import line_dedup, near_copies, simhash
from shapeflow.llm.common import store
from shapeflow.llm.near_copies import shingles


def brute_kept(texts):
    """Places of the texts that stay, if each one's id is its place."""
    sets = [set(shingles((t or "").encode()).tolist()) for t in texts]
    near = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    root, before = list(range(len(texts))), None
    while root != before:
        before = list(root)
        for i, js in enumerate(near):
            root[i] = min(root[j] for j in js)
    return {i for i, r in enumerate(root) if r == i}


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = "edit%d" % rng.randrange(10**6)
    return out


def test_near_copies_reach_four_fifths(make, odd, spark):
    rng, texts = random.Random(5), list(odd)
    for k in range(40):
        words = ["w%d" % rng.randrange(10**5) for _ in range(120 + 5 * k)]
        texts += [" ".join(words), " ".join(edited(words, 1 + k % 3, rng)), " ".join(edited(words, 6, rng))]
    kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, make(texts), "").collect()}
    assert kept == brute_kept(texts) and len(odd) < len(kept) < len(texts) - 30


def test_near_copies_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {rows[i][0] for i in brute_kept([t for _, t in rows])}


def test_repeated_rows_and_rows_without_ids_stay_once(make, spark):
    long = [" ".join("%s%d" % (k, i) for i in range(90)) for k in "abc"]
    docs = make([long[0], long[0], long[1], long[1], long[2], long[2]], [7, 7, None, 3, None, None])
    near = store(pipeline.drop_near_copies(spark, docs, ""), "near")
    assert sorted((r["doc_id"] or -1, r["text"]) for r in near.collect()) == [(-1, long[2]), (3, long[1]), (7, long[0])]
    cut = pipeline.cut_repeated_passages(spark, near, "")
    assert sorted(r["text"] for r in cut.collect()) == sorted(long)


def test_row_without_id_is_never_first(make):
    text = "shared a b\nshared c d"  # one chunk
    got = line_dedup.remove_repeated_chunks(make([text] * 3, [None, 4, 5])).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {None: "", 4: text, 5: ""}


@pytest.mark.parametrize("part", [600, 5_000])
def test_parted_cells_lose_no_link(make, monkeypatch, spark, part):
    """A large group of copies, chains whose ends differ, and rows that share a band with the group but not its words."""
    monkeypatch.setattr(near_copies, "PART", part)
    rng = random.Random(9)
    words = ["w%d" % rng.randrange(10**5) for _ in range(150)]
    texts = [" ".join(edited(words, rng.randrange(4), rng)) for _ in range(120)]
    for _ in range(40):  # each a few words from the one before
        words = edited(words, 3, rng)
        texts.append(" ".join(words))
    rng.shuffle(texts)
    assert {r["doc_id"] for r in pipeline.drop_near_copies(spark, make(texts), "").collect()} == brute_kept(texts)


def test_links_among_rows_away_from_the_pivot(make, monkeypatch, spark):
    """All rows in one cell, many groups in it: parts and blocks must find each group whole."""
    monkeypatch.setattr(near_copies, "PART", 300)
    rng, texts = random.Random(3), []
    for k in range(12):
        words = ["w%d" % rng.randrange(10**5) for _ in range(60)]
        texts += [" ".join(edited(words, x % 2, rng)) for x in range(6)]
    rng.shuffle(texts)
    links = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda first, numbered: links(first.withColumn("bands", F.array(F.lit(7).cast("long"))), numbered))
    whole = {r["doc_id"] for r in pipeline.drop_near_copies(spark, make(texts), "").collect()}
    assert whole == brute_kept(texts) and len(whole) == 12


def test_rows_that_op5_links_are_copies_too(make, spark):
    """Shingles that repeat weigh more in a fingerprint: below 0.8 as sets, within op5's radius. Before, both rows stayed."""
    block = " ".join("w%d" % i for i in range(40))
    texts = [" ".join([block] * 20 + ["%s%d" % (k, i) for i in range(14)]) for k in "ab"] + [" ".join("v%d" % i for i in range(60))]
    assert brute_kept(texts) == {0, 1, 2} and simhash.bit_difference(*(np.array([simhash.fingerprint(t.encode(), 4)], dtype=np.uint64) for t in texts[:2]))[0] <= simhash.RADIUS
    docs = make([*texts, texts[1]], [5, 3, 1, None])
    assert sorted(r["doc_id"] for r in dict(pipeline.STAGES)["near-copy dedup"](spark, docs, "").collect()) == [1, 3]


def test_no_two_rows_that_stay_are_linked_by_op5(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    near = store(dict(pipeline.STAGES)["near-copy dedup"](spark, docs, ""), "near")
    assert simhash.simhash_groups(near, width=4).select("component_id").distinct().count() == near.count()  # 1 less before
