"""The pipeline against its stages done plainly, in order."""

from collections import defaultdict

import corpus_pipeline as pipeline
from shapeflow.llm import line_dedup
from shapeflow.llm.common import store
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_text_operators import brute_suffix, data

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxicity, line_stage, near_stage, passages, packing = (f for _, f in pipeline.STAGES)
    clean = store(toxicity(spark, docs, sf), "t0")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == COLUMNS and all(i in kept for i, t in labels.items() if t == 0)  # on so few labels no clean document goes

    lines = store(line_stage(spark, clean, sf), "t1")
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    seen = set()
    for i in sorted(texts):
        own, out = data(texts[i]).split(b"\n"), []
        for s, e in line_dedup.chunk_bounds(own):
            chunk, telling = tuple(own[s:e]), sum(1 for x in own[s:e] if x.strip()) >= 2
            out += () if telling and chunk in seen else chunk
            seen |= {chunk} if telling else set()
        texts[i] = b"\n".join(out).decode()
    rows = {r["doc_id"]: r for r in lines.collect()}
    assert {i: r["text"] for i, r in rows.items()} == texts and lines.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in rows.values())

    near = store(near_stage(spark, lines, sf), "t2")
    ids = sorted(texts)
    assert {r["doc_id"] for r in near.collect()} == {ids[k] for k in brute_kept([texts[i] for i in ids])} and near.columns == COLUMNS

    cut = store(passages(spark, near, sf), "t3")
    left = sorted((r["doc_id"], r["text"]) for r in near.collect())
    expected = {i: kept.decode("utf-8", "ignore") for (i, _), (kept, _) in zip(left, brute_suffix([data(t) for _, t in left]))}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == expected

    pieces = packing(spark, cut, sf).collect()
    tokens, total = defaultdict(int), {}
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
        total[r["doc_id"]] = r["doc_tokens"]
    assert tokens == total and set(total) == set(expected)
    assert sum(r["length"] for r in pipeline.run(spark, sf).collect()) == sum(total.values())


def test_stages_take_odd_documents(make, odd, spark):
    docs = make([*odd, "a document without an id stays " * 3], [*range(len(odd)), None]).withColumnsRenamed({"keep_id": "n_bytes", "digest": "lines_removed"})
    for name, stage in pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "lines_removed", "score"], name
        assert docs.filter("doc_id is null").count() == 1 and docs.filter("doc_id = 0").first()["text"] is None, name
    assert pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
