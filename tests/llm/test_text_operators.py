"""Each operator against a plain brute-force version on small, odd inputs."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from shapeflow.llm import components, exact_dedup, license_scan, line_dedup, lm_scoring, packing, quality, simhash, suffix_dedup, tokenization, toxicity


def data(text):
    return (text or "").encode()


def test_exact_groups(make, odd):
    texts = [*odd, *["hot COPY"] * 300]
    for digest in (exact_dedup.sha256_hex, lambda c: (F.length(c) % 3).cast("string")):  # the second makes digests collide
        rows = {r["doc_id"]: r for r in exact_dedup.exact_groups(make(texts), digest=digest, salts=3).collect()}
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[data(t).lower()].append(i)
        for own in groups.values():
            for i in own:
                assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (max(own), len(own), i == max(own))


def test_exact_groups_odd_ids(make):
    rows = exact_dedup.exact_groups(make(["a", "A", "a", "b"], [None, 7, 7, None])).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == {(None, 7, 3, False): 1, (7, 7, 3, True): 2, (None, None, 1, True): 1}
    assert exact_dedup.exact_groups(make([])).count() == 0


def brute_suffix(texts, n=suffix_dedup.LENGTH):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        out.append((bytes(x for x, m in zip(t, mark) if not m), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))))
    return out


@pytest.mark.parametrize("most", [20_000, 3])  # 3: nearly every anchor is parted by distance, many times over
def test_suffix_dedup(make, odd, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", most)
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    shared = noise(260)
    texts = [*odd, *(noise(150) + shared[k % 40 :] + noise(150) for k in range(12)), noise(199) * 2, noise(201) * 2, "é" * 150 + "x", "é" * 150]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(make(texts)).collect()}
    for i, (kept, spans) in enumerate(brute_suffix([data(t) for t in texts])):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(data(texts[i])) - len(kept), spans, hashlib.sha256(kept).hexdigest()), i
    assert got[0]["text"] is None and suffix_dedup.remove_repeated(make([])).count() == 0


def test_suffix_dedup_repeated_rows(make):
    text = "abcdefghij" * 30
    rows = suffix_dedup.remove_repeated(make([text, text, "short"], [4, 4, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 300, 300]


def test_column_insertion_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 400).astype(np.uint8).tobytes()
    segments = [base[a:] for a in (0, 3, 10, 100)] + [base[:250] + b"zz" + base[252:], rng.integers(97, 100, 300).astype(np.uint8).tobytes()]
    marks = suffix_dedup.column_insertion(segments, [350 - 200] * len(segments))
    n = suffix_dedup.LENGTH
    for i, s in enumerate(segments):
        for w in range(len(s) - n + 1):
            right = len(s) - w
            others = any(len(o) >= right and o[len(o) - right :][:n] == s[w : w + n] for j, o in enumerate(segments) if j != i)
            assert marks[i][w] == others


def test_line_dedup_ids(make):
    """Rows of one id with different texts are documents of their own, as are rows without an id; rows alike are one place."""
    two, own = "a a\nb b", "unique one\nunique two"
    rows = line_dedup.remove_repeated_chunks(make([two, two, own, two, own, own], [1, 2, 2, None, None, None])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == {(1, two): 1, (2, ""): 1, (2, own): 1, (None, ""): 3}
    rows = line_dedup.remove_repeated_chunks(make([own, own], [None, None])).collect()
    assert [r["text"] for r in rows] == [own, own]


def test_runs_read_one_batch_at_a_time():
    from shapeflow.llm.common import whole_runs

    read = []

    def batches():
        for i, keys in enumerate([[1, 1, 2], [2, 2], [2], [2, 3], [], [4, 5]]):
            read.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())] * 2, names=["k", "v"])

    runs = whole_runs(batches(), "k", "v")
    assert next(runs)[0].tolist() == [1, 1] and read == [0]
    assert [x.tolist() for x, _ in runs] == [[2, 2, 2, 2, 2], [3], [4], [5]][:1] + [[3, 4]] + [[5]]


def test_dense_cells_lose_no_link():
    rng = np.random.default_rng(8)
    own = np.unique(rng.integers(0, 2**63, 900).astype(np.int64))
    near = np.array([x ^ sum(1 << int(k) for k in rng.choice(63, 4, replace=False)) for x in own[:300].tolist()], dtype=np.int64)
    a, b = simhash.cell_links(np.unique(np.concatenate((own, near))))
    linked = {frozenset(x) for x in zip(a, b)}
    assert all(simhash.bit_difference(np.array([x]), np.array([y]))[0] <= simhash.RADIUS for x, y in zip(a, b))
    assert all(frozenset((x, y)) in linked for x, y in zip(own[:300].tolist(), near.tolist()))


def brute_fingerprint(text, width):
    words = data(text).lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(make, odd):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(0, 400, 9)]
    texts = [*odd, *near, *["hot copy of one text"] * 50]
    rows = sorted(simhash.simhash_groups(make(texts), 4).collect(), key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(t, 4) for t in texts]
    assert [r["fp"] & (1 << 64) - 1 for r in rows] == fps
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert [r["component_id"] for r in rows] == root
    assert simhash.simhash_groups(make([])).count() == 0


def test_grid_reaches_every_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300).astype(np.int64)
    for bits in range(5):
        b = np.array([x ^ int(sum(1 << int(k) for k in rng.choice(63, bits, replace=False))) for x in a.tolist()], dtype=np.int64)
        ca, oa = simhash.grid_cells(a)
        cb, ob = simhash.grid_cells(b)
        cells = defaultdict(set)
        for c, o in zip(ca.tolist(), oa.tolist()):
            cells[o].add(c)
        meets = {(o, c) for o, c in zip(ob.tolist(), cb.tolist())}
        other = defaultdict(set)
        for o, c in meets:
            other[o].add(c)
        assert all(cells[x] & other[y] for x, y in zip(a.tolist(), b.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    rows = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(61)) and {rows[90], rows[95], rows[100]} == {90} and rows[201] == 200


def test_line_dedup(make, odd):
    texts = [*odd, *["own %d\nshared a b\nshared c d\nshared e f\nshared g h\nbye" % k for k in range(6)]]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_chunks(make(texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        lines, kept = data(t).split(b"\n") if t is not None else [], []
        for s, e in line_dedup.chunk_bounds(lines):
            chunk = tuple(lines[s:e])
            telling = sum(1 for x in chunk if x.strip()) >= 2
            if not (telling and chunk in seen):
                kept += chunk
            if telling:
                seen.add(chunk)
        assert data(got[i]["text"]) == b"\n".join(kept), i
        assert got[i]["lines_removed"] == len(lines) - len(kept)
    assert any(r["lines_removed"] for r in got.values()) and line_dedup.remove_repeated_chunks(make([])).count() == 0


def test_line_chunks_shift_resistant():
    lines = [b"line %d" % i for i in range(200)]
    a = {tuple(lines[s:e]) for s, e in line_dedup.chunk_bounds(lines)}
    moved = [b"new", *lines]
    b = {tuple(moved[s:e]) for s, e in line_dedup.chunk_bounds(moved)}
    assert len(a & b) > 0.8 * len(a)


def test_license_scan(make, odd):
    texts = [*odd, "Released under the MIT\nLicense.", "pad " * 127 + "GNU General Public License and the Apache License, Apache-license", "cc-by cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of that software"]
    rows = {r["doc_id"]: r for r in license_scan.scan(make(texts)).collect()}
    import re

    for i, t in enumerate(texts):
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data(t).lower())]
        places = [(k, label) for phrase, label, base in license_scan.TEMPLATES if base for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))), i
    assert rows[len(odd)]["labels"] == "mit,mit-notice" and rows[len(texts) - 1]["labels"] == "mit-text"
    assert license_scan.scan(make([])).count() == 0


def test_automaton_equals_library(make, odd):
    from tokenizers import Tokenizer

    path = tokenization.vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    texts = [*odd, "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>'s don't WE'LL ²Ⅷ 123", "".join(chr(c) for c in rng.integers(32, 0x3400, 2000)), "hahahaha lololol banana mississippi " * 3]
    texts += [" ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 15))) for _ in range(300))]
    rows = {r["doc_id"]: r for r in tokenization.encode_documents(make(texts)).collect()}
    digests = {r["doc_id"]: r for r in tokenization.encode_digests(make(texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == decoded, i
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_packing(make, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenization.vocabulary_path())
    rows = packing.pack_documents(make(odd)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(odd):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.DOCUMENT_END], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding < 4 * packing.WINDOW and packing.pack_documents(make([])).count() == 0


def brute_scores(texts, training):
    """(n_tokens, n_known, train_tokens, base score, model score) of each text with plain counts, quantised as the model does."""
    tokens = [[*data(t).lower().split(), b""] for t in texts]
    counts = Counter(x for own, t in zip(tokens, training) if t for x in own)
    pairs = Counter(p for own, t in zip(tokens, training) if t for p in zip([None, *own], own))
    total, distinct = counts.total(), len(counts)
    kept = {p: n for p, n in pairs.items() if n >= lm_scoring.LEAST}
    level = lambda n: math.floor(math.log2(n))
    mean = lambda table: {k: np.mean([n for n in table.values() if level(n) == k]) for k in {level(n) for n in table.values()}}
    word_means, pair_means = mean(counts), mean(kept)
    middle = lambda n, means=word_means: means[level(n)] if n else 0.0
    share = sum(kept.values()) / max(1, total)
    for own in tokens:
        score = 0.0
        for before, word in zip([None, *own], own):
            alone, context = (middle(counts[word]) + 1) / (total + distinct + 1), middle(counts[b"" if before is None else before])
            p = 0.9 * min(1.0, middle(kept.get((before, word), 0), pair_means) / context) + (1 - 0.9 * share) * alone if context else alone
            score += math.log10(p)
        yield len(own), sum(counts[x] > 0 for x in own), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in own), score


def test_lm_scoring(make, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "ENTRY_BITS", 200)  # hardly a false count, so that plain counts give the same score
    texts = [*odd, *(f"plain words number {k} again and again" for k in range(30))]
    docs = make(texts)
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, docs.filter(lm_scoring.in_training(F.col("doc_id")))).collect()}
    for i, (n, known, total, base, score) in enumerate(brute_scores(texts, [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))])):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9), i


@pytest.mark.parametrize("table", [lm_scoring.TABLE_ENTRIES, 5])
def test_lm_scoring_odd_rows(make, monkeypatch, table):
    """Null and repeated ids give a row each; tables that start anew all the time, and small slices, change nothing."""
    monkeypatch.setattr(lm_scoring, "TABLE_ENTRIES", table)
    monkeypatch.setattr(lm_scoring, "SLICE", 8)
    monkeypatch.setattr(lm_scoring, "ENTRY_BITS", 200)
    texts, ids = ["a b a b", "a b c", "a b c", None, "c c c"], [7, 7, None, None, 1]
    rows = lm_scoring.score_documents(make(texts, ids), make(texts)).collect()
    want = Counter((i, *(round(x, 9) for x in own)) for i, own in zip(ids, brute_scores(texts, [True] * 5)))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows) == want
    assert lm_scoring.score_documents(make([]), make([])).count() == 0


def test_filter_has_no_false_negatives_and_few_false_counts(spark):
    grams = lm_scoring.mix(np.arange(20000, dtype=np.uint64))
    level = np.arange(20000) % 5 + 1
    counts = spark.createDataFrame([(int(g), 1 << int(k) - 1) for g, k in zip(grams.view(np.int64), level)], "gram long, n long")
    plan = lm_scoring.filter_plan(counts)
    assert (plan.entries, plan.least) == (int(level.sum()), (1, 1))
    table = lm_scoring.build_filter(counts, plan)
    found = lm_scoring.levels(table, grams)
    assert (found >= level).all() and (found > level).mean() < 0.01
    strange = lm_scoring.levels(table, lm_scoring.mix(np.arange(10**6, 10**6 + 200_000, dtype=np.uint64)))
    assert abs((strange > 0).mean() - lm_scoring.false_count_rate(table)) < 0.002 and lm_scoring.false_count_rate(table) < 0.006


def test_filter_keeps_its_bound(spark, monkeypatch):
    """Beyond the bound only pairs of higher counts enter, then only words, and false counts stay as rare."""
    grams = lm_scoring.mix(np.arange(40000, dtype=np.uint64))
    level, pair = np.where(np.arange(40000) % 10 == 0, 4, 1), grams & np.uint64(1) == 1
    counts = spark.createDataFrame([(int(g), 1 << int(k) - 1) for g, k in zip(grams.view(np.int64), level)], "gram long, n long")
    for most, least in ((60_000, (1, 2)), (30_000, (2, 5))):
        monkeypatch.setattr(lm_scoring, "FILTER_BYTES", most)
        plan = lm_scoring.filter_plan(counts)
        table = lm_scoring.build_filter(counts, plan)
        found = lm_scoring.levels(table, grams)
        inside = level >= np.where(pair, *reversed(plan.least))
        assert plan.least == least and len(table) <= most + lm_scoring.BLOCK_BYTES and (found[inside] >= level[inside]).all() and (found[~inside] > 0).mean() < 0.01


@pytest.mark.parametrize("most", [lm_scoring.FILTER_BYTES, 9_000, 6_000])
def test_chances_sum_to_one(spark, make, monkeypatch, most):
    """Over the whole vocabulary and the unknown word, also where the filter is too small for all n-grams; behind training contexts on average."""
    whole = most == lm_scoring.FILTER_BYTES
    monkeypatch.setattr(lm_scoring, "FILTER_BYTES", most)
    monkeypatch.setattr(lm_scoring, "ENTRY_BITS", 60)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 60) if k < 3000) for _ in range(80)]
    tokens = [[*t.encode().split(), b""] for t in texts]
    words = sorted({w for own in tokens for w in own})
    total = sum(map(len, tokens))
    grams = lm_scoring.gram_counts(make(texts), total)
    plan = lm_scoring.filter_plan(grams)
    assert (plan.least == (1, 1)) == whole
    scorer = lm_scoring.Scorer(lm_scoring.build_filter(grams, plan), plan, total, len(words))
    hashes = lm_scoring.word_hashes(words)
    alone = (scorer.counts(hashes) + 1) / scorer.size
    unknown = 1 / scorer.size
    assert math.isclose(alone.sum() + unknown, 1, abs_tol=2e-3)
    sums, weights = [], Counter(w for own in tokens for w in own)
    for u in words:
        h = np.empty(2 * len(words), dtype=np.uint64)
        h[::2], h[1::2] = lm_scoring.word_hashes([u])[0], hashes
        starts = np.arange(0, len(h), 2)
        own = 10 ** scorer.logs(h, scorer.counts(h), starts)[1::2]
        sums.append((own.sum(), weights[u]))
    assert abs(np.average([x for x, _ in sums], weights=[n for _, n in sums]) - 1) < 0.06


@pytest.mark.parametrize("most, least", [(20_000, 1), (9_000, 2)])
def test_scores_do_not_depend_on_the_bound(make, monkeypatch, most, least):
    """What a filter too small for all n-grams leaves out, pairs or words too, comes back by the join."""
    monkeypatch.setattr(lm_scoring, "FILTER_BYTES", most)
    monkeypatch.setattr(lm_scoring, "ENTRY_BITS", 100)
    plans, planned = [], lm_scoring.filter_plan
    monkeypatch.setattr(lm_scoring, "filter_plan", lambda counts: plans.append(planned(counts)) or plans[-1])
    rng = np.random.default_rng(5)
    texts = [None, "", "w1 w1 w1 w1", *(" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 60) if k < 3000) for _ in range(90))]
    training = [k % 7 != 2 for k in range(len(texts))]
    docs = make(texts)
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, docs.filter("doc_id % 7 <> 2")).collect()}
    assert len(rows) == len(texts) and plans[0].least[1] > 1 and (plans[0].least[0] > 1) == (least > 1)
    for i, (n, known, total, base, score) in enumerate(brute_scores(texts, training)):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9), i


def test_filter_is_built_in_few_jobs(spark, make):
    """However many partitions the counts have, the blocks come to the driver at once."""
    grams = spark.range(0, 5000, numPartitions=20).selectExpr("xxhash64(id) AS gram", "id % 9 + 1 AS n")
    plan = lm_scoring.filter_plan(grams)
    spark.sparkContext.setJobGroup("filter", "")
    lm_scoring.build_filter(grams, plan)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("filter"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 4


def brute_rules(text):
    b = data(text)
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in b"#*$%&|<>" for c in b), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_rules(make, odd):
    texts = [*odd, "a b c d e f g h i j " * 3, "# * $ % & | < >\n\nx\nx\nx " + "one two three four five six seven eight nine ten " * 2]
    for t in texts:
        assert quality.rule_counts(data(t)) == brute_rules(t)
    rows = {r["doc_id"]: r for r in quality.score_quality(make(texts), (np.zeros(1 << quality.BITS, np.float32), 1.0, 1.0, 0.0)).collect()}
    for i, t in enumerate(texts):
        n, *_, repeats = brute_rules(t)
        assert rows[i]["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and rows[i]["kept"] == (not rows[i]["base_failed"])


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]]["toxic"] == 1]
    clean = [r["predicted"] for r in rows if labels[r["doc_id"]]["toxic"] == 0]
    assert len(toxic) == 6 and np.mean(toxic) > 0.6 and np.mean(clean) < 0.01  # a share of 0.13 is toxic: calling all clean would fail
    good = [r for r in quality.op10_quality_rules(spark, sf).collect() if not r["base_failed"] and r["doc_id"] in labels]
    assert np.mean([r["kept"] == (labels[r["doc_id"]]["quality"] == 1) for r in good]) > 0.97


def test_models_without_labels(spark, make, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(odd)
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, none)).collect()} == {0}
    assert quality.score_quality(docs, quality.train(docs, none)).count() == len(odd)


def test_label_model_finds_the_good_voter():
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.3
    votes = np.stack([np.where(rng.random(3000) < acc, truth, ~truth) + 1 for acc in (0.95, 0.8, 0.8, 0.55)], axis=1)
    model = toxicity.fit_label_model(votes)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93
    assert np.abs(model.accuracies(votes)[:3] - (0.95, 0.8, 0.8)).max() < 0.05


def test_label_model_discounts_tied_voters():
    """Voters that mostly repeat a poor one are tied to each other and to no good one, and the good ones are followed."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    vote = lambda acc: np.where(rng.random(4000) < acc, truth, ~truth) + 1
    poor = vote(0.65)
    copies = [np.where(rng.random(4000) < 0.3, vote(0.65), poor) for _ in range(3)]
    votes = np.stack([vote(0.85), vote(0.85), vote(0.85), vote(0.85), vote(0.85), *copies], axis=1)
    model = toxicity.fit_label_model(votes)
    assert sum(p is not None and p >= 5 for p in model.parents[5:]) == 2 and all(p is None or p < 5 for p in model.parents[:5])
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.94
    naive = ((votes == 2).sum(axis=1) * 2 > votes.shape[1])
    assert ((model.posterior(votes) > 0.5) == truth).mean() > (naive == truth).mean()


def test_label_model_counts_patterns():
    """A model of counted patterns is the model of the rows they stand for, and patterns give back their votes."""
    rng = np.random.default_rng(7)
    lexicon = np.array([toxicity.word_code("grr"), zlib.crc32(b"grum") & ~3 | 1], dtype=np.uint32)
    codes = [np.array([c for w in rng.choice(["grr", "grumble", "grumpy", "idiot", "tea", "cup", "trash"], 4) for c in toxicity.word_terms(str(w))], dtype=np.uint32) for _ in range(400)]
    votes = toxicity.voter_votes(codes, rng.integers(0, 16, 400), lexicon)
    patterns, rows = np.unique(toxicity.vote_patterns(votes), return_counts=True)
    assert (toxicity.pattern_votes(toxicity.vote_patterns(votes)) == votes).all() and len(patterns) < 400
    whole, counted = toxicity.fit_label_model(votes), toxicity.fit_label_model(toxicity.pattern_votes(patterns), rows)
    assert whole.parents == counted.parents and np.allclose(whole.posterior(votes), counted.posterior(votes), atol=1e-6)


def test_votes_of_all_rows_are_counted(make, odd):
    """Counts of vote patterns against plain loops over words: all rows with an id outside the held-out fifth, equal texts once."""
    texts = [*odd, "You IDIOT!!! you", "grumble grumpy m*ron", "grumble and grr", "grr", "grr", "sh#$%t", "STOP SHOUTING", "idiot", "x" * 100 + " grr", "\u00c9T\u00c9 \u00e9"] * 2
    ids = [None if k % 7 == 3 else k for k in range(len(texts))]
    ends = {"grum": 1, "grump": 2}
    lexicon = np.array([toxicity.word_code("grr"), *(zlib.crc32(w.encode()) & ~3 | k for w, k in ends.items())], dtype=np.uint32)
    plain = {}
    for i, text in zip(ids, texts):
        words = sorted({w for w in (text or "").lower().split()})
        if i is None or zlib.crc32(str(i).encode()) % 5 == 0 or not words:
            continue
        bare = [w.strip(toxicity.PUNCTUATION) for w in words]
        bits = [any(w in own.split() for w in bare) for own in toxicity.LEXICONS.values()]
        learned = [0] * 8
        for w in bare:
            if w == "grr":
                learned[(toxicity.word_code("grr") >> 2) % 4] += 1
            for end, k in ends.items():
                if w.startswith(end) and len(w) > len(end):
                    learned[4 + 2 * (k - 1) + (zlib.crc32(end.encode()) >> 2) % 2] += 1
        bits += [n > (v >= 4) for v, n in enumerate(learned)]
        tenth = text.count(" ") + 10
        bits += [sum(c.isupper() for c in text) > sum(c.islower() for c in text), text.count("!") * 10 > tenth]
        bits += [toxicity.MASKED.search(text) is not None, len(toxicity.SYMBOLS.findall(text)) * 10 > tenth]
        plain[text] = sum(1 << v for v, bit in enumerate(bits) if bit)
    patterns, rows = toxicity.vote_counts(make(texts, ids), lexicon)
    assert dict(zip(patterns.tolist(), rows.tolist())) == Counter(plain.values()) and len(patterns) > 5


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "TABLE_WORDS", 3)
    table = toxicity.WordTable(len)
    assert [table[w] for w in ("a", "bb", "ccc", "dddd", "e" * 65, "a")] == [1, 2, 3, 4, 65, 1] and set(table) == {"dddd", "a"}


def test_posterior_is_bayes_rule_over_all_votes():
    """The posterior against the product of chances written out for each combination of votes; chances sum to one."""
    rng = np.random.default_rng(6)
    votes = rng.integers(0, 3, (500, 4))
    votes[:, 2] = votes[:, 1]
    model = toxicity.fit_label_model(votes)
    assert np.allclose(model.chances.sum(axis=3), 1)
    for row, got in zip(votes, model.posterior(votes)):
        weight = [1 - model.prior, model.prior]
        for v, parent in enumerate(model.parents):
            for c in (0, 1):
                weight[c] *= model.chances[v, c, row[parent] if parent is not None else 0, row[v]]
        assert math.isclose(got, weight[1] / sum(weight), rel_tol=1e-6)


def test_rows_with_null_and_repeated_ids(make):
    """Each row gives its own result, whatever the ids; an empty table gives an empty result."""
    texts, ids = ["the mit license", "the mit license", None, "other words", "the mit license"], [7, 7, None, None, None]
    docs, empty = make(texts, ids), make([])
    rows = Counter((r["doc_id"], r["n_words"], r["labels"]) for r in license_scan.scan(docs).collect())
    assert rows == {(7, 3, "mit"): 2, (None, 0, ""): 1, (None, 2, ""): 1, (None, 3, "mit"): 1}
    rows = Counter((r["doc_id"], r["fp"] == 0, r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    assert rows == {(7, False, 7): 2, (None, False, 7): 1, (None, True, None): 1, (None, False, None): 1}
    rows = Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in packing.pack_documents(docs).collect())
    assert rows == {(7, 0, 4, 4): 2, (None, 0, 1, 1): 1, (None, 0, 3, 3): 1, (None, 0, 4, 4): 1}
    rows = Counter((r["doc_id"], r["n_tokens"]) for r in tokenization.encode_digests(docs).collect())
    assert rows == {(7, 3): 2, (None, 0): 1, (None, 2): 1, (None, 3): 1}
    model = (np.zeros(1 << quality.BITS, np.float32), 1.0, 1.0, 0.0)
    rows = Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality.score_quality(docs, model).collect())
    assert rows == {(7, 3, False): 2, (None, 0, False): 1, (None, 2, False): 1, (None, 3, False): 1}
    rows = Counter((r["doc_id"], r["predicted"]) for r in toxicity.score_toxicity(docs, (np.zeros(1 << toxicity.BITS, np.float32), 1.0, 1.0, 0.0)).collect())
    assert rows == {(7, 1): 2, (None, 1): 3}
    for out in (license_scan.scan(empty), tokenization.encode_digests(empty), tokenization.encode_documents(empty), quality.score_quality(empty, model)):
        assert out.count() == 0


def test_quality_score_is_the_calibrated_mean_of_weights(make, odd):
    """Score and verdict against the same features, n-gram by n-gram, in plain Python."""
    rng = np.random.default_rng(9)
    weights = rng.normal(size=1 << quality.BITS).astype(np.float32)
    long = " ".join(f"w{k}" for k in range(40))
    rows = {r["doc_id"]: r for r in quality.score_quality(make([*odd, long]), (weights, 0.1, 0.7, -0.2)).collect()}
    multiply = lambda x, bits: ((x ^ x >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits
    half = quality.BITS - 1
    for i, t in enumerate([*odd, long]):
        b = data(t)
        chars = [weights[multiply(int.from_bytes(b[k : k + 4], "little"), half)] for k in range(len(b) - 3)]
        codes = [zlib.crc32(w) for w in b.split()]
        codes += [a * 0x85EBCA77 & 0xFFFFFFFF ^ c for a, c in zip(codes, codes[1:])]
        words = [weights[multiply(c, half) + (1 << half)] for c in codes]
        raw = sum(quality.SCALE * math.fsum(map(float, x)) / len(x) for x in (chars, words) if x) + 0.1
        score = 1 / (1 + math.exp(-min(max(0.7 * raw - 0.2, -40), 40)))
        assert math.isclose(rows[i]["score"], score, rel_tol=1e-5), i
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and rows[i]["score"] >= 0.5)


def test_toxicity_learns_from_its_rows_alone(spark, make):
    """Labels and texts of held-out rows, and texts without an id, change nothing in the model; a row without an id and a
    very long text score as the same words do elsewhere."""
    texts = [("you idiot moron %d trash grumble" if k % 3 == 0 else "a nice cup of tea number %d for all") % k for k in range(120)]
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 5 == 0]
    labels = lambda flip: spark.createDataFrame([(k, int((k % 3 == 0) != (flip and k in held))) for k in range(120)], "doc_id long, toxic int")
    model = toxicity.train(make(texts), labels(False))
    other = [t if k not in held else "other words %d" % k for k, t in enumerate(texts)] + ["idiot without an id"]
    again = toxicity.train(make(other, [*range(120), None]), labels(True))
    assert model[0].any() and (model[0] == again[0]).all() and model[1:] == again[1:]
    rows = toxicity.score_toxicity(make([texts[0], texts[0], (texts[0] + " ") * 50_000, texts[1], "z" * 2_000_000], [1, None, 2, 3, 4]), model).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[1] == scores[None] == scores[2] > 0.5 > scores[3] and 0 <= scores[4] <= 1


def test_held_out_is_null_without_an_id(spark, make, tmp_path):
    make(["some words", None, "more"], [5, None, 7]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["doc_id"]: (r["held_out"], r["predicted"]) for r in toxicity.op2_toxicity(spark, str(tmp_path)).collect()}
    assert rows == {i: (zlib.crc32(str(i).encode()) % 5 == 0, 0) for i in (5, 7)} | {None: (None, 0)}
