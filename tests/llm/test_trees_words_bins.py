"""Manifest, spelling variants and best-fit packing against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeflow.llm import bin_search, merkle, spelling, tokenization

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, n long, place long"


def table(spark, rows):
    """Documents from (doc_id, text, source), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, 2) for i, t, s in rows], SCHEMA)


def joined_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(i, source, lang, n, text):
    return joined_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain_paths(hashes):
    """The root over some hashes, and each one's path: (left siblings, right siblings) of each level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 3 * 3 : place // 3 * 3 + 3]
            paths[k].append((run[: place % 3], run[place % 3 + 1 :]))
        level = [joined_hash(*level[k : k + 3]) for k in range(0, len(level), 3)]
        at = [place // 3 for place in at]
    return (level or [None])[0], paths


def plain_manifest(rows):
    """rows: (doc_id, text, source); the query's rows in any order."""
    groups = defaultdict(list)
    for i, t, s in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaf = plain_leaf(i, s, "en", len(t or ""), t)
        groups[s].append(((i is not None, i or 0, leaf), leaf, plain_leaf(i, s, "en", len(t or ""), t and t.replace("\n", "")) if even else leaf, i))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s]) for s in sources}
    trees = {s: plain_paths([x[1] for x in own[s]]) for s in sources}
    root, above = plain_paths([trees[s][0] for s in sources])
    for s, upper in zip(sources, above):
        for (_, leaf, claimed, i), path in zip(own[s], trees[s][1]):
            folded, proof = claimed, ""
            for left, right in path + upper:
                folded, proof = joined_hash(*left, folded, *right), proof + "".join(left + right)
            yield i, leaf, trees[s][0], root, joined_hash(proof), folded, folded == root


def manifest_of(docs):
    return merkle.manifest(merkle.document_leaves(docs), F.col("source"), F.col("doc_id"))


def test_manifest(spark, odd):
    texts = [*odd, *(f"line {k}\nof {k}" for k in range(300)), *(f"plain {k}" for k in range(40))]
    sources = [None, "", "one", "é", "Z", "hot", "hot", "hot", "hot"]
    rows = [(i, t, sources[i % 9] if i < 100 else "hot") for i, t in enumerate(texts)]
    rows += [(None, "no id\n", "hot"), (7, "no\nid", "one"), (7, "no\nid", "one"), (5000, "a\nb", "alone"), (5001, None, "alone too")]
    got = [(*r[:4], hashlib.sha256(re.sub("[,;*]", "", r["proof"]).encode()).hexdigest(), *r[5:]) for r in manifest_of(table(spark, rows)).collect()]
    assert Counter(got) == Counter(plain_manifest(rows))
    assert any(r[6] for r in got) and not all(r[6] for r in got)


@pytest.mark.parametrize("n", [0, 1, 4, 28, 82])
def test_manifest_sizes(spark, n):
    rows = [(i, f"t\n{i}", "s") for i in range(n)]
    got = manifest_of(table(spark, rows)).drop("proof").collect()
    assert Counter((r["doc_id"], r["leaf"], r["root"], r["folded_root"]) for r in got) == Counter((r[0], r[1], r[3], r[5]) for r in plain_manifest(rows))


def test_manifest_many_sources(spark):
    rows = [(i, "x", f"s{i % 40}") for i in range(130)]
    assert {r["root"] for r in manifest_of(table(spark, rows)).collect()} == {next(plain_manifest(rows))[3]}


def test_manifest_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(merkle.OP11_SQL).df()
    got = merkle.op11_merkle_manifest(spark, sf).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(texts, ids):
    counts = Counter()
    for i, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    forms, sizes = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        sizes[w] = len(others)
        if others and -others[0][0] >= 10 * n:
            forms[w] = others[0][1]
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        yield w, forms.get(w), root, n, sizes[w], counts[forms[w]] if w in forms else None


WORDS = {
    "separate": 400, "seperate": 35, "seperatte": 3, "saperate": 2, "separates": 39, "eparate": 5, "parates": 3, "deparate": 40, "Separate": 2, "naïveté": 50, "naïvete": 4,
    "letters": 20, "setters": 20, "lettres": 2, "lettersé": 2, "aaaaaaa": 30, "aaaaaaaa": 3, "aaabaaa": 2, "short": 500, "abcdefg": 2, "gfedcba": 2, "abcdegf": 2,
}


def test_variants(make, odd):
    texts, ids = list(odd), [*range(len(odd))]
    for k, (w, n) in enumerate(WORDS.items()):
        texts += [f"{w} x {w}, 1{w}9" for _ in range(n)]
        ids += [1000 * k + j for j in range(n)]
    texts += ["separate separate", "separate"]
    ids += [None, 7]
    got = Counter(tuple(r) for r in spelling.variants(make(texts, ids)).collect())
    assert got == Counter(plain_variants(texts, ids))
    assert ("seperatte", "seperate", "separate") in {r[:3] for r in got}  # a chain
    assert spelling.variants(make([])).count() == 0 and spelling.variants(make(["", None, "a b c"])).count() == 0


def test_variants_of_very_long_words(make):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefé"), 3000))
    other = [long[:1500] + "z" + long[1501:], long[:7] + long[8:], long[:2000] + "q" + long[2000:], long[:-1], "z" + long, long[1:] + long[0]]
    edge = "".join(rng.choice(list("abc"), spelling.LONG))  # words on either side of the length where digests change
    own = [long, *other, edge, edge + "a", edge[:-1], "b" + edge]
    texts = [t for x in own for t in [x] * 3] + [long] * 90
    got = Counter(tuple(r) for r in spelling.variants(make(texts)).collect())
    assert got == Counter(plain_variants(texts, range(len(texts))))


def test_anagrams_are_no_variants_and_meet_no_other(make):
    """Words of the same letters share all keys; only those that differ in one letter are near."""
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.permutation(list("abcdefg"))) for _ in range(400)})
    texts = [w for w in words for _ in (0, 1)] + ["abcdefgh"] * 2
    rows = list(spelling.variants(make(texts)).collect())
    assert Counter(tuple(r) for r in rows) == Counter(plain_variants(texts, range(len(texts))))
    assert max(r["n_near"] for r in rows) <= 8


def test_digests_without_a_letter():
    for n in (5, spelling.LONG, spelling.LONG + 1, spelling.LONG + 2, 700):
        word = "".join(np.random.default_rng(n).choice(list("abcÿ"), n))
        assert dict(spelling.digests_without(word, {"a", "ÿ"})) == {k: spelling.digest(word[:k] + word[k + 1 :]) for k in range(n) if word[k] in "aÿ"}


def packed_lengths(lengths):
    bins = bin_search.Bins(lengths)
    before = len(bins.items)
    bins.search()
    own = bins.packed()
    assert sorted(i for x in own for i in x) == list(range(len(lengths))) and all(sum(lengths[i] for i in x) <= bin_search.WINDOW for x in own)
    return before, len(own)


def test_search_empties_bins():
    """Lengths for which best fit takes 11 bins where 9 do."""
    lengths = lambda m: [1040] * 6 * m + [544] * 6 * m + [528] * 6 * m + [480] * 12 * m
    assert packed_lengths(lengths(5)) == (55, 45) and packed_lengths(lengths(40)) == (440, 360)


def test_search_never_takes_more():
    rng = np.random.default_rng(6)
    for low, high, n in ((1, 2048, 500), (900, 1300, 400), (1, 40, 3000), (400, 700, 600), (1, 2, 5000), (2047, 2048, 50)):
        lengths = rng.integers(low, high, n).tolist()
        before, after = packed_lengths(lengths)
        assert -(-sum(lengths) // bin_search.WINDOW) <= after <= before
    assert packed_lengths([]) == (0, 0)


def test_each_change_raises_squared_fill(monkeypatch):
    fills, give = [], bin_search.Bins.give

    def watched(self, *a):
        give(self, *a)
        fills.append(sum(x * x for x in self.load))

    monkeypatch.setattr(bin_search.Bins, "give", watched)
    packed_lengths([1040] * 30 + [544] * 30 + [528] * 30 + [480] * 60)
    assert len(fills) > 10 and all(a < b for a, b in zip(fills, fills[1:]))


@pytest.mark.parametrize("pool", [bin_search.POOL, 7])
def test_best_fit_packing(make, odd, pool, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bin_search, "POOL", pool)
    library = Tokenizer.from_file(tokenization.vocabulary_path())
    texts, ids = [*odd, *odd, "same", "same", None], [*range(2 * len(odd)), 900, 900, None]
    rows = bin_search.pack_whole(make(texts, ids)).collect()
    sequences, got = defaultdict(list), Counter()
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    want, total = Counter(), 0
    for i, t in zip(ids, texts):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(own)
        want.update((i, k, at, len(own[at : at + 2048]), zlib.crc32(own[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(own), 2048)))
    assert got == want
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + (2 if pool > 7 else 12)
    assert bin_search.pack_whole(make([])).count() == 0
