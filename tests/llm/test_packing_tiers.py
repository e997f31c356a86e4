"""Every tier of the packer packs its own pieces."""

from collections import defaultdict

import numpy as np

from shapeflow.llm.packing import TIERS, Packer


def packed(sizes, pools=1):
    packer = Packer(0, 8)
    out = []
    for k in range(pools):
        packer.waiting += [(i, np.arange(n, dtype="<u4"), 0, n, n) for i, n in enumerate(sizes) if i % pools == k]
        out += packer.pack(k == pools - 1)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r[0]].append((r[1], r[2]))
        sequences[r[5]].append(r)
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n
    return pieces, [(own[0][7], sum(r[2] for r in own), own) for own in sequences.values()]


def test_short_tiers_are_packed():
    rng = np.random.default_rng(3)
    for low, high, tier in ((1, 250, 256), (257, 1020, 1024)):
        sizes = rng.integers(low, high, 600).tolist()
        pieces, sequences = packed(sizes, 3)
        assert sum(n for t, n, _ in sequences if t == tier) > 0.95 * sum(sizes)
        assert sum(n < t for t, n, _ in sequences) <= 1


def test_tiers_together_lose_nothing():
    rng = np.random.default_rng(4)
    sizes = [*rng.integers(1, 256, 900).tolist(), *rng.integers(257, 1024, 300).tolist(), *rng.integers(1025, 20000, 200).tolist()]
    pieces, sequences = packed(sizes, 2)
    assert sum(n < t for t, n, _ in sequences) <= 1
    own = {t: sum(n for x, n, _ in sequences if x == t) for t in TIERS}
    assert all(own.values()) and own[256] > 0.3 * sum(sizes[:900]) and own[1024] > 0.3 * sum(sizes[900:1200])
    assert sum(len(x) > 1 for x, n in zip((pieces[i] for i in range(1200)), sizes)) < 600  # most short documents stay whole


def test_tasks_start_at_different_groups():
    firsts = set()
    for k in range(8):
        packer = Packer(0, 8, k)
        packer.waiting = [(0, np.arange(256, dtype="<u4"), 0, 256, 256)]
        firsts.add(packer.pack(True)[0][8])
    assert firsts == set(range(8))
