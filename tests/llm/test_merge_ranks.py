"""Ids by merge ranks against the vocabulary file's own library, and when they are not to be used."""

import json
import random

import pytest

from shapeflow.llm import merge_ranks as R
from shapeflow.llm import tokenization as T


def test_ids_equal_the_library(tmp_path):
    from tokenizers import Tokenizer

    path = T.vocabulary_path()
    assert R.ranks_decide(path)
    own, library, rng = R.word_encoder(path, True), Tokenizer.from_file(path), random.Random(3)
    labels = sorted(x.removesuffix("</w>") for x in library.get_vocab() if x.isascii() and "|" not in x)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "éüßñçøåœ漢字かなабвг😀0123456789'!?.-_­́\x7f\0�"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(5_000)]
    words += ["".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(5_000)]
    words += ["", "a" * 50_000, "ab" * 5_000, "it's", "<|endoftext|>", *("a" * k for k in range(1, 200))]
    got = [list(T.unpacked_ids(b"".join(map(own.ids, own.chunks(w.encode()))))) for w in words]
    assert got == [x.ids for x in library.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("merges, decides", [
    ([("a", "b"), ("ab", "c</w>")], True),
    ([("a", "b"), ("a", "bc</w>"), ("b", "c</w>")], False),  # a side made after its merge
    ([("b", "c</w>"), ("a", "b"), ("ab", "c</w>")], False),  # own letters don't give the label: bc goes first
])
def test_ranks_decide_only_where_proved(tmp_path, merges, decides):
    path = tmp_path / "v.json"
    tokens = [*"abc", *(x + "</w>" for x in "abc"), *dict.fromkeys(a + b for a, b in merges)]
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges, "end_of_word_suffix": "</w>"}}))
    assert R.ranks_decide(str(path)) is decides
