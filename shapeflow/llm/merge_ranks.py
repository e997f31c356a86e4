"""Ids of words by merge ranks: the vocabulary's merges handed to a compiled rank-based encoder."""

from __future__ import annotations

import json
from functools import cache

from shapeflow.llm.tokenization import Encoder, MergeAutomaton, byte_letters

#: Stands behind a word's last byte; no pre-split word has white space.
WORD_END = b"\n"


def merge_lists(path: str) -> tuple[dict[str, int], list[tuple[str, str]], str]:
    """Vocabulary, merges in order of rank, and word-end suffix of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"]


@cache
def ranks_decide(path: str) -> bool:
    """Whether merging by the rank of the merged bytes gives the ids of the file's own library, for every word.

    It does where each label is made by one merge only, each merge's sides are made before it,
    and the library encodes each label's own letters as that label. For take the first time
    that both ways differ: two neighbours spell a label but are not the sides of its merge.
    Nothing crossed the outer borders of their letters so far, and merges come in order of
    rank, so inside the borders all went as for the label's letters alone, which ended in the sides.
    """
    from tokenizers.models import BPE

    vocabulary, merges, end = merge_lists(path)
    rank = {}
    for k, (left, right) in enumerate(merges):
        if rank.setdefault(left + right, k) != k or rank.get(left, -1) > k or rank.get(right, -1) > k:
            return False
    inner, last = BPE(vocabulary, merges), BPE(vocabulary, merges, end_of_word_suffix=end)
    alone = lambda t: last.tokenize(t[: -len(end)]) if t.endswith(end) else inner.tokenize(t)
    return all(len(tokens := alone(t)) == 1 and tokens[0].id == vocabulary[t] for t in rank)


class MergeRanks:
    """Words to ids like ``MergeAutomaton``, by the rank of what neighbours merge to.

    A word's bytes are followed by WORD_END. Joining a last byte and WORD_END comes before
    all merges and gives the symbol that the library starts from.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        import tiktoken

        letters = byte_letters()
        self.number = {c: b for b, c in enumerate(letters)}
        self.label = {i: t for t, i in vocabulary.items()}
        spelled = lambda t: bytes(map(self.number.__getitem__, t[: -len(end)])) + WORD_END if t.endswith(end) else bytes(map(self.number.__getitem__, t))
        joined = [(bytes([b]) + WORD_END, vocabulary.get(c + end)) for b, c in enumerate(letters)]
        made = [(spelled(left + right), vocabulary[left + right]) for left, right in merges]
        single = [(bytes([b]), vocabulary.get(c)) for b, c in enumerate(letters)]
        self.ids = [i for _, i in (*joined, *made, *single)]
        self.ranked = tiktoken.Encoding("merge ranks", pat_str=r"[^\n]*\n", mergeable_ranks={x: k for k, (x, _) in enumerate((*joined, *made, *single))}, special_tokens={})

    def encode(self, letters: str) -> list[int]:
        word = letters if letters.isascii() else bytes(map(self.number.__getitem__, letters)).decode()
        return list(map(self.ids.__getitem__, self.ranked.encode_ordinary(word + "\n")))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def word_encoder(path: str, by_rank: bool) -> Encoder:
    """One encoder for a Python worker; by the automaton where ranks don't decide (``ranks_decide``, asked on the driver)."""
    key = (path, by_rank)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, MergeRanks if by_rank else MergeAutomaton)
    return _ENCODERS[key]
