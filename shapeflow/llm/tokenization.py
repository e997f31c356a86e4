"""BPE by a tokenization automaton: encode by table-driven transitions, decode by arc labels."""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches

VOCABULARY = "word_bpe_49k.json"
#: Most entries, and most bytes of their keys, of one generation of a worker's tables of chunks (runs without ASCII white space) and words.
TABLE_ENTRIES, TABLE_BYTES = 300_000, 8 << 20
#: Letters by which a state's longest arc is bounded.
HEAD = 4
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton over token labels that accepts each word's BPE tokenization and no other.

    A state is the label of the arc that led to it: all arcs of one label lead to one state.
    The start has an arc for every symbol. Merge by merge, in order of rank, the gadget of
    (left, right) -> token rewires it: the arc ``right`` leaves the state of ``left``; an arc
    ``token`` joins every state that has an arc ``left``; the state of ``token`` gets the arcs
    that the state of ``right`` has. ``born`` holds the merge that made a label and
    ``parts`` its sides, so that each arc's fate under the whole succession of gadgets
    follows from the two labels alone; ``arc`` evaluates it once for a pair of labels that
    texts reach and keeps it in the transition table.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.label = {i: t for t, i in vocabulary.items()}
        self.end = end
        self.gadget: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        made = {t for left, right in merges for t in (left + right,)}
        for rank, (left, right) in enumerate(merges):
            u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.gadget[u, v] = rank
            if w not in self.born:
                self.born[w], self.parts[w] = rank, (u, v)
        #: Labels that a state can have arcs for, by their letters: inside a word, and at its end.
        self.inner = {t: i for t, i in vocabulary.items() if not t.endswith(end) and (t in made or len(t) == 1)}
        self.last = {t[: -len(end)]: i for t, i in vocabulary.items() if t.endswith(end) and (t in made or len(t) == 1 + len(end))}
        #: Length of the longest label that begins with the given HEAD letters; without an entry, fewer than HEAD.
        self.reach: dict[str, int] = {}
        for t in (*self.inner, *self.last):
            if len(t) >= HEAD:
                self.reach[t[:HEAD]] = max(self.reach.get(t[:HEAD], 0), len(t))
        #: The transition table, one row for each state: whether it has an arc of a label. Filled for the pairs
        #: that texts reach; there are fewer than the square of the vocabulary's size whatever the texts.
        self.table: dict[int, dict[int, bool]] = {}

    def arc(self, state: int, label: int) -> bool:
        """Whether the state of a label has an arc of another label after all gadgets."""
        row = self.table.setdefault(state, {})
        if label not in row:
            row[label] = self._after(state, label, len(self.gadget))
        return row[label]

    def _after(self, x: int, y: int, rank: int) -> bool:
        """The same after the gadgets of rank below ``rank``: the later-made of both labels got its arcs from its parts."""
        while True:
            if self.gadget.get((x, y), rank) < rank:
                return False
            bx, by = self.born.get(x, -1), self.born.get(y, -1)
            if bx < 0 and by < 0:
                return True
            if by > bx or (by == bx and x != y):
                y, rank = self.parts[y][0], by + 1  # `token` came to the states that keep `left` once its gadget was in
            elif by == bx:
                # a label after itself: its left part's arc after the label's own state
                y, rank = self.parts[y][0], by + 1
            else:
                x, rank = self.parts[x][1], bx  # the state's arcs were those of `right` before its gadget

    def encode(self, letters: str) -> list[int]:
        """The labels of the one accepted path that spells a word: longest arcs first, one arc back where a path ends."""
        path: list[int] = []
        starts: list[int] = []
        inner, last, table, reach, whole = self.inner.get, self.last.get, self.table, self.reach.get, len(letters)
        at, upto, row = 0, min(whole, reach(letters[:HEAD], HEAD - 1)), None
        while at < whole:
            while upto > at:
                label = inner(letters[at:upto]) if upto < whole else last(letters[at:])
                if label is not None:
                    if row is None:
                        break
                    known = row.get(label)
                    if known or known is None and self.arc(path[-1], label):
                        break
                upto -= 1
            else:
                if not path:
                    raise ValueError(f"no path spells {letters!r}")
                path.pop()
                at, upto = starts.pop(), at - 1
                row = table[path[-1]] if path else None
                continue
            path.append(label)
            starts.append(at)
            at = upto
            row = table.get(label)
            if row is None:
                row = table[label] = {}
            upto = min(whole, at + reach(letters[at : at + HEAD], HEAD - 1))
        return path

    def decode(self, path: list[int]) -> str:
        """The labels of the path's arcs, emitted one after another."""
        return " ".join(map(self.label.__getitem__, path))


class Encoder:
    """Ids of whole texts as the vocabulary file's own library gives them.

    Texts are cut at the file's special tokens, then at ASCII white space, which no pre-split
    word crosses and normalisation keeps; each distinct chunk is normalised, pre-split and
    encoded once and then looked up. ``speller`` makes the ids of a pre-split word.
    """

    def __init__(self, path: str, speller: type = MergeAutomaton) -> None:
        from tokenizers import Tokenizer

        self.splitter = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = speller(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.automaton.label.update({i: c.decode() for c, i in self.special.items()})
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.special_split = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.letters = byte_letters()
        self.heads, self.tails = Table(self.encode_head), Table(self.encode_text)

    def encode_chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk. Most chunks are one word of Latin letters and a tail of ASCII punctuation, which
        pre-splitting parts there; such words and tails are looked up by themselves."""
        head = chunk.rstrip(PUNCTUATION)
        own = self.heads[head] if head else None
        if own is not None:
            return own + self.tails[chunk[len(head) :]] if len(head) < len(chunk) else own
        return self.encode_text(chunk)

    def encode_head(self, head: bytes) -> bytes | None:
        """Ids of a word of Latin letters; None for anything else."""
        if head.isalpha():
            return packed_ids(self.automaton.encode(head.decode()))
        text = head.decode("utf-8", "replace")
        if not text.isalpha() or max(text) >= "\u0250":
            return None
        word = unicodedata.normalize("NFC", text).lower()
        if not word.isalpha():  # lower case may add marks that are no letters
            return None
        return packed_ids(self.automaton.encode("".join(map(self.letters.__getitem__, word.encode()))))

    def encode_text(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        out: list[int] = []
        if text.isascii():
            for word in self.words.findall(text):
                out += self.automaton.encode("".join(map(self.letters.__getitem__, word.encode())) if not word.isprintable() else word)
        elif max(text) < "\u0250":
            for word in self.words.findall(unicodedata.normalize("NFC", text).lower()):
                out += self.automaton.encode("".join(map(self.letters.__getitem__, word.encode())))
        else:  # letters on which Unicode's versions differ: pre-split as the file's library does
            for word, _ in self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text)):
                out += self.automaton.encode(word)
        return packed_ids(out)

    def chunks(self, text: bytes) -> list[bytes]:
        """Chunks in lower case (A-Z); a special token is a chunk of its own behind a NUL and a space."""
        if self.special_split is None or not self.special_split.search(text):
            return text.lower().split()
        out: list[bytes] = []
        for part in self.special_split.split(text):
            out += [b"\0 " + part] if part in self.special else part.lower().split()
        return out

    def ids(self, chunk: bytes) -> bytes:
        """A chunk's ids, four little-endian bytes each."""
        return packed_ids([self.special[chunk[2:]]]) if chunk[:2] == b"\0 " else self.encode_chunk(chunk)


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked_ids(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) >> 2}I", data)


class Table(dict):
    """key -> what ``make`` gives for it, filled on demand. Beyond TABLE_ENTRIES entries or TABLE_BYTES of keys,
    what is held becomes the old generation, from which entries still asked for come back; the old one before is
    dropped. Keys of over LONG_KEY bytes are not held: long runs without white space seldom come again."""

    LONG_KEY = 256

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, key: bytes):
        if len(key) > self.LONG_KEY:
            return self.make(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= TABLE_ENTRIES or self.size > TABLE_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += len(key)
        self[key] = value
        return value


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, Encoder] = {}
_TABLES: dict[tuple, Table] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a Python worker: its automaton and tables serve all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def worker_table(path: str, kind: str, make) -> Table:
    """A worker's table of chunks for one vocabulary file and one kind of value."""
    if (path, kind) not in _TABLES:
        _TABLES[path, kind] = Table(make)
    return _TABLES[path, kind]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array) and decoded text of each row, in Arrow batches. Null text counts as empty, ids may be null or
    repeat, and an empty table gives an empty result."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    ddl = "doc_id long, ids array<int>, decoded string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        table = worker_table(path, "ids", own.ids)
        for batch in batches:
            ids = [list(unpacked_ids(b"".join(map(table.__getitem__, own.chunks(x))))) for x in byte_texts(batch.column("text"))]
            yield record_batch(schema, [batch.column("doc_id"), ids, [own.automaton.decode(x) for x in ids]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: the digests of ``encode_documents``
    without its long columns. A chunk's ids and its decoded labels are looked up as bytes.

    Null text counts as empty: no tokens, the digests of nothing. Rows are encoded one by one, so
    repeated rows and null ids give rows alike; an empty table gives an empty result.
    """
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)

        def make(chunk: bytes) -> tuple[bytes, bytes, int]:
            ids = unpacked_ids(own.ids(chunk))
            return " ".join(map(str, ids)).encode(), own.automaton.decode(ids).encode(), len(ids)

        table = worker_table(path, "digests", make)
        for batch in batches:
            out = []
            for text in byte_texts(batch.column("text")):
                parts = [x for x in map(table.__getitem__, own.chunks(text)) if x[2]]
                ids, labels, counts = zip(*parts) if parts else ((), (), ())
                out.append((sum(counts), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b" ".join(labels)).hexdigest()))
            yield record_batch(schema, [batch.column("doc_id"), *([x[i] for x in out] for i in range(3))])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
