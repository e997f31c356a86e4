"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.llm.common import arrow_schema, byte_texts, documents, record_batch, small_batches
from shapeflow.llm.ngram_model import code_bucket, code_buckets, fit_logistic, fit_platt, sigmoid

BITS = 20
MASKED, SYMBOLS = re.compile(r"[^\W\d_]\*+[^\W\d_]"), re.compile(r"[^\W\d_][*#$%&]{3}")
PUNCTUATION = ".,;:!?*&%$#|\"'()[]<>-"
#: A term is a word or one of its beginnings of these lengths.
PREFIXES = (4, 5)
#: Written lexicons, each a voter.
LEXICONS = {  # words that are common in another language here ("die", "dick") are left out
    "insults": "idiot idiots moron morons imbecile fool dumb dumbass stupid retard dunce halfwit nitwit simpleton airhead blockhead ignoramus",
    "contempt": "trash garbage worthless useless pathetic disgusting scum vermin filth filthy rubbish despicable repulsive lowlife parasite subhuman",
    "mockery": "clown loser losers coward crybaby laughable ridiculous ugly fatso creep weirdo wimp",
    "threats": "kill murder strangle stab shoot exterminate behead slaughter",
    "profanity": "shit bullshit fuck fucking fucker bitch bastard asshole crap damn slut whore prick cunt piss",
    "german": "idiot trottel dumm dummkopf depp arsch arschloch abschaum dreck wertlos widerlich versager hure scheisse scheiße schwein vollidiot",
    "french": "idiot imbécile crétin stupide débile ordure salaud connard connasse putain merde minable déchet abruti",
    "spanish": "idiota imbécil estúpido estúpida tonto basura inútil asqueroso asquerosa mierda puta cabrón pendejo perdedor escoria",
}
#: Pattern voters, in the order of their bits.
PATTERNS = ("shouting", "exclaiming", "masked words", "symbols on words")
#: Voters over learned words, and over learned beginnings of each length.
WORD_VOTERS, PREFIX_VOTERS = 4, 2
OTHER_LETTERS = re.compile(r"[^\x00-\x7f]")
#: Words kept in a task's table, and the longest that is kept (characters); beyond the first the table starts anew.
TABLE_WORDS, KEPT_WORD = 400_000, 64


class WordTable(dict):
    """What ``function`` gives for each word, kept for later texts; bounded in words and, as long words are not kept, in bytes."""

    def __init__(self, function: Callable[[str], object]) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, word: str) -> object:
        value = self.function(word)
        if len(word) <= KEPT_WORD:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = value
        return value


def word_set(text: str) -> set[str]:
    return set(text.lower().split())


def word_code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & ~3 & 0xFFFFFFFF


def word_terms(chunk: str) -> list[int]:
    """32-bit codes of a word and its beginnings; the low two bits tell the kind (0 word, 1 and 2 beginnings)."""
    word = chunk.strip(PUNCTUATION)
    if not word:
        return []
    return [word_code(word)] + [zlib.crc32(word[:n].encode("utf-8", "replace")) & ~3 | k for k, n in enumerate(PREFIXES, 1) if len(word) > n]


def pattern_bits(text: str) -> int:
    """One bit for each of PATTERNS: more capitals than small letters; exclamation marks on one word in ten; a masked
    word (letters around asterisks) ; three symbols behind one word in ten or more."""
    letters, others = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), OTHER_LETTERS.findall(text)
    upper = int(np.count_nonzero((letters >= 65) & (letters <= 90))) + sum(map(str.isupper, others))
    lower = int(np.count_nonzero((letters >= 97) & (letters <= 122))) + sum(map(str.islower, others))
    words = text.count(" ") + 1
    masked = "*" in text and MASKED.search(text) is not None
    symbols = len(SYMBOLS.findall(text)) if any(c in text for c in "*#$%&") else 0
    return (upper > lower) | (text.count("!") * 10 > words + 9) << 1 | masked << 2 | (symbols * 10 > words + 9) << 3


@dataclass
class LabelModel:
    """Prior, and P(vote | class, vote of the voter it is tied to) of each voter; votes are 0 abstain, 1 clean, 2 toxic.

    A voter that is tied to none has equal rows. The ties form a forest, so the product over
    voters is a proper joint distribution of all votes given the class, correlations included.
    """

    prior: float
    parents: list[int | None]
    chances: np.ndarray  # voter, class, vote of the parent, vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.chances)
        total = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for v, parent in enumerate(self.parents):
            before = votes[:, parent] if parent is not None else np.zeros(len(votes), dtype=np.int64)
            total += (logs[v, 1] - logs[v, 0])[before, votes[:, v]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def accuracies(self, votes: np.ndarray) -> np.ndarray:
        """Of each voter: how often, by the model's posterior, the class is the one it votes for, where it votes; null where it never does."""
        q = self.posterior(votes)
        right = np.where(votes == 2, q[:, None], 1 - q[:, None]) * (votes > 0)
        return right.sum(axis=0) / np.where((votes > 0).any(axis=0), (votes > 0).sum(axis=0), np.nan)


def joint_counts(a: np.ndarray, b: np.ndarray, shares: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(class, vote of a, vote of b): expected numbers of rows; ``shares`` are each pattern's rows of either class."""
    cell = a * 3 + b
    return np.stack([np.bincount(cell, w, minlength=9).reshape(3, 3) for w in shares])


def chance_tables(votes: np.ndarray, shares: tuple[np.ndarray, np.ndarray], parents: list[int | None]) -> np.ndarray:
    out = np.empty((votes.shape[1], 2, 3, 3))
    for v, parent in enumerate(parents):
        own = np.stack([np.bincount(votes[:, v], w, minlength=3) + 0.5 for w in shares])
        own /= own.sum(axis=1, keepdims=True)
        out[v] = own[:, None, :]
        if parent is not None:  # seldom seen votes of the parent fall back on the voter's own chances
            table = joint_counts(votes[:, parent], votes[:, v], shares) + 2 * own[:, None, :]
            out[v] = table / table.sum(axis=2, keepdims=True)
    return out


def tied_parents(votes: np.ndarray, shares: tuple[np.ndarray, np.ndarray], least: float = 30.0) -> list[int | None]:
    """The forest of strongest ties: pairs by their mutual information given the class, strongest first, while it is
    significant (twice the rows' log-likelihood ratio over ``least``) and closes no circle."""
    k, ties = votes.shape[1], []
    for v in range(k):
        for w in range(v + 1, k):
            table = joint_counts(votes[:, v], votes[:, w], shares) + 1e-9
            apart = table.sum(axis=2, keepdims=True) * table.sum(axis=1, keepdims=True) / table.sum(axis=(1, 2), keepdims=True)
            gain = 2 * float((table * np.log(table / apart)).sum())
            if gain > least:
                ties.append((-gain, v, w))
    tree, near = list(range(k)), {v: [] for v in range(k)}

    def root(v: int) -> int:
        while tree[v] != v:
            v = tree[v]
        return v

    for _, v, w in sorted(ties):
        if root(v) != root(w):
            tree[root(w)] = root(v)
            near[v].append(w)
            near[w].append(v)
    parents: list[int | None] = [None] * k
    seen: set[int] = set()
    for start in range(k):
        queue = [start] if start not in seen else []
        seen.update(queue)
        while queue:
            v = queue.pop()
            for w in near[v]:
                if w not in seen:
                    seen.add(w)
                    parents[w] = v
                    queue.append(w)
    return parents


def fit_label_model(votes: np.ndarray, rows: np.ndarray | None = None, rounds: int = 25) -> LabelModel:
    """Expectation-maximisation over voters' accuracies and ties, from the votes alone.

    ``rows`` tells how many rows have each pattern of votes (one, unless given). It starts from the share of toxic among each row's votes. Accuracies settle first with
    voters taken as independent given the class; then the strongest ties enter the
    likelihood and both are estimated to the end.
    """
    rows = np.ones(len(votes)) if rows is None else rows.astype(np.float64)
    toxic, clean = (votes == 2).sum(axis=1), (votes == 1).sum(axis=1)
    q = (toxic + 0.5) / (toxic + clean + 1.0)
    parents: list[int | None] = [None] * votes.shape[1]
    for step in range(2 * rounds):
        shares = (rows * (1 - q), rows * q)
        if step == rounds:
            parents = tied_parents(votes, shares)
        prior = float(np.clip(shares[1].sum() / rows.sum(), 0.001, 0.999))
        model = LabelModel(prior, parents, chance_tables(votes, shares, parents))
        after = np.clip(model.posterior(votes), 1e-6, 1 - 1e-6)
        if step >= rounds and np.abs(after - q).max() < 1e-6:
            break
        q = after
    return model


def written_codes() -> list[np.ndarray]:
    return [np.array(sorted(word_code(w) for w in words.split()), dtype=np.uint32) for words in LEXICONS.values()]


def word_voters() -> int:
    """Number of voters over words: written lexicons, learned words and learned beginnings."""
    return len(LEXICONS) + WORD_VOTERS + PREFIX_VOTERS * len(PREFIXES)


def vote_patterns(votes: np.ndarray) -> np.ndarray:
    """A row's votes as one number, a bit for each voter but the last that votes toxic. The last one's vote follows from the others'."""
    return ((votes[:, :-1] == 2).astype(np.int64) << np.arange(votes.shape[1] - 1)).sum(axis=1)


def pattern_votes(patterns: np.ndarray) -> np.ndarray:
    """The votes that ``vote_patterns`` made into numbers."""
    bits = patterns[:, None] >> np.arange(word_voters() + len(PATTERNS)) & 1
    return np.column_stack([2 * bits, np.where(bits[:, : word_voters()].any(axis=1), 0, 1)])


def voter_votes(codes: list[np.ndarray], patterns: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Votes (0 abstain, 1 clean, 2 toxic) of: written lexicons, learned words, learned beginnings, patterns, and absence of all words."""
    written = written_codes()
    first, learned = len(written), word_voters()
    row, flat = np.repeat(np.arange(len(codes)), list(map(len, codes))), np.concatenate(codes)
    votes = np.zeros((len(codes), learned + len(PATTERNS) + 1), dtype=np.int64)
    for v, own in enumerate(written):
        votes[row[np.isin(flat, own)], v] = 2
    hit = np.isin(flat, lexicon)
    kind, number = flat[hit] & 3, flat[hit] >> 2
    voter = np.where(kind == 0, number % WORD_VOTERS, WORD_VOTERS + PREFIX_VOTERS * (np.maximum(kind, 1) - 1) + number % PREFIX_VOTERS)
    hits = np.zeros((len(codes), learned - first), dtype=np.int64)
    np.add.at(hits, (row[hit], voter.astype(np.int64)), 1)
    hits[:, WORD_VOTERS:] -= 1  # one word that begins so may do so by chance
    votes[:, first:learned] = np.where(hits > 0, 2, 0)
    for k in range(len(PATTERNS)):
        votes[:, learned + k] = np.where(patterns >> k & 1, 2, 0)
    votes[:, -1] = np.where((votes[:, :learned] == 2).any(axis=1), 0, 1)
    return votes


def learn_lexicon(codes: list[np.ndarray], target: np.ndarray, precision: float = 0.9) -> np.ndarray:
    """Terms of which, at ``precision`` or more, the labelled texts they stand in are toxic, and in so many that chance
    would give less than one such term among all that there are."""
    own = [np.unique(x) for x in codes]
    terms, place = np.unique(np.concatenate(own) if own else np.zeros(0, dtype=np.uint32), return_inverse=True)
    toxic = np.bincount(place, np.repeat(target, list(map(len, own))), minlength=len(terms))
    texts = np.bincount(place, minlength=len(terms))
    least = np.log(max(2, len(terms))) / -np.log(np.clip(target.mean(), 1e-3, 0.9)) if len(target) else 1
    return terms[(toxic >= max(3, least)) & (toxic >= precision * texts)]


def telling_terms(row: np.ndarray, flat: np.ndarray, soft: np.ndarray, least: int = 3, deviation: float = 3.0) -> np.ndarray:
    """Mask of the terms that stand in ``least`` texts or more and whose posterior labels there differ from the
    prior by ``deviation`` standard errors or more."""
    _, place = np.unique(flat, return_inverse=True)
    first = np.ones(len(flat), dtype=bool)  # a text's codes are sorted: the first of equal ones stands for the text
    first[1:] = (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])
    support = np.bincount(place[first])
    toxic = np.bincount(place[first], soft[row[first]])
    prior = float(np.clip(soft.mean(), 1e-3, 1 - 1e-3))
    return ((support >= least) & (np.abs(toxic - support * prior) >= deviation * np.sqrt(support * prior * (1 - prior))))[place]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def vote_counts(docs: DataFrame, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of votes and how many different texts have each, over all rows with an id outside the held-out fifth.

    Every such text votes, in tasks; equal texts (by 128-bit digest) count once, so a large group of
    copies does not sway the model, and texts without words do not count. What reaches the driver is
    one count a pattern, 2^20 at most, whatever the corpus holds.
    """
    known = frozenset(np.concatenate([lexicon, *written_codes()]).tolist())
    shared = docs.sparkSession.sparkContext.broadcast((known, lexicon))  # terms of max_rows labelled texts
    ddl = "pattern long, digest binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lexicon = shared.value
        table = WordTable(lambda w: np.array([c for c in word_terms(w) if c in known], dtype=np.uint32).tobytes())
        for batch in batches:
            codes, bits, digests = [], [], []
            for text in byte_texts(batch.column("text")):
                string = text.decode("utf-8", "replace")
                words = word_set(string)
                if words:
                    codes.append(np.frombuffer(b"".join(map(table.__getitem__, words)), dtype=np.uint32))
                    bits.append(pattern_bits(string))
                    digests.append(xxhash.xxh3_128_digest(text))
            if codes:
                yield record_batch(schema, [vote_patterns(voter_votes(codes, np.array(bits), lexicon)), digests])

    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text")
    counts = rows.mapInArrow(run, ddl).distinct().groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    return counts.column("pattern").to_numpy(), counts.column("n").to_numpy()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, other_rows: int = 2000) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and calibration, from rows with an id outside the held-out fifth.

    Labels only choose the learned lexicons, from at most ``max_rows`` labelled rows, the first by a
    hash of the id. The label model is fitted, without labels, to the votes on all rows
    (``vote_counts``). The classifier is fitted to its posterior labels of a bounded sample: those
    labelled rows and ``other_rows`` more, the first by the same hash. Rows without an id take no part. Without labelled rows of both kinds the model calls every text clean.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("target"))
    first = lambda ids, n: ids.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(n)
    chosen = first(known, max_rows)
    others = first(docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), other_rows).distinct()
    chosen = chosen.unionByName(others.join(chosen, "doc_id", "left_anti").withColumn("target", F.lit(-1)))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows + other_rows ids at most
    ddl = "rank long, target int, patterns int, codes binary"
    schema = arrow_schema(ddl)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in byte_texts(batch.column("text"))]
            codes = [np.array(sorted(c for w in word_set(x) for c in word_terms(w)), dtype=np.uint32).tobytes() for x in texts]
            yield record_batch(schema, [batch.column("rank"), batch.column("target"), list(map(pattern_bits, texts)), codes])

    rows = {bytes(r["codes"]): r for r in sorted(sample.mapInArrow(terms, ddl).collect(), key=lambda r: (r["target"], r["rank"], r["codes"]))}.values()  # copies count once, labelled ones first
    rows = sorted((r for r in rows if r["codes"]), key=lambda r: (r["rank"], r["codes"]))
    gold = np.array([r["target"] for r in rows], dtype=np.float64)
    labelled = gold >= 0
    if not 0 < (gold == 1).sum() < labelled.sum():
        return np.zeros(1 << BITS, dtype=np.float32), -10.0, 1.0, 0.0
    codes = [np.frombuffer(r["codes"], dtype=np.uint32) for r in rows]
    lexicon = learn_lexicon([x for x, known in zip(codes, labelled) if known], gold[labelled])
    patterns, counts = vote_counts(docs, lexicon)
    votes = voter_votes(codes, np.array([r["patterns"] for r in rows]), lexicon)
    soft = fit_label_model(pattern_votes(patterns), counts).posterior(votes)
    row, flat = np.repeat(np.arange(len(codes)), list(map(len, codes))), np.concatenate(codes)
    telling = telling_terms(row, flat, soft)
    row, buckets = row[telling], code_buckets(flat[telling], BITS).astype(np.int64)
    check = np.arange(len(rows)) % 5 == 4
    inside = ~check[row]
    place = np.cumsum(~check) - 1
    weights, bias = fit_logistic(place[row[inside]], buckets[inside], np.ones(int(inside.sum())), soft[~check], 1 << BITS, l2=1e-4, steps=300, rate=0.02)
    z = np.bincount(row, weights[buckets], minlength=len(rows)) + bias
    return weights, bias, *fit_platt(z[check], soft[check])


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float, float, float], keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """score (probability of toxic) and predicted (score >= 0.5) beside the columns named in ``keep`` (default doc_id);
    ``names`` renames the two where the rows have such columns already.

    The score of a row follows from its whole text alone. Null text counts as empty and scores
    by the bias; repeated rows score alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS weights
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.col("text").alias("_scored_text"))
    fields = [f for f in rows.schema.fields if f.name != "_scored_text"]
    schema = f"{names[0]} double, {names[1]} int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, shift = shared.value
        table = WordTable(lambda w: sum(float(weights[code_bucket(c, BITS)]) for c in word_terms(w)))
        for batch in batches:
            scores = []
            for text in byte_texts(batch.column("_scored_text")):
                words = word_set(text.decode("utf-8", "replace"))
                scores.append(sigmoid(slope * (sum(sorted(filter(None, map(table.__getitem__, words)))) + bias) + shift))
            columns = [batch.column(f.name) for f in fields] + [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *names])

    from pyspark.sql.types import StructType

    return rows.mapInArrow(judge, StructType([*fields, *StructType.fromDDL(schema).fields]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; held_out is null where doc_id is, and such rows train nothing."""
    docs = documents(spark, sf_dir)
    small_batches(spark)
    scored = score_toxicity(docs, train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
