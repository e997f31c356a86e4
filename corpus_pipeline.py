"""Clean, deduplicate and pack a corpus: each stage is one of the text operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapeflow.llm import line_dedup, near_copies, packing, suffix_dedup, toxicity
from shapeflow.llm.common import documents, small_batches, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier, trained on the corpus, calls clean.

    Null and empty texts have no toxic word and stay; repeated rows stay or go together; rows
    without an id are scored like others. Without labelled rows of both kinds all stay.
    """
    small_batches(spark)
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, docs.columns, ("_toxic_score", "_toxic"))
    return scored.filter("_toxic = 0").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without multi-line chunks that an earlier document or place has; no row goes.

    Null and empty texts stay as they are. Rows of one id with different texts are documents of
    their own, rows alike in id and text keep the same chunks, rows without an id come last.
    """
    return line_dedup.remove_repeated_chunks(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingle sets of a similarity of 0.8 or more, found by MinHash bands.

    The row of the smallest id stays; repeated rows and rows without an id are copies like
    others. Texts without words, null and empty ones, are one group.
    """
    return near_copies.drop_copies(docs)


def drop_copies_of_both_kinds(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that the links of ``drop_near_copies`` and those of op5, fingerprints within its radius, make together.

    Either links pairs that the other leaves out. Else as ``drop_near_copies``.
    """
    return near_copies.drop_copies(docs, by_prints=True)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that stand at several places; no row goes.

    Null texts stay null, short and empty ones as they are. Rows alike in id and text, which
    the stage before leaves once, would lose each other's strings. Part of a character left by a cut goes too.
    """
    return suffix_dedup.remove_repeated(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences. A null or empty text is one piece, the end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near-copy dedup", drop_copies_of_both_kinds),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack),
]
#: No SQL expresses these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages, applied to the documents in order, leave."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"stage-{k}")
    return docs
