import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest int, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with extra columns whose names the operators use themselves."""
    def build(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, "y") for i, t in zip(ids, texts)], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Empty, null, blank and very long texts, repeats, ties and non-ASCII."""
    passage = "the quick brown fox jumps over the lazy dog while the band plays on and on until dawn " * 4
    return [
        None, "", " \t\n", "a", "Same text here", "same TEXT here", "same text here", passage, "Intro one. " + passage, "Another intro. " + passage + " tail",
        "x" * 5000, "word " * 20000, "Ünï cödé ΣΑΣ İstanbul é 日本語 \x00 \x1c text", "line one here\nline two here\nline three\n\nend", "head\nline one here\nline two here\nline three\n\nend",
    ]
