"""Labelled samples and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators.ranks import numbered_within

WARM_UP_S = 12
#: Scenario -> expected activity.
EXPECT = {"browsing": "web_browsing", "download": "large_file_download", "upload": "large_file_upload", "wallet": "wallet_polling_rpc", "chat": "chat", "torrent": "torrent", "ssh_typing": "ssh", "idle": "idle"}


def activity_key(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def catalog(rows: DataFrame, most: int = 255) -> DataFrame:
    """(key, name, shape) of an activity table (name, shape), white space collapsed; raises for empty fields, repeated keys or too many rows."""
    tidy = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    out = rows.select(activity_key(F.col("name")).alias("key"), tidy(F.col("name")).alias("name"), tidy(F.col("shape")).alias("shape"))
    state = out.agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.count_if((F.coalesce("name", F.lit("")) == "") | (F.coalesce("shape", F.lit("")) == "")).alias("empty")).first()
    if not 0 < state["n"] <= most or state["empty"] or state["keys"] != state["n"]:
        raise ValueError(f"bad activity catalog: {state.asDict()}")
    return out


def known_samples(samples: DataFrame, keys: DataFrame, every: int = 1) -> DataFrame:
    """Samples (seq, label, ...) with normalised labels, each ``every``-th in order of seq and mode; raises for labels not in the catalog."""
    s = samples.withColumn("label", activity_key(F.col("label")))
    if not s.join(F.broadcast(keys.select("key")), F.col("label") == F.col("key"), "left_anti").isEmpty():
        raise ValueError("samples with labels that the catalog does not have")
    return s if every == 1 else numbered_within(s, "mode", "seq", "_n").filter((F.col("_n") - 1) % every == 0).drop("_n")


def as_of_scenario(ticks: DataFrame, log: DataFrame, warm_up: int = WARM_UP_S) -> DataFrame:
    """Ticks (tag, secs, ...) with the scenario running then: the last start of their tag at or before them.

    Ticks before the first start, or within ``warm_up`` seconds of a start, are dropped. Each
    start's interval is joined by tag and range; Spark broadcasts the log where its size is
    under the session's threshold and sorts both by tag where it is not.
    """
    ends = F.lead("ts_s").over(Window.partitionBy("tag").orderBy("ts_s"))
    spans = log.withColumn("until", F.coalesce(ends, F.lit(1 << 30)))
    t = ticks.join(spans.withColumnRenamed("tag", "_tag"), (F.col("tag") == F.col("_tag")) & (F.col("secs") >= F.col("ts_s")) & (F.col("secs") < F.col("until")))
    return t.filter(F.col("secs") - F.col("ts_s") >= warm_up).drop("_tag", "until")


def with_expected(rows: DataFrame) -> DataFrame:
    """``expected``, the activity of the row's scenario; a scenario that has none fails the query."""
    pairs = F.create_map(*(F.lit(x) for kv in EXPECT.items() for x in kv))
    known = F.try_element_at(pairs, F.col("scenario"))
    return rows.withColumn("expected", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown scenario: "), F.coalesce("scenario", F.lit("null")))).cast("string")))


def p_expected(probabilities: Column, expected: Column) -> Column:
    return F.coalesce(F.try_element_at(probabilities, expected), F.lit(0.0))


def report(results: DataFrame, *extra: str) -> DataFrame:
    """Per scenario and tag: accuracy, mean probability of the expected activity, most common choice (ties: smallest), rows."""
    key = ["scenario", "tag", *extra]
    choices = results.groupBy(*key, "choice").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == F.col("expected")).alias("hits"), F.sum("p_expected").alias("p"))
    return choices.groupBy(*key).agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum("p") / F.sum("n")).alias("mean_p"),
        F.min(F.struct((-F.col("n")).alias("n"), "choice")).getField("choice").alias("common_choice"), F.sum("n").alias("n"))


def totals(results: DataFrame, *extra: str) -> DataFrame:
    """Per tag, idle scenarios left out."""
    return results.filter("scenario <> 'idle'").groupBy("tag", *extra).agg(F.avg((F.col("choice") == F.col("expected")).cast("int")).alias("accuracy"), F.avg("p_expected").alias("mean_p"), F.count("*").alias("n"))


def pivot(results: DataFrame, tags: list[str]) -> DataFrame:
    return results.groupBy("scenario").pivot("tag", tags).agg(F.avg((F.col("choice") == F.col("expected")).cast("int")))
