"""Recorded datasets: positions in files, scenario logs, unions, and changes of recorded states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.operators.evaluate import as_of_scenario, with_expected
from shapeflow.operators.ranks import numbered_within

#: Fixed value: a line of a scenario log, with hour, minute, second and name.
SCENARIO = r"^(\d\d):(\d\d):(\d\d) (\w+) for"
STEP_S, LEAD_S = 2, 5
PREVIOUS = ("previous_window_top_answers", "previous_batch_top_answers")
STATE = "map<string,string>"


def scenario_starts(lines: DataFrame) -> DataFrame:
    """(tag, ts_s, scenario) of scenario-log lines (tag, seq, value); other lines say nothing."""
    part = lambda i: F.regexp_extract("value", SCENARIO, i)
    return lines.filter(F.col("value").rlike(SCENARIO)).select("tag", (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).alias("ts_s"), part(4).alias("scenario"))


def load_dataset(ticks: DataFrame, log: DataFrame, every: int = 1) -> DataFrame:
    """(tag, scenario, expected, state, tick) of recorded ticks (tag, i, jev_state, ticks) and their scenario logs.

    Tick i of a tag stands at five seconds before the log's first line plus two seconds a tick.
    Ticks before the first start, within the warm-up of a start or without a state are
    dropped; of the rest each ``every``-th of a tag stays. The tag ends at its first underscore.
    """
    clock = F.split(F.substring("value", 1, 8), ":")
    seconds = clock[0].cast("int") * 3600 + clock[1].cast("int") * 60 + clock[2].cast("int")
    zero = log.groupBy("tag").agg((F.min_by(seconds, "seq") - LEAD_S).alias("_zero"))
    timed = ticks.filter(F.coalesce("jev_state", F.lit("")) != "").join(zero, "tag").withColumn("secs", (F.col("_zero") + F.col("i") * STEP_S).cast("int"))
    labelled = with_expected(as_of_scenario(timed, scenario_starts(log)))
    if every > 1:
        labelled = numbered_within(labelled, "tag", "i", "_n").filter((F.col("_n") - 1) % every == 0)
    return labelled.select(F.substring_index("tag", "_", 1).alias("tag"), "scenario", "expected", F.col("jev_state").alias("state"), F.col("ticks").alias("tick"))


def union_datasets(*parts: DataFrame) -> DataFrame:
    """Datasets and samples one behind another, with pos in the order given: first by part, then by the part's own pos."""
    out = None
    for k, part in enumerate(parts):
        own = part.withColumn("part", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def first_met(samples: DataFrame, *order: str) -> DataFrame:
    """(tag, place): distinct tags in the order in which they are first met."""
    tags = samples.groupBy("tag").agg(F.min(F.struct(*order)).alias("_at"))  # one row a tag
    return tags.select("tag", F.row_number().over(Window.orderBy("_at")).alias("place"))


def of_scenarios(samples: DataFrame, scenarios: list[str]) -> DataFrame:
    return samples.filter(F.col("scenario").isin(scenarios))


def reset_previous(state: Column) -> Column:
    """A recorded state (JSON object of strings) as if nothing had been answered before."""
    return F.to_json(F.transform_values(F.from_json(state, STATE), lambda k, v: F.when(k.isin(*PREVIOUS), "none yet").otherwise(v)))


def summary_apart(state: Column) -> Column:
    """A recorded state whose packet log begins with a summary line has that line in a field of its own; others stay as they are."""
    m = F.from_json(state, STATE)
    log = m["packet_log"]
    head = F.substring_index(log, "\n", 1)
    moved = F.map_concat(
        F.create_map(F.lit("legend"), m["legend"], F.lit("summary"), F.substring(head, F.lit(len("summary: ") + 1), F.length(head)), F.lit("packet_log"), F.when(head == log, "").otherwise(F.substring(log, F.length(head) + 2, F.length(log)))),
        F.map_filter(m, lambda k, v: ~k.isin("legend", "packet_log")),
    )
    return F.when(log.startswith("summary:"), F.to_json(moved)).otherwise(state)
