"""Analytics over answers: entropy, bits, smoothing, episodes, events, totals, scoring hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeflow.functions.levels import level
from shapeflow.operators.ranks import numbered_within
from shapeflow.operators.scans import RANGE, in_ranges, running
from shapeflow.session import store, tasks

ALPHA, HISTORY, TOP_N, EVENT_AT = 0.4, 60, 5, 0.6
#: Ticks that the smoothing looks back on: 0.6 ** 64 is below the precision of a double's last digits that matter here.
LOOK_BACK = 63
#: Answers of a link that are smoothed as one.
BLOCK = 2_048


def entropy_bits(p: Column) -> Column:
    """Shannon entropy of a map's positive values, normalised by their sum."""
    values = F.filter(F.map_values(p), lambda x: x > 0)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))).otherwise(0.0)


def identifying_bits(p: Column, options: int) -> Column:
    return bits_below(entropy_bits(p), options)


def bits_below(entropy: Column, options: int) -> Column:
    """What an entropy lacks of that of so many equal options."""
    return F.greatest(F.lit(0.0), F.log2(F.lit(float(options))) - entropy) if options > 1 else F.lit(0.0)


def anonymity_set(bits: Column, population: float = 8e9) -> Column:
    return F.greatest(F.lit(1.0), F.lit(float(population)) / F.pow(F.lit(2.0), bits))


def _blocks(answers: DataFrame, keys: list[str], *also: Column) -> DataFrame:
    """(iface, tick, ``also``, _p, _s): each activity's probability and its exponential mean over answered ticks, in the order of ``keys``.

    Answers are numbered along their link and dealt by blocks of BLOCK; a block also gets the LOOK_BACK
    answers before it, so a link of any length is spread over tasks. The weighted sum over the last 64 answers is put together
    by doubling: each step adds the sums that end as far back as they reach.
    """
    n = tasks(answers)
    p = F.array(*(F.coalesce(F.try_element_at("probabilities", F.lit(k)), F.lit(0.0)) for k in keys))
    s = numbered_within(answers.select("iface", "tick", "probabilities"), "iface", "tick", "_nth", n, ("iface", "tick", *also, p.alias("_p")))
    s = s.withColumn("_nth", F.col("_nth") - 1).withColumn("_own", F.expr(f"_nth div {BLOCK}"))
    s = s.withColumn("_block", F.explode(F.when(F.col("_nth") % BLOCK >= BLOCK - LOOK_BACK, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))).repartition(n, "iface", "_block")
    by, names = Window.partitionBy("iface", "_block").orderBy("_nth"), [f"_s{i}" for i in range(len(keys))]
    s = s.select("*", *((F.get("_p", F.lit(i)) * ALPHA).alias(c) for i, c in enumerate(names)))
    for k in (1, 2, 4, 8, 16, 32):
        s = s.withColumns({c: F.col(c) + F.lit((1 - ALPHA) ** k) * F.coalesce(F.lag(c, k).over(by), F.lit(0.0)) for c in names})
    return s.filter("_block = _own").withColumn("_s", F.array(*names)).drop("_nth", "_own", "_block", *names)


def smoothed(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(iface, tick, activity, p, smoothed): exponential mean over answered ticks, from 0; a missing key counts as 0."""
    names = F.array(*map(F.lit, keys))
    return _blocks(answers, keys).select("iface", "tick", F.inline(F.arrays_zip(names.alias("activity"), F.col("_p").alias("p"), F.col("_s").alias("smoothed"))))


def _likeliest(keys: list[str]) -> Column:
    """Structs (mark, activity, smoothed) of all activities, the likeliest first by their least mark; ties by name."""
    return F.array(*(F.struct((-F.round(F.get("_s", F.lit(i)), 9)).alias("mark"), F.lit(k).alias("activity"), F.get("_s", F.lit(i)).alias("smoothed")) for i, k in enumerate(keys)))


def top_smoothed(answers: DataFrame, keys: list[str], n: int = TOP_N) -> DataFrame:
    """(iface, tick, activity, smoothed, rank): the ``n`` likeliest smoothed activities of each tick; ties by name."""
    top = _blocks(answers, keys).select("iface", "tick", F.posexplode(F.slice(F.array_sort(_likeliest(keys)), 1, n)).alias("_at", "_x"))
    return top.select("iface", "tick", "_x.activity", "_x.smoothed", (F.col("_at") + 1).alias("rank"))


def episodes(answers: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """Per tick: smoothed top, entropy, bits, episode number, session bits (each episode counts its largest) and their raw sum.

    With ``spread`` the running values of a link of any length are dealt over many tasks.
    """
    a = _blocks(answers, keys, entropy_bits(F.col("probabilities")).alias("entropy"))
    a = a.select("iface", "tick", "entropy", bits_below(F.col("entropy"), len(keys)).alias("bits"), F.array_min(_likeliest(keys))["activity"].alias("smoothed_top"))
    a = store(a, "answer-tops")  # so that ranges are drawn without smoothing anew
    link, order = ["iface"], ["tick"]
    a = running(in_ranges(a, link, order, tasks(answers)) if spread else a, link, order, _before=("last", F.col("smoothed_top"), True))
    a = a.withColumn("_new", F.when(F.col("_before") == F.col("smoothed_top"), 0).otherwise(1))
    a = running(a, link, order, episode=("sum", F.col("_new"), False), raw_total_bits=("sum", F.col("bits"), False))
    a = running(a, ["iface", "episode"], order, _most=("max", F.col("bits"), True)).withColumn("gain", F.greatest(F.lit(0.0), F.col("bits") - F.coalesce("_most", F.lit(0.0))))
    return running(a, link, order, total_bits=("sum", F.col("gain"), False)).withColumn("anonymity_set", anonymity_set(F.col("total_bits"))).drop("_before", "_new", "_most", RANGE)


def session_totals(ticks: DataFrame) -> DataFrame:
    """Each link's last tick."""
    return ticks.groupBy("iface").agg(F.max_by("total_bits", "tick").alias("total_bits"), F.max_by("raw_total_bits", "tick").alias("raw_total_bits"), F.max("episode").alias("episodes"), F.count("*").alias("answered_ticks"))


def rising_edges(answers: DataFrame, at: float = EVENT_AT) -> DataFrame:
    """(iface, tick, kind, activity, probability) where a kind's probability comes to ``at`` or more; ticks without the kind don't count."""
    kinds = answers.select("iface", "tick", "top", F.explode("nouls").alias("kind", "p")).withColumn("on", F.col("p") >= at)
    was = F.lag("on").over(Window.partitionBy("iface", "kind").orderBy("tick"))
    return kinds.withColumn("was", was).filter(F.col("on") & ~F.coalesce("was", F.lit(False))).select("iface", "tick", "kind", F.col("top").alias("activity"), F.col("p").alias("probability"))


def latest_events(events: DataFrame, n: int = 30) -> DataFrame:
    return events.withColumn("rank", F.row_number().over(Window.partitionBy("iface").orderBy(F.desc("tick"), "kind"))).filter(F.col("rank") <= n)


def histories(answers: DataFrame, n: int = HISTORY) -> DataFrame:
    frame = Window.partitionBy("iface").orderBy("tick").rowsBetween(1 - n, 0)
    return answers.select("iface", "tick", F.collect_list("confidence").over(frame).alias("confidences"), F.collect_list("intensity").over(frame).alias("intensities"))


def previous_top(answers: DataFrame, n: int = 3) -> DataFrame:
    """(iface, tick, previous): the tick before's ``n`` likeliest activities with a word for each; null on a link's first tick."""
    pairs = F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: F.concat(x["k"], F.lit(": "), level("strength", -x["v"])))
    return answers.select("iface", "tick", F.lag(F.array_join(top, ", ")).over(Window.partitionBy("iface").orderBy("tick")).alias("previous"))


def token_totals(answers: DataFrame, seconds_per_tick: float) -> DataFrame:
    """Tokens, calls and tokens per second of each link; ticks without a count add nothing."""
    elapsed = F.greatest(F.lit(1.0), (F.max("tick") - F.min("tick")) * F.lit(seconds_per_tick))
    return answers.groupBy("iface").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_in"), F.count("input_tokens").alias("calls"), F.round(F.coalesce(F.sum("input_tokens"), F.lit(0)) / elapsed, 1).alias("tokens_per_s"))


def answered(spine: DataFrame, answers: DataFrame) -> DataFrame:
    """Ticks of each link with and without an answer."""
    seen = answers.select("iface", "tick", F.lit(1).alias("_a"))
    return spine.join(seen, ["iface", "tick"], "left").groupBy("iface").agg(F.count("_a").alias("answered_ticks"), F.count_if(F.col("_a").isNull()).alias("dropped_ticks"))


def all_links(totals: DataFrame) -> DataFrame:
    """(links, total_bits): bits of all links' last ticks together."""
    return totals.agg(F.count("*").alias("links"), F.coalesce(F.sum("total_bits"), F.lit(0.0)).alias("total_bits"))


def flags(nouls: Column, at: float = EVENT_AT) -> Column:
    """Names, in order, of the kinds whose probability is ``at`` or more."""
    return F.array_sort(F.map_keys(F.map_filter(nouls, lambda k, p: p >= at)))


def normalised(score: Column, levels: int) -> Column:
    """A score of 0 to levels - 1 as a share of the highest."""
    return score / F.lit(float(max(1, levels - 1)))


def model_state(rows: DataFrame, legend: str | None = None) -> DataFrame:
    """(iface, tick, state): the record that a model is asked with, as JSON; with a legend, that of packet logs."""
    before = F.coalesce("previous", F.lit("none yet"))
    if legend is None:
        fields = F.struct(F.col("text").alias("traffic_shape"), before.alias("previous_window_top_answers"))
    else:
        fields = F.struct(F.lit(legend).alias("legend"), F.col("text").alias("packet_log"), before.alias("previous_batch_top_answers"))
    return rows.select("iface", "tick", F.to_json(fields).alias("state"))


def score(states: DataFrame, ask: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Answers of the user's own function, batch by batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield ask(batch)

    return states.mapInPandas(run, schema)


def snapshot(ticks: DataFrame, names: DataFrame) -> DataFrame:
    """The latest tick of each link with its display name and rounded figures, as JSON too."""
    last = ticks.groupBy("iface").agg(F.max_by(F.struct("tick", "smoothed_top", "bits", "total_bits", "episode"), "tick").alias("s")).select("iface", "s.*")
    shown = last.join(F.broadcast(names), last.smoothed_top == names.key, "left").select("iface", "tick", F.coalesce("name", "smoothed_top").alias("activity"), F.round("bits", 4).alias("bits"), F.round("total_bits", 4).alias("total_bits"), "episode")
    return shown.withColumn("json", F.to_json(F.struct("iface", "tick", "activity", "episode")))
