"""Quantities to words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each measure, (edge, word below it) in order, and the word above all edges.
LEVELS = {
    "flow_count": ([(1, "none"), (2, "a single flow"), (5, "a few"), (15, "moderate"), (40, "many")], "a very large number"),
    "endpoint_count": ([(1, "none"), (2, "one"), (4, "a few"), (10, "several")], "many"),
    "new_endpoint_count": ([(1, "none"), (2, "one"), (4, "a few"), (10, "several")], "a burst of many"),
    "direction": ([(0.05, "almost entirely download"), (0.2, "download-dominated"), (0.4, "download-leaning"), (0.6, "roughly balanced"), (0.8, "upload-leaning"), (0.95, "upload-dominated")], "almost entirely upload"),
    "packet_direction": ([(0.25, "mostly inbound packets"), (0.45, "more inbound than outbound"), (0.55, "packet counts balanced"), (0.75, "more outbound than inbound")], "mostly outbound packets"),
    "volume": ([(200, "negligible"), (5000, "low"), (100000, "moderate"), (1000000, "high")], "very high"),
    "packet_rate": ([(0.5, "near-zero"), (5, "low"), (50, "moderate"), (500, "high")], "very high"),
    "packet_size": ([(90, "tiny"), (200, "small"), (600, "medium"), (1200, "large")], "MTU-sized"),
    "size_spread": ([(0.15, "uniform"), (0.5, "narrow"), (1.0, "mixed")], "widely spread"),
    "inter_arrival": ([(2, "back-to-back"), (20, "rapid"), (100, "steady"), (500, "paced"), (2000, "slow")], "very sparse"),
    "regularity": ([(0.3, "clock-like regular"), (0.8, "fairly regular"), (1.5, "irregular")], "highly bursty"),
    "burst_count": ([(1, "no"), (2, "a single"), (4, "a few"), (8, "several")], "many"),
    "burst_length": ([(300, "brief"), (1500, "short"), (5000, "sustained")], "continuous"),
    "occupancy": ([(0.02, "silent"), (0.15, "sporadic"), (0.4, "intermittent"), (0.8, "mostly active")], "continuously active"),
    "idle_gap": ([(250, "no idle gaps"), (1000, "brief idle gaps"), (3000, "noticeable idle gaps"), (7000, "long idle gaps")], "almost entirely idle"),
    "idle_gap_count": ([(1, "none"), (2, "one"), (4, "a few")], "many"),
    "spacing": ([(0.25, "at clock-like regular intervals"), (0.6, "at fairly regular intervals")], "at irregular, human-looking intervals"),
    "rhythm": ([(0.25, "bursts have come at a clock-like regular rhythm"), (0.6, "bursts have come at a fairly regular rhythm")], "bursts have come at irregular, human-looking intervals"),
    "flow_lifetime": ([(200, "very short-lived"), (1500, "short-lived"), (6000, "medium-lived")], "long-lived"),
    "churn": ([(0.05, "no new connections"), (0.3, "few new connections"), (0.7, "steady connection churn")], "almost all connections are new"),
    "concentration": ([(0.3, "spread across many flows"), (0.6, "led by one flow with others"), (0.9, "concentrated in one dominant flow")], "a single flow carries nearly everything"),
    "ratio": ([(0.33, "falling sharply"), (0.75, "falling"), (1.33, "steady"), (3.0, "rising")], "rising sharply"),
    "outbound_evenness": ([(0.4, "outbound packets spread evenly over time"), (1.0, "outbound packets clustered into groups")], "outbound packets concentrated in a few spikes"),
    "strength": ([(0.15, "faint"), (0.4, "possible"), (0.7, "likely")], "strong"),
}
#: Fixed values: (condition, word) tried in order, and the word where none holds.
CHAINS = {
    "size_mix": ([("{a} > 0.7", "dominated by tiny packets"), ("{b} > 0.7", "dominated by full-size packets"), ("{a} > 0.3 AND {b} > 0.3", "bimodal: tiny control packets alongside full-size data packets"), ("{a} < 0.15 AND {b} < 0.15", "almost all mid-sized packets"), ("{b} > {a}", "leaning to large packets with some small ones")], "leaning to small packets with some large ones"),
    "transport_mix": ([("{a} > 0.9", "almost all TCP"), ("{b} > 0.9", "almost all UDP"), ("{a} > 0.6", "mostly TCP with some UDP"), ("{b} > 0.6", "mostly UDP with some TCP")], "an even TCP/UDP mix"),
    "human_cadence": ([("{c} > 0.5 AND {a} >= 50 AND {a} <= 600 AND {b} > 0.4", "keystroke-like: tiny packets at an uneven human rhythm"), ("{b} < 0.3 AND {a} < 100", "machine-like: even pacing"), ("{b} > 1.2 AND {a} > 300", "click-like: bursts separated by pauses")], "no distinct human rhythm"),
    "exchange_pattern": ([("{a} > 0.6", "tight request/response ping-pong"), ("{a} > 0.3", "requests answered by multi-packet replies")], "one-way streaming with sparse acknowledgements"),
}


#: Words of windows where a level does not apply, by what is missing.
TREND_WORDS = ("still quiet", "started from nothing", "dropped to nothing")
SPACING_WORDS = ("as a single burst or continuously, so spacing does not apply", "too rarely to judge their spacing")
RHYTHM_WORDS = ("there has been no activity at all", "there has been a single burst", "bursts have been too few to judge their rhythm")


def level_sql(name: str, x: str) -> str:
    """The word of an SQL expression's value, as SQL. Values count to nine digits, so the order of sums moves none over an edge."""
    edges, top = LEVELS[name]
    return "CASE " + " ".join(f"WHEN round({x}, 9) < {edge} THEN '{word}'" for edge, word in edges) + f" ELSE '{top}' END"


def chain_sql(name: str, **parts: str) -> str:
    rules, rest = CHAINS[name]
    return "CASE " + " ".join(f"WHEN {rule.format(**{k: f'round({v}, 9)' for k, v in parts.items()})} THEN '{word}'" for rule, word in rules) + f" ELSE '{rest}' END"


def level(name: str, x: Column) -> Column:
    edges, top = LEVELS[name]
    out = None
    for edge, word in edges:
        at = F.round(x, 9) < edge
        out = F.when(at, word) if out is None else out.when(at, word)
    return out.otherwise(top)


def trend_sql(before: str, now: str) -> str:
    return f"CASE WHEN {before} <= 0 AND {now} <= 0 THEN '{TREND_WORDS[0]}' WHEN {before} <= 0 THEN '{TREND_WORDS[1]}' WHEN {now} <= 0 THEN '{TREND_WORDS[2]}' ELSE {level_sql('ratio', f'({now} / {before})')} END"


def spacing_sql(cv: str, bursts: str) -> str:
    return f"CASE WHEN {bursts} <= 1 THEN '{SPACING_WORDS[0]}' WHEN {cv} < 0 THEN '{SPACING_WORDS[1]}' ELSE {level_sql('spacing', cv)} END"


def rhythm_sql(cv: str, bursts: str) -> str:
    return f"CASE WHEN {bursts} = 0 THEN '{RHYTHM_WORDS[0]}' WHEN {bursts} = 1 THEN '{RHYTHM_WORDS[1]}' WHEN {cv} < 0 THEN '{RHYTHM_WORDS[2]}' ELSE {level_sql('rhythm', cv)} END"


def shape_columns() -> dict[str, str]:
    """Each word of a window as SQL over its measures, the previous tick's as prev_*. The plain words of windows without data are fixed values."""
    when = lambda ok, word, otherwise: f"CASE WHEN {ok} THEN {word} ELSE '{otherwise}' END"
    return {
        "concurrency": level_sql("flow_count", "flows"),
        "endpoints_word": level_sql("endpoint_count", "endpoints"),
        "new_endpoints_word": level_sql("new_endpoint_count", "new_endpoints"),
        "volume": level_sql("volume", "bytes_per_s"),
        "packet_rate": level_sql("packet_rate", "packets_per_s"),
        "direction_bytes": when("up_bytes + down_bytes > 0", level_sql("direction", "(up_bytes * 1.0 / (up_bytes + down_bytes))"), "no bytes moved"),
        "direction_packets": when("up_packets + down_packets > 0", level_sql("packet_direction", "(up_packets * 1.0 / (up_packets + down_packets))"), "no packets"),
        "occupancy": level_sql("occupancy", "active_bin_frac"),
        "burst_count": level_sql("burst_count", "bursts"),
        "burst_length": level_sql("burst_length", "longest_burst_ms"),
        "typical_burst": level_sql("burst_length", "typical_burst_ms"),
        "idle_gap": level_sql("idle_gap", "longest_gap_ms"),
        "idle_gap_count": level_sql("idle_gap_count", "gaps_over_1s"),
        "burst_spacing": spacing_sql("burst_gap_cv", "bursts"),
        "burst_rhythm_minute": rhythm_sql("long_gap_cv", "long_bursts"),
        "packet_size": when("flows > 0", level_sql("packet_size", "mean_ps"), "no packets"),
        "size_spread": level_sql("size_spread", "ps_cv"),
        "size_mix": when("flows > 0", chain_sql("size_mix", a="tiny_frac", b="large_frac"), "no packets"),
        "inter_arrival": when("mean_piat_ms > 0", level_sql("inter_arrival", "mean_piat_ms"), "no measurable spacing"),
        "regularity": when("mean_piat_ms > 0", level_sql("regularity", "piat_cv"), "no measurable rhythm"),
        "cadence": when("flows > 0", chain_sql("human_cadence", a="mean_piat_ms", b="piat_cv", c="tiny_frac"), "no activity"),
        "exchange_pattern": when("flows > 0", chain_sql("exchange_pattern", a="alternation"), "no exchanges"),
        "outbound_evenness": when("up_packets > 0", level_sql("outbound_evenness", "up_bin_cv"), "no outbound traffic"),
        "transport": when("flows > 0", chain_sql("transport_mix", a="tcp_frac", b="udp_frac"), "none"),
        "lifetime": when("flows > 0", level_sql("flow_lifetime", "mean_lifetime_ms"), "none"),
        "churn": when("flows > 0", level_sql("churn", "new_flow_frac"), "no connections"),
        "concentration": when("flows > 0", level_sql("concentration", "top_flow_share"), "none"),
        "trend_volume": trend_sql("prev_bytes_per_s", "bytes_per_s"),
        "trend_flows": trend_sql("prev_flows", "(flows * 1.0)"),
        "trend_packets": trend_sql("prev_packets_per_s", "packets_per_s"),
    }


#: Fixed value: the window's text; names in braces are the words above.
PROSE = """Traffic shape on one virtual machine's network link, observed over a short rolling window a few seconds long. Only shape is described: nothing about content, addresses, ports or amounts.

CONCURRENCY. Active flows in the window: {concurrency}. Distinct remote endpoints: {endpoints_word}. Endpoints contacted for the first time this session: {new_endpoints_word}. Connection churn: {churn}. Flow lifetimes are {lifetime}. Traffic is {concentration}.

VOLUME AND DIRECTION. Overall throughput level: {volume}. Packet rate level: {packet_rate}. By bytes the link is {direction_bytes}; by packet count it shows {direction_packets}. Exchange pattern within flows: {exchange_pattern}.

BURST STRUCTURE. The window is {occupancy}, with {burst_count} distinct bursts. The longest burst is {burst_length} and the typical burst is {typical_burst}. There are {idle_gap}; count of pauses long enough to notice: {idle_gap_count}. Bursts arrive {burst_spacing}. Over the last minute, {burst_rhythm_minute}. Outbound timing: {outbound_evenness}.

PACKET SIZES. Typical packet size is {packet_size}; the size distribution is {size_spread} and {size_mix}.

INTER-ARRIVAL TIMES. Packets arrive {inter_arrival}; spacing is {regularity}. Cadence reads as {cadence}.

TRANSPORT. Packets are {transport}.

TREND VERSUS THE PREVIOUS WINDOW. Volume is {trend_volume}; the number of flows is {trend_flows}; packet rate is {trend_packets}.

LEVEL GLOSSARY. Throughput and packet-rate levels run negligible, low, moderate, high, very high. Burst lengths run brief, short, sustained, continuous. Occupancy runs silent, sporadic, intermittent, mostly active, continuously active. Packet sizes run tiny, small, medium, large, MTU-sized. Inter-arrival runs back-to-back, rapid, steady, paced, slow, very sparse. Trends run dropped to nothing, falling sharply, falling, steady, rising, rising sharply, started from nothing."""


def prose() -> Column:
    """The text of a row of words; the row must have them all."""
    import re

    parts = re.split(r"\{(\w+)\}", PROSE)
    return F.concat(*(F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def numbers_free(text: Column) -> Column:
    """The text itself; a text that holds a digit fails the query."""
    return F.when(text.rlike(r"\p{Nd}"), F.raise_error(F.lit("rendered shape contains digits")).cast("string")).otherwise(text)
