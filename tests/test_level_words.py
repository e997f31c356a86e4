"""Words at the edges of each level, written by hand: the value just below and the value at every edge."""

import pytest

from shapeflow.functions import levels

EDGES = {
    "endpoint_count": [(0, "none"), (1, "one"), (2, "a few"), (3, "a few"), (4, "several"), (9, "several"), (10, "many")],
    "new_endpoint_count": [(0, "none"), (1, "one"), (3, "a few"), (9, "several"), (10, "a burst of many")],
    "packet_direction": [(0.24, "mostly inbound packets"), (0.25, "more inbound than outbound"), (0.45, "packet counts balanced"), (0.55, "more outbound than inbound"), (0.74, "more outbound than inbound"), (0.75, "mostly outbound packets")],
    "packet_rate": [(0.49, "near-zero"), (0.5, "low"), (4.9, "low"), (5, "moderate"), (50, "high"), (499, "high"), (500, "very high")],
    "size_spread": [(0.14, "uniform"), (0.15, "narrow"), (0.5, "mixed"), (0.99, "mixed"), (1, "widely spread")],
    "regularity": [(0.29, "clock-like regular"), (0.3, "fairly regular"), (0.8, "irregular"), (1.49, "irregular"), (1.5, "highly bursty")],
    "burst_count": [(0, "no"), (1, "a single"), (2, "a few"), (3, "a few"), (4, "several"), (7, "several"), (8, "many")],
    "burst_length": [(299, "brief"), (300, "short"), (1500, "sustained"), (4999, "sustained"), (5000, "continuous")],
    "idle_gap_count": [(0, "none"), (1, "one"), (2, "a few"), (3, "a few"), (4, "many")],
    "flow_lifetime": [(199, "very short-lived"), (200, "short-lived"), (1500, "medium-lived"), (5999, "medium-lived"), (6000, "long-lived")],
    "concentration": [(0.29, "spread across many flows"), (0.3, "led by one flow with others"), (0.6, "concentrated in one dominant flow"), (0.9, "a single flow carries nearly everything")],
}
#: (SQL of the word, word).
RULES = [
    (levels.chain_sql("size_mix", a="0.71D", b="0.0D"), "dominated by tiny packets"),
    (levels.chain_sql("size_mix", a="0.1D", b="0.71D"), "dominated by full-size packets"),
    (levels.chain_sql("size_mix", a="0.7D", b="0.31D"), "bimodal: tiny control packets alongside full-size data packets"),
    (levels.chain_sql("size_mix", a="0.14D", b="0.14D"), "almost all mid-sized packets"),
    (levels.chain_sql("size_mix", a="0.2D", b="0.3D"), "leaning to large packets with some small ones"),
    (levels.chain_sql("size_mix", a="0.3D", b="0.3D"), "leaning to small packets with some large ones"),
    (levels.chain_sql("transport_mix", a="0.91D", b="0.09D"), "almost all TCP"),
    (levels.chain_sql("transport_mix", a="0.0D", b="0.91D"), "almost all UDP"),
    (levels.chain_sql("transport_mix", a="0.9D", b="0.1D"), "mostly TCP with some UDP"),
    (levels.chain_sql("transport_mix", a="0.1D", b="0.9D"), "mostly UDP with some TCP"),
    (levels.chain_sql("transport_mix", a="0.6D", b="0.4D"), "an even TCP/UDP mix"),
    (levels.chain_sql("human_cadence", a="50D", b="0.41D", c="0.51D"), "keystroke-like: tiny packets at an uneven human rhythm"),
    (levels.chain_sql("human_cadence", a="99D", b="0.29D", c="1D"), "machine-like: even pacing"),
    (levels.chain_sql("human_cadence", a="301D", b="1.21D", c="0.5D"), "click-like: bursts separated by pauses"),
    (levels.chain_sql("human_cadence", a="100D", b="0.29D", c="0.5D"), "no distinct human rhythm"),
    (levels.trend_sql("0D", "0D"), "still quiet"),
    (levels.trend_sql("0D", "1D"), "started from nothing"),
    (levels.trend_sql("1D", "0D"), "dropped to nothing"),
    (levels.trend_sql("100D", "32D"), "falling sharply"),
    (levels.trend_sql("100D", "33D"), "falling"),
    (levels.trend_sql("100D", "75D"), "steady"),
    (levels.trend_sql("100D", "133D"), "rising"),
    (levels.trend_sql("100D", "300D"), "rising sharply"),
    (levels.spacing_sql("0.1D", "1"), "as a single burst or continuously, so spacing does not apply"),
    (levels.spacing_sql("-1D", "2"), "too rarely to judge their spacing"),
    (levels.spacing_sql("0.24D", "3"), "at clock-like regular intervals"),
    (levels.spacing_sql("0.25D", "3"), "at fairly regular intervals"),
    (levels.spacing_sql("0.6D", "3"), "at irregular, human-looking intervals"),
    (levels.rhythm_sql("-1D", "0"), "there has been no activity at all"),
    (levels.rhythm_sql("-1D", "1"), "there has been a single burst"),
    (levels.rhythm_sql("-1D", "2"), "bursts have been too few to judge their rhythm"),
    (levels.rhythm_sql("0.24D", "4"), "bursts have come at a clock-like regular rhythm"),
    (levels.rhythm_sql("0.25D", "4"), "bursts have come at a fairly regular rhythm"),
    (levels.rhythm_sql("0.6D", "4"), "bursts have come at irregular, human-looking intervals"),
]


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, name):
    rows = spark.createDataFrame([(float(x), w) for x, w in EDGES[name]], "x double, w string")
    assert rows.filter(levels.level(name, rows.x) != rows.w).isEmpty() and rows.selectExpr(f"{levels.level_sql(name, 'x')} = w AS ok").filter("not ok").isEmpty()


def test_rules(spark):
    got = spark.range(1).selectExpr(*(f"{sql} AS w{i}" for i, (sql, _) in enumerate(RULES))).first()
    assert list(got) == [w for _, w in RULES]
