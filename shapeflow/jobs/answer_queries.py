"""Queries over answers and evaluation results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeflow.operators import answers as A
from shapeflow.operators import evaluate as E
from shapeflow.sources import derived

KEYS = [a.replace(" ", "_") for a in derived.ACTIVITIES]
N = len(KEYS)
_EXPECT = list(E.EXPECT)
_BASE = f"WITH {derived.ANSWERS_SQL}"
SMOOTH_SQL = f"""{_BASE},
sm AS (SELECT iface, tick, activity, p, list_reduce(list_prepend(0.0::DOUBLE, list(p) OVER (PARTITION BY iface, activity ORDER BY tick ROWS BETWEEN {A.LOOK_BACK} PRECEDING AND CURRENT ROW)), lambda a, x : a + 0.4::DOUBLE * (x - a)) AS smoothed FROM p),
rk AS (SELECT *, row_number() OVER (PARTITION BY iface, tick ORDER BY round(smoothed, 9) DESC, activity) AS rank FROM sm),
h AS (SELECT iface, tick, -sum(CASE WHEN p > 0 THEN p / t * log2(p / t) ELSE 0 END) AS entropy FROM (SELECT *, sum(p) OVER (PARTITION BY iface, tick) AS t FROM p) GROUP BY iface, tick),
e1 AS (SELECT h.iface, h.tick, entropy, greatest(0, log2({N}) - entropy) AS bits, activity AS smoothed_top FROM h JOIN rk ON h.iface = rk.iface AND h.tick = rk.tick AND rank = 1),
e2 AS (SELECT *, CASE WHEN lag(smoothed_top) OVER o = smoothed_top THEN 0 ELSE 1 END AS new FROM e1 WINDOW o AS (PARTITION BY iface ORDER BY tick)),
e3 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY iface ORDER BY tick) AS BIGINT) AS episode FROM e2),
e4 AS (SELECT *, greatest(0, bits - coalesce(max(bits) OVER (PARTITION BY iface, episode ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gain FROM e3),
ep AS (SELECT *, sum(gain) OVER (PARTITION BY iface ORDER BY tick) AS total_bits, sum(bits) OVER (PARTITION BY iface ORDER BY tick) AS raw_total_bits FROM e4)"""
_NOULS = """n AS (SELECT iface, tick, ([__K])[turn + 1] AS top, unnest(['just_started', 'automated']) AS kind, unnest([(event_id * 7 % 10) / 10, round(value * 10) % 10 / 10]) AS p FROM base),
ev AS (SELECT iface, tick, kind, top AS activity, p AS probability FROM (SELECT *, lag(p) OVER (PARTITION BY iface, kind ORDER BY tick) AS was FROM n) WHERE p >= 0.6 AND coalesce(was, 0) < 0.6)""".replace("__K", ", ".join(f"'{k}'" for k in KEYS))


def results(spark, sf):
    """Evaluation results from ``conversations``: scenario, expected activity, choice and probability by arithmetic."""
    c = derived.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", f"element_at(array({', '.join(repr(x) for x in _EXPECT)}), cast(conv_id % {len(_EXPECT)} + 1 AS int)) AS scenario",
        "element_at(array('shape', 'raw', 'raw-ips'), cast(turn % 3 + 1 AS int)) AS tag", "element_at(array('v0', 'v4'), cast(conv_id % 2 + 1 AS int)) AS variant", "cast(conv_id * 2 + turn AS bigint) AS tick",
        f"element_at(array({', '.join(repr(x) for x in KEYS)}), cast((conv_id * 3 + turn * turn) % {N} + 1 AS int)) AS choice", "(conv_id * 5 + turn) % 11 AS w")
    c = E.with_expected(c)
    c = c.withColumn("choice", F.when((F.col("w") < 6), F.col("expected")).otherwise(F.col("choice")))
    probs = F.create_map(F.col("choice"), F.lit(0.5) + F.col("w") / 32)
    return c.withColumn("p_expected", E.p_expected(probs, F.col("expected"))).withColumn("input_tokens", F.expr("CASE WHEN w = 3 THEN NULL ELSE 100 + w END"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in E.EXPECT.items()) + "}"
RESULTS_SQL = f"""r0 AS (SELECT conv_id, turn, ([{', '.join(repr(x) for x in _EXPECT)}])[conv_id % {len(_EXPECT)} + 1] AS scenario, (['shape', 'raw', 'raw-ips'])[turn % 3 + 1] AS tag, (['v0', 'v4'])[conv_id % 2 + 1] AS variant, conv_id * 2 + turn AS tick,
  ([{', '.join(repr(x) for x in KEYS)}])[(conv_id * 3 + turn * turn) % {N} + 1] AS c0, (conv_id * 5 + turn) % 11 AS w FROM conversations),
r1 AS (SELECT *, {_MAP}[scenario] AS expected FROM r0), r2 AS (SELECT *, CASE WHEN w < 6 THEN expected ELSE c0 END AS choice, CASE WHEN w = 3 THEN NULL ELSE 100 + w END AS input_tokens FROM r1),
res AS (SELECT *, CASE WHEN choice = expected THEN 0.5 + w / 32 ELSE 0.0 END::DOUBLE AS p_expected FROM r2)"""
_REPORT = """k AS (SELECT scenario, tag, variant, choice, count(*) AS n FROM res GROUP BY ALL), kk AS (SELECT scenario, tag, variant, arg_min(choice, (-n, choice)) AS common_choice FROM k GROUP BY ALL)"""


def j6(spark, sf):
    ticks = derived.table(spark, sf, "conversations").selectExpr("concat('d', conv_id % 3) AS tag", "cast(conv_id * 4 + turn AS int) AS secs", "conv_id", "turn")
    log = derived.table(spark, sf, "nation").selectExpr("concat('d', n_nationkey % 3) AS tag", "cast(40 + n_nationkey * 60 AS int) AS ts_s", f"element_at(array({', '.join(repr(x) for x in _EXPECT)}), cast(n_nationkey % {len(_EXPECT)} + 1 AS int)) AS scenario")
    return E.with_expected(E.as_of_scenario(ticks, log)).select("tag", "secs", "conv_id", "turn", "scenario", "expected")


J6_SQL = f"""WITH t AS (SELECT 'd' || (conv_id % 3) AS tag, CAST(conv_id * 4 + turn AS INT) AS secs, conv_id, turn FROM conversations),
l AS (SELECT 'd' || (n_nationkey % 3) AS tag, CAST(40 + n_nationkey * 60 AS INT) AS ts_s, ([{', '.join(repr(x) for x in _EXPECT)}])[n_nationkey % {len(_EXPECT)} + 1] AS scenario FROM nation)
SELECT t.tag, secs, conv_id, turn, scenario, {_MAP}[scenario] AS expected FROM t ASOF JOIN l ON t.tag = l.tag AND t.secs >= l.ts_s WHERE secs - ts_s >= 12"""


def s6(spark, sf, every=3):
    samples = derived.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS seq", "CASE WHEN turn % 2 = 0 THEN 'shape' ELSE 'raw' END AS mode", f"concat('  ', element_at(array({', '.join(repr(a) for a in derived.ACTIVITIES)}), cast(conv_id % {N} + 1 AS int)), ' ') AS label")
    keys = spark.createDataFrame([(k,) for k in KEYS], "key string")
    return E.known_samples(samples, keys, every)


S6_SQL = f"""WITH s AS (SELECT conv_id * 1000 + turn AS seq, CASE WHEN turn % 2 = 0 THEN 'shape' ELSE 'raw' END AS mode, ([{', '.join(repr(k) for k in KEYS)}])[conv_id % {N} + 1] AS label FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY seq) AS n FROM s) SELECT seq, mode, label FROM n WHERE (n - 1) % 3 = 0"""
E1_SQL = f"SELECT CASE WHEN turn % 2 = 0 THEN 'shape' ELSE 'raw' END AS mode, ([{', '.join(repr(k) for k in KEYS)}])[conv_id % {N} + 1] AS label, count(*) AS n FROM conversations GROUP BY ALL"


def s4(spark, sf):
    """Keys and tidy names of many raw names (parts of ``part``)."""
    p = derived.table(spark, sf, "part").selectExpr("p_partkey", "concat('  ', p_name, '  /', p_type, '! ') AS name")
    return p.select("p_partkey", E.activity_key(F.col("name")).alias("key"), F.regexp_replace(F.trim("name"), r"\s+", " ").alias("name"))


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


QUERIES = {
    "a1_a2_a3_entropy_bits": lambda s, d: _round(derived.answers(s, d).select("iface", "tick", A.entropy_bits(F.col("probabilities")).alias("entropy"), A.identifying_bits(F.col("probabilities"), N).alias("bits")).withColumn("anonymity", F.round(A.anonymity_set(F.col("bits")) / 1e6, 3)), "entropy", "bits"),
    "a4_w8_smoothed": lambda s, d: _round(A.smoothed(derived.answers(s, d), KEYS), "p", "smoothed"),
    "a7_w14_top_smoothed": lambda s, d: _round(A.top_smoothed(derived.answers(s, d), KEYS), "smoothed"),
    "a5_a6_w9_w10_episodes": lambda s, d: _round(A.episodes(derived.answers(s, d), KEYS, True).drop("anonymity_set"), "entropy", "bits", "gain", "total_bits", "raw_total_bits"),
    "a5_a6_w9_w10_episodes_in_ranges": lambda s, d: _round(A.episodes(derived.answers(s, d), KEYS, True).drop("anonymity_set"), "entropy", "bits", "gain", "total_bits", "raw_total_bits"),
    "a12_session_totals": lambda s, d: _round(A.session_totals(A.episodes(derived.answers(s, d), KEYS, True)), "total_bits", "raw_total_bits"),
    "a12_all_links": lambda s, d: _round(A.all_links(A.session_totals(A.episodes(derived.answers(s, d), KEYS, True))), "total_bits"),
    "a9_w11_rising_edges": lambda s, d: A.rising_edges(derived.answers(s, d)),
    "w13_latest_events": lambda s, d: A.latest_events(A.rising_edges(derived.answers(s, d))),
    "a8_w12_histories": lambda s, d: A.histories(derived.answers(s, d)).select("iface", "tick", F.array_join(F.transform("confidences", lambda x: F.format_number(x, 2)), ",").alias("confidences"), F.array_join(F.transform("intensities", lambda x: F.format_number(x, 2)), ",").alias("intensities")),
    "a10_previous_top": lambda s, d: A.previous_top(derived.answers(s, d)),
    "a11_token_totals": lambda s, d: A.token_totals(derived.answers(s, d), 2.0),
    "j9_answered": lambda s, d: A.answered(derived.answers(s, d).select("iface", "tick"), derived.answers(s, d).filter("input_tokens is not null")),
    "s8_x15_snapshot": lambda s, d: A.snapshot(A.episodes(derived.answers(s, d), KEYS, True), s.createDataFrame([(k, n) for k, n in zip(KEYS, derived.ACTIVITIES) if n != "chat"], "key string, name string")),
    "e1_sample_counts": lambda s, d: s6(s, d, 1).groupBy("mode", "label").agg(F.count("*").alias("n")),
    "e2_e6_report": lambda s, d: _round(E.report(results(s, d), "variant"), "accuracy", "mean_p"),
    "e3_pivot": lambda s, d: E.pivot(results(s, d), ["shape", "raw", "raw-ips"]).select("scenario", *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("-", "_")) for c in ("shape", "raw", "raw-ips"))),
    "e4_totals": lambda s, d: _round(E.totals(results(s, d)), "accuracy", "mean_p"),
    "e5_p_expected": lambda s, d: results(s, d).select("conv_id", "turn", "expected", "choice", F.round("p_expected", 6).alias("p_expected")),
    "e7_token_total": lambda s, d: results(s, d).groupBy("tag").agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("tokens")),
    "j6_j7_scenario_labels": j6,
    "s4_activity_keys": s4,
    "s6_w15_samples": s6,
}
ORACLES = {
    "a1_a2_a3_entropy_bits": f"{SMOOTH_SQL} SELECT iface, tick, round(entropy, 6) AS entropy, round(bits, 6) AS bits, round(greatest(1, 8e9 / pow(2, bits)) / 1e6, 3) AS anonymity FROM e1",
    "a4_w8_smoothed": f"{SMOOTH_SQL} SELECT iface, tick, activity, round(p, 6) AS p, round(smoothed, 6) AS smoothed FROM sm",
    "a7_w14_top_smoothed": f"{SMOOTH_SQL} SELECT iface, tick, activity, round(smoothed, 6) AS smoothed, rank FROM rk WHERE rank <= 5",
    "a5_a6_w9_w10_episodes": f"{SMOOTH_SQL} SELECT iface, tick, round(entropy, 6) AS entropy, round(bits, 6) AS bits, smoothed_top, episode, round(gain, 6) AS gain, round(total_bits, 6) AS total_bits, round(raw_total_bits, 6) AS raw_total_bits FROM ep",
    "a12_session_totals": f"{SMOOTH_SQL} SELECT iface, round(arg_max(total_bits, tick), 6) AS total_bits, round(arg_max(raw_total_bits, tick), 6) AS raw_total_bits, max(episode) AS episodes, count(*) AS answered_ticks FROM ep GROUP BY iface",
    "a12_all_links": f"{SMOOTH_SQL} SELECT count(*) AS links, round(sum(b), 6) AS total_bits FROM (SELECT arg_max(total_bits, tick) AS b FROM ep GROUP BY iface)",
    "a9_w11_rising_edges": f"{_BASE}, {_NOULS} SELECT * FROM ev",
    "w13_latest_events": f"{_BASE}, {_NOULS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iface ORDER BY tick DESC, kind) AS rank FROM ev) WHERE rank <= 30",
    "a8_w12_histories": f"{_BASE} SELECT iface, tick, array_to_string(list('0.70') OVER w, ',') AS confidences, array_to_string(list(format('{{:.2f}}', event_id % 5 / 4)) OVER w, ',') AS intensities FROM base WINDOW w AS (PARTITION BY iface ORDER BY tick ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "a10_previous_top": f"{_BASE}, z AS (SELECT iface, tick, activity, p, row_number() OVER (PARTITION BY iface, tick ORDER BY p DESC, activity) AS r FROM p), y AS (SELECT iface, tick, string_agg(activity || ': ' || CASE WHEN p < 0.15 THEN 'faint' WHEN p < 0.4 THEN 'possible' WHEN p < 0.7 THEN 'likely' ELSE 'strong' END, ', ' ORDER BY r) AS t FROM z WHERE r <= 3 GROUP BY ALL) SELECT iface, tick, lag(t) OVER (PARTITION BY iface ORDER BY tick) AS previous FROM y",
    "a11_token_totals": f"{_BASE}, t AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 900 + event_id % 300 END AS n FROM base) SELECT iface, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens_in, count(n) AS calls, round(coalesce(sum(n), 0) / greatest(1.0, (max(tick) - min(tick)) * 2.0), 1) AS tokens_per_s FROM t GROUP BY iface",
    "j9_answered": f"{_BASE} SELECT iface, count(*) FILTER (event_id % 17 <> 0) AS answered_ticks, count(*) FILTER (event_id % 17 = 0) AS dropped_ticks FROM base GROUP BY iface",
    "s8_x15_snapshot": f"{SMOOTH_SQL}, l AS (SELECT iface, max(tick) AS tick, arg_max(smoothed_top, tick) AS k, arg_max(bits, tick) AS bits, arg_max(total_bits, tick) AS total_bits, arg_max(episode, tick) AS episode FROM ep GROUP BY iface), m AS (SELECT *, CASE WHEN k = 'chat' THEN k ELSE replace(k, '_', ' ') END AS activity FROM l) SELECT iface, tick, activity, round(bits, 4) AS bits, round(total_bits, 4) AS total_bits, episode, '{{\"iface\":\"' || iface || '\",\"tick\":' || tick || ',\"activity\":\"' || activity || '\",\"episode\":' || episode || '}}' AS json FROM m",
    "e1_sample_counts": E1_SQL,
    "e2_e6_report": f"WITH {RESULTS_SQL}, {_REPORT}, a AS (SELECT scenario, tag, variant, round(avg((choice = expected)::INT), 6) AS accuracy, round(avg(p_expected), 6) AS mean_p, count(*) AS n FROM res GROUP BY ALL) SELECT scenario, tag, variant, accuracy, mean_p, common_choice, n FROM a JOIN kk USING (scenario, tag, variant)",
    "e3_pivot": f"WITH {RESULTS_SQL} SELECT scenario, round(avg((choice = expected)::INT) FILTER (tag = 'shape'), 6) AS shape, round(avg((choice = expected)::INT) FILTER (tag = 'raw'), 6) AS raw, round(avg((choice = expected)::INT) FILTER (tag = 'raw-ips'), 6) AS raw_ips FROM res GROUP BY scenario",
    "e4_totals": f"WITH {RESULTS_SQL} SELECT tag, round(avg((choice = expected)::INT), 6) AS accuracy, round(avg(p_expected), 6) AS mean_p, count(*) AS n FROM res WHERE scenario <> 'idle' GROUP BY tag",
    "e5_p_expected": f"WITH {RESULTS_SQL} SELECT conv_id, turn, expected, choice, round(p_expected, 6) AS p_expected FROM res",
    "e7_token_total": f"WITH {RESULTS_SQL} SELECT tag, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS tokens FROM res GROUP BY tag",
    "j6_j7_scenario_labels": J6_SQL,
    "s4_activity_keys": r"SELECT p_partkey, trim(regexp_replace(lower(trim(n)), '[^a-z0-9]+', '_', 'g'), '_') AS key, regexp_replace(trim(n), '\s+', ' ', 'g') AS name FROM (SELECT p_partkey, '  ' || p_name || '  /' || p_type || '! ' AS n FROM part)",
    "s6_w15_samples": S6_SQL,
}
ORACLES["a5_a6_w9_w10_episodes_in_ranges"] = ORACLES["a5_a6_w9_w10_episodes"]
