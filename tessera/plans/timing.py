"""Queries on clocks, intervals, the buffer model and carried state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import carry, timing
from tessera.plans.common import LONGEST, PEAK, SAMPLES, UNITS, table, units

_W = "PARTITION BY stream_id ORDER BY au"


def q9_clock_unwrap(spark, sf_dir):
    return timing.unwrapped(units(spark, sf_dir)).select("stream_id", "au", "input_timing", "unwrapped")


Q9 = f"""WITH {UNITS}, b AS (SELECT *, CASE WHEN input_timing < lag(input_timing) OVER ({_W}) THEN 65536 ELSE 0 END AS back FROM units)
SELECT stream_id, au, input_timing, CAST(input_timing + sum(back) OVER ({_W}) AS BIGINT) AS unwrapped FROM b"""


def q10_restart_gap(spark, sf_dir):
    gaps = timing.restart_gaps(units(spark, sf_dir))
    return gaps.select("stream_id", "au", "gap", "distance", "segment", F.coalesce((F.col("gap") != 1) & (F.col("gap") < 8), F.lit(False)).alias("invalid"))


_GAPS = f"""gaps AS (SELECT *, CASE WHEN is_major THEN au - max(CASE WHEN is_major THEN au END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap,
 au - max(CASE WHEN is_major THEN au END) OVER ({_W}) AS distance, count(CASE WHEN is_major THEN 1 END) OVER ({_W}) AS segment FROM units)"""
Q10 = f"WITH {UNITS}, {_GAPS} SELECT stream_id, au, gap, distance, segment, coalesce(gap <> 1 AND gap < 8, false) AS invalid FROM gaps"


def q11_interval_rules(spark, sf_dir):
    timed = timing.intervals(units(spark, sf_dir), F.lit(PEAK))
    return timing.interval_rules(timed, SAMPLES, LONGEST, PEAK)


_INTERVALS = f"""timed AS (SELECT *, (input_timing - lag(input_timing) OVER ({_W}) + 65536) & 65535 AS "interval",
 lag(length) OVER ({_W}) AS previous_length, lag((length * 256 + {PEAK - 1}) // {PEAK}) OVER ({_W}) AS previous_duration FROM units)"""
_RULES = f"""SELECT stream_id, au, 'access_unit.timing_too_short' AS rule FROM timed WHERE "interval" < {SAMPLES // 4}
 UNION ALL SELECT stream_id, au, 'access_unit.timing_shorter_than_previous' FROM timed WHERE "interval" < previous_duration
 UNION ALL SELECT stream_id, au, 'access_unit.data_rate_exceeded' FROM timed WHERE previous_length * 256 > "interval" * {PEAK}
 UNION ALL SELECT stream_id, au, 'access_unit.timing_too_long' FROM timed WHERE "interval" > {LONGEST}"""
Q11 = f"WITH {UNITS}, {_INTERVALS} {_RULES}"


def _buffered(spark, sf_dir):
    """Units of a steady output clock: quarter minutes are samples, so a stream's own mean pace drains it."""
    flow = timing.unwrapped(units(spark, sf_dir))
    start = F.min("unwrapped").over(timing.so_far())
    ready = flow.withColumns({"bytes": F.col("length") * 2, "first_output": start + LONGEST})
    return timing.depths(ready, SAMPLES)


def q12_fifo_depth(spark, sf_dir):
    return _buffered(spark, sf_dir).select("stream_id", "au", "drained", "depth", "underrun")


_DEPTHS = f"""flow AS (SELECT *, CAST(input_timing + sum(back) OVER ({_W}) AS BIGINT) AS unwrapped FROM (
  SELECT *, CASE WHEN input_timing < lag(input_timing) OVER ({_W}) THEN 65536 ELSE 0 END AS back FROM units)),
ready AS (SELECT *, unwrapped - (min(unwrapped) OVER ({_W}) + {LONGEST}) AS late, CAST(sum(length * 2) OVER ({_W}) AS BIGINT) AS prefix FROM flow),
gone AS (SELECT *, max(greatest(0, CAST(ceil(late / {SAMPLES}) AS BIGINT) - 1)) OVER ({_W}) AS drained FROM ready),
depths AS (SELECT g.stream_id, g.au, g.drained, CASE WHEN g.drained <= g.au THEN g.prefix - coalesce(e.prefix, 0) END AS depth, g.drained > g.au AS underrun
 FROM gone g LEFT JOIN gone e ON e.stream_id = g.stream_id AND e.au = g.drained - 1)"""
Q12 = f"WITH {UNITS}, {_DEPTHS} SELECT * FROM depths"


def q13_fifo_peak(spark, sf_dir):
    return timing.peak_depth(_buffered(spark, sf_dir)).select("stream_id", "depth", "au")


Q13 = f"WITH {UNITS}, {_DEPTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY depth DESC, au) AS n FROM depths WHERE depth IS NOT NULL) SELECT stream_id, depth, au FROM r WHERE n = 1"


def q21_branch_merge(spark, sf_dir):
    """Events of one user and day are one unit's restarts."""
    e = table(spark, sf_dir, "events")
    day = F.floor(F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', ts)")).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    restarts = e.select(F.col("user_id").alias("stream_id"), day.alias("au"), (F.col("value") < 150).alias("advance"), (k < 90).alias("buffer"), (k % 10 != 3).alias("rate"))
    merged = carry.merged_branches(restarts, ["advance", "buffer", "rate"])
    return merged.select("stream_id", "au", F.array_join("failed", ",").alias("failed"), "restarts", "valid")


Q21 = """WITH r AS (SELECT user_id AS stream_id, epoch_us(ts) // 86400000000 AS au, value < 150 AS advance, CAST(json_extract(props, '$.k') AS BIGINT) < 90 AS buffer,
 CAST(json_extract(props, '$.k') AS BIGINT) % 10 <> 3 AS rate FROM events),
g AS (SELECT stream_id, au, list_filter([CASE WHEN NOT bool_and(advance) THEN 'advance' END, CASE WHEN NOT bool_and(buffer) THEN 'buffer' END, CASE WHEN NOT bool_and(rate) THEN 'rate' END], lambda x: x IS NOT NULL) AS failed, count(*) AS restarts FROM r GROUP BY ALL)
SELECT stream_id, au, array_to_string(failed, ',') AS failed, restarts, len(failed) = 0 AS valid FROM g"""


def q23_duplicate_filter(spark, sf_dir):
    """Documents of one source in order; equal neighbours are duplicates, which go."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("stream_id"), F.col("doc_id").alias("au"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "lang")
    return carry.duplicates(d, "digest", "lang").where(~F.col("is_duplicate")).select("stream_id", "au", "digest")


Q23 = f"""WITH d AS (SELECT coalesce(source, '') AS stream_id, doc_id AS au, md5(coalesce(text, '')) AS digest, lang FROM documents),
n AS (SELECT *, lag(au) OVER ({_W}) IS NOT NULL AND digest IS NOT DISTINCT FROM lag(digest) OVER ({_W}) AND lang IS NOT DISTINCT FROM lag(lang) OVER ({_W}) AS same FROM d)
SELECT stream_id, au, digest FROM n WHERE NOT same"""


def _objects(spark, sf_dir):
    return units(spark, sf_dir).select("stream_id", "au", (F.col("k") % 3).alias("gain"), (F.col("length") % 2).alias("zone"), F.when(F.col("k") % 4 > 0, F.col("event_type")).alias("mode"))


def q24_event_diff(spark, sf_dir):
    return carry.changed_only(_objects(spark, sf_dir), "gain", "zone", "mode")


_D = "lag({c}) OVER (PARTITION BY stream_id ORDER BY au)"
Q24 = f"""WITH {UNITS}, o AS (SELECT stream_id, au, k % 3 AS gain, length % 2 AS zone, CASE WHEN k % 4 > 0 THEN event_type END AS mode FROM units),
d AS (SELECT stream_id, au, au = 0 AS f, CASE WHEN au = 0 OR gain IS DISTINCT FROM {_D.format(c='gain')} THEN gain END AS gain,
 CASE WHEN au = 0 OR zone IS DISTINCT FROM {_D.format(c='zone')} THEN zone END AS zone, CASE WHEN au = 0 OR mode IS DISTINCT FROM {_D.format(c='mode')} THEN mode END AS mode FROM o)
SELECT stream_id, au, gain, zone, mode FROM d WHERE f OR gain IS NOT NULL OR zone IS NOT NULL OR mode IS NOT NULL"""


def q25_param_carry_forward(spark, sf_dir):
    """A parameter set by every fourth kind of unit, reset at major syncs to 24."""
    rows = timing.restart_gaps(units(spark, sf_dir)).withColumn("update", F.when(F.col("k") % 4 == 0, F.col("k")))
    return rows.withColumn("value", carry.carried(rows, F.col("update"), F.lit(24).cast("long"), F.col("is_major"))).select("stream_id", "au", "segment", "update", "value")


Q25 = f"""WITH {UNITS}, {_GAPS}, u AS (SELECT *, CASE WHEN k % 4 = 0 THEN k END AS "update" FROM gaps)
SELECT stream_id, au, segment, "update", coalesce(last_value("update" IGNORE NULLS) OVER (PARTITION BY stream_id, segment ORDER BY au), 24) AS value FROM u"""


def q26_segmenter(spark, sf_dir):
    rows = units(spark, sf_dir).withColumns({"rate": F.col("k") % 2, "channels": F.col("length") % 3})
    return carry.segmented(rows, "rate", "channels").select("stream_id", "au", "output_segment")


Q26 = f"""WITH {UNITS}, c AS (SELECT *, k % 2 AS rate, length % 3 AS channels FROM units),
d AS (SELECT stream_id, au, CASE WHEN au > 0 AND (rate IS DISTINCT FROM {_D.format(c='rate')} OR channels IS DISTINCT FROM {_D.format(c='channels')}) THEN 1 ELSE 0 END AS changed FROM c)
SELECT stream_id, au, CAST(sum(changed) OVER ({_W}) AS BIGINT) AS output_segment FROM d"""


def q36_drc_cadence(spark, sf_dir):
    rows = units(spark, sf_dir).withColumn("drc", F.when(F.col("k") % 5 == 0, F.col("k")))
    timed = carry.cadence(rows, "drc")
    return timed.select("stream_id", "au", "since", (F.col("since") > F.call_function("shiftleft", F.lit(1), (F.col("length") % 4).cast("int"))).alias("exceeded"))


Q36 = f"""WITH {UNITS}, s AS (SELECT *, au - coalesce(max(CASE WHEN k % 5 = 0 THEN au END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM units)
SELECT stream_id, au, since, since > (1 << (length % 4)) AS exceeded FROM s"""

QUERIES = {
    "q9_clock_unwrap": (q9_clock_unwrap, Q9),
    "q10_restart_gap": (q10_restart_gap, Q10),
    "q11_interval_rules": (q11_interval_rules, Q11),
    "q12_fifo_depth": (q12_fifo_depth, Q12),
    "q13_fifo_peak": (q13_fifo_peak, Q13),
    "q21_branch_merge": (q21_branch_merge, Q21),
    "q23_duplicate_filter": (q23_duplicate_filter, Q23),
    "q24_event_diff": (q24_event_diff, Q24),
    "q25_param_carry_forward": (q25_param_carry_forward, Q25),
    "q26_segmenter": (q26_segmenter, Q26),
    "q36_drc_cadence": (q36_drc_cadence, Q36),
}
