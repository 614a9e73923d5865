"""Queries on diagnostics: tallies, limits, severities, facts, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import streams as S
from tessera.operators import tally, timing
from tessera.plans.common import LONGEST, PEAK, SAMPLES, UNITS, table, units
from tessera.plans.timing import _GAPS, _INTERVALS, _RULES

# how bad each rule of the derived streams counts
SEVERITY = {
    "access_unit.timing_too_short": "warning",
    "access_unit.timing_shorter_than_previous": "warning",
    "access_unit.data_rate_exceeded": "error",
    "access_unit.timing_too_long": "info",
    "access_unit.restart_gap_invalid": "warning",
    "access_unit.fba_sync_too_far": "fatal",
}
_FAR = 5


def diagnostics(spark, sf_dir) -> DataFrame:
    """(stream_id, au, seq, rule, severity): what the derived streams break."""
    timed = timing.intervals(timing.restart_gaps(units(spark, sf_dir)), F.lit(PEAK))
    rules = {
        "access_unit.timing_too_short": F.col("interval") < SAMPLES // 4,
        "access_unit.timing_shorter_than_previous": F.col("interval") < F.col("previous_duration"),
        "access_unit.data_rate_exceeded": F.col("previous_length") * 256 > F.col("interval") * PEAK,
        "access_unit.timing_too_long": F.col("interval") > LONGEST,
        "access_unit.restart_gap_invalid": (F.col("gap") != 1) & (F.col("gap") < 8),
        "access_unit.fba_sync_too_far": F.col("distance") > _FAR,
    }
    found = timing.broken(timed, rules, "event_id")
    names = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return found.select("stream_id", "au", F.array_position(F.array(*[F.lit(r) for r in rules]), F.col("rule")).cast("long").alias("seq"), "rule", F.element_at(names, F.col("rule")).alias("severity"))


_SEVERITY_SQL = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items()) + " END"
_SEQ_SQL = "CASE rule " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(SEVERITY, 1)) + " END"
_RANK_SQL = "CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END"
_DIAGNOSTICS = f"""{UNITS}, {_GAPS}, {_INTERVALS}, fired AS ({_RULES}
 UNION ALL SELECT stream_id, au, 'access_unit.restart_gap_invalid' FROM gaps WHERE gap <> 1 AND gap < 8
 UNION ALL SELECT stream_id, au, 'access_unit.fba_sync_too_far' FROM gaps WHERE distance > {_FAR}),
diag AS (SELECT *, {_SEVERITY_SQL} AS severity, {_SEQ_SQL} AS seq FROM fired)"""
_WORST = f"['info', 'warning', 'error', 'fatal'][max({_RANK_SQL}) + 1]"
_TALLY = f"""SELECT stream_id, rule, count(*) AS count, least(count(*), 10) AS shown, {_WORST} AS worst, min(au) AS first_au, max(au) AS last_au, count(DISTINCT au) AS access_units FROM diag GROUP BY stream_id, rule"""


def q14_tally(spark, sf_dir):
    return tally.tally(diagnostics(spark, sf_dir), 10)


Q14 = f"WITH {_DIAGNOSTICS} {_TALLY}"


def q15_suppression(spark, sf_dir):
    return tally.limited(diagnostics(spark, sf_dir), 3).select("stream_id", "rule", "au", "severity")


Q15 = f"""WITH {_DIAGNOSTICS}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, rule ORDER BY au, seq) AS n FROM diag)
SELECT stream_id, rule, au, severity FROM n WHERE n <= 3"""


def q16_severity_rollup(spark, sf_dir):
    return tally.severity_totals(diagnostics(spark, sf_dir))


Q16 = f"""WITH {_DIAGNOSTICS} SELECT stream_id, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in S.SEVERITIES)}, {_WORST} AS worst FROM diag GROUP BY stream_id"""


def q16b_domain_rollup(spark, sf_dir):
    """Totals for each domain and rule, each domain, and all."""
    parts = F.split("rule", r"\.")
    d = diagnostics(spark, sf_dir).select(parts[0].alias("domain"), parts[1].alias("name"))
    return d.rollup("domain", "name").agg(F.count("*").alias("count"))


Q16B = f"WITH {_DIAGNOSTICS} SELECT split_part(rule, '.', 1) AS domain, split_part(rule, '.', 2) AS name, count(*) AS count FROM diag GROUP BY ROLLUP (split_part(rule, '.', 1), split_part(rule, '.', 2))"


def facts(spark, sf_dir) -> DataFrame:
    u = units(spark, sf_dir)
    first = F.min_by(F.struct("event_type", "k"), F.col("au"))
    return u.groupBy("stream_id").agg(
        first.alias("config"),
        F.count("*").alias("access_units"),
        F.count_if("is_major").alias("major_syncs"),
        F.max("length").alias("longest"),
        F.sum("length").alias("words"),
        F.max(F.struct("length", (-F.col("au")).alias("au"))).alias("peak"),
        F.max(F.col("k") % 8).alias("max_channel"),
    )


def q17_stream_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.select(
        "stream_id",
        F.col("config.event_type").alias("first_type"),
        F.col("config.k").alias("first_k"),
        "access_units",
        "major_syncs",
        "longest",
        "words",
        (-F.col("peak.au")).alias("longest_au"),
        F.floor(F.col("words") * 2 / F.col("access_units")).cast("long").alias("average_bytes"),
        (F.col("access_units") * SAMPLES).alias("samples"),
        "max_channel",
    )


_FACTS = f"""facts AS (SELECT stream_id, arg_min(event_type, au) AS first_type, arg_min(k, au) AS first_k, count(*) AS access_units, count(*) FILTER (WHERE is_major) AS major_syncs,
 max(length) AS longest, CAST(sum(length) AS BIGINT) AS words, max(k % 8) AS max_channel FROM units GROUP BY stream_id)"""
Q17 = f"""WITH {UNITS}, {_FACTS}, w AS (SELECT u.stream_id, min(u.au) AS longest_au FROM units u JOIN facts f ON f.stream_id = u.stream_id AND f.longest = u.length GROUP BY u.stream_id)
SELECT f.*, longest_au, words * 2 // access_units AS average_bytes, access_units * {SAMPLES} AS samples FROM facts f JOIN w USING (stream_id)"""


def q18_verdict(spark, sf_dir):
    totals = tally.severity_totals(diagnostics(spark, sf_dir))
    f = facts(spark, sf_dir).join(totals, "stream_id", "left")
    name = S.verdict(F.col("access_units"), F.coalesce("fatal", F.lit(0)) > 12, F.col("words") % 13 - 12, S.severity_rank(F.col("worst")), F.lit(2), F.col("max_channel") < 7)
    return f.select("stream_id", name.alias("verdict"), S.exit_code(name).alias("exit_code"))


Q18 = f"""WITH {_DIAGNOSTICS}, {_FACTS}, t AS (SELECT stream_id, count(*) FILTER (WHERE severity = 'fatal') AS fatal, max({_RANK_SQL}) AS worst FROM diag GROUP BY stream_id),
v AS (SELECT f.stream_id, CASE WHEN access_units = 0 OR coalesce(fatal, 0) > 12 OR words % 13 - 12 > 0 THEN 'unparseable' WHEN coalesce(worst >= 2, false) THEN 'non_conformant'
 WHEN NOT max_channel < 7 THEN 'conformant_off_disc' ELSE 'conformant' END AS verdict FROM facts f LEFT JOIN t USING (stream_id))
SELECT stream_id, verdict, CASE verdict WHEN 'unparseable' THEN 4 WHEN 'non_conformant' THEN 7 ELSE 0 END AS exit_code FROM v"""


def q19_disc_validity(spark, sf_dir):
    """Streams are orders: a line's size and quantity give channel counts, the order's key the rate code."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_quantity").cast("int") % 9).alias("carried"), F.every(F.col("l_linenumber") <= 6).alias("numbered"))
    code = F.col("l_orderkey") % 11
    freq = S.sampling_frequency(code.cast("int"))
    high = freq.isin(176_400, 192_000)
    bluray = F.col("numbered") & F.when(high, F.col("carried") <= 6).otherwise(True) & ~freq.isin(44_100, 88_200, 176_400)
    hd = F.col("numbered") & F.when(high, F.col("carried") <= 2).otherwise(True)
    return lines.select("l_orderkey", freq.alias("frequency"), F.coalesce(bluray & freq.isNotNull(), F.lit(False)).alias("bluray"), F.coalesce(hd & freq.isNotNull(), F.lit(False)).alias("hd"))


Q19 = """WITH l AS (SELECT l_orderkey, max(CAST(l_quantity AS INTEGER) % 9) AS carried, bool_and(l_linenumber <= 6) AS numbered FROM lineitem GROUP BY l_orderkey),
f AS (SELECT *, CASE WHEN l_orderkey % 11 <= 2 THEN 48000 << CAST(l_orderkey % 11 AS INTEGER) WHEN l_orderkey % 11 >= 8 THEN 44100 << CAST(l_orderkey % 11 - 8 AS INTEGER) END AS frequency FROM l)
SELECT l_orderkey, frequency, frequency IS NOT NULL AND numbered AND (frequency NOT IN (176400, 192000) OR carried <= 6) AND frequency NOT IN (44100, 88200, 176400) AS bluray,
 frequency IS NOT NULL AND numbered AND (frequency NOT IN (176400, 192000) OR carried <= 2) AS hd FROM f"""


def q20_channel_tiling(spark, sf_dir):
    """Lines are channel spans of an order; sorted, each must begin where the one before ended."""
    low = F.col("l_partkey") % 8
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", low.alias("low"), (low + F.col("l_quantity").cast("long") % 3).alias("high"), "l_linenumber")
    order = Window.partitionBy("l_orderkey").orderBy("low", "high", "l_linenumber")
    broken = F.col("low") != F.coalesce(F.lag("high").over(order) + 1, F.lit(0))
    return spans.withColumn("broken", broken).groupBy("l_orderkey").agg(F.some("broken").alias("broken"), F.count_if("broken").alias("places"))


Q20 = """WITH s AS (SELECT l_orderkey, l_partkey % 8 AS low, l_partkey % 8 + CAST(l_quantity AS BIGINT) % 3 AS high, l_linenumber FROM lineitem),
b AS (SELECT l_orderkey, low <> coalesce(lag(high) OVER (PARTITION BY l_orderkey ORDER BY low, high, l_linenumber) + 1, 0) AS broken FROM s)
SELECT l_orderkey, bool_or(broken) AS broken, count(*) FILTER (WHERE broken) AS places FROM b GROUP BY l_orderkey"""


def q35_pair_disagreement(spark, sf_dir):
    """Pairs of an order's lines whose flag differs, the lower line first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 2).alias("bit"))
    a, b = lines.alias("a"), lines.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.bit") != F.col("b.bit"))
    return a.join(b, on).select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("i"), F.col("b.l_linenumber").alias("j"))


Q35 = "SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_suppkey % 2 <> b.l_suppkey % 2"


def q37_json_lines(spark, sf_dir):
    t = tally.tally(diagnostics(spark, sf_dir), 3).where("count > shown")
    line = F.to_json(F.struct(F.lit("suppressed").alias("type"), F.col("stream_id").alias("stream"), "rule", (F.col("count") - F.col("shown")).alias("suppressed"), F.col("first_au").alias("first"), F.col("last_au").alias("last")))
    return t.select("stream_id", "rule", line.alias("line"))


Q37 = f"""WITH {_DIAGNOSTICS}, t AS ({_TALLY.replace('least(count(*), 10)', 'least(count(*), 3)')})
SELECT stream_id, rule, printf('{{"type":"suppressed","stream":%d,"rule":"%s","suppressed":%d,"first":%d,"last":%d}}', stream_id, rule, count - shown, first_au, last_au) AS line FROM t WHERE count > shown"""

QUERIES = {
    "q14_tally": (q14_tally, Q14),
    "q15_suppression": (q15_suppression, Q15),
    "q16_severity_rollup": (q16_severity_rollup, Q16),
    "q16b_domain_rollup": (q16b_domain_rollup, Q16B),
    "q17_stream_facts": (q17_stream_facts, Q17),
    "q18_verdict": (q18_verdict, Q18),
    "q19_disc_validity": (q19_disc_validity, Q19),
    "q20_channel_tiling": (q20_channel_tiling, Q20),
    "q35_pair_disagreement": (q35_pair_disagreement, Q35),
    "q37_json_lines": (q37_json_lines, Q37),
}
