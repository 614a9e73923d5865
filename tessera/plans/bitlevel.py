"""Queries on bits, checksums and configuration fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.functions import streams as S
from tessera.kernels import dither
from tessera.plans.common import epoch_ms, table


def _array_sql(values) -> str:
    return "[" + ",".join(map(str, values)) + "]"


_BYTES = "list_transform(range(1, strlen({c}) + 1), lambda i: CAST(concat('0x', substr(hex(encode({c})), 2 * i - 1, 2)) AS INTEGER))"


def q1_parity_nibble(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", B.parity(F.col("p_name")).alias("parity"))
    return p.select("p_partkey", "parity", B.nibble(F.col("parity")).alias("nibble"), (B.nibble(F.col("parity")) == 15).alias("passes"))


Q1 = f"""WITH p AS (SELECT p_partkey, list_reduce({_BYTES.format(c='p_name')}, lambda a, x: xor(a, x), 0) AS parity FROM part)
SELECT p_partkey, parity, xor(parity >> 4, parity & 15) AS nibble, xor(parity >> 4, parity & 15) = 15 AS passes FROM p"""


def _crc_query(name, key, column, width, polynomial, initial):
    def run(spark, sf_dir):
        crc = B.crc8 if width == 8 else B.crc16
        return table(spark, sf_dir, name).select(key, crc(F.col(column), polynomial, initial).alias("crc"))

    step = "xor(t[a + 1], x)" if width == 8 else "xor(xor(t[(a >> 8) + 1], (a << 8) & 65535), x)"
    sql = f"""WITH t AS (SELECT {_array_sql(B.crc_table(polynomial, width))} AS t)
SELECT {key}, list_reduce({_BYTES.format(c=column)}, lambda a, x: {step}, {initial}) AS crc FROM {name}, t"""
    return run, sql


q2_crc8_segment, Q2 = _crc_query("part", "p_partkey", "p_name", 8, 0x63, 0xA2)
q3_crc16_sync, Q3 = _crc_query("nation", "n_nationkey", "n_name", 16, 0x2D, 0)
q3b_crc8_header, Q3B = _crc_query("part", "p_partkey", "p_type", 8, 0x1D, 0)


def q4_directory_unpack(spark, sf_dir):
    word, extra = F.col("l_orderkey").bitwiseAND(F.lit(0xFFFF)), F.col("l_partkey").bitwiseAND(F.lit(0xFFFF))
    there = B.bit(word, 15)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        there.alias("extra_word"),
        B.bit(word, 14).alias("restart_nonexistent"),
        B.bit(word, 13).alias("crc_present"),
        B.field(word, 0, 12).alias("end_ptr"),
        F.when(there, B.signed(B.field(extra, 7, 9), 9)).alias("drc_gain"),
        F.when(there, B.field(extra, 4, 3)).alias("drc_time"),
    )


Q4 = """WITH w AS (SELECT *, l_orderkey & 65535 AS w, l_partkey & 65535 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (w >> 15) & 1 = 1 AS extra_word, (w >> 14) & 1 = 1 AS restart_nonexistent, (w >> 13) & 1 = 1 AS crc_present, w & 4095 AS end_ptr,
 CASE WHEN (w >> 15) & 1 = 1 THEN CASE WHEN (e >> 7) & 511 >= 256 THEN ((e >> 7) & 511) - 512 ELSE (e >> 7) & 511 END END AS drc_gain,
 CASE WHEN (w >> 15) & 1 = 1 THEN (e >> 4) & 7 END AS drc_time FROM w"""


def _masks(spark, sf_dir):
    """Presentation masks of an info byte and two flags from each part's size."""
    info = (F.col("p_size") * 37 + F.col("p_partkey")).bitwiseAND(F.lit(255)).cast("int")
    masks = S.presentation_masks(info, F.col("p_size").bitwiseAND(F.lit(3)).cast("int"), F.col("p_partkey") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", masks.alias("m"))


_MASKS_SQL = """i AS (SELECT p_partkey, (p_size * 37 + p_partkey) & 255 AS si, p_size & 3 AS ext, p_partkey % 3 = 0 AS fbb FROM part),
m AS (SELECT *, 1 AS m0, CASE WHEN fbb THEN CASE WHEN si & 8 <> 0 THEN 3 ELSE 0 END ELSE (si >> 2) & 3 END AS m1, CASE WHEN fbb THEN 0 ELSE (si >> 4) & 7 END AS m2,
 CASE WHEN fbb THEN 0 ELSE ((si >> 4) & 8) | xor(7, 7 >> ext) END AS m3 FROM i)"""


def q5_presentation_map(spark, sf_dir):
    m = _masks(spark, sf_dir)
    return m.select("p_partkey", *[F.col("m")[i].alias(f"mask_{i}") for i in range(4)], S.max_independent_presentation(F.col("m")).alias("highest"), S.required_mask(F.col("m"), [1, 3]).alias("required"))


Q5 = f"""WITH {_MASKS_SQL}, h AS (SELECT *, CASE WHEN m3 >> 3 <> 0 THEN 3 WHEN m2 >> 2 <> 0 THEN 2 WHEN m1 >> 1 <> 0 THEN 1 ELSE 0 END AS highest,
 m1 >> 1 = 0 AND m1 = 0 AS bad1, m3 = 0 AS bad3 FROM m), b AS (SELECT *, [m0, m1, m2, m3][highest + 1] AS best FROM h)
SELECT p_partkey, m0 AS mask_0, m1 AS mask_1, m2 AS mask_2, m3 AS mask_3, highest, (CASE WHEN bad1 THEN best ELSE m1 END) | (CASE WHEN bad3 THEN best ELSE m3 END) AS required FROM b"""


def q6_presentation_type(spark, sf_dir):
    m = _masks(spark, sf_dir)
    return m.select("p_partkey", *[S.presentation_type(F.col("m"), i).alias(f"type_{i}") for i in range(4)])


def _type_sql(i: int) -> str:
    down = " ".join(f"WHEN m{j} >> {j} <> 0 AND (m{j} >> {i}) & 1 = 1 THEN 'DownmixOf({j})'" for j in range(i + 1, 4))
    copy = " ".join(f"WHEN m{i} >> {j} <> 0 THEN 'CopyOf({j})'" for j in reversed(range(i)))
    down = f"CASE {down} ELSE 'Independent' END" if down else "'Independent'"
    copy = f"CASE {copy} ELSE 'Invalid' END" if copy else "'Invalid'"
    return f"CASE WHEN m{i} >> {i} <> 0 THEN {down} ELSE {copy} END AS type_{i}"


Q6 = f"WITH {_MASKS_SQL} SELECT p_partkey, {', '.join(_type_sql(i) for i in range(4))} FROM m"


def _assignment():
    return ((F.col("p_partkey") * 2654435 + F.col("p_size")) % 8192).cast("int")


_ASSIGNMENT_SQL = "CAST((p_partkey * 2654435 + p_size) % 8192 AS INTEGER)"


def _labels_sql(value: str, tables: list[list[str]]) -> str:
    return "list_concat(" + ", ".join(f"CASE WHEN ({value} >> {i}) & 1 = 1 THEN {names!r} ELSE []::VARCHAR[] END" for i, names in enumerate(tables)) + ")"


def q7_labels_from_bitmask(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _assignment().alias("a"), F.when(F.col("p_size") % 2 == 0, 0x800).otherwise(0).alias("flags"))
    return p.select("p_partkey", F.posexplode(S.eightch_labels(F.col("a"), F.col("flags"))).alias("channel", "label"))


Q7 = f"""WITH p AS (SELECT p_partkey, {_ASSIGNMENT_SQL} AS a, p_size % 2 = 0 AS few FROM part),
l AS (SELECT p_partkey, CASE WHEN few THEN {_labels_sql('a', S.EIGHTCH_RESTRICTED)} ELSE {_labels_sql('a', S.EIGHTCH)} END AS labels FROM p),
x AS (SELECT p_partkey, labels, unnest(range(1, len(labels) + 1)) AS i FROM l)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS channel, labels[i] AS label FROM x"""


def q8_marker_scan(spark, sf_dir):
    """The first marker from the fifth byte on, by whole bytes, and how many there are."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    after = F.instr(F.substring("html", 5, 1 << 30), "</p>")
    return pages.select("page_id", F.when(after > 0, after + 3).cast("long").alias("first"), F.size(F.split("html", "</p>", -1)).cast("long").alias("pieces"))


Q8 = """SELECT page_id, CASE WHEN strpos(substr(coalesce(html, ''), 5), '</p>') > 0 THEN strpos(substr(coalesce(html, ''), 5), '</p>') + 3 END AS first,
CAST(len(string_split(coalesce(html, ''), '</p>')) AS BIGINT) AS pieces FROM pages"""


def q31_dither_lfsr(spark, sf_dir):
    """The places in the dither table of one seed for each region; the generator is sequential, so a kernel makes each."""
    regions = table(spark, sf_dir, "region").select("r_regionkey")

    def run(batches):
        for frame in batches:
            rows = [(int(key), n, int(v)) for key in frame["r_regionkey"] for n, v in enumerate(dither.indices(40, int(key) * 7919 + 1)[0])]
            yield frame.__class__(rows, columns=["r_regionkey", "n", "value"])

    return regions.mapInPandas(run, "r_regionkey int, n int, value int")


Q31 = """WITH RECURSIVE s(r, n, seed) AS (
 SELECT r_regionkey, 0, CAST(r_regionkey * 7919 + 1 AS BIGINT) FROM region UNION ALL
 SELECT r, n + 1, xor(xor(seed << 8, seed >> 15), (seed >> 15) << 5) & 8388607 FROM s WHERE n < 63)
SELECT r AS r_regionkey, n, seed >> 15 AS value FROM s"""

KEY = b"tessera"


def q32_hmac_verify(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", B.hmac_sha256(KEY, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("digest"))


def _pad(value: int) -> str:
    return bytes(b ^ value for b in KEY.ljust(64, b"\0")).hex()


Q32 = f"""SELECT conv_id, turn, sha256(unhex(concat('{_pad(0x5C)}', sha256(unhex(concat('{_pad(0x36)}', hex(encode(coalesce(text, '')))))))))  AS digest FROM conversations"""


def q33_bcd_timestamp(spark, sf_dir):
    code = (F.col("event_id") * 40503 % 65536).cast("int")
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), S.bcd(code, 4).alias("value"))


Q33 = """WITH c AS (SELECT event_id, CAST(event_id * 40503 % 65536 AS INTEGER) AS code FROM events)
SELECT event_id, code, CASE WHEN code & 15 <= 9 AND (code >> 4) & 15 <= 9 AND (code >> 8) & 15 <= 9 AND (code >> 12) & 15 <= 9
 THEN (code & 15) + 10 * ((code >> 4) & 15) + 100 * ((code >> 8) & 15) + 1000 * ((code >> 12) & 15) END AS value FROM c"""


def q34_time_str(spark, sf_dir):
    ms = (epoch_ms("ts") % 100_000_000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", S.time_text(ms).alias("time"))


Q34 = """WITH m AS (SELECT event_id, (epoch_us(ts) // 1000) % 100000000 AS ms FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS time FROM m"""


def q38_layout_lookup(spark, sf_dir):
    """Labels joined to the layouts that name exactly their order; other orders are described one by one."""
    from tessera.sinks import layouts

    p = table(spark, sf_dir, "part").select("p_partkey", S.labels((F.col("p_size") % 16).cast("int"), S.SIXCH).alias("labels"))
    known = F.broadcast(layouts.standard(spark))  # a fixed table of the format
    joined = p.withColumn("order", F.array_join("labels", " ")).join(known, "order", "left")
    return joined.select("p_partkey", "order", F.coalesce("tag", F.lit(0)).alias("tag"), F.size("labels").alias("channels"))


def _q38() -> str:
    from tessera.sinks import layouts

    rows = ", ".join(f"('{order}', {tag})" for order, tag in layouts.orders())
    return f"""WITH known("order", tag) AS (VALUES {rows}), p AS (SELECT p_partkey, {_labels_sql('(p_size % 16)', S.SIXCH)} AS labels FROM part)
SELECT p_partkey, array_to_string(labels, ' ') AS "order", coalesce(tag, 0) AS tag, CAST(len(labels) AS INTEGER) AS channels FROM p LEFT JOIN known ON known."order" = array_to_string(labels, ' ')"""


def q39_mask_or_null(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.labels((_assignment() % 1024).cast("int"), S.SIXTEENCH).alias("labels"))
    return p.select("p_partkey", F.array_join("labels", " ").alias("order"), S.wave_mask(F.col("labels")).alias("mask"))


_BITS_SQL = "map {" + ", ".join(f"'{k}': {v}" for k, v in S.WAVE_BITS.items()) + "}"
Q39 = f"""WITH l AS (SELECT p_partkey, {_labels_sql(f'({_ASSIGNMENT_SQL} % 1024)', S.SIXTEENCH)} AS labels FROM part),
b AS (SELECT *, list_transform(labels, lambda x: {_BITS_SQL}[x]) AS bits FROM l)
SELECT p_partkey, array_to_string(labels, ' ') AS "order",
 CASE WHEN len(bits) > 0 AND len(list_filter(bits, lambda x: x IS NULL)) = 0 AND bits = list_sort(bits) AND len(list_distinct(bits)) = len(bits)
 THEN CAST(list_sum(bits) AS INTEGER) END AS mask FROM b"""

QUERIES = {
    "q1_parity_nibble": (q1_parity_nibble, Q1),
    "q2_crc8_segment": (q2_crc8_segment, Q2),
    "q3_crc16_sync": (q3_crc16_sync, Q3),
    "q3b_crc8_header": (q3b_crc8_header, Q3B),
    "q4_directory_unpack": (q4_directory_unpack, Q4),
    "q5_presentation_map": (q5_presentation_map, Q5),
    "q6_presentation_type": (q6_presentation_type, Q6),
    "q7_labels_from_bitmask": (q7_labels_from_bitmask, Q7),
    "q8_marker_scan": (q8_marker_scan, Q8),
    "q31_dither_lfsr": (q31_dither_lfsr, Q31),
    "q32_hmac_verify": (q32_hmac_verify, Q32),
    "q33_bcd_timestamp": (q33_bcd_timestamp, Q33),
    "q34_time_str": (q34_time_str, Q34),
    "q38_layout_lookup": (q38_layout_lookup, _q38()),
    "q39_mask_or_null": (q39_mask_or_null, Q39),
}
