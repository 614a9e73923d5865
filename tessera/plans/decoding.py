"""Queries on the decode formulas: checks, remapping, matrices, predictors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import streams as S
from tessera.kernels import huffman
from tessera.plans.bitlevel import _labels_sql
from tessera.plans.common import table
from tessera.storage import materialise, spread


def folded(digest):
    """A 32-bit digest folded to a byte by XOR."""
    half = F.shiftrightunsigned(digest, 16).bitwiseXOR(digest).bitwiseAND(F.lit(0xFFFF))
    return F.shiftrightunsigned(half, 8).bitwiseXOR(half).bitwiseAND(F.lit(0xFF))


def q22_lossless_check(spark, sf_dir):
    """An order's line digest against the check byte of the customer's next order."""
    value = F.floor("l_extendedprice").cast("long")
    part = value.bitwiseAND(F.lit(0xFFFFFF)) * F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("l_linenumber") % 8 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bit_xor(part).alias("digest"), F.bit_or(value).alias("bits"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    check = (F.lead("o_orderkey").over(order) * 31).bitwiseAND(F.lit(255))
    return joined.select("o_orderkey", "digest", "bits", folded(F.col("digest")).alias("byte"), check.alias("expected")).withColumn("lossless", F.col("byte") == F.col("expected"))


Q22 = """WITH l AS (SELECT l_orderkey AS o_orderkey, bit_xor((CAST(floor(l_extendedprice) AS BIGINT) & 16777215) * (1 << (l_linenumber % 8))) AS digest, bit_or(CAST(floor(l_extendedprice) AS BIGINT)) AS bits FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey, digest, bits, (lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 31) & 255 AS expected FROM orders JOIN l USING (o_orderkey)),
h AS (SELECT *, xor(digest >> 16, digest) & 65535 AS half FROM j)
SELECT o_orderkey, digest, bits, xor(half >> 8, half) & 255 AS byte, expected, xor(half >> 8, half) & 255 = expected AS lossless FROM h"""

BED = ["L", "R", "C", "LFE", "Ls", "Rs", "Lb", "Rb", "Tsl", "Tsr"]


def q27_bed_conform(spark, sf_dir):
    """Ten target slots, each with its channel's sample or 0."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    labels = S.labels((F.col("vec_id") * 37 % 1024).cast("int"), S.SIXTEENCH)
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long"))
    both = e.select("vec_id", labels.alias("labels"), samples.alias("samples"))
    slots = F.array(*[F.coalesce(F.get("samples", F.array_position("labels", F.lit(name)).cast("int") - 1), F.lit(0).cast("long")) for name in BED])
    return both.select("vec_id", F.posexplode(slots).alias("slot", "sample"))


Q27 = f"""WITH e AS (SELECT vec_id, {_labels_sql('(vec_id * 37 % 1024)', S.SIXTEENCH)} AS labels, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS samples FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT vec_id, labels, samples, unnest(range(0, 10)) AS slot FROM e)
SELECT vec_id, CAST(slot AS INTEGER) AS slot, coalesce(CASE WHEN list_position(labels, {BED!r}[slot + 1]) > 0 THEN samples[list_position(labels, {BED!r}[slot + 1])] END, 0) AS sample FROM s"""

_CHANNELS, _SHIFT, _STEP, _ASSIGN = 6, 18, 2, [2, 0, 1, 5, 3, 4]
_MATRIX = [[((i * 7 + j * 13 + 3) % 17 - 8) * 16384 for j in range(_CHANNELS)] for i in range(_CHANNELS)]


def q28_matrix_remap(spark, sf_dir):
    """Matrix primitives in order and in place, then the channel assignment and an output shift."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    sample = F.transform(F.slice("embedding", 1, _CHANNELS), lambda x: F.floor(x.cast("double") * 4096).cast("long"))
    rows = e.select("vec_id", sample.alias("s"))
    names = [f"c{i}" for i in range(_CHANNELS)]
    rows = rows.select("vec_id", *[F.col("s")[i].alias(n) for i, n in enumerate(names)])
    for i, weights in enumerate(_MATRIX):
        total = sum((F.col(n) * w for n, w in zip(names, weights, strict=True)), F.lit(0).cast("long"))
        rows = rows.withColumn(names[i], F.shiftright(total, _SHIFT).bitwiseAND(F.lit(~((1 << _STEP) - 1)).cast("long")))
    return rows.select("vec_id", *[(F.col(names[a]) * 2).alias(f"out_{k}") for k, a in enumerate(_ASSIGN)])


def _q28() -> str:
    steps, last = [], "s0"
    first = ", ".join(f"CAST(floor(CAST(embedding[{i + 1}] AS DOUBLE) * 4096) AS BIGINT) AS c{i}" for i in range(_CHANNELS))
    steps.append(f"s0 AS (SELECT vec_id, {first} FROM embeddings WHERE embedding IS NOT NULL)")
    for i, weights in enumerate(_MATRIX):
        total = " + ".join(f"c{j} * ({w})" for j, w in enumerate(weights))
        columns = ", ".join(f"CAST(floor(({total}) / {1 << _SHIFT}.0) AS BIGINT) & -4 AS c{j}" if j == i else f"c{j}" for j in range(_CHANNELS))
        steps.append(f"s{i + 1} AS (SELECT vec_id, {columns} FROM {last})")
        last = f"s{i + 1}"
    return f"WITH {', '.join(steps)} SELECT vec_id, {', '.join(f'c{a} * 2 AS out_{k}' for k, a in enumerate(_ASSIGN))} FROM {last}"


_A, _B, _Q, _MASK = (7, -3), (2,), 3, 7


def _samples(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(order).cast("long") - 1)
    return o.select("o_custkey", "n", F.floor("o_totalprice").cast("long").alias("x"))


_SAMPLES = """samples AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders)"""


def q29_fir_predictor(spark, sf_dir):
    """Residuals of the feed-forward predictor: each sample less the masked prediction from the two before."""
    w = Window.partitionBy("o_custkey").orderBy("n")
    past = [F.coalesce(F.lag("x", k + 1).over(w), F.lit(0).cast("long")) for k in range(len(_A))]
    prediction = F.shiftright(sum((p * a for p, a in zip(past, _A, strict=True)), F.lit(0).cast("long")), _Q)
    return _samples(spark, sf_dir).select("o_custkey", "n", (F.col("x") - prediction.bitwiseAND(F.lit(~_MASK).cast("long"))).alias("residual"))


Q29 = f"""WITH {_SAMPLES} SELECT o_custkey, n, x - ((coalesce(lag(x, 1) OVER w, 0) * {_A[0]} + coalesce(lag(x, 2) OVER w, 0) * {_A[1]}) >> {_Q} & {~_MASK}) AS residual
FROM samples WINDOW w AS (PARTITION BY o_custkey ORDER BY n)"""


def recorrelate(x: list[int], a: tuple[int, ...], b: tuple[int, ...], shift: int, mask: int) -> list[tuple[int, int]]:
    """Outputs and feedback values of both predictors over one channel; every sample needs the ones before."""
    outputs, feedback, done = [0] * len(a), [0] * len(b), []
    for value in x:
        prediction = (sum(p * q for p, q in zip(a, outputs, strict=True)) + sum(p * q for p, q in zip(b, feedback, strict=True))) >> shift
        output = value + (prediction & ~mask)
        outputs = [output, *outputs[:-1]]
        feedback = [output - prediction, *feedback[:-1]]
        done.append((output, feedback[0]))
    return done


def q30_iir_predictor(spark, sf_dir):
    """Both predictors in feedback over each customer's samples, which come in order."""
    import pyarrow as pa

    def run(rows):
        rows = rows.sort_by("n")
        done = recorrelate([v % 4096 for v in rows["x"].to_pylist()], (5, -2), (1,), _Q, 0)
        return pa.table({"o_custkey": rows["o_custkey"], "n": rows["n"], "output": pa.array([d[0] for d in done], pa.int64()), "feedback": pa.array([d[1] for d in done], pa.int64())})

    return _samples(spark, sf_dir).groupBy("o_custkey").applyInArrow(run, "o_custkey long, n long, output long, feedback long")


Q30 = f"""WITH RECURSIVE {_SAMPLES}, r(o_custkey, n, f1, f2, i1) AS (
 SELECT DISTINCT o_custkey, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM samples UNION ALL
 SELECT r.o_custkey, s.n, s.x % 4096 + CAST(floor((5 * f1 - 2 * f2 + i1) / 8.0) AS BIGINT), f1, s.x % 4096 FROM r JOIN samples s ON s.o_custkey = r.o_custkey AND s.n = r.n + 1)
SELECT o_custkey, n, f1 AS "output", i1 AS feedback FROM r WHERE n >= 0"""


def q40_huffman_decode(spark, sf_dir):
    """Each part's name read as residual codes, one row for each of the three codes."""
    import pyarrow as pa

    parts = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"))

    def run(batches):
        for batch in batches:
            keys, codes, counts, totals = [], [], [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for code in (1, 2, 3):
                    count = total = 0
                    for values in huffman.symbols(data or b"", code):
                        count, total = count + len(values), total + sum(values)
                    keys.append(key)
                    codes.append(code)
                    counts.append(count)
                    totals.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(x, pa.int32()) for x in (codes, counts, totals))], ["p_partkey", "code", "symbols", "total"])

    return spread(parts, "p_partkey").mapInArrow(run, "p_partkey long, code int, symbols int, total int")


Q40 = """WITH RECURSIVE c(code, base, width) AS (VALUES (1, 4, 2), (2, 2, 1), (3, 1, 0)),
b AS (SELECT p_partkey, CAST(CAST(encode(p_name) AS BIT) AS VARCHAR) AS bits FROM part),
r(p_partkey, code, base, width, bits, place, symbols, total) AS (
  SELECT p_partkey, code, base, width, bits, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM b, c UNION ALL
  SELECT p_partkey, code, base, width, bits, place + size, symbols + 1, total + value FROM (
    SELECT *, CASE WHEN w[1] = '1' THEN 1 + width ELSE 3 + zeros END AS size,
      CASE WHEN w[1] = '1' THEN (CASE width WHEN 2 THEN 2 * CAST(w[2] AS BIGINT) + CAST(w[3] AS BIGINT) WHEN 1 THEN CAST(w[2] AS BIGINT) ELSE 0 END) WHEN w[2] = '1' THEN base + zeros ELSE -1 - zeros END AS value
    FROM (SELECT *, least(6, length(regexp_extract(w[3:9], '^0*'))) AS zeros FROM (SELECT *, rpad(substr(bits, CAST(place + 1 AS INTEGER), 9), 9, '0') AS w FROM r WHERE place < length(bits))))
  WHERE place + size <= length(bits))
SELECT p_partkey, code, CAST(max(symbols) AS INTEGER) AS symbols, CAST(arg_max(total, symbols) AS INTEGER) AS total FROM r GROUP BY p_partkey, code"""

#: Units between major syncs, and bytes of a unit of 40 samples in two channels with and without one.
EVERY, MAJOR_BYTES, MINOR_BYTES = 8, 298, 250


def _event_streams(spark, sf_dir):
    """A stream for each user: an event is a unit, whose samples rise on the left and fall on the right from its value on."""
    import itertools

    import numpy as np
    import pyarrow as pa

    from tessera.kernels import synth

    def run(batches):
        step = np.arange(40)
        every = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for stream, rows in itertools.groupby(every, lambda row: row[0]):
            levels = np.array([int(level) for _, level in rows])[:, None]
            data = synth.encode(np.stack([levels + step, 2 * step - levels], axis=2), every=EVERY)
            yield pa.RecordBatch.from_arrays([pa.array([stream], pa.string()), pa.array([data], pa.binary())], ["stream_id", "data"])

    events = table(spark, sf_dir, "events")
    levels = events.select(F.col("user_id").cast("string").alias("stream_id"), "ts", "event_id", (F.floor(F.col("value") * 10) % 60_000).cast("long").alias("level"))
    ordered = spread(levels, "stream_id").sortWithinPartitions("stream_id", "ts", "event_id")
    return ordered.select("stream_id", "level").mapInArrow(run, "stream_id string, data binary")


_LEVELS = """levels AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS au, CAST(floor(value * 10) AS BIGINT) % 60000 AS level FROM events)"""


def q41_frame_stream(spark, sf_dir):
    """The users' streams, arriving in chunks of 300 bytes, framed by a streaming query."""
    from tessera.storage import fresh_path
    from tessera.streaming.framing import frames_stream

    chunks = _event_streams(spark, sf_dir).select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / 300).cast("int")), lambda i: F.substring(F.col("data"), i * 300 + 1, F.lit(300)))).alias("seq", "data"))
    source, sink, state = (fresh_path(spark, name) for name in ("chunks", "frames", "state"))
    chunks.write.parquet(source)
    arriving = spark.readStream.schema("stream_id string, seq int, data binary").parquet(source)
    units = frames_stream(arriving).withColumn("bytes", F.octet_length("data").cast("long")).drop("data")
    running = units.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("stream_id string, au long, au_offset long, segment long, is_major boolean, bytes long").parquet(sink)


Q41 = f"""WITH {_LEVELS}
SELECT stream_id, au, au * {MINOR_BYTES} + (au + {EVERY - 1}) // {EVERY} * {MAJOR_BYTES - MINOR_BYTES} AS au_offset, au // {EVERY} + 1 AS segment, au % {EVERY} = 0 AS is_major,
CASE WHEN au % {EVERY} = 0 THEN {MAJOR_BYTES} ELSE {MINOR_BYTES} END AS bytes FROM levels"""

#: Objects that move, beside the bed channel.
MOVING = 4


def q42_object_metadata(spark, sf_dir):
    """Positions and gains of the objects of a payload made from each event."""
    import pyarrow as pa

    from tessera.kernels import synth
    from tessera.operators import objects

    def run(batches):
        for batch in batches:
            for part in (batch.slice(low, 2000) for low in range(0, batch.num_rows, 2000)):
                data = [synth.object_payload(MOVING, 0, pick=lambda index, field, limit, k=k: (k * (7 + field) + index * 13 + field * 5) % limit) for k in part.column("au").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], ["stream_id", "au", "data"])

    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("au"))
    payloads = spread(events, "au").mapInArrow(run, "stream_id string, au long, data binary")
    found = objects.objects(payloads)
    scaled = F.transform("pos", lambda x: F.round(x * 10_000).cast("long"))
    return found.select("stream_id", "au", "object_idx", "active", "in_bed", "gain", F.round(F.col("priority") * 32).cast("int").alias("priority"), "zones", "elevation", "snap", *[scaled[i].alias(axis) for i, axis in enumerate("xyz")])


def _q42() -> str:
    pick = lambda field, limit: f"(au * {7 + field} + i * 13 + {5 * field}) % {limit}"
    moving = lambda value, still: f"CASE WHEN i = 0 THEN {still} ELSE {value} END"
    gain, z = pick(0, 64), f"CAST(round((CASE WHEN {pick(4, 2)} = 1 THEN 1 ELSE -1 END) * ({pick(5, 16)}) / 15.0 * 10000) AS BIGINT)"
    return f"""SELECT CAST(user_id AS VARCHAR) AS stream_id, au, CAST(i AS INTEGER) AS object_idx, true AS active, i = 0 AS in_bed, CAST(CASE WHEN {gain} <= 14 THEN 15 - {gain} ELSE 14 - {gain} END AS INTEGER) AS gain, CAST({pick(1, 32)} AS INTEGER) AS priority,
CAST({moving(pick(6, 6), 0)} AS INTEGER) AS zones, {moving(pick(7, 2) + ' = 1', 'true')} AS elevation, {moving(pick(9, 2) + ' = 1', 'false')} AS snap,
{moving(f'CAST(round((({pick(2, 63)}) / 62.0 - 0.5) * 20000) AS BIGINT)', 0)} AS x, {moving(f'CAST(round((0.5 - ({pick(3, 63)}) / 62.0) * 20000) AS BIGINT)', 0)} AS y, {moving(z, 0)} AS z
FROM (SELECT user_id, event_id AS au, unnest(range({MOVING + 1})) AS i FROM events)"""


def q43_verify_streams(spark, sf_dir):
    """The whole conformance run over the users' streams; of every fifth the last byte, a checksum, is damaged."""
    from tessera import api

    streams = materialise(_event_streams(spark, sf_dir), "streams")
    size = F.octet_length("data")
    last = F.conv(F.hex(F.substring(F.col("data"), size, F.lit(1))), 16, 10).cast("int")
    damaged = F.concat(F.substring(F.col("data"), F.lit(1), size - 1), F.unhex(F.lpad(F.hex(last.bitwiseXOR(F.lit(255))), 2, "0")))
    run = api.verify(streams.withColumn("data", F.when(F.col("stream_id").cast("long") % 5 == 0, damaged).otherwise(F.col("data"))))
    return run.summary.select("stream_id", "syntax", "frequency", "substreams", "access_units", "channels", "duration", "bytes", "worst", "verdict", "exit_code")


#: The encoder writes no serial output times; the rule on them speaks with the sixth restart.
Q43 = f"""WITH {_LEVELS},
n AS (SELECT stream_id, count(*) AS n, CAST(stream_id AS BIGINT) % 5 = 0 AS bad FROM levels GROUP BY stream_id),
t AS (SELECT *, n * 40 * 1000 // 48000 AS ms FROM n)
SELECT stream_id, 'FBA' AS syntax, 48000 AS frequency, 1 AS substreams, n AS access_units, 2 AS channels,
printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS duration, n * {MINOR_BYTES} + (n + {EVERY - 1}) // {EVERY} * {MAJOR_BYTES - MINOR_BYTES} AS bytes,
CASE WHEN bad THEN 'fatal' WHEN n > {5 * EVERY} THEN 'warning' END AS worst, CASE WHEN bad THEN 'unparseable' ELSE 'conformant' END AS verdict, CASE WHEN bad THEN 4 ELSE 0 END AS exit_code FROM t"""


def q44_decode_streams(spark, sf_dir):
    """The samples of the users' streams, decoded and added up unit by unit, with the number of intervals whose check byte agrees."""
    import numpy as np
    import pyarrow as pa

    from tessera import api

    streams = materialise(_event_streams(spark, sf_dir), "streams")
    samples, checks = api.decode_checked(streams, [0])

    def run(batches):
        for batch in batches:
            data = batch.column("pcm").to_pylist()
            ends = np.cumsum([0] + [len(x) // 6 for x in data])
            four = np.zeros((2 * ends[-1], 4), np.uint8)
            four[:, 1:] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 3)
            value = (four.view("<i4") >> 8).reshape(-1, 2).astype(np.int64)
            sums = np.diff(np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(value, axis=0)])[ends], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("stream_id", "au", "samples", "channels")] + [pa.array(sums[:, k]) for k in (0, 1)], ["stream_id", "au", "samples", "channels", "left", "right"])

    added = samples.select("stream_id", "au", "samples", "channels", "pcm").mapInArrow(run, "stream_id string, au long, samples int, channels int, left long, right long")
    good = checks.groupBy("stream_id").agg(F.count_if(F.col("calculated") == F.col("stated")).alias("lossless"))
    return added.join(good, "stream_id", "left").withColumn("lossless", F.coalesce("lossless", F.lit(0).cast("long")))


Q44 = f"""WITH {_LEVELS}
SELECT stream_id, au, 40 AS samples, 2 AS channels, 40 * level + 780 AS "left", 1560 - 40 * level AS "right", (count(*) OVER (PARTITION BY stream_id) - 1) // {EVERY} AS lossless FROM levels"""


QUERIES = {
    "q22_lossless_check": (q22_lossless_check, Q22),
    "q27_bed_conform": (q27_bed_conform, Q27),
    "q28_matrix_remap": (q28_matrix_remap, _q28()),
    "q29_fir_predictor": (q29_fir_predictor, Q29),
    "q30_iir_predictor": (q30_iir_predictor, Q30),
    "q40_huffman_decode": (q40_huffman_decode, Q40),
    "q41_frame_stream": (q41_frame_stream, Q41),
    "q42_object_metadata": (q42_object_metadata, _q42()),
    "q43_verify_streams": (q43_verify_streams, Q43),
    "q44_decode_streams": (q44_decode_streams, Q44),
}
