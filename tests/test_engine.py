"""Kernels, framing, parsing, decoding, rules, metadata, sinks and streaming."""

from __future__ import annotations

import hashlib
import hmac
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import bits as bit_columns
from tessera.functions import streams as S
from tessera.kernels import bits as B
from tessera.kernels import framing, huffman, objects, syntax, synth
from tessera.operators import conformance, frames, units
from tessera.operators import objects as object_ops
from tessera.sinks import audio, containers, events

# Two raw streams of known content.
TWO_UNITS = bytes.fromhex(
    "01100001002300450016001900118000f02affacf8726fba00008001b752000000008080101403803f1fe307e3005298b01803f0f1ea0000011000000209528000000002b44401e8c44088d1fe91006303e91833862068ffcb6edb6db6db6db7800064f9500a0000700791404800113ddbeff3ded000d504"
)
ONE_UNIT = bytes.fromhex(
    "a04bf348f8726fbb2f0f0001b7524000000080c21005560300008080001b6538303af1ea0000011000000212b580000000021644512f80430900144b00003ffedaa131b6c6ea0ccb6dd7f81b493e1cf9c9b948a8b1a4a70af57309bac98f1201e9522019e3c2ff7a01a3ff020cf6017fb6806c7fe00472b6f3227dbfa70efbbbeba53751d37cde3bf4cf99a54c7d7144670b8400e366"
)


def decoded(data, wanted=(0,)):
    found, scanner = framing.scan(data)
    reader, pcm, notes = None, [], []
    for n, _, _, major, body in found:
        if major:
            reader = syntax.Interval(list(wanted))
        unit = reader.unit(body)
        pcm += unit["pcm"].get(wanted[0], [])
        notes += [(n, rule) for rule, _, _ in unit["notes"]]
        if unit["stopped"]:
            break
    return pcm, notes, scanner


@given(st.lists(st.tuples(st.integers(1, 33), st.integers(0, 1 << 33)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_reader_reads_what_the_writer_wrote(fields):
    w = B.BitWriter()
    for width, value in fields:
        w.put(value, width)
    r = B.BitReader(w.bytes())
    for width, value in fields:
        assert r.get(width) == value & ((1 << width) - 1)
    with pytest.raises(B.EndOfData):
        r.get(8)


def test_huffman_codes_are_complete_prefix_codes():
    for code, (low, high) in {1: (-7, 10), 2: (-7, 8), 3: (-7, 7)}.items():
        table = huffman.TABLES[code]
        assert {v for v, _ in table} == set(range(low, high + 1))
        for bits, (value, length) in enumerate(table):
            block = bits >> (9 - length) << (9 - length)
            assert all(table[block + k] == (value, length) for k in range(1 << (9 - length)))


def test_known_streams_parse_without_a_note():
    pcm, notes, scanner = decoded(TWO_UNITS)
    assert (len(pcm), notes, scanner.errors, len(scanner.left)) == (80, [], 0, 0)
    stamp = scanner.smpte
    assert (stamp.hours, stamp.minutes, stamp.seconds, stamp.frames, stamp.samples, framing.RATES[stamp.rate_code], stamp.drop_frame) == (1, 23, 45, 16, 0x19, "29.97", True)
    unit = syntax.Interval([0]).unit(ONE_UNIT)
    assert unit["stopped"] is None and unit["notes"] == [] and len(unit["pcm"][0]) == 40
    assert (unit["input_timing"], unit["major"]["peak"], unit["directory"][0]["end_ptr"], unit["restarts"][0]["max_lsbs"]) == (62280, 194, 58, 18)
    again = TWO_UNITS + b"\xff" * 4
    found, _ = framing.scan(again * 2)
    assert [len(u[4]) for u in found] == [84, 20, 84, 20]


MUTATIONS = [
    (52, 162, "substream.invalid_termination_word"),
    (71, 36, "block.huffman_ninth_bit_missing"),
    (16 + 24, 0x13, "sync.major_sync_crc_mismatch"),
    (16 + 60, None, "substream.parity_mismatch"),
    (16 + 13, 0x53, "sync.invalid_major_sync_signature"),
    (16 + 35, 0x08, "access_unit.nibble_parity"),
]


@pytest.mark.parametrize(("place", "value", "rule"), MUTATIONS)
def test_a_changed_byte_fires_its_rule(place, value, rule):
    data = bytearray(TWO_UNITS)
    data[place] = data[place] ^ 0xFF if value is None else value
    unit = syntax.Interval().unit(bytes(data[16:100]))
    rules = {r for r, _, _ in unit["notes"]}
    if rule == "sync.invalid_major_sync_signature":
        assert rules >= {rule}  # and the checksum fails too
    else:
        assert rule in rules


@pytest.mark.parametrize("shape", [{}, {"channels": 6, "coeffs": (300, -100)}, {"sync": syntax.FBB, "rate_code": 8}, {"rate_code": 2, "coeffs": (256,)}, {"units": 9, "every": 3, "seed": 7}])
def test_streams_decode_to_their_samples(shape):
    data, pcm = synth.stream(**shape)
    got, notes, scanner = decoded(b"\x01\x02" + data)
    assert got == pcm and notes == [] and scanner.errors == 0


@given(st.integers(1, 400), st.integers(0, 50))
@settings(max_examples=25, deadline=None)
def test_chunks_of_any_size_give_the_same_units(size, junk):
    data = b"\xf8" * junk + synth.stream(units=10, every=4)[0]
    whole, _ = framing.scan(data)
    scanner, parts = framing.Scanner(), []
    for at in range(0, len(data), size):
        parts += scanner.push(data[at : at + size])
    assert parts + scanner.finish() == whole and len(whole) == 10


def test_scanning_goes_on_after_damage():
    data = bytearray(synth.stream(units=24, every=8)[0])
    found, _ = framing.scan(bytes(data))
    data[found[10][1] + 1] ^= 0x50
    after, scanner = framing.scan(bytes(data))
    assert scanner.errors >= 1
    assert [u[4] for u in after] == [u[4] for u in found[:10]] + [u[4] for u in found[16:]]


@pytest.fixture(scope="module")
def streams(spark):
    rows = [
        ("clean", synth.stream(units=24)[0]),
        ("six", synth.stream(units=24, channels=6, coeffs=(300, -100), every=8, seed=5)[0]),
        ("short", synth.stream(units=24, every=4, seed=6)[0]),
        ("fbb", synth.stream(sync=syntax.FBB, rate_code=8, first_timing=65_000)[0]),
        ("slow", synth.stream(units=24, peak=100)[0]),
        ("trailing", synth.stream(units=24)[0] + b"xx"),
        ("nothing", b""),
    ]
    broken = bytearray(rows[0][1])
    broken[framing.scan(rows[0][1])[0][12][1] + 40] ^= 1
    rows.append(("broken", bytes(broken)))
    return spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "stream_id string, data binary")


def test_verify_finds_what_is_there(spark, streams):
    run = api.verify(streams)
    tally = {(r.stream_id, r.rule): r for r in run.tally.collect()}
    assert not [k for k in tally if k[0] in ("clean", "six", "fbb", "trailing")]
    assert tally["short", "access_unit.restart_gap_invalid"]["count"] == 5
    assert tally["slow", "access_unit.data_rate_exceeded"]["shown"] == 10 < tally["slow", "access_unit.data_rate_exceeded"]["count"]
    assert tally["broken", "substream.parity_mismatch"].worst == "fatal" and tally["broken", "substream.parity_mismatch"].first_au == 12
    verdicts = {r.stream_id: (r.verdict, r.exit_code) for r in run.summary.collect()}
    assert verdicts == {"clean": ("conformant", 0), "six": ("conformant", 0), "short": ("conformant", 0), "fbb": ("conformant", 0), "slow": ("conformant", 0), "trailing": ("unparseable", 4), "nothing": ("unparseable", 4), "broken": ("unparseable", 4)}
    lines = [r.line for r in run.json_lines().collect()]
    assert sum('"type":"summary"' in x for x in lines) == 8 and any('"type":"suppressed"' in x for x in lines)
    strict = {r.stream_id: r.verdict for r in api.verify(streams, fail_on="warning").summary.collect()}
    assert strict["short"] == "non_conformant"


def test_tables_do_not_depend_on_partitioning(spark, streams):
    def rows(n):
        parsed = units.units(frames.frames(streams.repartition(n)))
        return sorted(map(repr, conformance.diagnostics(parsed).collect()))

    assert rows(1) == rows(7)


def test_interval_by_interval_decoding_equals_the_stream(spark, streams):
    samples = api.decode(streams.where("stream_id = 'six'"), [0, 1]).orderBy("presentation", "au").collect()
    data = b"".join(bytes(r.pcm) for r in samples)
    pcm = synth.stream(units=24, channels=6, coeffs=(300, -100), every=8, seed=5)[1]
    assert data == b"".join((v & 0xFFFFFF).to_bytes(3, "little") for row in pcm for v in row)
    assert {r.presentation for r in samples} == {0}  # 1 is a copy of 0
    checks = conformance.lossless_checks(api.decode(streams, [0]), units.units(frames.frames(streams))).collect()
    assert len(checks) > 8 and all(r.calculated == r.stated for r in checks)


def test_info(spark, streams):
    rows = {r.stream_id: r for r in api.info(streams).collect()}
    assert (rows["fbb"].syntax, rows["fbb"].frequency, rows["six"].channels, rows["clean"].samples, rows["clean"].duration) == ("FBB", 44_100, 6, 960, "00:00:00.020")
    assert (rows["clean"].presentation_0, rows["clean"].presentation_1, rows["clean"].presentation_3) == ("Independent", "CopyOf(0)", "Invalid")
    assert rows["trailing"].trailing_bytes == 2 and rows["nothing"].access_units == 0


def test_presentation_selection():
    assert [api.parse_presentations(t) for t in ("0-3", "2,0", "all", "max", "1")] == [[0, 1, 2, 3], [0, 2], [0, 1, 2, 3], [3], [1]]
    with pytest.raises(ValueError):
        api.parse_presentations("4")
    assert syntax.effective_presentations([1, 1, 1, 0], [0, 1, 2, 3]) == [0]
    assert syntax.effective_presentations([1, 3, 0, 0], [0, 3]) == [0, 1]


def test_masks_and_types(spark):
    rows = [(0b11001100, 1, False), (0b01011000, 0, False), (0x14, 0, False), (0x0D, 0, True), (0x05, 0, True)]
    frame = spark.createDataFrame(rows, "i int, e int, fbb boolean").withColumn("m", S.presentation_masks(F.col("i"), F.col("e"), F.col("fbb")))
    out = frame.select("m", *[S.presentation_type(F.col("m"), i).alias(f"t{i}") for i in range(4)]).collect()
    assert [list(r.m) for r in out] == [[1, 3, 4, 12], [1, 2, 5, 0], [1, 1, 1, 0], [1, 3, 0, 0], [1, 0, 0, 0]]
    assert [list(r.m) for r in out] == [syntax.presentation_masks(syntax.FBB if f else syntax.FBA, i, e) for i, e, f in rows]
    assert [r.t0 for r in out] == ["DownmixOf(1)", "DownmixOf(2)", "Independent", "DownmixOf(1)", "Independent"]
    assert [r.t3 for r in out] == ["Independent", "Invalid", "Invalid", "Invalid", "Invalid"]


def test_column_checksums_equal_the_kernels(spark):
    data = [bytes(range(k, k + 3 * k)) for k in range(1, 40)] + [b""]
    frame = spark.createDataFrame([(bytearray(d),) for d in data], "d binary")
    out = frame.select(bit_columns.parity(F.col("d")), bit_columns.crc8(F.col("d"), *B.SEGMENT_CRC), bit_columns.crc16(F.col("d"), *B.SYNC_CRC), bit_columns.hmac_sha256(b"key", F.col("d"))).collect()
    for d, row in zip(data, out, strict=True):
        assert tuple(row) == (B.parity(d), B.crc8(d, B.SEGMENT_CRC), B.crc16(d), hmac.new(b"key", d, hashlib.sha256).hexdigest())


def test_object_metadata(spark):
    payload = objects.parse(synth.object_payload(4, 3))
    assert payload["count"] == 5 and payload["programme"]["beds"] == [[3]] and payload["programme"]["dynamic"] == 4
    made = objects.events(payload, 100)
    assert [e["id"] for e in made] == [3, 10, 11, 12, 13] and made[0]["binaural_render_mode"] == "off"
    assert all(-1 <= v <= 1 for e in made[1:] for v in e["pos"])
    assert [objects.bed_id(i) for i in (0, 7, 8, 9, 10, 11, 12, 16)] == [0, 7, 130, 131, 8, 9, 132, 136]
    rows = [("s", 0, 0, synth.object_payload(3, 1)), ("s", 1, 40, synth.object_payload(3, 1)), ("s", 2, 80, synth.object_payload(3, 2)), ("s", 3, 120, b"\xff\xff"), ("t", 0, 0, synth.object_payload(1, 9))]
    frame = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "stream_id string, au long, sample long, data binary")
    found = object_ops.objects(frame).collect()
    assert len(found) == 4 * 3 + 1 + 2 and sum(r.error is not None for r in found) == 1
    changes = object_ops.event_changes(object_ops.events(frame)).collect()
    assert {(r.stream_id, r.au) for r in changes} == {("s", 0), ("s", 2), ("t", 0)}
    assert all(r.active is None for r in changes if r.au == 2)
    text = [r.line for r in events.yaml_events(object_ops.event_changes(object_ops.events(frame)), 48_000).where("stream_id = 't'").collect()]
    assert text[:4] == ["sampleRate: 48000", "events:", "  - ID: 3", "    samplePos: 0"]


def test_yaml_scalars():
    assert [events.scalar(v) for v in (True, 1.0, 0.5, [0.5, -1.0], "-inf", "no back", "a: b", "it's", "")] == ["true", "1", "0.5", "[0.5, -1]", "-inf", "no back", "'a: b'", "'it''s'", "''"]


def test_evolution_frames_and_their_protection(spark):
    key = b"secret key"
    sync = synth.major_sync(syntax.FBA, 0, 1, 0x14, flags=0x1000)
    body = synth.segment([[0, 0]] * 40, synth.restart_header(2, 200, 0), [], [[0] * 8, [0] * 8])
    extra = synth.evolution([(11, synth.object_payload(2, 4))], key=key)
    plain = synth.unit(0, sync, [body], True, extra)
    before = plain[: len(plain) - len(extra)]
    unit = synth.unit(0, sync, [body], True, synth.evolution([(11, synth.object_payload(2, 4))], before, key))
    parsed = syntax.Interval([0]).unit(unit)
    assert parsed["notes"] == [] and parsed["extra"]["payloads"][0]["id"] == objects.PAYLOAD_ID
    frame = frames.frames(spark.createDataFrame([("good", bytearray(unit)), ("bad", bytearray(plain[:-1] + plain[-1:]))], "stream_id string, data binary"))
    table = units.units(frame)
    assert {r.stream_id: r.status for r in object_ops.protection(frame, table, key).collect()}["good"] == "match"
    assert {r.status for r in object_ops.protection(frame, table, b"other").collect()} == {"mismatch"}
    assert object_ops.payloads(table).where("id = 11").count() == 2


def test_container_headers():
    w64 = containers.w64_header(2, 48_000, 600, ["L", "R"])
    assert w64[:4] == b"riff" and struct.unpack("<Q", w64[16:24])[0] == len(w64) + 600 and b"\xfe\xff" in w64
    plain = containers.w64_header(2, 48_000, 600, ["R", "L"])
    assert len(plain) == len(w64) - 24
    caf = containers.caf_header(6, 96_000, 1800, ["L", "R", "C", "LFE", "Ls", "Rs"])
    assert caf[:8] == b"caff\0\1\0\0" and struct.unpack(">d", caf[20:28])[0] == 96_000 and struct.pack(">I", 121 << 16 | 6) in caf
    assert caf[-12:] == struct.pack(">qI", 1804, 0)
    assert b"chan" not in containers.caf_header(2, 48_000, 6, ["L", "?"])
    assert containers.wave_mask(["L", "R", "C", "LFE", "Ls", "Rs"]) == 0x60F and containers.wave_mask(["L", "Ls", "C"]) is None
    assert containers.swapped(containers.swapped(b"abcdef")) == b"abcdef" and containers.swapped(b"abc") == b"cba"


@pytest.mark.parametrize("kind", audio.FORMATS)
def test_audio_files_hold_the_samples(spark, streams, tmp_path, kind):
    names = streams.where("stream_id in ('clean', 'six')")
    rates = spark.createDataFrame([("clean", 48_000, ["L", "R"]), ("six", 48_000, None)], "stream_id string, frequency int, labels array<string>")
    written = {r.stream_id: r for r in audio.write_audio(api.decode(names, [0]), rates, f"file://{tmp_path}", kind).collect()}
    for name, shape in (("clean", {"units": 24}), ("six", {"units": 24, "channels": 6, "coeffs": (300, -100), "every": 8, "seed": 5})):
        pcm = synth.stream(**shape)[1]
        order = "big" if kind == "caf" else "little"
        expected = b"".join((v & 0xFFFFFF).to_bytes(3, order) for row in pcm for v in row)
        data = (tmp_path / f"{name}.{kind}").read_bytes()
        assert data.endswith(expected) and len(data) == written[name].bytes and written[name].samples == len(pcm)


def test_streaming_frames_equal_the_batch(spark, streams, tmp_path):
    from tessera.streaming.framing import frames_stream

    chunks = streams.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length("data"), F.lit(1)) - 1) / 700).cast("int")), lambda i: F.substring(F.col("data"), i * 700 + 1, F.lit(700)))).alias("seq", "data"))
    chunks.where("seq < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(chunks.schema).parquet(f"{tmp_path}/in")

    def run():
        query = frames_stream(arriving).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    chunks.where("seq >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # the state carries the unread bytes over
    got = spark.read.parquet(f"{tmp_path}/out").where("stream_id <> 'broken'")
    batch = frames.frames(streams).drop("smpte").where("stream_id <> 'broken'")
    key = lambda d: sorted((r.stream_id, r.au, r.au_offset, bytes(r.data)) for r in d.collect())
    assert key(got) == key(batch)


def test_serial_timing_fields():
    from tessera.kernels import hires

    samples, bits, expected = 40, [], []
    at = 0
    for n in range(6):
        width = 16
        start = at + 5
        position = start * samples * 1000 + 12_345
        value, low = position >> 16 & 0xFFFF, position & 0xFFFF
        line = hires.serialise(value, width)[0 if n == 0 else 5 :]
        start = at + (5 if n == 0 else 0)
        for k, bit in enumerate(line):
            bits.append((at + k, bit, low))
        expected.append((start, value))
        at += len(line)
    found = list(hires.fields(bits))
    assert [(f["au"], f["value"]) for f in found] == expected
    steady = [{"au": a, "output_timing": (a * 40 + 500) & 0xFFFF, "value": (a * 40 + 500) >> 16} for a in (0, 2000, 4000, 9000)]
    assert list(hires.check(steady, 40)) == [{"au": 0, "start": 500}]
    steady[2]["value"] += 1
    assert {"au": 4000, "rule": "restart_header.invalid_hires_output_timing_sequence"} in list(hires.check(steady, 40))
    assert "fault" in list(hires.fields([(n, False, 0) for n in range(7)]))[0]
    assert [f for f in hires.fields([(n, bool(n & 1), 0) for n in range(50)])] == []


def _timed(n, start, latency, au=0, every=8, length=20, **more):
    rows = []
    for k in range(n):
        row = {"au": au + k, "input": (start + 40 * k) & 0xFFFF, "length": length, "samples": 40, "frequency": 48_000, "peak": 3000, "variable": True}
        if k % every == 0:
            row["output"] = (start + 40 * k + latency) & 0xFFFF
        rows.append(row | more)
    return rows


def test_splices():
    from tessera.kernels import splices

    plain = list(splices.follow(_timed(40, 65_000, 200)))
    assert all(r["valid"] is None and not r["rules"] and r["epoch"] == 0 for r in plain)
    assert [r["unwrapped"] for r in plain] == [65_000 + 40 * k for k in range(40)]
    same = list(splices.follow(_timed(16, 1000, 200) + _timed(16, 30_000, 200, au=16)))
    at = same[16]
    assert at["valid"] is True and at["epoch"] == 0 and not at["rules"] and at["unwrapped"] - same[15]["unwrapped"] == 40
    late = list(splices.follow(_timed(16, 1000, 200) + _timed(16, 30_000, 2000, au=16)))
    assert late[16]["failed"] == ["advance_step", "fifo_duration", "data_rate"] or "advance_step" in late[16]["failed"]
    assert late[16]["epoch"] == 1 and "restart_header.invalid_seamless_branch" in late[16]["rules"]
    far = list(splices.follow(_timed(16, 1000, 3590) + _timed(16, 30_000, 3610, au=16)))
    assert far[16]["failed"] == ["within_75ms"]
    strict = list(splices.follow(_timed(16, 1000, 200) + _timed(16, 30_000, 200, au=16), tolerant=False))
    assert "restart_header.invalid_output_timing" in strict[16]["rules"]


def test_spliced_streams_end_to_end(spark):
    a = synth.stream(units=16)[0]
    good, bad = a + synth.stream(units=16, seed=2, first_timing=30_000)[0], a + synth.stream(units=16, seed=2, first_timing=30_000, latency=2400)[0]
    frame = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad))], "stream_id string, data binary")
    run = api.verify(frame)
    rules = {(r.stream_id, r.rule) for r in run.diagnostics.collect()}
    assert ("bad", "restart_header.invalid_seamless_branch") in rules and ("good", "restart_header.invalid_seamless_branch") not in rules
    from tessera.operators import splices

    ready = conformance.latency(conformance.configured(units.units(frames.frames(frame))))
    found = {r.stream_id: r for r in splices.branches(splices.followed(ready), ready).collect()}
    assert found["good"].valid and not found["bad"].valid and found["good"].au == 16 and found["good"].sample == 640
    depths = conformance.buffer_depths(ready, splices.followed(ready)).where("stream_id = 'bad' and accumulator = 'whole' and au = 16").collect()
    assert depths[0].depth == depths[0].bytes  # a new epoch begins with an empty buffer


def test_framed_source(spark, tmp_path):
    from tessera.sources import framed

    data = {"a.bin": synth.stream(units=40)[0], "b.bin": b"junk" + synth.stream(units=9, seed=3)[0] + b"\0", "c.txt": b"no stream", "d.bin": b""}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    framed.register(spark)
    rows = spark.read.format("framed").option("suffix", ".bin").option("chunkBytes", 333).load(f"file://{tmp_path}").collect()
    for name in ("a.bin", "b.bin"):
        expected, _ = framing.scan(data[name])
        got = sorted((r.au, r.au_offset, r.segment, r.is_major, bytes(r.data)) for r in rows if r.stream_id.endswith(name))
        assert got == expected
    assert {r.stream_id[-5:] for r in rows} == {"a.bin", "b.bin"}
    # its frames go where whole streams go
    read = spark.read.format("framed").option("suffix", ".bin").load(f"file://{tmp_path}").where("stream_id like '%a.bin'")
    whole = api.load(spark, str(tmp_path), "a.bin")
    columns = ["syntax", "access_units", "frames", "bytes", "duration", "fifo_peaks", "by_rule", "verdict"]
    assert api.verify(read).summary.select(*columns).collect() == api.verify(whole).summary.select(*columns).collect()
    pcm = [b"".join(bytes(r.pcm) for r in api.decode(x, [0]).orderBy("au").collect()) for x in (read, whole)]
    assert pcm[0] == pcm[1] and api.info(read).head().access_units == 40


def test_master_document():
    from tessera.sinks import master

    payload = objects.parse(synth.object_payload(2, 3))
    text = list(master.lines(payload, "show"))
    assert text[1] == "presentations:" and "    fps: 24" in text and "    scBedConfiguration: [3]" in text and "      - ID: 10" in text and "      - ID: 11" in text
    assert text[text.index("      - channels:") + 1 :][:2] == ["          - channel: LFE", "            ID: 3"]
    payload["trim"] = {"warp": 1, "mode": 2, "bypass": None, "trims": [None] * 8 + [{"automatic": False, "disabled": False, "trim_centre": -3.0, "balance_top": 0.5}]}
    text = list(master.lines(payload, "show"))
    assert "    warpMode: warping" in text and "        ManySurroundsManyHeights:" in text and "            centerTrim: -3" in text


def test_dither_table_is_a_parameter(tmp_path):
    from tessera.kernels import dither

    (tmp_path / "table").write_text(", ".join(str(v - 128) for v in range(256)))
    assert dither.load(str(tmp_path / "table")) == list(range(-128, 128))
    (tmp_path / "short").write_text("1 2 3")
    with pytest.raises(ValueError):
        dither.load(str(tmp_path / "short"))
    places, seed = dither.indices(40, 1)
    assert len(places) == 64 and max(places) < 256 and dither.indices(64, 1) == (places, seed)


def test_replay_equals_the_closed_form_where_it_holds(spark):
    import random

    from tessera.kernels import buffers
    from tessera.operators import timing

    rng = random.Random(4)
    rows, expected = [], {}
    for stream in range(12):
        clock, first = rng.randrange(1000), None
        units_ = []
        for n in range(60):
            clock += rng.randrange(20, 60)
            first = clock + 400 if first is None else first
            units_.append((f"s{stream}", n, clock, rng.randrange(1, 500), first))
        rows += units_
        played = list(buffers.replay((c, f + (n + 1) * 40, (b,)) for _, n, c, b, f in units_))
        for (name, n, *_), (depths, dry) in zip(units_, played, strict=True):
            expected[name, n] = (depths[0], dry)
    frame = spark.createDataFrame(rows, "stream_id string, au long, unwrapped long, bytes long, first_output long")
    seen = 0
    for r in timing.depths(frame, 40).orderBy("stream_id", "au").collect():
        depth, dry = expected[r.stream_id, r.au]
        if any(expected[r.stream_id, k][1] is not None for k in range(r.au + 1)):
            continue  # after an underrun only the replay holds
        assert r.depth == depth and not r.underrun
        seen += 1
    assert seen > 300


def test_decoding_leaves_out_what_a_splice_repeats(spark):
    import json

    from tessera import report

    blocks = [[[100 * n + i, 7 * i - n] for i in range(40)] for n in range(20)]
    data = synth.encode(blocks[:13], every=1) + synth.encode(blocks[12:], every=1, first_timing=12 * 40)
    frame = spark.createDataFrame([("twice", bytearray(data)), ("once", bytearray(synth.encode(blocks, every=1)))], "stream_id string, data binary")
    every = api.decode(frame, [0], keep_repeated=True)
    assert {r.stream_id: r["count"] for r in every.groupBy("stream_id").count().collect()} == {"twice": 21, "once": 20}
    left = api.decode(frame, [0])
    pcm = {name: b"".join(bytes(r.pcm) for r in left.where(F.col("stream_id") == name).orderBy("au").collect()) for name in ("twice", "once")}
    assert pcm["twice"] == pcm["once"] and len(pcm["once"]) == 20 * 40 * 6
    run = api.verify(frame)
    lines = {r.stream_id: json.loads(r.line) for r in report.decode_json(api.decode_summary(left), verified=run.summary).collect()}
    assert (lines["twice"]["frames"], lines["twice"]["skippedFrames"], lines["twice"]["samples"], lines["twice"]["sampleRate"]) == (20, 1, 800, 48_000)
    assert lines["once"]["skippedFrames"] == 0 and lines["once"]["presentations"] == [{"index": 0, "format": "pcm", "channels": 2, "files": []}]


def test_summary_states_what_was_measured(spark):
    fbb = synth.stream(units=24, channels=2, sync=syntax.FBB)[0]
    spliced = synth.stream(units=16)[0] + synth.stream(units=16, seed=2, first_timing=30_000)[0]
    six = synth.stream(units=24, channels=6, rate_code=2, every=8, seed=5)[0]
    frame = spark.createDataFrame([("two", bytearray(TWO_UNITS)), ("fbb", bytearray(fbb)), ("spliced", bytearray(spliced)), ("six", bytearray(six))], "stream_id string, data binary")
    run = api.verify(frame, strict=True)
    rows = {r.stream_id: r for r in run.summary.collect()}
    two = rows["two"]
    assert list(two.fifo_peaks) == [104, 104, 104, 0, 104] and list(two.fifo_caps) == [30_000, 90_000, 120_000, None, 120_000]
    assert [a + b for a, b in zip(two.fifo_stream_bytes, two.fifo_overhead_bytes, strict=True)] == list(two.fifo_peaks)
    # end pointers of 24 and 7 words
    assert two.fifo_stream_bytes[4] == 62 and two.substream_properties[0].fifo_peak == 62
    assert (two.substream_properties[0].restart_sync_word, two.substream_properties[0].min_chan, two.substream_properties[0].max_chan, two.substream_properties[0].fifo_cap) == ("31EA", 0, 1, 30_000)
    assert (two.max_access_unit_size, two.average_access_unit_size, two.bluray, two.hd_dvd_video, two.dvd_audio) == (84, 52.0, True, True, False)
    assert (rows["fbb"].dvd_audio, rows["fbb"].dvd_audio_needs_decode, rows["fbb"].bluray) == (True, True, False)
    assert (rows["six"].bluray, rows["six"].hd_dvd_video) == (True, False)  # six channels at 192 kHz
    assert [(b.au, b.valid) for b in rows["spliced"].branches] == [(16, True)] and rows["spliced"].invalid_branches == 0
    for r in rows.values():
        assert r.diagnostics == sum((r.by_rule or {}).values()) == r.info + r.warning + r.error + r.fatal
        assert r.verdict == ("conformant" if not r.diagnostics else "non_conformant")
    from tessera import report

    text = report.report_text(two, run.tally.collect())
    for line in ("Cumulative buffers", "Substreams", "Disc validity", "2-channel decoder", "no 16-channel presentation", "BluRay"):
        assert line in text
    assert "Branch points" not in text and "Branch points" in report.report_text(rows["spliced"], [])


def test_parts_of_buffers_are_followed_beside_them():
    from tessera.kernels import buffers

    out = list(buffers.replay([(0, 10, (100, 60, 9)), (50, 20, (70, 50, 9)), (60, 100, (5, 5, 9))], 2))
    assert [d for d, _ in out] == [(100, 60, 9), (70, 50, 9), (75, 55, 18)] and [x for _, x in out] == [None, 0, None]


def test_replay_after_an_underrun():
    from tessera.kernels import buffers

    out = list(buffers.replay([(0, 10, (100,)), (50, 20, (70,)), (60, 100, (5,))]))
    assert out == [((100,), None), ((70,), 0), ((75,), None)]  # the second unit's record left before its bytes came


def test_reports(spark, streams, tmp_path):
    from tessera import report

    run = api.verify(streams.where("stream_id in ('short', 'nothing')"))
    tally, rows = run.tally.collect(), {r.stream_id: r for r in run.summary.collect()}
    text = report.report_text(rows["short"], tally)
    assert "restart_gap_invalid" in text and "5 x warning, units 4 to 20" in text and "conformant" in text and "Measurements" in text
    assert "no major sync found" in report.report_text(rows["nothing"], tally)
    info = {r.stream_id: r for r in api.info(streams).collect()}
    assert "48000 Hz" in report.stream_text(info["clean"]) and "CopyOf(0)" in report.stream_text(info["clean"])
    line = report.decode_json(api.decode_summary(api.decode(streams.where("stream_id = 'six'"), [0]))).collect()[0].line
    assert line == '{"version":"1","input":"six","frames":24,"skippedFrames":null,"branches":null,"invalidBranches":null,"evoChecked":null,"evoFailed":null,"samples":960,"sampleRate":null,"presentations":[{"index":0,"format":"pcm","channels":6,"files":[]}]}'
    (tmp_path / "key").write_bytes(b"abc")
    assert report.parse_key("616263") == report.parse_key(f"@{tmp_path}/key") == b"abc"
    with pytest.raises(ValueError):
        report.parse_key("00" * 65)
    order = report.bed_conformed(["L", "R", "LFE"], ["L", "R", "C", "LFE"])
    assert order == [0, 1, None, 2] and report.conform_bed(b"aaabbbccc", 3, order) == b"aaabbb\0\0\0ccc"


def test_rates_and_output_segments(spark):
    from tessera import report

    data = synth.stream(units=16)[0] + synth.stream(units=8, channels=2, rate_code=1, first_timing=640)[0]
    frame = spark.createDataFrame([("s", bytearray(data))], "stream_id string, data binary")
    parsed = units.units(frames.frames(frame))
    ready = conformance.configured(parsed)
    rate = report.max_data_rate(ready).collect()[0]
    lengths = [r.length for r in parsed.orderBy("au").collect()]
    expected = max(-(-48_000 * 16 * lengths[n] // 40) for n in range(15))
    assert rate.max_data_rate >= expected
    out = report.output_segments(api.decode(frame, [0]), parsed).select("au", "output_segment").orderBy("au").collect()
    assert [r.output_segment for r in out] == [0] * 16 + [16] * 8


def test_more_rules(spark):
    fixed = synth.stream(units=16)[0]
    head = synth.major_sync(syntax.FBA, 0, 1, 0x14, 3000, variable=False)
    found, _ = framing.scan(fixed)
    rebuilt = b"".join(d[:4] + head + d[4 + len(head) :] if m else d for _, _, _, m, d in found)
    frame = spark.createDataFrame([("fixed", bytearray(rebuilt))], "stream_id string, data binary")
    rules = {r.rule for r in api.verify(frame).tally.collect()}
    assert "access_unit.fixed_rate_mismatch" in rules
    spliced = synth.stream(units=16, peak=100)[0] + synth.stream(units=16, seed=2, first_timing=30_000)[0]
    quiet = api.verify(spark.createDataFrame([("s", bytearray(spliced))], "stream_id string, data binary")).tally.collect()
    assert {r.rule: r["count"] for r in quiet}["access_unit.data_rate_exceeded"] == 14  # silent at the major syncs 8 and 16


def test_decode_diagnostics(spark):
    good, pcm = synth.stream(units=24)
    found, _ = framing.scan(good)
    # a second interval whose header states another check byte, with its checksum repaired
    body = bytearray(found[8][4])
    history = [[0] * 8, [0] * 8]
    rows = pcm[8 * 40 : 9 * 40]
    header = synth.restart_header(2, (8 * 40 + 200) & 0xFFFF, 1 + syntax.folded(synth.digest_of(pcm[: 8 * 40])) & 0xFF)
    body = synth.unit(8 * 40, synth.major_sync(syntax.FBA, 0, 1, 0x14), [synth.segment(rows, header, [], history)], True)
    data = b"".join(body if n == 8 else d for n, _, _, _, d in found)
    frame = spark.createDataFrame([("wrong", bytearray(data)), ("good", bytearray(good))], "stream_id string, data binary")
    out = conformance.decode_diagnostics(api.decode(frame, [0]), units.units(frames.frames(frame))).collect()
    assert [(r.stream_id, r.au, r.rule) for r in out] == [("wrong", 8, "restart_header.lossless_check_mismatch")]


def test_start_up_gains(spark):
    rows = [("s", 0, 0, [(5,)], None, 10, 0), ("s", 4, 0, [(None,)], None, 2, 0), ("s", 8, 0, [(None,)], None, 1, 0)]
    config = "struct<start_gain:int,heavy_start_gain:int,substreams:int>"
    schema = f"stream_id string, au long, au_offset long, directory array<struct<drc_gain:int>>, restarts array<struct<substream:int,heavy_gain:int>>, config {config}"
    frame = spark.createDataFrame([(a, b, c, d, e, (f, g, 1)) for a, b, c, d, e, f, g in rows], schema)
    out = conformance.start_up_rules(frame).collect()
    assert [(r.au, r.rule) for r in out] == [(4, "channel.drc_start_up_gain_too_large")]
