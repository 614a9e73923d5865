"""What must not grow with the streams: what the driver gathers, what a worker holds, what is done for a single sample."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest

from tessera.kernels import bits as B
from tessera.kernels import framing, huffman, synth, syntax
from tessera.operators import conformance, objects, splices
from tessera.operators import frames as framed
from tessera.operators import units as parsing
from tessera.plans import decoding


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(str(k), bytearray(synth.stream(units=20, seed=k)[0])) for k in range(3)], "stream_id string, data binary")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_conformance_run_gathers_no_units_on_the_driver(spark, some):
    units = parsing.units(framed.frames(some))
    shared = conformance.follow(units)
    tables = [conformance.diagnostics(units, followed=shared), conformance.buffer_depths(shared.units, shared.follow), splices.branches(shared.follow, shared.units)]
    for found in map(_plan, tables):
        assert "SortMergeJoin" in found
        assert "BroadcastExchange" not in found


def test_serial_timing_takes_no_task_of_its_own_for_a_stream(spark, some):
    shared = conformance.follow(parsing.units(framed.frames(some)), depths=False)
    assert "MapInArrow" in _plan(splices.serial_timing(shared.units))


def test_a_block_without_codes_is_read_at_once(monkeypatch):
    data, samples = synth.stream(units=16, channels=2, seed=4)
    reads, get = [], B.BitReader.get
    monkeypatch.setattr(B.BitReader, "get", lambda self, bits: reads.append(bits) or get(self, bits))
    out, reader = [], None
    for *_, major, unit in framing.scan(data)[0]:
        reader = syntax.Interval([0]) if major else reader
        out += reader.unit(unit)["pcm"][0]
    assert out == samples
    assert len(reads) < 40 * 16


def test_samples_out_of_range_stop_as_one_by_one():
    data = synth.encode([[[1 << 23, 5]] * 40], every=8)
    (*_, unit), = framing.scan(data)[0]
    assert syntax.Interval().unit(unit)["stopped"] is None  # wraps in 24 bits
    header = synth.segment([[3, 4]] * 40, synth.restart_header(2, 200, 0), [], [[0] * 8] * 2, width=16)
    unit = synth.unit(0, synth.major_sync(syntax.FBA, 0, 1, 0x14), [header], True)
    assert syntax.Interval([0]).unit(unit)["pcm"][0] == [[3, 4]] * 40


def test_seeds_leap_as_they_step():
    seed = 0x5A5A5A
    for steps in range(50):
        assert syntax.later_seed(0x5A5A5A, steps) == seed
        seed = syntax.next_seed(seed)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_streams_are_made_without_a_join_or_a_task_for_each(spark):
    plan = _plan(decoding._event_streams(spark, DATA))
    assert "MapInArrow" in plan
    assert not [word for word in ("Join", "FlatMapGroups", "Window") if word in plan]


class _Run:
    """Takes a table's place and gives the function that would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_objects_are_handed_on_in_small_batches(spark):
    payload = synth.object_payload(4, seed=1)
    rows = [{"stream_id": "s", "au": n, "data": payload if n else b"\xff"} for n in range(3000)]
    found = [batch.num_rows for batch in objects.objects(_Run())(iter([pa.RecordBatch.from_pylist(rows)]))]
    assert sum(found) == 2999 * 5 + 1
    assert max(found) <= objects.FLUSHED


def test_parts_are_decoded_by_all_tasks_and_words(spark, monkeypatch):
    reads = []
    monkeypatch.setattr(huffman, "read", lambda *a: reads.append(a))
    assert huffman.decode_all(bytes([0b11101001, 0b00000001]), 1) == [3, 6, -6]
    assert huffman.decode_all(bytes(9000), 3) == [-7] * 8000
    assert not reads


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
@pytest.mark.parametrize("name", ["q40_huffman_decode", "q42_object_metadata"])
def test_one_file_is_work_for_all_tasks(spark, name):
    frame = decoding.QUERIES[name][0](spark, DATA)
    assert "REPARTITION_BY_NUM" in _plan(frame)


def test_one_reading_gives_samples_and_headers(spark):
    loud = bytearray(synth.encode([[[(1 << 22) + 5, 5]] * 40] * 20, every=4, coeffs=(2040,)))  # predictions near the limits
    cut = bytearray(synth.stream(units=20, seed=9)[0])
    cut[700] ^= 1
    rows = [("loud", loud), ("cut", cut), ("good", bytearray(synth.stream(units=20, seed=8)[0]))]
    found = framed.frames(spark.createDataFrame(rows, "stream_id string, data binary"))
    both, samples, units = parsing.pcm_and_headers(found, [0, 3]).cache(), parsing.pcm(found, [0, 3]), parsing.units(found)
    names = ["stream_id", "segment", "restarts", "stopped"]
    assert sorted(map(repr, both.where("presentation is not null").select(samples.columns).collect())) == sorted(map(repr, samples.collect()))
    assert sorted(map(repr, both.where("is_unit").select(names).collect())) == sorted(map(repr, units.select(names).collect()))
    both.unpersist()
