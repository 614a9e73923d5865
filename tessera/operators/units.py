"""Frames to parsed units and to samples, one restart interval at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.kernels import syntax
from tessera.storage import spread


def _by_interval(frames: DataFrame, schema: StructType, rows) -> DataFrame:
    """Runs ``rows(unit rows of an interval)`` over each interval, which stays in one task in order."""
    import pyarrow as pa

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, interval, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["stream_id"], row["segment"]) != key:
                    if interval:
                        out.extend(rows(interval))
                    key, interval = (row["stream_id"], row["segment"]), []
                interval.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if interval and (out := list(rows(interval))):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    chosen = frames.select("stream_id", "segment", "au", "au_offset", "is_major", "data")
    return spread(chosen, "stream_id", "segment").sortWithinPartitions("stream_id", "segment", "au").mapInArrow(run, schema)


def _unit_row(row: dict, unit: dict) -> dict:
    config = unit["major"]
    if config is not None:
        meaning = config["meaning"]
        extension = meaning.get("extra") or {}
        config = config | {"start_gain": meaning.get("start_gain"), "heavy_start_gain": meaning.get("heavy_start_gain"), "extension_words": extension.get("length"), "content": extension.get("content")}
    extra = unit["extra"]
    if extra is not None:
        protection = extra["protection"] or {}
        payloads = [{"id": p["id"], "sample_offset": p["config"].get("sample_offset"), "data": p["data"]} for p in extra["payloads"]]
        extra = extra | {"payloads": payloads, "protection_at": protection.get("at"), "primary": protection.get("primary"), "secondary": protection.get("secondary")}
    notes = [{"rule": rule, "severity": severity, "bit": at} for rule, severity, at in unit["notes"]]
    same = {k: row[k] for k in ("stream_id", "au", "au_offset", "segment", "is_major")}
    return same | {k: unit.get(k) for k in ("length", "input_timing", "directory", "restarts", "segments", "stopped")} | {"config": config, "extra": extra, "notes": notes}


def units(frames: DataFrame) -> DataFrame:
    """Each unit parsed; after one that ended early the rest of its interval is skipped, as nothing there can be trusted."""

    def rows(interval: list[dict]) -> Iterator[dict]:
        reader = syntax.Interval()
        for row in interval:
            unit = reader.unit(row["data"])
            yield _unit_row(row, unit)
            if unit["stopped"]:
                return

    return _by_interval(frames, StructType.fromDDL(schemas.UNITS), rows)


def pcm(frames: DataFrame, presentations: list[int], dither_table: list[int] | None = None) -> DataFrame:
    """Samples of each unit and presentation, 24-bit little-endian, interleaved; copies and absent presentations resolve to what carries them."""

    def rows(interval: list[dict]) -> Iterator[dict]:
        return (sample for _, samples in _decoded(interval, presentations, dither_table) for sample in samples)

    return _by_interval(frames, StructType.fromDDL(schemas.PCM), rows)


def pcm_and_headers(frames: DataFrame, presentations: list[int], dither_table: list[int] | None = None) -> DataFrame:
    """Rows of :func:`pcm`, and, where ``is_unit``, the columns restarts and stopped of :func:`units`, in one reading.

    A row may be both; ``presentation`` is null in one that is no sample's.  An
    interval in which decoding stops is parsed again, as parsing may go on.
    """

    def rows(interval: list[dict]) -> Iterator[dict]:
        ended, none = False, {"is_unit": False, "restarts": None, "stopped": None}
        found = []
        for unit, samples in _decoded(interval, presentations, dither_table):
            ended = ended or bool(unit["stopped"])
            header = {"stream_id": interval[0]["stream_id"], "segment": interval[0]["segment"], "is_unit": True, "restarts": unit["restarts"], "stopped": unit["stopped"]}
            found.append((header, list(samples)))
        if not ended:
            for header, samples in found:
                for sample in samples or [{}]:
                    yield sample | header
                    header = none
            return
        yield from (sample | none for _, samples in found for sample in samples)
        reader = syntax.Interval()
        for row in interval:
            unit = reader.unit(row["data"])
            yield {"stream_id": row["stream_id"], "segment": row["segment"], "is_unit": True, "restarts": unit["restarts"], "stopped": unit["stopped"]}
            if unit["stopped"]:
                return

    pcm_fields = StructType.fromDDL(schemas.PCM).fields
    more = [f for f in StructType.fromDDL(schemas.HEADERS).fields if f.name not in ("stream_id", "segment")]
    return _by_interval(frames, StructType([*pcm_fields, *more]), rows)


def _decoded(interval: list[dict], presentations: list[int], dither_table: list[int] | None) -> Iterator[tuple[dict, Iterator[dict]]]:
    """Each unit of an interval and its samples, up to one that ends early."""
    reader = syntax.Interval(presentations, dither_table)
    for row in interval:
        unit = reader.unit(row["data"])
        if unit["stopped"]:
            yield unit, iter(())
            return
        yield unit, _samples(row, unit, reader)


def _samples(row: dict, unit: dict, reader: syntax.Interval) -> Iterator[dict]:
    restarted = next((r["output_timing"] for r in unit["restarts"] if r["block"] == 0), None)
    for presentation, samples in sorted(unit["pcm"].items()):
        data = (np.array(samples, np.int64).reshape(-1) & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        substream = reader.substreams[presentation]
        yield {k: row[k] for k in ("stream_id", "segment", "au")} | {"presentation": presentation, "samples": len(samples), "channels": substream.max_matrix_chan + 1, "pcm": data, "digest": substream.digest, "width": substream.width, "output_timing": restarted}
