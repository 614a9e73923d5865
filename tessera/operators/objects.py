"""Object metadata of parsed units: payloads, objects, events and what changes between them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.kernels import bits as B
from tessera.kernels import objects as kernel

OBJECTS = "stream_id string, au long, object_idx int, block_idx int, active boolean, in_bed boolean, gain int, priority double, pos array<double>, size array<double>, distance double, zones int, elevation boolean, snap boolean, error string"
EVENTS = (
    "stream_id string, au long, id int, sample_pos long, active boolean, pos array<double>, snap boolean, elevation boolean, zones string, size double, importance double, gain string, ramp_length int, "
    "trim_bypass boolean, dialog int, music int, screen_factor double, depth_factor double, head_track_mode string, binaural_render_mode string, restates boolean, error string"
)
#: Payloads read, and rows handed on, at once.
SLICE, FLUSHED = 500, 2_000
#: Event fields that are written only when they change.
CHANGING = ("active", "pos", "snap", "elevation", "zones", "size", "importance", "gain", "ramp_length", "trim_bypass", "dialog", "music", "screen_factor", "depth_factor", "head_track_mode", "binaural_render_mode")


def payloads(units: DataFrame) -> DataFrame:
    """(stream_id, au, segment, id, sample_offset, data) of all metadata payloads."""
    return units.select("stream_id", "au", "segment", F.explode("extra.payloads").alias("p")).select("stream_id", "au", "segment", "p.id", "p.sample_offset", "p.data")


def _each(metadata: DataFrame, schema: str, rows) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # what is held is a slice of payloads and the rows to be handed on, whatever a batch and its payloads hold
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                for row in batch.slice(low, SLICE).to_pylist():
                    try:
                        yield from rows(row, kernel.parse(row["data"] or b""))
                    except (kernel.Unsupported, B.EndOfData, IndexError) as problem:
                        yield {"stream_id": row["stream_id"], "au": row["au"], "error": str(problem)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = parsed(batches)
        while part := list(itertools.islice(found, FLUSHED)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in part], f.type) for f in arrow], schema=arrow)

    return metadata.mapInArrow(run, schema)


def objects(metadata: DataFrame) -> DataFrame:
    """One row for each object and block of the object payloads (stream_id, au, data); a payload that can't be read gives one row with its error."""

    def rows(row: dict, payload: dict) -> Iterator[dict]:
        places = kernel.positions(payload)
        for i, blocks in enumerate(payload["object"]["objects"] if payload["object"] else []):
            for k, block in enumerate(blocks):
                distance = block["distance"]
                yield {"stream_id": row["stream_id"], "au": row["au"], "object_idx": i, "block_idx": k, "pos": places[i][k], "distance": math.inf if distance == math.inf else distance} | {n: block[n] for n in ("active", "in_bed", "gain", "priority", "size", "zones", "elevation", "snap")}

    return _each(metadata.select("stream_id", "au", "data"), OBJECTS, rows)


def events(metadata: DataFrame) -> DataFrame:
    """One event for each object of the payloads (stream_id, au, sample, data)."""

    def rows(row: dict, payload: dict) -> Iterator[dict]:
        for event in kernel.events(payload, row["sample"]):
            yield {"stream_id": row["stream_id"], "au": row["au"], "restates": kernel.restates(payload)} | event

    return _each(metadata.select("stream_id", "au", "sample", "data"), EVENTS, rows)


def event_changes(all_events: DataFrame) -> DataFrame:
    """Events with unchanged fields null; events without a change, or with only a ramp of 0 from a payload that restates, go."""
    order = Window.partitionBy("stream_id", "id").orderBy("au", "sample_pos")
    good = all_events.where("error is null")
    first = F.lag("au").over(order).isNull()
    fresh = {n: F.when(first | ~F.col(n).eqNullSafe(F.lag(n).over(order)), F.col(n)) for n in CHANGING}
    changed = good.withColumns({f"new_{n}": c for n, c in fresh.items()} | {"first": first})
    some, other = F.lit(False), F.lit(False)
    for n in CHANGING:
        some = some | F.col(f"new_{n}").isNotNull()
        if n != "ramp_length":
            other = other | F.col(f"new_{n}").isNotNull()
    only_ramp = ~other & (F.col("new_ramp_length") == 0) & F.col("restates")
    kept = changed.where(F.col("first") | (some & ~F.coalesce(only_ramp, F.lit(False))))
    return kept.select("stream_id", "au", "id", "sample_pos", *[F.col(f"new_{n}").alias(n) for n in CHANGING])


def protection(frames: DataFrame, units: DataFrame, key: bytes) -> DataFrame:
    """(stream_id, au, status): whether each unit's protection word is the keyed digest of the unit before its extra data and of the frame with the word blank."""
    import hashlib
    import hmac

    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    marked = units.where("extra.protection_at is not null").select("stream_id", "au", "extra")
    both = frames.select("stream_id", "au", "data").join(marked, ["stream_id", "au"])
    rows = both.select("stream_id", "au", "data", F.col("extra.offset").alias("offset"), F.col("extra.frame_bytes").alias("size"), F.col("extra.protection_at").alias("at"), F.col("extra.primary").alias("primary"), F.col("extra.secondary").alias("secondary"))

    def status(row: dict) -> str:
        word, start = row["primary"], row["offset"] + 4
        if not word or start + row["size"] > len(row["data"]):
            return "absent"
        frame = int.from_bytes(row["data"][start : start + row["size"]], "big")
        bits = 8 * (len(word) + len(row["secondary"] or b""))
        low = 8 * row["size"] - row["at"] - bits
        frame &= ~(((1 << bits) - 1) << low)
        message = row["data"][: row["offset"]] + frame.to_bytes(row["size"], "big")
        return "match" if hmac.new(key, message, hashlib.sha256).digest()[: len(word)] == word else "mismatch"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([status(r) for r in found], pa.string())], ["stream_id", "au", "status"])

    return rows.mapInArrow(run, "stream_id string, au long, status string")
