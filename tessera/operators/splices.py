"""Splices and serial timing of whole streams, over narrow rows in order."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import hires, splices
from tessera.storage import side_by_side

FOLLOWED = "stream_id string, au long, epoch long, unwrapped long, advance int, failed array<string>, valid boolean, rules array<string>"
#: Rows handed on at once.
FLUSHED = 2_000
HIRES = "stream_id string, substream int, au long, start long, rule string"


def followed(units: DataFrame, tolerant: bool = True) -> DataFrame:
    """Each unit's epoch and clock, and splices; ``units`` as from conformance.configured.

    The state runs through a whole stream, so one task follows one stream, in
    memory of bounded size; a row is some fifty bytes, whatever the unit holds.
    """
    first = F.get(F.filter("restarts", lambda r: (r["substream"] == 0) & (r["block"] == 0)), F.lit(0))["output_timing"]
    now = F.col("now")
    rows = units.where("now is not null").select(
        "stream_id", "au", F.col("input_timing").alias("input"), "length", now["samples"].alias("samples"), now["frequency"].alias("frequency"), now["peak"].alias("peak"), now["variable_rate"].alias("variable"), first.alias("output")
    )

    names = [f.split()[0] for f in FOLLOWED.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string()))

    def run(batches):
        # row by row: what is held is the state and one batch, however long the stream
        every = (row for batch in batches for row in batch.to_pylist())
        found = ({"stream_id": stream} | r for stream, rows in itertools.groupby(every, lambda r: r["stream_id"]) for r in splices.follow(rows, tolerant))
        while part := list(itertools.islice(found, FLUSHED)):
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], k) for n, k in zip(names, kinds, strict=True)], names)

    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "au").mapInArrow(run, FOLLOWED)


def branches(follow: DataFrame, units: DataFrame) -> DataFrame:
    """(stream_id, au, byte_offset, sample, advance, failed, valid): one row for each splice."""
    where = units.select("stream_id", "au", F.col("au_offset").alias("byte_offset"), F.col("now.samples").alias("samples"))
    return follow.where("valid is not null").join(side_by_side(where), ["stream_id", "au"]).select("stream_id", "au", "byte_offset", (F.col("au") * F.col("samples")).alias("sample"), "advance", "failed", "valid")


def serial_timing(units: DataFrame) -> DataFrame:
    """(stream_id, substream, au, start, rule): start times of first fields, and fields that are malformed or out of sequence."""
    rows = units.where("now is not null").select("stream_id", "au", F.col("now.samples").alias("samples"), F.posexplode("restarts").alias("place", "r"))
    rows = rows.select("stream_id", F.col("r.substream").alias("substream"), "au", "place", "samples", F.col("r.hires").alias("bit"), F.col("r.output_timing").alias("output"))

    names = [f.split()[0] for f in HIRES.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())

    def checked(every):
        for (stream, substream), headers in itertools.groupby(every, lambda r: (r["stream_id"], r["substream"])):
            first = next(headers)
            bits = ((r["au"], r["bit"], r["output"]) for r in itertools.chain([first], headers))
            for item in hires.check(hires.fields(bits), first["samples"]):
                yield {"stream_id": stream, "substream": substream} | item

    def run(batches):
        found = checked(row for batch in batches for row in batch.to_pylist())
        while part := list(itertools.islice(found, FLUSHED)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], k) for n, k in zip(names, kinds, strict=True)], names)

    return rows.repartition("stream_id", "substream").sortWithinPartitions("stream_id", "substream", "au", "place").mapInArrow(run, HIRES)
