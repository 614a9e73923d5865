"""Byte streams to units' frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.kernels import framing


def read_streams(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(stream_id, data) of the files under a path, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("stream_id"), F.col("content").alias("data"))


def _scan(streams: DataFrame, schema: str, rows) -> DataFrame:
    import pyarrow as pa

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = rows(name, data or b"")
                for low in range(0, len(found), 2000):
                    yield pa.RecordBatch.from_pylist(found[low : low + 2000], schema=arrow)

    return streams.select("stream_id", "data").mapInArrow(run, schema)


def frames(streams: DataFrame) -> DataFrame:
    """One row for each unit of each stream, in order, with its major sync's number as ``segment``.

    Scanning is over the whole stream: after a byte that begins no unit the next
    valid major sync is sought.  The first row bears the stream's timestamp.
    """

    def rows(name: str, data: bytes) -> list[dict]:
        units, scanner = framing.scan(data)
        smpte = asdict(scanner.smpte) if scanner.smpte else None
        return [{"stream_id": name, "au": n, "au_offset": at, "segment": s, "is_major": m, "data": d, "smpte": smpte if n == 0 else None} for n, at, s, m, d in units]

    return _scan(streams, schemas.FRAMES, rows)


def stream_sizes(streams: DataFrame) -> DataFrame:
    """Frames, bytes, what follows the last frame, and resynchronisations of each stream."""

    def rows(name: str, data: bytes) -> list[dict]:
        units, scanner = framing.scan(data)
        end = units[-1][1] + len(units[-1][4]) if units else 0
        return [{"stream_id": name, "frames": len(units), "bytes": len(data), "trailing_bytes": len(data) - end, "resyncs": scanner.errors}]

    return _scan(streams, schemas.STREAMS, rows)
