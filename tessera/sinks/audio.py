"""Decoded samples to files: raw PCM, CAF and Wave64.

One task writes one file from its rows in order, so memory stays at a batch.
Sizes come from an aggregation beforehand, so headers need no patching, and a
file gets its name only when it is whole: a repeated task replaces nothing half.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sinks import containers
from tessera.storage import materialise

FORMATS = ("pcm", "caf", "w64")
WRITTEN = "stream_id string, presentation int, output_segment long, path string, samples long, channels int, bytes long"


def file_name(stream_id: str, presentation: int, segment: int, several: bool, kind: str) -> str:
    """Name of an output: the stream's, with its presentation if there are several and its segment if it isn't the first."""
    stem = re.sub(r"[^A-Za-z0-9._-]", "_", posixpath.basename(stream_id.rstrip("/")) or "stream")
    return stem + (f"_p{presentation}" if several else "") + (f"_{segment}" if segment else "") + "." + kind


def write_audio(samples: DataFrame, rates: DataFrame, folder: str, kind: str = "caf") -> DataFrame:
    """Files of all streams, presentations and output segments under ``folder``; returns what was written.

    ``samples`` is the decoder's table, with ``output_segment`` if the
    configuration changes within a stream; ``rates`` has (stream_id, frequency,
    labels: array of channel labels or null).
    """
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    keys = ["stream_id", "presentation", "output_segment"]
    rows = samples if "output_segment" in samples.columns else samples.withColumn("output_segment", F.lit(0).cast("long"))
    totals = rows.groupBy(*keys).agg(F.sum(F.octet_length("pcm")).cast("long").alias("size"), F.sum("samples").cast("long").alias("total"))
    several = rows.groupBy("stream_id").agg((F.count_distinct("presentation") > 1).alias("several"))
    ready = rows.join(totals, keys).join(several, "stream_id").join(rates.select("stream_id", "frequency", "labels"), "stream_id")
    ready = ready.select(*keys, "au", "channels", "frequency", "labels", "size", "total", "several", "pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        key, out, done, parts = None, None, [], ("", "")

        def close() -> None:
            out.close()
            system.move(*parts)

        for batch in batches:
            for row in batch.to_pylist():
                if (now := tuple(row[k] for k in keys)) != key:
                    if out is not None:
                        close()
                    key = now
                    path = f"{root}/{file_name(*now, row['several'], kind)}"
                    parts = (f"{path}.{id(out)}.part", path)
                    out = system.open_output_stream(parts[0], compression=None)
                    head = b""
                    if kind == "caf":
                        head = containers.caf_header(row["channels"], row["frequency"], row["size"], row["labels"])
                    elif kind == "w64":
                        head = containers.w64_header(row["channels"], row["frequency"], row["size"], row["labels"])
                    out.write(head)
                    done.append((*now, f"{folder.rstrip('/')}/{posixpath.basename(path)}", row["total"], row["channels"], row["size"] + len(head)))
                out.write(containers.swapped(row["pcm"]) if kind == "caf" else row["pcm"])
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*keys, "path", "samples", "channels", "bytes"])

    return materialise(ready.repartition(*keys).sortWithinPartitions(*keys, "au").mapInArrow(run, WRITTEN), "audio")
