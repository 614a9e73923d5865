"""A data source of framed streams: ``spark.read.format("framed").load(path)``.

Each file is a partition, read in chunks and scanned as it comes, so a stream
of any length needs the memory of a chunk and a unit.  Options: ``path`` (a
folder or a file on any file system that pyarrow knows), ``suffix``, and
``chunkBytes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.kernels.framing import Scanner

SCHEMA = "stream_id string, au long, au_offset long, segment long, is_major boolean, data binary"
ROWS = 2000


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FramedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.suffix = options.get("suffix", "")
        self.chunk = int(options.get("chunkbytes", options.get("chunkBytes", 1 << 20)))

    def partitions(self) -> list[InputPartition]:
        system, place = pafs.FileSystem.from_uri(self.root)
        info = system.get_file_info(place)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(place, recursive=True))
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix))
        return [File(scheme + n if scheme else n) for n in names]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, place = pafs.FileSystem.from_uri(partition.path)
        scanner, rows = Scanner(), []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            parts = [pa.array([partition.path] * len(rows), pa.string())] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(parts, ["stream_id", "au", "au_offset", "segment", "is_major", "data"])

        with system.open_input_stream(place, compression=None) as stream:
            while data := stream.read(self.chunk):
                rows += scanner.push(data)
                while len(rows) >= ROWS:
                    rest, rows = rows[ROWS:], rows[:ROWS]
                    yield batch()
                    rows = rest
        rows += scanner.finish()
        if rows:
            yield batch()


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramedReader:
        return FramedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedSource)
