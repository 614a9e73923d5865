"""Units of streams that arrive in chunks: Structured Streaming with the unread bytes as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.kernels.framing import Scanner

STATE = "left binary, offset long, substreams int, au long, segment long, errors long"
UNITS = "stream_id string, au long, au_offset long, segment long, is_major boolean, data binary"
NAMES = ["stream_id", "au", "au_offset", "segment", "is_major", "data"]


def frames_stream(chunks: DataFrame) -> DataFrame:
    """Units of the streaming table ``chunks`` (stream_id, seq, data); a stream's chunks arrive in the order of seq over the micro-batches.

    The state of a stream is what a unit still lacks, the lock and the
    counters; units leave as soon as they are whole, so it stays small.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner = Scanner(*(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in state.get)) if state.exists else Scanner()
        chunks = sorted(((seq, data) for frame in frames for seq, data in zip(frame["seq"].tolist(), frame["data"].tolist(), strict=True)), key=lambda c: c[0])
        rows = scanner.push(b"".join(data for _, data in chunks))
        state.update((scanner.left, scanner.offset, scanner.substreams, scanner.index, scanner.segment, scanner.errors))
        yield pd.DataFrame(dict(zip(NAMES, ([key[0]] * len(rows), *(zip(*rows, strict=True) if rows else [[]] * 5)), strict=True)))

    return chunks.groupBy("stream_id").applyInPandasWithState(step, UNITS, STATE, "append", GroupStateTimeout.NoTimeout)
