"""Finding units in a byte stream: length hops, parity, resynchronisation, timestamps."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.kernels import bits as B

MARKERS = (b"\xf8\x72\x6f\xba", b"\xf8\x72\x6f\xbb")
# Frame rates of the timestamp's codes.
RATES = {1: "23.976", 2: "24", 3: "25", 4: "29.97", 5: "30", 6: "50", 7: "59.94", 8: "60"}


@dataclass
class Timestamp:
    hours: int
    minutes: int
    seconds: int
    frames: int
    samples: int
    rate_code: int
    drop_frame: bool


def bcd(value: int) -> int:
    """Four binary-coded decimal digits."""
    digits = [value >> shift & 15 for shift in (12, 8, 4, 0)]
    if max(digits) > 9:
        raise ValueError("not a decimal digit")
    return int("".join(map(str, digits)))


def timestamp(data: bytes) -> Timestamp | None:
    """The sixteen bytes before a stream's first unit, if they are a timestamp."""
    if len(data) != 16 or data[:2] != b"\x01\x10" or data[14:] != b"\x80\x00":
        return None
    words = [int.from_bytes(data[i : i + 2], "big") for i in range(2, 12, 2)]
    try:
        hours, minutes, seconds, frames = map(bcd, words[:4])
    except ValueError:
        return None
    last = int.from_bytes(data[12:14], "big")
    return Timestamp(hours, minutes, seconds, frames, words[4], last >> 2 & 15, bool(last & 1))


def sync_length(unit: bytes) -> int:
    """Bytes of the major sync in a unit, without its checksum."""
    if unit[7] == 0xBA and unit[29] & 1:
        return 28 + (unit[30] >> 3 & 0x1E)
    return 26


class Scanner:
    """Takes bytes as they come and gives whole units; what is left over waits for more."""

    def __init__(self, left: bytes = b"", offset: int = 0, substreams: int = 0, index: int = 0, segment: int = 0, errors: int = 0):
        self.left, self.offset, self.substreams = left, offset, substreams
        self.index, self.segment, self.errors = index, segment, errors
        self.smpte: Timestamp | None = None

    def push(self, data: bytes) -> list[tuple[int, int, int, bool, bytes]]:
        """(index, offset, segment, is_major, unit) of the units completed by ``data``."""
        buffer, at, out = self.left + data, 0, []
        while True:
            if not self.substreams:
                found = self._locate(buffer, at)
                if found is None:
                    at = max(at, len(buffer) - 64)  # a marker, its header and a timestamp may straddle the end
                    break
                if found < 0:
                    break
                at = found
            step = self._step(buffer, at)
            if step == 0:
                break
            if step < 0:
                self.errors += 1
                self.substreams = 0
                at += 1
                continue
            unit = buffer[at : at + step]
            major = unit[4:6] == b"\xf8\x72"
            self.segment += major
            out.append((self.index, self.offset + at, self.segment, major, unit))
            self.index += 1
            at += step
        self.left, self.offset = buffer[at:], self.offset + at
        return out

    def finish(self) -> list[tuple[int, int, int, bool, bytes]]:
        """At the end of the stream: a unit longer than what is left is no unit, so the search goes on behind it."""
        out = []
        while self.substreams and len(self.left) > 8:
            self.errors += 1
            self.substreams = 0
            self.left, self.offset = self.left[1:], self.offset + 1
            found = self.push(b"")
            if not found:
                break
            out += found
        return out

    def _locate(self, buffer: bytes, at: int) -> int | None:
        """Start of the next unit with a valid major sync; None: there is no marker; -1: more bytes are needed."""
        place = at + 3
        while True:
            hits = [p for m in MARKERS if (p := buffer.find(m, place + 1)) >= 0]
            if not hits:
                return None
            place = min(hits)
            start = place - 4
            if start < at:
                continue
            if start + 64 > len(buffer) and start + 2 * (int.from_bytes(buffer[start : start + 2], "big") & 0xFFF) > len(buffer):
                return -1
            unit = buffer[start : start + 64]
            if len(unit) < 32:
                continue
            end = 4 + sync_length(unit)
            if int.from_bytes(unit[end : end + 2], "big") != B.crc16(unit[4:end]):
                continue
            if self.index == 0 and self.smpte is None and start >= 16:
                self.smpte = timestamp(buffer[start - 16 : start])
            self.substreams = unit[20] >> 4
            if self.substreams:
                return start

    def _step(self, buffer: bytes, at: int) -> int:
        """Bytes of the unit at ``at``; 0: more are needed; -1: no unit begins here."""
        if at + 8 > len(buffer):
            return 0
        length = 2 * (int.from_bytes(buffer[at : at + 2], "big") & 0xFFF)
        if length < 8:
            return -1
        if at + length > len(buffer):
            return 0
        unit = buffer[at : at + length]
        place = 4
        if unit[4:6] == b"\xf8\x72" and len(unit) >= 32:
            if unit[20] >> 4 != self.substreams:
                return -1
            place += sync_length(unit) + 2
        check = B.nibble(unit[:4])
        for _ in range(self.substreams):
            size = 4 if place < length and unit[place] & 0x80 else 2
            if place + size > length:
                return -1
            check ^= B.nibble(unit[place : place + size])
            place += size
        return length if check == 15 else -1


def scan(data: bytes) -> tuple[list[tuple[int, int, int, bool, bytes]], Scanner]:
    """All units of a whole stream, and the scanner after them."""
    scanner = Scanner()
    units = scanner.push(data)
    return units + scanner.finish(), scanner
