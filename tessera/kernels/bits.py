"""A most-significant-bit-first reader and writer, and the checks over byte and bit ranges."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tessera.functions.bits import crc_table

HEADER_CRC = (0x1D, 0)
SEGMENT_CRC = (0x63, 0xA2)
SYNC_CRC = (0x2D, 0)
PARITY_SEED = 0xA9


#: Bits that are shifted as one number for a field; of more, the field's bytes are cut out.
SHORT = 1 << 14


class EndOfData(ValueError):
    """A field reaches past the data."""


class BitReader:
    def __init__(self, data: bytes):
        self.value = int.from_bytes(data, "big")
        self.size = 8 * len(data)
        self.data = data
        self.at = 0

    def peek(self, bits: int) -> int:
        """The next bits, zeros past the end."""
        over = max(0, self.at + bits - self.size)
        first, last = self.at >> 3, (self.at + bits - over + 7) >> 3
        chunk = int.from_bytes(self.data[first:last], "big") >> (8 * last - (self.at + bits - over))
        return (chunk & ((1 << (bits - over)) - 1)) << over

    def get(self, bits: int) -> int:
        end = self.at + bits
        if end > self.size:
            raise EndOfData(f"{bits} bits at {self.at} of {self.size}")
        if self.size <= SHORT:
            self.at = end
            return self.value >> (self.size - end) & (1 << bits) - 1
        out = self.peek(bits) if bits else 0
        self.at = end
        return out

    def flag(self) -> bool:
        return self.get(1) == 1

    def signed(self, bits: int) -> int:
        out = self.get(bits)
        return out - (1 << bits) if bits and out >> (bits - 1) else out

    def skip(self, bits: int) -> None:
        if not 0 <= self.at + bits <= self.size:
            raise EndOfData(f"skip of {bits} bits at {self.at} of {self.size}")
        self.at += bits

    def left(self) -> int:
        return self.size - self.at

    def align16(self) -> None:
        self.skip(-self.at % 16)

    def variable(self, bits: int, groups: int = 1 << 30) -> int:
        """Groups of bits; a set flag after a group says that another follows."""
        value = 0
        for _ in range(groups):
            value += self.get(bits)
            if not self.flag():
                break
            value = (value + 1) << bits
        return value


class BitWriter:
    def __init__(self) -> None:
        self.value = 0
        self.size = 0

    def put(self, value: int, bits: int) -> BitWriter:
        self.value = self.value << bits | (value & ((1 << bits) - 1))
        self.size += bits
        return self

    def align(self, bits: int) -> BitWriter:
        return self.put(0, -self.size % bits)

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")


_TABLES = {8: {p: crc_table(p, 8) for p in (0x1D, 0x63)}, 16: {0x2D: crc_table(0x2D, 16)}}


#: Bytes whose remainders are added up at once.
SPAN = 512


@lru_cache
def _powers(polynomial: int) -> np.ndarray:
    """Remainders of each byte with 0 to SPAN zero bytes after it."""
    table = np.array(_TABLES[8][polynomial], np.uint8)
    out = np.empty((SPAN + 1, 256), np.uint8)
    out[0] = np.arange(256)
    for k in range(SPAN):
        out[k + 1] = table[out[k]]
    return out


@lru_cache(SPAN)
def _places(polynomial: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(polynomial).reshape(-1), np.arange(size - 1, -1, -1) * 256


def crc8(data: bytes, kind: tuple[int, int]) -> int:
    table, crc = _TABLES[8][kind[0]], kind[1]
    if len(data) < 32:
        for byte in data:
            crc = table[crc] ^ byte
        return crc
    # a remainder of a sum is the sum of the remainders
    for low in range(0, len(data), SPAN):
        part = np.frombuffer(data[low : low + SPAN], np.uint8)
        powers, places = _places(kind[0], len(part))
        crc = int(powers[256 * len(part) + crc]) ^ int(np.bitwise_xor.reduce(powers[places + part]))
    return crc


def crc8_bits(value: int, bits: int, kind: tuple[int, int]) -> int:
    """The CRC of a bit string whose first bits % 8 bits stand alone before the whole bytes."""
    odd = bits % 8
    crc = kind[1]
    rest = bits - odd
    if odd:
        crc = _TABLES[8][kind[0]][crc] ^ (value >> rest & ((1 << odd) - 1))
    for shift in range(rest - 8, -1, -8):
        crc = _TABLES[8][kind[0]][crc] ^ (value >> shift & 0xFF)
    return crc


def crc16(data: bytes, kind: tuple[int, int] = SYNC_CRC) -> int:
    table, crc = _TABLES[16][kind[0]], kind[1]
    for byte in data:
        crc = table[crc >> 8] ^ (crc << 8 & 0xFFFF) ^ byte
    return crc


def parity(data: bytes) -> int:
    out, size = int.from_bytes(data, "big"), len(data)
    while size > 1:
        size = (size + 1) // 2
        out = out >> 8 * size ^ out & (1 << 8 * size) - 1
    return out


def nibble(data: bytes) -> int:
    out = parity(data)
    return out >> 4 ^ out & 15


def fnv1a(data: bytes, digest: int = 0xCBF29CE484222325) -> int:
    for byte in data:
        digest = (digest ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return digest
