"""Bit fields, parities and checksums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """The bytes of a binary (or the UTF-8 bytes of a string) as an array of integers."""
    digits = F.hex(data)
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.octet_length(data) > 0, pairs).otherwise(F.array().cast("array<int>"))


def parity(data: Column) -> Column:
    """XOR of all bytes."""
    return F.aggregate(byte_values(data), F.lit(0), lambda a, x: a.bitwiseXOR(x))


def nibble(value: Column) -> Column:
    """The two halves of a byte folded by XOR."""
    return F.shiftright(value, 4).bitwiseXOR(value.bitwiseAND(F.lit(15)))


def crc_table(polynomial: int, width: int) -> list[int]:
    """The most-significant-bit-first table of a CRC, by its rule."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = []
    for value in range(256):
        crc = value << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ polynomial if crc & top else crc << 1) & mask
        table.append(crc)
    return table


def crc8(data: Column, polynomial: int, initial: int) -> Column:
    """An 8-bit CRC whose step is table[crc] ^ byte: the byte enters after the table, not before."""
    table = F.array(*[F.lit(v) for v in crc_table(polynomial, 8)])
    return F.aggregate(byte_values(data), F.lit(initial), lambda a, x: F.get(table, a).bitwiseXOR(x))


def crc16(data: Column, polynomial: int, initial: int) -> Column:
    """A 16-bit CRC whose step is table[crc >> 8] ^ (crc << 8) ^ byte."""
    table = F.array(*[F.lit(v) for v in crc_table(polynomial, 16)])
    step = lambda a, x: F.get(table, F.shiftright(a, 8)).bitwiseXOR(F.shiftleft(a, 8).bitwiseAND(F.lit(0xFFFF))).bitwiseXOR(x)
    return F.aggregate(byte_values(data), F.lit(initial), step)


def field(word: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a word from ``shift`` up."""
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << bits) - 1))


def signed(value: Column, bits: int) -> Column:
    """Two's complement of a field of so many bits."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def bit(word: Column, place: int) -> Column:
    return field(word, place, 1) == 1


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as lower-case hexadecimal, by two nested digests; ``key`` has at most 64 bytes."""
    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    padded = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in padded).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
