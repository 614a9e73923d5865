"""The three residual codes, as tables over the next nine bits.

A code starts with 00 for negative values, 01 for large ones (both then count
zeros up to a one) and 1 for the small ones in fixed width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.kernels.bits import BitReader

DEEPEST = -7
# Fixed values for codes 1 to 3: the first large value, and the width of the small ones.
_SHAPES = {1: (4, 2), 2: (2, 1), 3: (1, 0)}


def _table(code: int) -> list[tuple[int, int]]:
    base, width = _SHAPES[code]
    out = []
    for bits in range(512):
        if bits >> 8:
            out.append((bits >> (8 - width) & ((1 << width) - 1), 1 + width))
            continue
        tail = bits & 0x7F
        zeros = min(6, 7 - tail.bit_length())
        out.append((base + zeros if bits >> 7 & 1 else -1 - zeros, 3 + zeros))
    return out


TABLES = {code: _table(code) for code in _SHAPES}


def read(reader: BitReader, code: int) -> int:
    value, length = TABLES[code][reader.peek(9)]
    reader.skip(length)
    return value


#: Each code word, and the value it stands for; the last of the large or negative ones leaves its ninth bit open.
_WORDS = {code: {f"{bits:09b}"[:length]: value for bits, (value, length) in enumerate(table)} for code, table in TABLES.items()}
#: A code word, or what is left where none is whole.
_WORD = {code: re.compile(f"1.{{{width}}}|0.(?:0{{0,5}}1|0{{6}}.)|.+") for code, (_, width) in _SHAPES.items()}
#: Bytes that are spelt out as bits at once.
SPELT = 4096


def symbols(data: bytes, code: int) -> Iterator[list[int]]:
    """All whole symbols of a byte string, by parts."""
    words, left = _WORDS[code], ""
    for low in range(0, len(data), SPELT):
        part = data[low : low + SPELT]
        found = _WORD[code].findall(left + f"{int.from_bytes(part, 'big'):0{8 * len(part)}b}")
        left = "" if found[-1] in words else found.pop()
        yield [words[w] for w in found]


def decode_all(data: bytes, code: int) -> list[int]:
    """All whole symbols of a byte string."""
    return [value for part in symbols(data, code) for value in part]
