"""The dither sequence: a shift register whose upper eight bits pick from a table of 256 amplitudes.

The table is a parameter of decoding, as text with one whole number after
another; only streams of the second and third restart syntax that ask for
dither need it.
"""

from __future__ import annotations

import re

ENTRIES = 256


def load(path: str) -> list[int]:
    """The table of a text file."""
    with open(path, encoding="utf-8") as file:
        values = [int(v) for v in re.findall(r"-?\d+", file.read())]
    if len(values) != ENTRIES:
        raise ValueError(f"a dither table has {ENTRIES} values, not {len(values)}")
    return values


def indices(samples: int, seed: int) -> tuple[list[int], int]:
    """Places in the table for as many samples as the next power of two, and the seed after them."""
    out = []
    for _ in range(1 << max(0, (samples - 1).bit_length())):
        high = seed >> 15
        out.append(high)
        seed = ((seed << 8) ^ high ^ (high << 5)) & 0x7FFFFF
    return out, seed
