"""Headers of the audio containers, with sizes known beforehand."""

from __future__ import annotations

import struct

from tessera.functions.streams import WAVE_BITS
from tessera.sinks import layouts

# Chunk identifiers of Wave64 and the PCM subformat.
_TAIL = bytes.fromhex("f3acd3118cd100c04f8edb8a")
W64_RIFF = b"riff" + bytes.fromhex("2e91cf11a5d628db04c10000")
W64_WAVE, W64_FMT, W64_DATA = b"wave" + _TAIL, b"fmt " + _TAIL, b"data" + _TAIL
PCM_SUBFORMAT = bytes.fromhex("0100000000001000800000aa00389b71")


def wave_mask(labels: list[str]) -> int | None:
    """The speaker mask, if every label has a bit and the order is ascending."""
    bits = [WAVE_BITS.get(name) for name in labels]
    if not bits or None in bits or any(a >= b for a, b in zip(bits, bits[1:], strict=False)):
        return None
    return sum(bits)


def w64_header(channels: int, rate: int, data_bytes: int, labels: list[str] | None = None, bits: int = 24) -> bytes:
    mask = wave_mask(labels or [])
    width = bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if mask else 1, channels, rate, rate * channels * width, channels * width, bits)
    if mask:
        form += struct.pack("<HHI", 22, bits, mask) + PCM_SUBFORMAT
    size = 40 + 24 + len(form) + 24 + data_bytes
    return W64_RIFF + struct.pack("<Q", size) + W64_WAVE + W64_FMT + struct.pack("<Q", 24 + len(form)) + form + W64_DATA + struct.pack("<Q", 24 + data_bytes)


def caf_header(channels: int, rate: int, data_bytes: int, labels: list[str] | None = None, bits: int = 24, little_endian: bool = False) -> bytes:
    """``caff``, ``desc``, a channel layout if every channel has a label, and the head of ``data``."""
    width = bits // 8
    out = b"caff" + struct.pack(">HH", 1, 0)
    out += b"desc" + struct.pack(">q", 32) + struct.pack(">d4sIIIII", rate, b"lpcm", 2 if little_endian else 0, channels * width, 1, channels, bits)
    if labels and len(labels) == channels and all(name in layouts.LABEL_CODES for name in labels):
        tag = layouts.tag_for(labels)
        if tag is not None:
            body = struct.pack(">III", tag, 0, 0)
        else:
            body = struct.pack(">III", 0, 0, channels) + b"".join(struct.pack(">II3f", layouts.LABEL_CODES[n], 0, 0.0, 0.0, 0.0) for n in labels)
        out += b"chan" + struct.pack(">q", len(body)) + body
    return out + b"data" + struct.pack(">qI", data_bytes + 4, 0)


def swapped(pcm: bytes, width: int = 3) -> bytes:
    """Little-endian samples as big-endian, or back."""
    out = bytearray(len(pcm))
    for k in range(width):
        out[k::width] = pcm[width - 1 - k :: width]
    return bytes(out)
