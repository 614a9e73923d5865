"""An encoder for streams of known content: the input of tests and examples."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np

from tessera.kernels import bits as B
from tessera.kernels.bits import BitWriter
from tessera.kernels.syntax import FBA, SIGNATURE, SYNC_A, folded


def major_sync(sync: int, rate_code: int, substreams: int, info: int, peak: int = 3000, flags: int | None = None, variable: bool = True) -> bytes:
    w = BitWriter().put(sync, 32)
    if sync == FBA:
        w.put(rate_code, 4).put(0, 4).put(0, 4).put(1, 5).put(0, 2).put(1, 13)
    else:
        w.put(2, 4).put(15, 4).put(rate_code, 4).put(15, 4).put(0, 4).put(0, 4).put(0, 3).put(1, 5)
    flags = (0 if sync == FBA else 0x4000) if flags is None else flags
    w.put(SIGNATURE, 16).put(flags, 16).put(0, 16).put(variable, 1).put(peak, 15).put(substreams, 4).put(0, 4).put(info, 8).put(0, 64)
    body = w.bytes()
    return body + B.crc16(body).to_bytes(2, "big")


def restart_header(channels: int, output_timing: int, check: int, bits: int = 24, seed: int = 1, low: int = 0) -> BitWriter:
    w = BitWriter().put(SYNC_A, 14).put(output_timing, 16).put(low, 4).put(channels - 1, 4).put(channels - 1, 4).put(0, 4).put(seed, 23)
    w.put(0, 4).put(24, 5).put(bits, 5).put(bits, 5).put(0, 1).put(check, 8).put(0, 1).put(0, 2).put(0, 1).put(0, 12)
    for c in range(channels):
        w.put(c, 6)
    return w.put(B.crc8_bits(w.value, w.size, B.HEADER_CRC), 8)


def segment(samples: list[list[int]], restart: BitWriter | None, coeffs: list[int], history: list[list[int]], q: int = 8, width: int = 24) -> bytes:
    """One block of raw residuals; ``history`` holds each channel's last outputs, newest first, and is changed where there are coefficients."""
    channels = len(samples[0])
    w = BitWriter()
    if restart is not None:
        w.put(1, 1).put(1, 1).put(restart.value, restart.size)
        w.put(0, 1).put(1, 1).put(len(samples), 9).put(0, 1).put(0, 1).put(0, 1)
        for _ in range(channels):
            w.put(1, 1)
            if coeffs:
                w.put(1, 1).put(len(coeffs), 4).put(q, 4).put(12, 5).put(0, 3)
                for c in coeffs:
                    w.put(c, 12)
                w.put(0, 1)
            else:
                w.put(0, 1)
            w.put(0, 1).put(0, 1).put(0, 2).put(width, 5)
    else:
        w.put(0, 1)
    whole = not coeffs and width % 8 == 0 and width <= 32
    if whole:  # nothing is predicted: all fields at once
        fields = (np.asarray(samples, np.int64).reshape(-1) + (1 << (width - 1))).astype(">u4").view(np.uint8).reshape(-1, 4)
        data = fields[:, 4 - width // 8 :].tobytes()
        w.put(int.from_bytes(data, "big"), 8 * len(data))
    for row in () if whole else samples:
        for c, value in enumerate(row):
            prediction = sum(a * b for a, b in zip(coeffs, history[c], strict=False)) >> q
            w.put(value - prediction + (1 << (width - 1)), width)
            history[c] = [value, *history[c][:7]]
    w.put(1, 1).align(16)
    body = w.bytes()
    return body + bytes([B.parity(body) ^ B.PARITY_SEED, B.crc8(body, B.SEGMENT_CRC)])


def unit(timing: int, sync: bytes, segments: list[bytes], is_major: bool, extra: bytes = b"") -> bytes:
    entries, end = BitWriter(), 0
    for body in segments:
        end += len(body) // 2
        entries.put(0, 1).put(not is_major, 1).put(1, 1).put(0, 1).put(end, 12)
    directory = entries.bytes()
    length = (4 + len(sync) + len(directory) + sum(map(len, segments)) + len(extra)) // 2
    head = BitWriter().put(0, 4).put(length, 12).put(timing, 16).bytes()
    nibble = B.nibble(head) ^ B.nibble(directory) ^ 15
    return bytes([head[0] | nibble << 4]) + head[1:] + sync + directory + b"".join(segments) + extra


def digest_of(rows: list[list[int]]) -> int:
    out = 0
    for c, column in enumerate(np.bitwise_xor.reduce(np.asarray(rows, np.int64), axis=0).tolist()):
        out ^= (column & 0xFFFFFF) << (c & 7)
    return out


def encode(blocks: list[list[list[int]]], every: int = 8, sync: int = FBA, rate_code: int = 0, coeffs: tuple[int, ...] = (), first_timing: int = 0, latency: int = 200, peak: int = 3000) -> bytes:
    """A stream of one substream that holds the given samples, a block a unit, with a major sync ``every`` so many units."""
    info = 0x14 if sync == FBA else 0x05
    out, digest, history = [], 0, []
    for n, rows in enumerate(blocks):
        major = n % every == 0
        timing = (first_timing + n * len(rows)) & 0xFFFF
        restart = None
        if major:
            restart = restart_header(len(rows[0]), (timing + latency) & 0xFFFF, folded(digest))
            history, digest = [[0] * 8 for _ in rows[0]], 0
        digest ^= digest_of(rows)
        body = segment(rows, restart, list(coeffs), history)
        out.append(unit(timing, major_sync(sync, rate_code, 1, info, peak) if major else b"", [body], major))
    return b"".join(out)


def stream(units: int = 32, channels: int = 2, every: int = 8, seed: int = 1, sync: int = FBA, rate_code: int = 0, coeffs: tuple[int, ...] = (), first_timing: int = 0, latency: int = 200, peak: int = 3000) -> tuple[bytes, list[list[int]]]:
    """A stream of random samples, and these."""
    rng = random.Random(seed)
    frequency = 48_000 << rate_code if rate_code < 8 else 44_100 << (rate_code - 8)
    size = frequency // 44_100 * 40
    level = [0] * channels
    blocks = []
    for _ in range(units):
        rows = []
        for _ in range(size):
            level = [max(-60_000, min(60_000, v + rng.randint(-500, 500))) for v in level]
            rows.append(list(level))
        blocks.append(rows)
    return encode(blocks, every, sync, rate_code, coeffs, first_timing, latency, peak), [row for rows in blocks for row in rows]


def object_payload(dynamic: int, seed: int, ramp: int = 1, pick: Callable[[int, int, int], int] | None = None) -> bytes:
    """Object metadata of one low-frequency bed channel and some moving objects, in one block.

    ``pick`` gives the value, below a limit, of an object's field by number:
    gain, priority, x, y, sign of z, z, zones, elevation, size, snap; random
    without it.
    """
    rng = random.Random(seed)
    pick = pick or (lambda index, field, limit: rng.randrange(limit))
    body = BitWriter().put(0, 1).put(0, 2).put(0, 3).put(0, 6).put(ramp, 2).put(1, 1)
    for index in range(dynamic + 1):
        body.put(0, 1).put(2, 2).put(pick(index, 0, 64), 6).put(0, 1).put(pick(index, 1, 32), 5)
        if index:
            body.put(pick(index, 2, 63), 6).put(pick(index, 3, 63), 6).put(pick(index, 4, 2), 1).put(pick(index, 5, 16), 4).put(0, 1)
            body.put(pick(index, 6, 6), 3).put(pick(index, 7, 2), 1).put(1, 2).put(pick(index, 8, 32), 5).put(0, 1).put(pick(index, 9, 2), 1)
        body.put(0, 1)
    body.align(8)
    size = body.size // 8 - 1
    w = BitWriter().put(0, 2).put(dynamic, 5).put(1, 1).put(1, 1).put(0, 1).put(1, 4).put(1, 4)
    if size < 16:
        w.put(size, 4).put(0, 1)
    else:
        w.put((size >> 4) - 1, 4).put(1, 1).put(size & 15, 4).put(0, 1)
    return w.put(body.value, body.size).align(8).bytes()


def evolution(payloads: list[tuple[int, bytes]], before: bytes = b"", key: bytes | None = None) -> bytes:
    """Extra data with an evolution frame; with a key, its primary word is the keyed digest over ``before`` and the frame."""
    import hashlib
    import hmac

    w = BitWriter().put(0, 2).put(0, 3)
    for kind, data in payloads:
        w.put(kind, 5).put(0, 4).put(1, 1)
        if len(data) < 256:
            w.put(len(data), 8).put(0, 1)
        else:
            w.put((len(data) >> 8) - 1, 8).put(1, 1).put(len(data) & 255, 8).put(0, 1)
        w.put(int.from_bytes(data, "big"), 8 * len(data))
    w.put(0, 5).put(2 if key else 0, 2).put(0, 2)
    at = w.size
    if key:
        w.put(0, 32)
    frame = w.align(8).bytes()
    if key:
        word = int.from_bytes(hmac.new(key, before + frame, hashlib.sha256).digest()[:4], "big")
        frame = (int.from_bytes(frame, "big") | word << (8 * len(frame) - at - 32)).to_bytes(len(frame), "big")
    body = BitWriter().put(0, 4).put(len(frame), 12).bytes() + frame
    body += bytes((len(body) + 1) % 2)
    body += bytes([B.parity(body) ^ B.PARITY_SEED])
    words = len(body) // 2
    head = BitWriter().put(0, 4).put(words, 12).bytes()
    return bytes([head[0] | (B.nibble(head) ^ 15) << 4]) + head[1:] + body
