"""Parsing and decoding of the units of one restart interval.

A restart header wipes the parameters of its substream, and a major sync
carries the whole configuration, so an interval is read without anything
before it.  What a rule finds is noted with its level; rules that end a unit
raise :class:`Stop`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tessera.kernels import bits as B
from tessera.kernels import dither, huffman
from tessera.kernels.bits import BitReader

FBA, FBB = 0xF8726FBA, 0xF8726FBB
SIGNATURE = 0xB752
SYNC_A, SYNC_B, SYNC_C = 0x31EA, 0x31EB, 0x31EC
TERMINATOR_A, TERMINATOR_B = 0x348D3, 0x1234
SYNTAX_MARKER, EVOLUTION_FLAG, HEAVY_FLAG = 0x4000, 0x1000, 0x2000
RESERVED_FLAGS = {FBA: 0x27FF, FBB: 0x3FFF}
PROTECTION_BYTES = (0, 1, 4, 16)
# The legal substream layouts of FBA, as bits 2 to 6 of the info byte.
LEGAL_INFO = {20 + i for i in range(57) if 76562297473007889 >> i & 1} | {88 + i for i in range(37) if 68987981841 >> i & 1}
#: What a substream has before any restart header.
UNSET = {"sync_word": 0, "output_timing": 0, "min_chan": 0, "max_chan": 0, "max_matrix_chan": 0, "dither_shift": 0, "seed": 0, "max_shift": 0, "max_lsbs": 0, "max_bits": 0, "error_protect": 0, "lossless_check": 0, "assign": [0], "restart_digest": None, "digest_before": None}
GUARDS, HUFF_OFFSET, COEFFS_B, COEFFS_A, QUANTISER, OUTPUT_SHIFT, MATRIXING, BLOCK_SIZE = range(8)


class Stop(ValueError):
    """A rule that ends its unit."""

    def __init__(self, rule: str):
        super().__init__(rule)
        self.rule = rule


def sampling_frequency(code: int) -> int:
    if code <= 2:
        return 48_000 << code
    if 8 <= code <= 10:
        return 44_100 << (code - 8)
    raise Stop("sync.invalid_audio_sampling_freq")


def presentation_masks(sync: int, info: int, extended: int) -> list[int]:
    if sync == FBB:
        return [1, 3 if info & 8 else 0, 0, 0]
    return [1, info >> 2 & 3, info >> 4 & 7, info >> 4 & 8 | (7 ^ 7 >> (extended & 3))]


def effective_presentations(masks: list[int], wanted: list[int]) -> list[int]:
    """What is decoded for some presentations: a copy's source, and the highest there is for an absent one."""
    out = set()
    own = [i for i in range(4) if masks[i] >> i]
    for i in wanted:
        if i in own:
            out.add(i)
        else:
            copies = [j for j in range(i) if masks[i] >> j]
            out.add(copies[-1] if copies else own[-1])
    return sorted(out)


def next_seed(seed: int) -> int:
    """The generator of the first syntax one sample on; a linear map of the seed's bits."""
    high = seed >> 7
    return (high ^ high << 5 ^ seed << 16) & 0x7FFFFF


@lru_cache
def _leaps(steps: int) -> list[int]:
    """What each bit of a seed becomes after some steps."""
    out = [1 << i for i in range(23)]
    for _ in range(steps):
        out = [next_seed(v) for v in out]
    return out


def later_seed(seed: int, steps: int) -> int:
    out = 0
    for i, value in enumerate(_leaps(steps)):
        if seed >> i & 1:
            out ^= value
    return out


def fields(data: int, size: int, widths: list[int]) -> np.ndarray:
    """``size`` rows of fields of up to 32 bits, first ones highest, out of a number."""
    total = sum(widths)
    if widths[0] % 8 == 0 and widths == widths[:1] * len(widths):
        whole = widths[0] // 8
        wide = np.zeros((size * len(widths), 4), np.uint8)
        wide[:, 4 - whole :] = np.frombuffer(data.to_bytes(size * total // 8, "big"), np.uint8).reshape(-1, whole)
        return wide.view(">u4").reshape(size, -1).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(data.to_bytes((size * total + 7) // 8, "big"), np.uint8))[-size * total :].reshape(size, total)
    out, at = np.empty((size, len(widths)), np.int64), 0
    for c, width in enumerate(widths):
        wide = np.zeros((size, 32), np.uint8)
        wide[:, 32 - width :] = bits[:, at : at + width]
        out[:, c] = np.packbits(wide).view(">u4")
        at += width
    return out


@dataclass
class Filter:
    order: int = 0
    q: int = 0
    coeffs: list[int] = field(default_factory=list)
    states: list[int] | None = None


@dataclass
class Channel:
    a: Filter = field(default_factory=Filter)
    b: Filter = field(default_factory=Filter)
    huff_offset: int = 0
    huff_type: int = 0
    huff_lsbs: int = 24
    quantiser: int = 0
    outputs: list[int] = field(default_factory=lambda: [0] * 8)
    feedback: list[int] = field(default_factory=lambda: [0] * 8)


@dataclass
class Primitive:
    channel: int = 0
    frac: int = 0
    shift: int = 0
    bypass: int = 0
    scale: int = 0
    mask: int = 0
    delta_bits: int = 0
    delta_precision: int = 0
    coeffs: list[int] = field(default_factory=lambda: [0] * 18)
    deltas: list[int] = field(default_factory=lambda: [0] * 18)


class Substream:
    """What a restart header sets and the blocks after it change."""

    def __init__(self, header: dict):
        self.__dict__.update(header)
        self.guards = 0xFF
        self.block_size = 8
        self.channels = [Channel() for _ in range(16)]
        self.output_shift = [0] * 16
        self.matrices: list[Primitive] = []
        self.digest = 0
        self.table: list[int] = []
        self.rows: list[list[int]] = []
        self.out: list[list[int]] = []
        self.width = 0


class Interval:
    """Reads the units of an interval in order; ``wanted`` presentations are decoded, or none."""

    def __init__(self, wanted: list[int] | None = None, dither_table: list[int] | None = None):
        self.wanted, self.dither_table = wanted, dither_table
        self.sync: dict | None = None
        self.substreams: dict[int, Substream] = {}
        self.notes: list[tuple[str, str, int]] = []
        self.effective: list[int] = []

    def note(self, rule: str, level: str, r: BitReader) -> None:
        self.notes.append((rule, level, r.at))

    def unit(self, data: bytes) -> dict:
        """Everything one unit holds; ``notes`` and, if it ended early, ``stopped`` tell what is wrong with it."""
        self.notes = []
        out: dict = {"major": None, "directory": [], "restarts": [], "blocks": [], "extra": None, "pcm": {}, "stopped": None, "segments": []}
        r = BitReader(data)
        try:
            self._unit(r, data, out)
        except Stop as stop:
            out["stopped"] = stop.rule
            self.note(stop.rule, "fatal", r)
        except B.EndOfData:
            out["stopped"] = "other.unclassified"
            self.note("other.unclassified", "fatal", r)
        out["notes"] = self.notes
        return out

    def _unit(self, r: BitReader, data: bytes, out: dict) -> None:
        out["check_nibble"], out["length"], out["input_timing"] = r.get(4), r.get(12), r.get(16)
        parity = B.nibble(data[:4])
        if r.peek(32) in (FBA, FBB):
            out["major"] = self.sync = self._major(r, data)
            if self.wanted is not None:
                self.effective = effective_presentations(self.sync["masks"], self.wanted)
        elif self.sync is None:
            raise Stop("access_unit.missing_initial_sync")
        sync = self.sync
        if not sync["substreams"]:
            raise Stop("access_unit.no_substream")
        start = r.at
        for i in range(sync["substreams"]):
            out["directory"].append(self._directory(r, out["major"] is not None))
        parity ^= B.nibble(data[start >> 3 : r.at >> 3])
        if parity != 15:
            raise Stop("access_unit.nibble_parity")
        base = r.at
        first_timing: list[int] = []
        for i, entry in enumerate(out["directory"]):
            self._segment(r, data, i, entry, base, out, first_timing)
        end = 16 * out["length"]
        timing_bits = {x["hires"] for x in out["restarts"] if x["block"] == 0}
        if len(timing_bits) > 1:
            self.note("access_unit.hires_output_timing_mismatch", "warning", r)
        if r.at > end:
            raise Stop("access_unit.access_unit_too_long")
        if r.at < end:
            out["extra"] = self._extra(r, data, end)
        if self.wanted is not None:
            self._collect(out)

    # -- configuration

    def _major(self, r: BitReader, data: bytes) -> dict:
        start = r.at
        sync = r.get(32)
        fbb = sync == FBB
        m: dict = {"format_sync": sync}
        if fbb:
            m |= {"quant_1": r.get(4), "quant_2": r.get(4), "rate_code": r.get(4), "rate_code_2": r.get(4)}
            r.skip(4)
            m |= {"channel_type": r.get(4)}
            r.skip(3)
            m |= {"assignment": r.get(5)}
        else:
            m |= {"rate_code": r.get(4), "sixch_type": r.get(1), "eightch_type": r.get(1)}
            r.skip(2)
            m |= {"twoch_modifier": r.get(2), "sixch_modifier": r.get(2), "sixch_assignment": r.get(5), "eightch_modifier": r.get(2), "eightch_assignment": r.get(13)}
        m["frequency"] = sampling_frequency(m["rate_code"])
        m["samples"] = m["frequency"] // 44_100 * 40
        if r.get(16) != SIGNATURE:
            self.note("sync.invalid_major_sync_signature", "warning", r)
        m["flags"] = r.get(16)
        if m["flags"] & RESERVED_FLAGS[sync]:
            self.note("sync.reserved_flags_non_zero", "warning", r)
        if bool(m["flags"] & SYNTAX_MARKER) != fbb:
            raise Stop("sync.invalid_flags_syntax_marker")
        r.skip(16)
        m |= {"variable_rate": r.flag(), "peak": r.get(15), "substreams": r.get(4), "extended_info": r.get(4), "info": r.get(8)}
        if not fbb:
            self._fba_info(m, r)
        else:
            self._fbb_info(m, r)
        m["masks"] = presentation_masks(sync, m["info"], m["extended_info"])
        m["meaning"] = self._fbb_meaning(r) if fbb else self._fba_meaning(r, m)
        crc = B.crc16(data[start >> 3 : r.at >> 3])
        if r.get(16) != crc:
            raise Stop("sync.major_sync_crc_mismatch")
        m["bytes"] = (r.at - start) // 8
        return m

    def _fba_info(self, m: dict, r: BitReader) -> None:
        info, extended = m["info"], m["extended_info"]
        if extended >> 2:
            self.note("sync.reserved_extended_substream_info", "info", r)
        if info & 3:
            self.note("sync.reserved_substream_info", "info", r)
        layout, ext = info & 0x7C, extended & 3
        if layout not in LEGAL_INFO:
            raise Stop("sync.invalid_substream_info")
        if ext == 2 and layout != 0x68 or ext == 1 and layout & 0x78 != 0x48:
            self.note("sync.substream_info_in_compatible", "warning", r)
        if not info >> 7 and ext:
            self.note("sync.reserved_extended_substream_info", "info", r)
        if (info >> 4) & 7 == (info & 0xFC) >> 2 & 0xC:
            if m["sixch_assignment"] != m["eightch_assignment"]:
                self.note("sync.sixch_and_eightch_channel_assignment_mismatch", "info", r)
            if 1 in (m["sixch_assignment"], m["eightch_assignment"]) and m["sixch_modifier"] != m["eightch_modifier"]:
                self.note("sync.sixch_and_eightch_channel_modifier_mismatch", "warning", r)
        for least, place in ((2, 3), (2, 5), (3, 6), (4, 7)):
            if info >> place & 1 and m["substreams"] < least:
                self.note("sync.substream_count_insufficient", "warning", r)
        if info >> 7:
            expected = 4
        elif info & 0x48 or info & 0x60 == 0x20:
            expected = 2 + (info >> 6 & 1)
        else:
            expected = 1
        if expected != m["substreams"]:
            self.note("sync.substream_count_info_inconsistent", "info", r)

    def _fbb_info(self, m: dict, r: BitReader) -> None:
        if m["extended_info"] or m["info"] >> 4:
            self.note("sync.reserved_before_substream_info", "info", r)
        if m["info"] & 8 and m["substreams"] < 2:
            self.note("sync.substream_count_insufficient", "warning", r)

    def _fba_meaning(self, r: BitReader, m: dict) -> dict:
        out = {"heavy_start_gain": r.signed(6), "control": [r.flag() for _ in range(3)]}
        r.skip(1)
        out["start_gain"] = r.signed(7)
        out |= {"two": [r.get(6), r.get(6)], "six": [r.get(5), r.get(6), r.get(5)], "eight": [r.get(5), r.get(6), r.get(6)]}
        if r.get(1):
            self.note("sync.reserved_channel_meaning_non_zero", "info", r)
        out["extra"] = None
        if r.flag():
            start = r.at
            length = r.get(4)
            extra: dict = {"length": length}
            if m["info"] >> 7:
                extra |= {"norm": r.get(5), "mix": r.get(6), "count": r.get(5) + 1, "dynamic_only": r.flag()}
                if extra["dynamic_only"]:
                    extra["lfe"] = r.flag()
                else:
                    extra["content"] = r.get(4)
                    if extra["content"] & 1:
                        extra["distribute"] = r.flag()
                        r.skip(1)
                        extra["lfe_only"] = r.flag()
                        if not extra["lfe_only"]:
                            r.skip(1)
                            extra["assignment"] = r.get(10)
                    if extra["content"] & 2:
                        extra["intermediate"] = r.get(3)
                    if extra["content"] & 4:
                        extra["objects"] = r.get(5) + 1
            r.at = start
            r.skip(16 * (length + 1))
            out["extra"] = extra
        return out

    def _fbb_meaning(self, r: BitReader) -> dict:
        names = (("fs", 5), ("word_width", 5), ("occupancy", 6), ("kind", 3), ("layout", 10), ("copy", 3), ("level", 16), ("hdcd", 1), ("reserved", 6), ("source", 4), ("summary", 5))
        out = {name: r.get(width) for name, width in names}
        if out["reserved"]:
            self.note("sync.reserved_channel_meaning_non_zero", "info", r)
        return out

    def _directory(self, r: BitReader, is_major: bool) -> dict:
        d = {"extra_word": r.flag(), "restart_nonexistent": r.flag(), "crc_present": r.flag()}
        r.skip(1)
        d |= {"end_ptr": r.get(12), "drc_gain": None, "drc_time": None}
        if d["extra_word"]:
            if self.sync["format_sync"] == FBB:
                raise Stop("substream.invalid_extra_substream_word_fbb")
            d |= {"drc_gain": r.signed(9), "drc_time": r.get(3)}
            r.skip(4)
        if is_major == d["restart_nonexistent"]:
            self.note("substream.invalid_restart_nonexistent", "warning", r)
        return d

    # -- segments and blocks

    def _segment(self, r: BitReader, data: bytes, index: int, entry: dict, base: int, out: dict, first_timing: list[int]) -> None:
        start, samples, block, last = r.at, 0, 0, False
        end = base + 16 * entry["end_ptr"]
        if index in self.substreams:
            self.substreams[index].rows, self.substreams[index].out, self.substreams[index].width = [], [], 0
        while not last:
            if block > 4 or block >= 3 and self.sync["format_sync"] == FBA:
                self.note("substream.too_many_blocks", "warning", r)
            samples += self._block(r, index, block, samples, out, first_timing)
            last = r.flag()
            block += 1
        r.align16()
        if r.at > end:
            raise Stop("substream.substream_size_underflow")
        zero = None
        if end - r.at >= 32 + 16 * entry["crc_present"]:
            if r.peek(18) == TERMINATOR_A:
                r.skip(18)
                if r.flag():
                    zero = r.get(13)
                    if zero >= self.sync["samples"]:
                        self.note("substream.too_many_zero_samples", "warning", r)
                else:
                    zero = 0
                    if r.get(13) != TERMINATOR_B:
                        self.note("substream.invalid_terminator_b", "warning", r)
            else:
                self.note("substream.invalid_termination_word", "warning", r)
        if samples != self.sync["samples"]:
            self.note("substream.sample_count_mismatch", "warning", r)
        if entry["crc_present"]:
            body = data[start >> 3 : r.at >> 3]
            parity, crc = r.get(8), r.get(8)
            if parity != B.parity(body) ^ B.PARITY_SEED:
                raise Stop("substream.parity_mismatch")
            if crc != B.crc8(body, B.SEGMENT_CRC):
                raise Stop("substream.crc_mismatch")
        if r.at % 16:
            raise Stop("substream.unaligned_segment_end")
        if r.at != end:
            raise Stop("substream.substream_end_mismatch")
        out["segments"].append({"substream": index, "blocks": block, "samples": samples, "zero_samples": zero, "bytes": (end - start) // 8})

    def _block(self, r: BitReader, index: int, block: int, done: int, out: dict, first_timing: list[int]) -> int:
        if r.flag():
            if r.flag():
                header = self._restart(r, index, block, first_timing)
                before = self.substreams.get(index)
                self.substreams[index] = Substream(header)
                if before is not None and before.restart_digest is not None:
                    header["digest_before"] = before.digest
                out["restarts"].append(header)
            elif index not in self.substreams:
                self.substreams[index] = Substream(dict(UNSET))
            self._header(r, index)
        if (s := self.substreams.get(index)) is None:
            s = self.substreams[index] = Substream(dict(UNSET))
        declared = None
        if s.error_protect:
            declared = r.get(16)
            if declared > 16_000:
                raise Stop("block.block_data_bits_too_large")
        start = r.at
        for c in range(s.min_chan, s.max_chan + 1):
            if s.channels[c].huff_lsbs > s.max_lsbs:
                raise Stop("block.huff_lsbs_too_large")
        residual, bypassed = self._samples(r, s)
        if declared is not None and r.at - start != declared:
            raise Stop("block.block_data_bit_count_mismatch")
        if s.error_protect:
            r.get(8)
        out["blocks"].append({"substream": index, "block": block, "size": s.block_size, "bits": r.at - start})
        if self.wanted is not None:
            self._recorrelate(s, residual)
            if index in self.effective:
                self._rematrix(index, s, bypassed, done)
        return s.block_size

    def _samples(self, r: BitReader, s: Substream) -> tuple[list[list[int]], list[list[int]]]:
        wide = s.sync_word == SYNC_C
        plan = []
        for c in range(s.min_chan, s.max_chan + 1):
            ch = s.channels[c]
            if ch.quantiser > ch.huff_lsbs:
                raise Stop("block.quantiser_step_too_large")
            low = ch.huff_lsbs - ch.quantiser
            if ch.huff_type:
                shift = low + 2 - ch.huff_type
                centre = 1 << shift if shift >= 0 else 0
            else:
                centre = 1 << (low - 1) if low else 0
            plan.append((ch.huff_type, low, ch.huff_offset - centre, ch.quantiser))
        bypass = [p.bypass for p in s.matrices]
        if not any(bypass) and (at_once := self._uncoded(r, plan, s.block_size, wide)) is not None:
            return at_once, [[0] * len(bypass)] * len(at_once)
        residual, bypassed = [], []
        for _ in range(s.block_size):
            bypassed.append([r.get(b) if b else 0 for b in bypass])
            row = []
            for kind, low, offset, step in plan:
                at = r.at
                if kind:
                    code = huffman.read(r, kind)
                    if code == huffman.DEEPEST and not r.data[(r.at - 1) >> 3] >> (7 - (r.at - 1) % 8) & 1:
                        self.note("block.huffman_ninth_bit_missing", "warning", r)
                    value = (code << low) + (r.get(low) if low else 0) + offset
                else:
                    value = (r.get(low) if low else 0) + offset
                value <<= step
                if not wide:
                    if value >= 1 << 23:
                        raise Stop("block.huffman_positive_saturation")
                    if value < -(1 << 23):
                        raise Stop("block.huffman_negative_saturation")
                    if r.at - at > 29:
                        raise Stop("block.huffman_sample_too_long")
                row.append(value)
            residual.append(row)
        return residual, bypassed

    def _uncoded(self, r: BitReader, plan: list[tuple[int, int, int, int]], size: int, wide: bool) -> list[list[int]] | None:
        """Residuals of fixed widths read at once; None where there are others, or any is out of range, so that reading them one by one tells which."""
        widths = [low for _, low, _, _ in plan]
        total = sum(widths)
        if not total or any(kind for kind, *_ in plan) or r.left() < size * total or not wide and max(widths) > 29:
            return None
        values = (fields(r.peek(size * total), size, widths) + np.array([p[2] for p in plan])) << np.array([p[3] for p in plan])
        if not wide and not -(1 << 23) <= values.min() <= values.max() < 1 << 23:
            return None
        r.skip(size * total)
        return values.tolist()

    def _restart(self, r: BitReader, index: int, block: int, first_timing: list[int]) -> dict:
        start, sync = r.at, self.sync
        fba = sync["format_sync"] == FBA
        h: dict = {"substream": index, "block": block, "sync_word": r.get(14)}
        if h["sync_word"] not in (SYNC_A, SYNC_B, SYNC_C):
            raise Stop("restart_header.invalid_restart_sync_word")
        for name, width in (("output_timing", 16), ("min_chan", 4), ("max_chan", 4), ("max_matrix_chan", 4), ("dither_shift", 4), ("seed", 23), ("max_shift", 4), ("max_lsbs", 5), ("max_bits", 5), ("max_bits_again", 5), ("error_protect", 1), ("lossless_check", 8)):
            h[name] = r.get(width)
        h["max_shift"] -= 16 * (h["max_shift"] >> 3)
        if first_timing and first_timing[0] != h["output_timing"]:
            self.note("restart_header.output_timing_mismatch", "warning", r)
        first_timing.append(h["output_timing"])
        if h["sync_word"] == SYNC_A and index == 1 and not sync["info"] & 8:
            raise Stop("restart_header.invalid_sync_b_for_substream1")
        if h["sync_word"] == SYNC_B and index == 0:
            raise Stop("restart_header.invalid_sync_b_for_substream0")
        if h["sync_word"] == SYNC_C and index != 3:
            raise Stop("restart_header.invalid_sync_c")
        if h["max_bits"] != h["max_bits_again"]:
            raise Stop("restart_header.max_bits_mismatch")
        h["hires"] = r.flag()
        r.skip(2)
        heavy = r.flag() and bool(sync["flags"] & HEAVY_FLAG)
        h |= {"heavy_gain": None, "heavy_time": None}
        if heavy and not fba:
            self.note("restart_header.heavy_drc_present_in_fbb", "warning", r)
        elif heavy:
            h |= {"heavy_gain": r.signed(9), "heavy_time": r.get(3)}
        else:
            r.skip(12)
        assign: list[int] = []
        for i in range(h["max_matrix_chan"] + 1):
            place = r.get(6)
            if place > h["max_matrix_chan"]:
                raise Stop("restart_header.channel_assign_too_high")
            if fba and index == 0 and place != i and sync["frequency"] >= 44_100 << 2:
                raise Stop("restart_header.channel_assign_misordered")
            if place in assign:
                raise Stop("restart_header.channel_assign_duplicate")
            assign.append(place)
        h["assign"] = assign
        size = r.at - start
        whole = int.from_bytes(r.data, "big") >> (r.size - r.at) & ((1 << size) - 1)
        if r.get(8) != B.crc8_bits(whole, size, B.HEADER_CRC):
            raise Stop("restart_header.restart_header_crc_mismatch")
        h |= {"restart_digest": 0, "digest_before": None}
        return h

    def _header(self, r: BitReader, index: int) -> None:
        s = self.substreams[index]

        def new(guard: int) -> bool:
            return bool(s.guards >> guard & 1) and r.flag()

        if new(GUARDS):
            s.guards = r.get(8)
        if new(BLOCK_SIZE):
            size = r.get(9)
            if not 8 <= size <= 160:
                raise Stop("block.invalid_block_size_range")
            if size > self.sync["samples"]:
                raise Stop("block.block_size_exceeds_au")
            s.block_size = size
        if new(MATRIXING):
            self._matrices(r, index, s)
        if new(OUTPUT_SHIFT):
            for i in range(s.max_matrix_chan + 1):
                shift = r.signed(4)
                if shift > s.max_shift:
                    raise Stop("block.output_shift_too_large")
                s.output_shift[i] = shift
        if new(QUANTISER):
            for i in range(s.max_chan + 1):
                s.channels[i].quantiser = r.get(4)
        for c in range(s.min_chan, s.max_chan + 1):
            if r.flag():
                self._channel(r, s, s.channels[c])

    def _channel(self, r: BitReader, s: Substream, ch: Channel) -> None:
        a = b = None
        if s.guards >> COEFFS_A & 1 and r.flag():
            a = self._filter(r, "a", 8)
        if s.guards >> COEFFS_B & 1 and r.flag():
            b = self._filter(r, "b", 4)
        if a and b:
            if a.order + b.order > 8:
                raise Stop("channel.filter_order_too_high")
            if a.order and b.order and a.q != b.q:
                raise Stop("channel.coeff_q_mismatch")
        ch.a, ch.b = a or ch.a, b or ch.b
        if b and b.states is not None:
            ch.feedback = (b.states + [0] * 8)[:8]
        if s.guards >> HUFF_OFFSET & 1 and r.flag():
            ch.huff_offset = r.signed(15)
        ch.huff_type, ch.huff_lsbs = r.get(2), r.get(5)
        if ch.huff_lsbs > (31 if s.sync_word == SYNC_C else 24):
            raise Stop("channel.huff_lsbs_too_large")

    def _filter(self, r: BitReader, kind: str, most: int) -> Filter:
        f = Filter(order=r.get(4))
        if f.order > most:
            raise Stop(f"filter.filter_{kind}_order_too_high")
        if not f.order:
            return f
        f.q = r.get(4)
        if f.q < 8:
            raise Stop("filter.invalid_coeff_q")
        width, shift = r.get(5), r.get(3)
        if not 1 <= width <= 16:
            raise Stop("filter.invalid_coeff_bits")
        if width + shift > 16:
            raise Stop("filter.total_coeff_bits_too_large")
        f.coeffs = [r.signed(width) << shift for _ in range(f.order)]
        if -32768 in f.coeffs:
            raise Stop("filter.invalid_coeff_value")
        if r.flag():
            if kind == "a":
                raise Stop("filter.filter_a_new_states_not_allowed")
            width, shift = r.get(4), r.get(4)
            f.states = [(r.signed(width) << shift) if width else 0 for _ in range(f.order)]
            if any(not -(1 << 23) <= v < 1 << 23 for v in f.states):
                raise Stop("filter.filter_state_out_of_range")
        return f

    def _matrices(self, r: BitReader, index: int, s: Substream) -> None:
        wide = s.sync_word == SYNC_C
        if not wide:
            fresh = []
            for _ in range(r.get(4)):
                p = Primitive(channel=r.get(4), frac=r.get(4), bypass=r.get(1))
                for c in range(s.max_matrix_chan + 1 + 2 * (s.sync_word == SYNC_A)):
                    p.coeffs[c] = r.signed(p.frac + 2) << (18 - p.frac) if r.flag() else 0
                if s.sync_word == SYNC_B:
                    p.scale = r.get(4)
                fresh.append(p)
            s.matrices = fresh
        else:
            if r.flag():
                if r.flag():
                    s.matrices = [Primitive(channel=r.get(4), frac=r.get(4), shift=r.get(3) - 1, bypass=r.get(2), scale=r.get(4), mask=r.get(s.max_matrix_chan + 1)) for _ in range(r.get(4) + 1)]
                for p in s.matrices:
                    for c in range(s.max_matrix_chan + 1):
                        p.coeffs[c] = r.signed(p.frac + 2) << (18 + p.shift - p.frac) if p.mask >> c & 1 else 0
            if r.flag():
                if r.flag():
                    if r.flag():
                        for p in s.matrices:
                            p.delta_bits, p.delta_precision = r.get(4), r.get(2)
                    for p in s.matrices:
                        for c in range(s.max_matrix_chan + 1):
                            delta = r.signed(p.delta_bits + 1) if p.delta_bits and p.mask >> c & 1 else 0
                            scale = 18 + p.shift - p.frac - p.delta_precision
                            p.deltas[c] = delta << scale if scale >= 0 else delta >> -scale
            else:
                for p in s.matrices:
                    p.deltas = [0] * 18
        for p in s.matrices:
            if p.channel > s.max_matrix_chan:
                self.note("matrix.matrix_channel_too_high", "warning", r)
            elif p.frac > 14:
                self.note("matrix.frac_bits_too_high", "warning", r)
            elif index == 0 and not wide and p.bypass and (self.sync["info"] & 2 or self.sync["frequency"] >= 44_100 << 2):
                self.note("matrix.invalid_lsb_bypass", "warning", r)

    # -- extra data

    def _extra(self, r: BitReader, data: bytes, end: int) -> dict:
        if r.at % 8:
            self.note("extra_data.misaligned_extra_data_start", "warning", r)
        offset = r.at >> 3
        check, length = r.get(4), r.get(12)
        out = {"offset": offset, "length": length, "shape": "padding", "payloads": [], "protection": None, "frame_bytes": 0}
        if not check and not length:
            while r.at < end:
                if r.get(16):
                    self.note("extra_data.padding_not_zero", "warning", r)
            return out
        if B.nibble(data[offset : offset + 2]) != 15:
            self.note("extra_data.length_parity_failed", "warning", r)
        size = 16 * length
        if size > end - r.at:
            self.note("extra_data.extra_data_too_long", "warning", r)
            return out | {"shape": "truncated"}
        if not self.sync["flags"] & EVOLUTION_FLAG:
            r.skip(size)
            return out | {"shape": "opaque"}
        out["shape"] = "evolution"
        if size < 16:
            self.note("extra_data.evo_frame_no_room", "warning", r)
            return out
        start = r.at
        reserved, out["frame_bytes"] = r.get(4), r.get(12)
        if 8 * out["frame_bytes"] + 24 > size:
            self.note("extra_data.evo_frame_too_long", "warning", r)
            return out
        if out["frame_bytes"]:
            self._evolution(r, out)
        while r.at < start + size - 8:
            if r.flag():
                self.note("extra_data.evo_frame_padding_not_zero", "warning", r)
        expected = B.parity(data[start >> 3 : r.at >> 3]) ^ B.PARITY_SEED ^ reserved << 4 ^ reserved
        if r.get(8) != expected:
            self.note("extra_data.extra_data_parity_mismatch", "warning", r)
        return out

    def _evolution(self, r: BitReader, out: dict) -> None:
        start = r.at
        out["version"] = r.get(2)
        if out["version"] == 3:
            out["version"] += r.variable(2, 16)
        out["key"] = r.get(3)
        if out["key"] == 7:
            out["key"] += r.variable(3, 10)
        try:
            while kind := r.get(5):
                config = {name: r.variable(width, groups) if r.flag() else None for name, width, groups in (("sample_offset", 11, 2), ("duration", 11, 2), ("group", 2, 16))}
                config["codec_data"] = r.get(8) if r.flag() else None
                if not r.flag():
                    aligned = config["sample_offset"] is None and r.flag()
                    if aligned:
                        config |= {"create_duplicate": r.flag(), "remove_duplicate": r.flag()}
                    if aligned or config["sample_offset"] is not None:
                        config |= {"priority": r.get(5), "processing": r.get(2)}
                body = bytes(r.get(8) for _ in range(r.variable(8, 4)))
                out["payloads"].append({"id": kind, "config": config, "data": body})
        except B.EndOfData:  # a list that ends with the data ends silently
            pass
        lengths = [PROTECTION_BYTES[r.get(2)], PROTECTION_BYTES[r.get(2)]]
        out["protection"] = {"at": r.at - start, "primary": bytes(r.get(8) for _ in range(lengths[0])), "secondary": bytes(r.get(8) for _ in range(lengths[1]))}

    # -- decoding

    def _recorrelate(self, s: Substream, residual: list[list[int]]) -> None:
        limit = 1 << (31 if s.sync_word == SYNC_C else 23)
        among = s.channels[s.min_chan : s.max_chan + 1]
        if among and not any(ch.a.coeffs or ch.b.coeffs for ch in among) and -limit <= min(map(min, residual)) and max(map(max, residual)) < limit:
            # nothing is predicted
            for ch, newest in zip(among, zip(*residual[:-9:-1], strict=True), strict=True):
                ch.outputs, ch.feedback = [*newest, *ch.outputs][:8], [*newest, *ch.feedback][:8]
            s.rows.extend(residual)
            return
        columns = []
        for k, c in enumerate(range(s.min_chan, s.max_chan + 1)):
            ch = s.channels[c]
            a, b = ch.a.coeffs, ch.b.coeffs
            q = ch.a.q if ch.a.order else ch.b.q
            mask = ~((1 << ch.quantiser) - 1)
            outputs, feedback, column = ch.outputs, ch.feedback, []
            for row in residual:
                total = 0
                for x, y in zip(a, outputs, strict=False):
                    total += x * y
                for x, y in zip(b, feedback, strict=False):
                    total += x * y
                prediction = total >> q
                value = row[k] + (prediction & mask)
                back = value - prediction
                if value >= limit:
                    raise Stop("decode.recorrelator_positive_saturation")
                if value < -limit:
                    raise Stop("decode.recorrelator_negative_saturation")
                if not -limit <= back < limit:
                    raise Stop("decode.filter_b_input_too_wide32" if s.sync_word == SYNC_C else "decode.filter_b_input_too_wide24")
                outputs = [value, *outputs[:7]]
                feedback = [back, *feedback[:7]]
                column.append(value)
            ch.outputs, ch.feedback = outputs, feedback
            columns.append(column)
        s.rows.extend([list(row) for row in zip(*columns, strict=True)])

    def _rematrix(self, index: int, s: Substream, bypassed: list[list[int]], done: int) -> None:
        samples, top = self.sync["samples"], s.max_matrix_chan
        mask = self.sync["masks"][index]
        members = [self.substreams[i] for i in range(index + 1) if mask >> i & 1 and i in self.substreams]
        if s.sync_word != SYNC_A and done == 0:
            s.table, s.seed = dither.indices(samples, s.seed)
            if self.dither_table is None and any(p.scale for p in s.matrices):
                raise Stop("other.unclassified")  # dither is asked for, and there is no table of it
        if not s.matrices:
            return self._unmixed(s, members, done, len(bypassed))
        for k, bypass in enumerate(bypassed):
            at = done + k
            row = [0] * 18
            for m in members:
                if at < len(m.rows):
                    row[m.min_chan : m.max_chan + 1] = m.rows[at]
            if s.sync_word == SYNC_A:
                for place, value in ((top + 1, s.seed >> 15), (top + 2, s.seed >> 7)):
                    value &= 0xFF
                    row[place] = (value - 256 * (value >> 7)) << s.dither_shift
                s.seed = next_seed(s.seed)
            for p, primitive in enumerate(s.matrices):
                total = sum(x * y for x, y in zip(row, primitive.coeffs, strict=True) if y)
                if s.sync_word != SYNC_A and primitive.scale:
                    place = (len(s.matrices) - p) * (2 * at + 1) + at
                    total += self.dither_table[s.table[place & (len(s.table) - 1)]] << (11 + primitive.scale)
                if s.sync_word == SYNC_C:
                    drift = sum(x * y for x, y in zip(row, primitive.deltas, strict=True) if y)
                    total += (drift >> 18) * at * (((1 << 16) // samples) << 2)
                step = s.channels[primitive.channel].quantiser
                row[primitive.channel] = ((total >> 18) & ~((1 << step) - 1)) + bypass[p]
            out = [0] * (top + 1)
            for c in range(top + 1):
                shift = s.output_shift[c]
                value = row[c] << shift if shift >= 0 else row[c] >> -shift
                out[s.assign[c]] = value
                s.digest ^= (value & 0xFFFFFF) << (c & 7)
                s.width |= value ^ (value >> 31)
            s.out.append(out)
        if s.sync_word == SYNC_C and done + len(bypassed) == samples:
            for p in s.matrices:
                p.coeffs = [x + y for x, y in zip(p.coeffs, p.deltas, strict=True)]

    def _unmixed(self, s: Substream, members: list[Substream], done: int, size: int) -> None:
        """Outputs of a block without matrices: channels shifted and in their places."""
        top = s.max_matrix_chan + 1
        rows = np.zeros((size, 18), np.int64)
        for m in members:
            part = m.rows[done : done + size]
            if part:
                rows[: len(part), m.min_chan : m.max_chan + 1] = part
        if s.sync_word == SYNC_A:
            s.seed = later_seed(s.seed, size)
        rows = rows[:, :top]
        if any(s.output_shift[:top]):
            shifts = np.array(s.output_shift[:top])
            rows = rows << np.maximum(shifts, 0) >> np.maximum(-shifts, 0)
        for c, value in enumerate(np.bitwise_xor.reduce(rows, axis=0).tolist()):
            s.digest ^= (value & 0xFFFFFF) << (c & 7)
        s.width |= int(np.bitwise_or.reduce((rows ^ (rows >> 31)).reshape(-1)))
        out = np.zeros((size, top), np.int64)
        out[:, s.assign[:top]] = rows
        s.out.extend(out.tolist())

    def _collect(self, out: dict) -> None:
        for index in self.effective:
            s = self.substreams.get(index)
            if s is None:
                continue
            if s.width >> s.max_bits:
                self.notes.append(("decode.outputs_exceed_max_bits", "warning", 0))
            zero = next((x["zero_samples"] or 0 for x in out["segments"] if x["substream"] == index), 0)
            out["pcm"][index] = s.out[: max(0, self.sync["samples"] - zero)]


def folded(digest: int) -> int:
    """A digest as the check byte that the next restart header of the substream carries."""
    digest &= 0xFFFFFFFF
    digest ^= digest >> 16
    return (digest ^ digest >> 8) & 0xFF
