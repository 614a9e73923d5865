"""The serial output-timing field: one bit for each restart header.

Five zeros lead in, a one starts a field.  Inside it a one is stuffed after
every four zeros that follow a one or each other, so five zeros can only end
the field, and lead in the next.  A field is the high half of an output time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

MASK = 0xFFFFFFFF


def fields(bits: Iterable[tuple[int, bool, int]]) -> Iterator[dict]:
    """Fields and faults of (au, bit, output_timing) in order: {"au", "output_timing", "value"} or {"au", "fault"}."""
    zeros, start, value, held, read = 0, None, 0, False, 0
    for au, bit, output in bits:
        if start is None:  # leading in
            if bit and zeros == 5:
                start, value, held, zeros, read = (au, output), 0, False, 0, 0
            elif not bit and zeros == 5:
                yield {"au": au, "fault": "a sixth 0 before a field"}
                zeros = 0
            else:
                zeros = 0 if bit else zeros + 1
        elif bit:
            # a one that is held back counts only when the next one shows that the field goes on
            value = (value << 1 | 1) << zeros if held else value << zeros
            read += zeros + held
            held, zeros = zeros < 4, 0
        elif zeros < 4:
            zeros += 1
        elif held:
            yield {"au": start[0], "output_timing": start[1], "value": value}
            start, zeros = None, 5
        else:
            yield {"au": start[0], "fault": "a 0 where a stuffed 1 belongs"}
            start, zeros = None, 0


def check(found: Iterable[dict], samples: int) -> Iterator[dict]:
    """Start times from first fields ({"au", "start"}), and what does not continue the field before ({"au", "rule"})."""
    before = None
    for item in found:
        if "fault" in item:
            yield {"au": item["au"], "rule": "restart_header.invalid_hires_output_timing"}
            continue
        if before is None:
            yield {"au": item["au"], "start": ((item["value"] << 16) + item["output_timing"] - item["au"] * samples) & MASK}
        else:
            steps = ((item["au"] - before["au"]) * samples + before["output_timing"]) & MASK
            if (item["value"] - before["value"]) & MASK != steps >> 16:
                yield {"au": item["au"], "rule": "restart_header.invalid_hires_output_timing_sequence"}
                before = None
                continue
        before = item


def serialise(value: int, width: int) -> list[bool]:
    """The bits of a field, with its lead-in and its end."""
    out: list[bool] = [False] * 5 + [True]
    zeros = 0
    for place in range(width - 1, -1, -1):
        bit = bool(value >> place & 1)
        out.append(bit)
        zeros = 0 if bit else zeros + 1
        if zeros == 4:
            out.append(True)
            zeros = 0
    return [*out, True] + [False] * 5
