"""Splices of a stream: where timing jumps, and whether a decoder can play across.

Each unit is compared with the last one before it that was no valid splice.  A
valid splice shifts the output clock; any other starts a new epoch, in which
clocks and buffers begin anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

CONDITIONS = ("advance_step", "fifo_duration", "within_75ms", "data_rate")
CAUSES = ("branch_advance_too_large", "branch_advance_exceeds_buffer", "branch_advance_exceeds_75ms", "branch_data_rate_exceeded")
WRAP = 0xFFFF


def _duration(length: int, peak: int) -> int:
    return -(-length * 256 // peak) if peak else 0


def follow(rows: Iterable[dict], tolerant: bool = True) -> Iterator[dict]:
    """For each unit its epoch, unwrapped input time, advance, and, at a splice, the conditions that failed; and its rules.

    A row has au, input, length, samples, frequency, peak, variable, and, at a
    restart, output.
    """
    before: dict | None = None  # what the next unit is compared with
    epoch = deviation = output = clock = major = first_output = 0
    spliced = False
    for row in rows:
        samples, peak, now = row["samples"], row["peak"], row["input"]
        limit = -(-row["frequency"] * 3 // 40)
        rules: list[str] = []
        failed = None
        arrival = (now - deviation) & WRAP
        while before is not None and before["arrival"] > arrival:
            arrival += WRAP + 1
        jump = False
        if before is not None:
            interval = arrival - before["arrival"] if spliced else (now - before["input"]) & WRAP
            jump = interval < samples // 4 or interval < before["duration"] or interval > limit
            jump = jump or (row["variable"] and before["length"] * 256 > interval * peak)
        was_spliced, spliced, fresh = spliced, False, before is None
        if row.get("output") is not None:
            major, output = row["au"], row["output"]
            advance = (output - samples - now) & WRAP
            if before is None:
                first_output = output + (WRAP + 1) * (output < now)
                clock = first_output
            else:
                expected = (deviation + samples + clock) & WRAP
                jump = jump or (tolerant and before["peak"] != peak)
                if expected != output:
                    if not tolerant:
                        rules.append("restart_header.invalid_output_timing")
                    elif was_spliced:
                        rules.append("restart_header.output_timing_after_jump")
                    jump = jump or tolerant
                clock += samples
                if jump:
                    step = (samples + before["advance"] - advance) & WRAP
                    if step == 0:
                        rules.append("restart_header.zero_input_timing_interval")
                    else:
                        met = (
                            advance <= before["advance"] + 3 * (samples // 4),
                            advance <= before["advance"] + samples - before["duration"],
                            advance <= limit - samples,
                            before["length"] * 256 <= before["peak"] * step,
                        )
                        failed = [name for name, good in zip(CONDITIONS, met, strict=True) if not good]
                        if not failed:
                            spliced = True
                            deviation = (output - first_output - row["au"] * samples) & WRAP
                            arrival = (now - deviation) & WRAP
                            while before["arrival"] > arrival:
                                arrival += WRAP + 1
                        else:
                            rules += [f"restart_header.{cause}" for cause, good in zip(CAUSES, met, strict=True) if not good]
                            rules.append("restart_header.invalid_seamless_branch")
                            epoch, deviation, arrival, fresh = epoch + 1, 0, now, True
                            first_output = output + (WRAP + 1) * (output < now)
                            clock = first_output
        else:
            clock += samples
            advance = (((row["au"] - major) * samples + output - now) & WRAP) - samples
        yield {"au": row["au"], "epoch": epoch, "unwrapped": arrival, "advance": advance, "fresh": fresh, "failed": failed, "valid": None if failed is None else not failed, "rules": rules}
        if not spliced:
            before = {"input": now, "arrival": arrival, "length": row["length"], "duration": _duration(row["length"], peak), "advance": advance, "peak": peak}
