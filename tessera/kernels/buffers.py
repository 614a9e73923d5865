"""The buffer model unit by unit, for epochs in which its closed form does not hold.

Arrivals wait in a ring of 128 places, each with the time at which it leaves.
Before a unit's bytes are added, everything that the input clock has passed
leaves; a buffer that would fall below zero is empty, and the leaving stops.
Parts of buffers are followed beside them: they are empty when the buffer is,
never run dry themselves and stop nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

PLACES = 128


def replay(units: Iterable[tuple[int, int, tuple[int, ...]]], parts: int = 0) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """For each (input clock, leaving time, bytes by buffer) the depths after it, and the last buffer that ran dry, if any.

    The last ``parts`` sizes are of parts; the k-th belongs to the k-th buffer, those beyond to none.
    """
    ring: list[tuple[int, tuple[int, ...]] | None] = [None] * PLACES
    oldest = newest = 0
    depths: list[int] = []
    for clock, leaves, sizes in units:
        depths = depths or [0] * len(sizes)
        whole = len(sizes) - parts
        ring[newest] = (leaves, sizes)
        dry = None
        for _ in range(PLACES):
            record = ring[oldest] or (0, (0,) * len(sizes))  # a place never used leaves at once
            if clock <= record[0]:
                break
            empty = []
            for k, size in enumerate(record[1]):
                if size <= depths[k]:
                    depths[k] -= size
                else:
                    depths[k] = 0
                    if k < whole:
                        dry = k
                        empty.append(k)
            for k in empty:
                if k < parts:
                    depths[whole + k] = 0
            oldest = (oldest + 1) % PLACES
            if dry is not None:
                break
        depths = [a + b for a, b in zip(depths, sizes, strict=True)]
        newest = (newest + 1) % PLACES
        yield tuple(depths), dry
