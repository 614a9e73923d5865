"""The header document of an object master: presentation, beds, objects, trims."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.kernels import objects
from tessera.sinks.events import scalar

# Names of the trim settings in the order they are coded, and the names of their values.
TRIM_MODES = [f"{s}Surrounds{h}Heights" for h in ("No", "Some", "Many") for s in ("No", "Some", "Many")]
TRIM_VALUES = {"trim_centre": "centerTrim", "trim_surround": "surroundTrim", "trim_height": "heightTrim", "balance_top": "frontBackBalanceOverheadFloor", "balance_listener": "frontBackBalanceListener"}
WARPS = ["normal", "warping", "ProLogicIIx", "LoRo"]


def beds(payload: dict) -> list[list[tuple[str, int]]]:
    """For each bed its (speaker, output channel)."""
    return [[(objects.SPEAKERS[place], objects.bed_id(place)) for place in bed] for bed in payload["programme"]["beds"]]


def object_ids(payload: dict) -> list[int]:
    """Output channels of the moving objects: from 10 on."""
    return [10 + i for i in range(payload["programme"]["dynamic"])]


def lines(payload: dict, base: str, fps: str = "24", warp: str | None = None, version: str = "0.5.1") -> Iterator[str]:
    """The document's lines; the stream doesn't say its frame rate, and ``warp`` replaces what it says of warping."""
    yield f"version: {version}"
    yield "presentations:"
    yield "  - type: home"
    yield "    simplified: false"
    yield f"    metadata: {scalar(base + '.metadata')}"
    yield f"    audio: {scalar(base + '.audio')}"
    yield "    offset: 0"
    yield f"    fps: {fps}"
    if payload["programme"]["beds"]:
        yield f"    scBedConfiguration: {scalar(payload['programme']['beds'][0])}"
    trim = payload["trim"]
    if warp or trim:
        yield f"    warpMode: {warp or WARPS[trim['warp']]}"
    stated = [(mode, t) for mode, t in zip(TRIM_MODES, trim["trims"], strict=True) if t and not t["automatic"]] if trim else []
    if stated:
        yield "    trimMode:"
        for mode, t in stated:
            yield f"        {mode}:"
            for key, name in TRIM_VALUES.items():
                if key in t:
                    yield f"            {name}: {scalar(t[key])}"
    yield "    bedInstances:" + ("" if payload["programme"]["beds"] else " []")
    for bed in beds(payload):
        yield "      - channels:"
        for speaker, channel in bed:
            yield f"          - channel: {speaker}"
            yield f"            ID: {channel}"
    ids = object_ids(payload)
    yield "    objects:" + ("" if ids else " []")
    for channel in ids:
        yield f"      - ID: {channel}"
