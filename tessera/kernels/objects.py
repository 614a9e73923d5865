"""Object metadata: programme, per-object blocks, trims, headphone and description elements.

A block inherits what it doesn't state from the block before of the same
object; a gain may repeat the previous object's at the same block.
"""

from __future__ import annotations

import math

from tessera.kernels.bits import BitReader

PAYLOAD_ID = 11
SILENT = -128

# Fixed values of the format.
STANDARD_BEDS = [(0, 1), (2,), (3,), (4, 5), (6, 7), (8, 9), (10, 11), (12, 13), (14, 15), (16,)]
SPEAKERS = ["L", "R", "C", "LFE", "Lss", "Rss", "Lrs", "Rrs", "Lfh", "Rfh", "Lts", "Rts", "Lrh", "Rrh", "Lw", "Rw", "LFE2"]
INTERMEDIATE_COUNTS = [4, 8, 10, 14, 15, 30, 0, 0]
SAMPLE_OFFSETS = [8, 16, 18, 24]
RAMPS = [32, 64, 128, 256, 320, 480, 1000, 1001, 1024, 1600, 1601, 1602, 1920, 2000, 2002, 2048]
DISTANCES = [1.1, 1.3, 1.6, 2.0, 2.5, 3.2, 4.0, 5.0, 6.3, 7.9, 10.0, 12.6, 15.8, 20.0, 25.1, 50.1]
PRECISE = [1.0, 2.0, -1.0, -2.0]
DIALOG = [2, 1, 3, 0]
DIVERGENCE = [0.500755, 0.608529, 0.704833, 1.0]
TRIMS = [6.0, 3.0, 1.5, 0.75, -0.75, -1.5, -3.0, -4.5, -6.0, -7.5, -9.0, -10.5, -12.0, -13.5, -15.0, -36.0]
DIVERGENCE_CODES = [
    0.0, 0.0, 0.004026, 0.00716, 0.012731, 0.020173, 0.028485, 0.04021, 0.050582, 0.063601,
    0.079914, 0.100299, 0.125666, 0.140532, 0.157027, 0.175282, 0.195417, 0.217536, 0.241718, 0.268002,
    0.296377, 0.326766, 0.359017, 0.392895, 0.428081, 0.464184, 0.500755, 0.537316, 0.573389, 0.608529,
    0.642346, 0.674524, 0.704833, 0.733123, 0.75932, 0.783416, 0.805451, 0.825506, 0.843686, 0.860112,
    0.874914, 0.888222, 0.900168, 0.910875, 0.920461, 0.929035, 0.936698, 0.943544, 0.949656, 0.955112,
    0.95998, 0.964322, 0.968195, 0.974729, 0.979923, 0.98405, 0.98733, 0.989935, 0.992874, 0.994955,
    0.996817, 0.99821, 0.998993, 1.0,
]
ZONES = ["all", "no back", "no sides", "center back", "screen only", "surround only"]
OBJECT, TRIM, HEADPHONE, DESCRIPTION, EXTENDED = 1, 2, 3, 4, 5
TRIM_NAMES = ["trim_centre", "trim_surround", "trim_height", "balance_top", "balance_listener"]


class Unsupported(ValueError):
    """A reserved code that has no meaning to decode."""


def bed_id(place: int) -> int:
    """Output channel of a bed speaker: the usual ten first, the others from 128 on."""
    if place < 8:
        return place
    if place < 10:
        return place + 122
    return place - 2 if place < 12 else place + 120


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def parse(data: bytes) -> dict:
    """One payload; elements that aren't known are skipped by their size."""
    r = BitReader(data)
    version = r.get(2)
    if version == 3:
        version += r.get(3)
    if version:
        raise Unsupported(f"object metadata version {version}")
    count = r.get(5)
    if count == 31:
        count += r.get(7)
    out: dict = {"count": count + 1, "elements": [], "object": None, "trim": None, "extended": None, "headphone": None, "description": None}
    out["programme"] = _programme(r, out["count"])
    alternate = r.flag()
    elements = r.get(4)
    if elements == 15:
        elements += r.get(5)
    for _ in range(elements):
        _element(r, out, alternate)
    return out


def _programme(r: BitReader, count: int) -> dict:
    p: dict = {"beds": [], "distribute": False, "intermediate": 0, "dynamic": 0}
    if r.flag():
        p["dynamic"] = count
        if r.flag():
            p["beds"].append([3])
            p["dynamic"] -= 1
    else:
        content = r.get(4)
        if content & 1:
            p["distribute"] = r.flag()
            for _ in range(r.get(3) + 2 if r.flag() else 1):
                if r.flag():
                    p["beds"].append([3])
                elif r.flag():
                    bits = r.get(10)
                    p["beds"].append(sorted(s for i, group in enumerate(STANDARD_BEDS) if bits >> i & 1 for s in group))
                else:
                    bits = r.get(17)
                    p["beds"].append([i for i in range(17) if bits >> i & 1])
        if content & 2:
            p["intermediate"] = INTERMEDIATE_COUNTS[r.get(3)]
        if content & 4:
            dynamic = r.get(5)
            if dynamic == 31:
                dynamic += r.get(7)
            p["dynamic"] = dynamic + 1
        if content & 8:
            r.skip(8 * (r.get(4) + 1))
    p["bed_objects"] = sum(map(len, p["beds"]))
    return p


def _element(r: BitReader, out: dict, alternate: bool) -> None:
    kind = r.get(4)
    size = 8 * (r.variable(4, 4) + 1)
    end = min(r.at + size, r.size)
    if alternate:
        r.get(4)
    r.get(1)
    readers = {OBJECT: ("object", _object), TRIM: ("trim", _trim), EXTENDED: ("extended", _extended), HEADPHONE: ("headphone", _headphone), DESCRIPTION: ("description", _description)}
    if kind in readers:
        name, read = readers[kind]
        out[name] = read(r, out)
    out["elements"].append(kind)
    if end > r.at:
        r.skip(end - r.at)


def _object(r: BitReader, out: dict) -> dict:
    code = r.get(2)
    if code == 3:
        raise Unsupported("reserved sample offset code")
    offset = (0, None, None)[code]
    if code == 1:
        offset = SAMPLE_OFFSETS[r.get(2)]
    elif code == 2:
        offset = r.get(5)
    blocks = r.get(3) + 1
    updates = []
    for _ in range(blocks):
        factor, ramp = r.get(6), r.get(2)
        duration = (0, 512, 1536, 0)[ramp]
        if ramp == 3:
            duration = RAMPS[r.get(4)] if r.flag() else r.get(11)
        updates.append({"factor": factor, "ramp": duration})
    if not r.flag():
        r.get(5)
    anchored = out["programme"]["bed_objects"] + out["programme"]["intermediate"]
    gains: list[int] = [0] * blocks
    objects = []
    for index in range(out["count"]):
        basic, render, row = None, None, []
        for block in range(blocks):
            active = not r.flag()
            basic = _basic(r, basic if block else None, active, block, index, gains)
            in_bed = index < anchored
            render = _render(r, render if block else None, active and not in_bed, block)
            if r.flag():
                r.skip(8 * (r.get(4) + 1))
            row.append({"active": active, "in_bed": in_bed} | basic | render)
        objects.append(row)
    return {"sample_offset": offset, "updates": updates, "objects": objects}


def _basic(r: BitReader, before: dict | None, active: bool, block: int, index: int, gains: list[int]) -> dict:
    default = {"gain": SILENT, "priority": 0.0}
    status = 0 if not active else 1 if block == 0 else r.get(2)
    if status == 0:
        return default
    out = dict(before or default)
    if status == 2:
        return out
    what = 3 if status == 1 else r.get(2)
    if what & 1:
        code = r.get(2)
        if code == 2:
            step = r.get(6)
            out["gain"] = 15 - step if step <= 14 else 14 - step
        else:
            out["gain"] = (0, SILENT, None, gains[block] if index else 0)[code]
        gains[block] = out["gain"]
    if what & 2:
        out["priority"] = 1.0 if r.flag() else r.get(5) / 32
    return out


def _render(r: BitReader, before: dict | None, stated: bool, block: int) -> dict:
    default = {"position": [0.5, 0.5, 0.0], "distance": None, "zones": 0, "elevation": True, "size": [0.0, 0.0, 0.0], "screen_factor": 0.0, "depth_factor": 0.25, "snap": False}
    status = 0 if not stated else 1 if block == 0 else r.get(2)
    if status == 0:
        return default
    out = dict(before or default)
    if status == 2:
        return out
    what = 15 if status == 1 else r.get(4)
    if what & 1:
        if block and r.flag():
            step = [r.signed(3) / 62, r.signed(3) / 62, r.signed(3) / 15]
            place = [a + b for a, b in zip(out["position"], step, strict=True)]
        else:
            x, y = r.get(6) / 62, r.get(6) / 62
            sign = 1 if r.flag() else -1
            place = [x, y, sign * r.get(4) / 15]
        out["position"] = [clamp(place[0], 0, 1), clamp(place[1], 0, 1), clamp(place[2], -1, 1)]
        out["distance"] = None
        if r.flag():
            out["distance"] = math.inf if r.flag() else DISTANCES[r.get(4)]
    if what & 2:
        out["zones"] = r.get(3) % 7
        out["elevation"] = r.flag()
    if what & 4:
        kind = r.get(2)
        out["size"] = [0.0] * 3
        if kind == 1:
            out["size"] = [r.get(5) / 31] * 3
        elif kind == 2:
            out["size"] = [r.get(5) / 31 for _ in range(3)]
    if what & 8:
        out["screen_factor"] = 0.0
        if r.flag():
            out["screen_factor"], out["depth_factor"] = (r.get(3) + 1) / 8, 0.25 * (r.get(2) + 1)
    out["snap"] = r.flag()
    return out


def _trim(r: BitReader, out: dict) -> dict:
    t: dict = {"warp": r.get(2), "reserved": r.get(2), "mode": r.get(2), "trims": [None] * 9, "bypass": None}
    if t["mode"] == 2:
        for i in range(9):
            trim: dict = {"automatic": r.flag(), "disabled": False}
            if not trim["automatic"]:
                trim["disabled"] = r.flag()
                if not trim["disabled"]:
                    present = r.get(5)
                    for k, name in enumerate(TRIM_NAMES):
                        if present >> k & 1:
                            if k < 3:
                                trim[name] = TRIMS[r.get(4)]
                            else:
                                sign = 1 if r.flag() else -1
                                trim[name] = sign * (r.get(4) + 1) / 16
            t["trims"][i] = trim
    if r.flag():
        t["bypass"] = [r.flag() for _ in range(out["count"])]
    return t


def _extended(r: BitReader, out: dict) -> dict:
    e: dict = {"divergence": None, "precise": None}
    stated = r.flag()
    if out["object"] is None:
        return e
    objects = out["object"]["objects"]
    if stated:
        e["divergence"] = []
        for row in objects:
            values: list[float] = []
            for block in row:
                value = 0.0
                if block["active"] and not block["in_bed"] and r.flag():
                    mode = r.get(2)
                    if mode == 0:
                        value = DIVERGENCE[r.get(2)]
                    elif mode == 1:
                        value = values[-1] if values else 0.0
                    else:
                        value = DIVERGENCE_CODES[r.get(6)]
                values.append(value)
            e["divergence"].append(values)
    if r.flag():
        e["precise"] = []
        for row in objects:
            steps = []
            for block in row:
                step = [0.0, 0.0, 0.0]
                if block["active"] and not block["in_bed"] and r.flag():
                    present = r.get(3)
                    for k, scale in enumerate((310, 310, 75)):
                        if present >> k & 1:
                            step[k] = PRECISE[r.get(2)] / scale
                steps.append(step)
            e["precise"].append(steps)
    return e


def _headphone(r: BitReader, out: dict) -> dict:
    mode, blocks, programme = r.get(3), r.get(3) + 1, out["programme"]
    h: dict = {"mode": mode, "objects": []}
    if mode <= 2:
        one = (mode, True if mode == 0 else r.flag())
        h["objects"] = [[one] * blocks for _ in range(out["count"])]
    elif mode == 3:
        first = programme["bed_objects"]
        for i in range(out["count"]):
            if first < i < first + programme["intermediate"]:
                h["objects"].append(h["objects"][first])
            else:
                h["objects"].append([(min(2, r.get(2)), r.flag()) for _ in range(blocks)])
    return h


def _description(r: BitReader, out: dict) -> dict:
    blocks = r.get(3) + 1
    d: dict = {"present": r.flag(), "dialog": []}
    if not d["present"]:
        return d
    mode = r.get(2)
    if mode == 0:
        d["dialog"] = [[1 if r.flag() else 2 for _ in range(blocks)] for _ in range(out["count"])]
    elif mode == 1:
        more = r.flag()
        for _ in range(out["count"]):
            row = []
            for _ in range(blocks):
                code = r.get(2)
                if code == 2 and more:
                    r.skip(5)
                row.append(DIALOG[code])
            d["dialog"].append(row)
    else:
        size = r.get(5) + 1
        if r.flag():
            size += r.variable(2, 3)
        d["dialog"] = [[0] * blocks for _ in range(out["count"])]
        r.skip(8 * size)
    return d


def positions(payload: dict) -> list[list[list[float]]]:
    """Room positions of all objects and blocks, -1 to 1, with the precise steps added."""
    out = []
    precise = (payload["extended"] or {}).get("precise")
    for i, row in enumerate(payload["object"]["objects"] if payload["object"] else []):
        places = []
        for k, block in enumerate(row):
            x, y, z = (a + (precise[i][k][n] if precise else 0.0) for n, a in enumerate(block["position"]))
            places.append([(clamp(x, 0, 1) - 0.5) * 2, (0.5 - clamp(y, 0, 1)) * 2, clamp(z, -1, 1)])
        out.append(places)
    return out


def events(payload: dict, sample: int) -> list[dict]:
    """One event for each object of a payload with one block, one bed and no intermediate format."""
    if payload["object"] is None:
        return []
    element, programme = payload["object"], payload["programme"]
    if len(element["updates"]) != 1 or len(programme["beds"]) != 1 or programme["intermediate"]:
        raise Unsupported("several update blocks or beds, or an intermediate format")
    trim, bed, places = payload["trim"], programme["beds"][0], positions(payload)
    bypass = [False] * payload["count"]
    if trim:
        bypass = trim["bypass"] or [trim["mode"] == 1] * payload["count"]
    ramp = element["updates"][0]["ramp"]
    out = []
    for i, row in enumerate(element["objects"]):
        block = row[0]
        event = {
            "id": bed_id(bed[i]) if block["in_bed"] else i + 10 - len(bed),
            "sample_pos": sample + element["sample_offset"],
            "active": block["active"],
            "importance": block["priority"],
            "gain": "-inf" if block["gain"] == SILENT else str(block["gain"]),
            "ramp_length": ramp,
            "trim_bypass": bypass[i],
            "head_track_mode": "undefined",
            "binaural_render_mode": "off" if block["in_bed"] else "undefined",
        }
        if not block["in_bed"]:
            zone = block["zones"]
            event |= {"pos": places[i][0], "snap": block["snap"], "elevation": block["elevation"], "zones": ZONES[zone] if zone < len(ZONES) else ZONES[0], "size": block["size"][0], "dialog": -1, "music": -1, "screen_factor": block["screen_factor"], "depth_factor": block["depth_factor"]}
        out.append(event)
    return out


def restates(payload: dict) -> bool:
    """Whether a payload only repeats the state: no offset and no ramp anywhere."""
    element = payload["object"]
    return element is not None and element["sample_offset"] == 0 and all(u["factor"] == 0 and u["ramp"] == 0 for u in element["updates"])
