"""What a stream's configuration fields mean, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bits import bit

FBA, FBB = 0xF8726FBA, 0xF8726FBB
PRESENTATIONS = 4

# The labels that each bit of a channel assignment stands for, lowest bit first.
SIXCH = [["L", "R"], ["C"], ["LFE"], ["Ls", "Rs"], ["Tfl", "Tfr"]]
EIGHTCH = [["L", "R"], ["C"], ["LFE"], ["Ls", "Rs"], ["Tfl", "Tfr"], ["Lsc", "Rsc"], ["Lb", "Rb"], ["Cb"], ["Tc"], ["Lsd", "Rsd"], ["Lw", "Rw"], ["Tfc"], ["LFE2"]]
EIGHTCH_RESTRICTED = [["L", "R"], ["C"], ["LFE"], ["Ls", "Rs"], ["Tsl", "Tsr"]]
SIXTEENCH = [["L", "R"], ["C"], ["LFE"], ["Ls", "Rs"], ["Lb", "Rb"], ["Tfl", "Tfr"], ["Tsl", "Tsr"], ["Tbl", "Tbr"], ["Lw", "Rw"], ["LFE2"]]
GROUPS = ["Stereo", "Lt/Rt", "Lbin/Rbin", "Dual Mono"]

# Speaker bits of the extensible wave header; labels without a bit are absent.
WAVE_BITS = {
    "L": 0x1, "R": 0x2, "C": 0x4, "LFE": 0x8, "Lb": 0x10, "Rb": 0x20, "Cb": 0x100, "Ls": 0x200, "Rs": 0x400,
    "Tc": 0x800, "Tfl": 0x1000, "Tfr": 0x4000, "Tbl": 0x10000, "Tbr": 0x40000,
}

# Byte caps of the buffer model.
FBA_CAPS = {"substream0": 30_000, "sixch": 90_000, "eightch": 120_000, "sixteench": 120_000, "whole": 120_000}
FBB_SUBSTREAM0_CAPS = [90_000, 30_000, 0, 30_000, 0, 0, 0, 0, 0, 30_000]
FBB_STREAM_CAPS = [90_000, 30_000, 0, 30_000, 0, 0, 0, 0, 0, 90_000]
SEVERITIES = ["info", "warning", "error", "fatal"]


def _and(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask))


def presentation_masks(info: Column, extended: Column, is_fbb: Column) -> Column:
    """The substream masks of the four presentations."""
    shift = _and(extended, 3)
    ladder = F.when(shift == 0, 0).when(shift == 1, 4).when(shift == 2, 6).otherwise(7)
    fba = F.array(F.lit(1), _and(F.shiftright(info, 2), 3), _and(F.shiftright(info, 4), 7), _and(F.shiftright(info, 4), 8).bitwiseOR(ladder))
    fbb = F.array(F.lit(1), F.when(_and(info, 8) != 0, 3).otherwise(0), F.lit(0), F.lit(0))
    return F.when(is_fbb, fbb).otherwise(fba)


def presentation_type(masks: Column, index: int) -> Column:
    """Independent, DownmixOf(j), CopyOf(j) or Invalid."""
    own = masks[index]
    kind = F.lit("Independent")
    for j in range(PRESENTATIONS - 1, index, -1):
        kind = F.when((F.shiftright(masks[j], j) != 0) & bit(masks[j], index), F.lit(f"DownmixOf({j})")).otherwise(kind)
    copy = F.lit("Invalid")
    for j in range(index):
        copy = F.when(F.shiftright(own, j) != 0, F.lit(f"CopyOf({j})")).otherwise(copy)
    return F.when(F.shiftright(own, index) != 0, kind).otherwise(copy)


def max_independent_presentation(masks: Column) -> Column:
    """The highest presentation with a substream of its own, or null."""
    return F.coalesce(*[F.when(F.shiftright(masks[i], i) != 0, F.lit(i)) for i in reversed(range(PRESENTATIONS))])


def required_mask(masks: Column, required: list[int]) -> Column:
    """Substreams needed for some presentations; one that is absent stands for the highest there is."""
    best = F.coalesce(F.get(masks, max_independent_presentation(masks)), F.lit(0))
    out = F.lit(0)
    for i in required:
        out = out.bitwiseOR(F.when(presentation_type(masks, i) == "Invalid", best).otherwise(masks[i]))
    return out


def labels(assignment: Column, table: list[list[str]]) -> Column:
    """Channel labels of an assignment's bits."""
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(bit(assignment, i), F.array(*[F.lit(x) for x in names])).otherwise(empty) for i, names in enumerate(table)]))


def eightch_labels(assignment: Column, flags: Column) -> Column:
    return F.when(_and(flags, 0x800) != 0, labels(assignment, EIGHTCH_RESTRICTED)).otherwise(labels(assignment, EIGHTCH))


def wave_mask(names: Column) -> Column:
    """The speaker mask, or null: no labels, one without a bit, or an order that isn't ascending."""
    table = F.create_map(*[F.lit(x) for pair in WAVE_BITS.items() for x in pair])
    step = lambda s, x: F.struct(
        F.when(s["mask"].isNotNull() & (F.element_at(table, x) > s["last"]), s["mask"].bitwiseOR(F.element_at(table, x))).alias("mask"),
        F.element_at(table, x).alias("last"),
    )
    return F.aggregate(names, F.struct(F.lit(0).alias("mask"), F.lit(0).alias("last")), step, lambda s: F.when(F.size(names) > 0, s["mask"]))


def sampling_frequency(code: Column) -> Column:
    """Hertz of a rate code; null where undefined."""
    return F.when(code.between(0, 2), F.call_function("shiftleft", F.lit(48_000), code)).when(code.between(8, 10), F.call_function("shiftleft", F.lit(44_100), code - 8))


def samples_per_unit(frequency: Column) -> Column:
    return F.floor(frequency / 44_100).cast("int") * 40


def samples_per_75ms(frequency: Column) -> Column:
    return F.floor((frequency * 3 + 39) / 40).cast("int")


def substream_cap(low: Column, high: Column) -> Column:
    return F.when(high < low, 5_000).otherwise(F.least((high - low + 1) * 15_000, F.lit(120_000)))


def time_text(milliseconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    part = lambda unit, modulo: F.floor(milliseconds / unit) % modulo if modulo else F.floor(milliseconds / unit)
    return F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), milliseconds % 1000)


def bcd(value: Column, digits: int) -> Column:
    """A binary-coded decimal of some digits, or null where a digit is over nine."""
    out, good = F.lit(0), F.lit(True)
    for i in range(digits):
        digit = _and(F.shiftright(value, 4 * i), 15)
        out, good = out + digit * 10**i, good & (digit <= 9)
    return F.when(good, out)


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name).cast("int") - 1


def verdict(units: Column, unrecovered: Column, trailing: Column, worst: Column, threshold: Column, on_disc: Column) -> Column:
    """unparseable, non_conformant, conformant_off_disc or conformant, in this order of precedence."""
    return (
        F.when((units == 0) | unrecovered | (trailing > 0), "unparseable")
        .when(F.coalesce(worst >= threshold, F.lit(False)), "non_conformant")
        .when(~on_disc, "conformant_off_disc")
        .otherwise("conformant")
    )


def exit_code(name: Column) -> Column:
    return F.when(name == "unparseable", 4).when(name == "non_conformant", 7).otherwise(0)
