"""Rules over parsed units: what the parser noted, and what only windows over the stream can tell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import streams as S
from tessera.kernels import buffers
from tessera.operators import splices, tally, timing
from tessera.storage import materialise, side_by_side

FBA, FBB = S.FBA, S.FBB


def configured(units: DataFrame) -> DataFrame:
    """Units with the configuration in force and the major sync's number and distance."""
    carried = F.last("config", ignorenulls=True).over(timing.so_far())
    return timing.restart_gaps(units.withColumn("now", carried))


def _majors(units: DataFrame) -> DataFrame:
    """Major syncs with the configuration before them."""
    return units.where("config is not null").withColumn("before", F.lag("config").over(timing.in_order()))


def _rules(rows: DataFrame, rules: dict[str, tuple[str, Column]], order: int) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"), F.lit(order + k).alias("seq"))) for k, (rule, (level, c)) in enumerate(rules.items())]))
    return rows.select("stream_id", "au", "au_offset", F.explode(found).alias("f")).select("stream_id", "au", "au_offset", "f.seq", "f.rule", "f.severity", F.lit(None).cast("int").alias("bit"))


def sync_rules(units: DataFrame) -> DataFrame:
    """What must not change from one major sync to the next."""
    now, was = F.col("config"), F.col("before")
    fbb = now["format_sync"] == FBB
    constant = F.when(fbb, 0xC000).otherwise(0xD800)
    info = now["info"].bitwiseXOR(was["info"]).bitwiseAND(F.when(fbb, 0x0F).otherwise(0xFF))
    rules = {
        "sync.flags_mismatch": ("warning", now["flags"].bitwiseXOR(was["flags"]).bitwiseAND(constant) != 0),
        "sync.peak_data_rate_mismatch": ("warning", now["peak"] != was["peak"]),
        "sync.substream_count_mismatch": ("warning", now["substreams"] != was["substreams"]),
        "sync.substream_info_mismatch": ("warning", info != 0),
        "sync.extended_substream_info_mismatch": ("warning", ~fbb & (now["extended_info"] != was["extended_info"])),
    }
    return _rules(_majors(units), rules, 100)


def timing_rules(units: DataFrame, follow: DataFrame, tolerant: bool = True) -> DataFrame:
    """Gaps, intervals and data rates; ``units`` as from :func:`configured`, ``follow`` as from splices.followed.

    After a valid splice a unit is compared with the one before the splice.
    With tolerance, an interval rule is silent at a major sync, where a splice
    may be; after a valid splice its twin speaks.
    """
    now, order = F.col("now"), timing.in_order()
    fbb = now["format_sync"] == FBB
    samples, peak = now["samples"], now["peak"]
    duration = F.when(peak > 0, timing.ceil_div(F.col("length").cast("long") * 256, peak)).otherwise(0)
    rows = units.join(side_by_side(follow.select("stream_id", "au", "unwrapped", F.coalesce("valid", F.lit(False)).alias("spliced"))), ["stream_id", "au"]).withColumn("duration", duration)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("spliced"), F.struct("input_timing", "length", "duration", "unwrapped")), ignorenulls=True).over(earlier)
    rows = rows.withColumns({"p": last, "after": F.coalesce(F.lag("spliced").over(order), F.lit(False)), "sent": F.sum(F.col("length").cast("long")).over(earlier), "start": F.first("input_timing").over(timing.so_far())})
    plain = (F.col("input_timing") - F.col("p.input_timing")).bitwiseAND(F.lit(0xFFFF))
    interval = F.when(F.col("after"), F.col("unwrapped") - F.col("p.unwrapped")).otherwise(plain)
    rows = rows.withColumn("interval", interval)
    limit = F.when(fbb, 153_600_000).otherwise(288_000_000)
    said = ~F.col("is_major") if tolerant else F.lit(True)
    broken = {
        "timing_too_short": F.col("interval") < F.floor(samples / 4),
        "timing_shorter_than_previous": F.col("interval") < F.col("p.duration"),
        "data_rate_exceeded": now["variable_rate"] & (F.col("p.length").cast("long") * 256 > F.col("interval").cast("long") * peak),
        "timing_too_long": F.col("interval") > S.samples_per_75ms(now["frequency"]),
    }
    drift = F.abs((F.col("unwrapped") - F.col("start")) * peak - F.col("sent") * 256)
    rules = {
        "access_unit.restart_gap_invalid": ("warning", (F.col("gap") != 1) & (F.col("gap") < 8)),
        "access_unit.fbb_sync_too_far": ("warning", fbb & (F.col("distance") > 32)),
        "access_unit.fba_sync_too_far": ("warning", ~fbb & (F.col("distance") > 128)),
        "access_unit.peak_data_rate_too_high": ("warning", peak.cast("long") * now["frequency"] > limit),
    }
    for name, condition in broken.items():
        rules[f"access_unit.{name}"] = ("warning", condition & said)
        rules[f"access_unit.{name}_after_jump"] = ("warning", condition & F.col("after"))
    rules["access_unit.fixed_rate_mismatch"] = ("warning", ~now["variable_rate"] & (drift >= 256))
    return _rules(rows, rules, 200)


def start_up_rules(units: DataFrame) -> DataFrame:
    """Start-up gains that exceed the gain a substream already runs at; gains are logarithms, so they compare as they are."""
    updates = units.select("stream_id", "au", F.posexplode("directory").alias("substream", "d")).where("d.drc_gain is not null").select("stream_id", "au", "substream", F.col("d.drc_gain").alias("gain"), F.lit(False).alias("heavy"))
    heavy = units.select("stream_id", "au", F.explode("restarts").alias("r")).where("r.heavy_gain is not null").select("stream_id", "au", F.col("r.substream").alias("substream"), F.col("r.heavy_gain").alias("gain"), F.lit(True).alias("heavy"))
    asks = units.where("config.start_gain is not null and au > 0").select("stream_id", "au", "au_offset", F.col("config.start_gain").alias("light"), F.col("config.heavy_start_gain").alias("strong"), F.explode(F.sequence(F.lit(0), F.col("config.substreams") - 1)).alias("substream"))
    asked = asks.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("heavy"))
    both = asked.withColumn("gain", F.lit(None).cast("int")).withColumn("place", F.lit(0)).unionByName(updates.unionAll(heavy).withColumn("place", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("stream_id", "substream", "heavy").orderBy("au", "place").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("running", F.last("gain", ignorenulls=True).over(before)).where("place = 0")
    rules = {
        "channel.drc_start_up_gain_too_large": ("warning", ~F.col("heavy") & (F.col("light") * 4 > F.col("running"))),
        "channel.heavy_drc_start_up_gain_too_large": ("warning", F.col("heavy") & (F.col("strong") * 8 > F.col("running"))),
    }
    return _rules(rows, rules, 450)


def heavy_drc_rules(units: DataFrame) -> DataFrame:
    """Heavy gain updates that come later, counted in restart headers, than they promised."""
    rows = units.where(F.col("now.format_sync") == FBA).where(F.col("now.flags").bitwiseAND(F.lit(0x2000)) != 0)
    headers = rows.select("stream_id", "au", "au_offset", F.explode("restarts").alias("r")).select("stream_id", "au", "au_offset", F.col("r.substream").alias("substream"), F.col("r.block").alias("block"), F.col("r.heavy_time").alias("time"))
    order = Window.partitionBy("stream_id", "substream").orderBy("au", "block")
    numbered = headers.withColumn("n", F.row_number().over(order))
    update = F.when(F.col("time").isNotNull(), F.struct("n", "time"))
    late = numbered.withColumn("last", F.last(update, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return _rules(late, {"restart_header.heavy_drc_time_update_exceeded": ("warning", F.col("n") - F.col("last.n") > F.call_function("shiftleft", F.lit(1), F.col("last.time")))}, 470)


def latency(units: DataFrame) -> DataFrame:
    """Adds ``output_timing`` of the last restart of substream 0 and the unit's ``latency``."""
    first = F.get(F.filter("restarts", lambda r: r["substream"] == 0), F.lit(0))["output_timing"]
    carried = F.last(first, ignorenulls=True).over(timing.so_far())
    value = (F.col("distance") * F.col("now.samples") + F.col("output_timing") - F.col("input_timing")).bitwiseAND(F.lit(0xFFFF))
    return units.withColumn("output_timing", carried).withColumn("latency", value)


def latency_rules(units: DataFrame) -> DataFrame:
    now, value = F.col("now"), F.col("latency")
    was = F.lag("latency").over(timing.in_order())
    constant = (now["flags"].bitwiseAND(F.lit(0x8000)) != 0) & F.col("was").isNotNull()
    judged = F.when(constant, F.col("was")).otherwise(value)
    duration = F.when(now["peak"] > 0, timing.ceil_div(F.col("length").cast("long") * 256, now["peak"])).otherwise(0)
    rules = {
        "block.latency_inconsistent": ("warning", constant & (F.col("was") != value)),
        "block.duration_exceeds_latency": ("warning", duration > judged),
        "block.latency_too_high": ("warning", judged > S.samples_per_75ms(now["frequency"])),
        "block.latency_too_low": ("warning", judged < now["samples"]),
    }
    return _rules(units.withColumn("was", was), rules, 300)


def drc_rules(units: DataFrame) -> DataFrame:
    """Directory gain updates that come later than they promised."""
    entries = units.select("stream_id", "au", "au_offset", F.posexplode("directory").alias("substream", "d"), F.col("now.format_sync").alias("sync"))
    window = Window.partitionBy("stream_id", "substream").orderBy("au")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    update = F.when(F.col("d.drc_time").isNotNull(), F.struct(F.col("au").alias("at"), F.col("d.drc_time").alias("time")))
    rows = entries.withColumn("last", F.last(update, ignorenulls=True).over(earlier))
    late = (F.col("sync") == FBA) & (F.col("au") - F.col("last.at") > F.call_function("shiftleft", F.lit(1), F.col("last.time")))
    return _rules(rows, {"substream.drc_time_update_exceeded": ("warning", late)}, 400)


CAPS = ("substream0", "sixch", "eightch", "sixteench", "whole")
#: The substreams' own bytes within the buffers, and by substream.
HELD, OWN = tuple(f"held_{name}" for name in CAPS), tuple(f"own_{i}" for i in range(S.PRESENTATIONS))


def contributions(units: DataFrame) -> DataFrame:
    """Bytes that each unit adds to each of the five buffers, priced from its directory; null where a buffer isn't kept."""
    now = F.col("now")
    fba = now["format_sync"] == FBA
    masks = S.presentation_masks(now["info"], now["extended_info"], ~fba)
    extension = F.coalesce(16 * (F.col("config.extension_words") + 1), F.lit(0))
    base = 32 + F.when(F.col("is_major"), 224 + F.when(fba, extension).otherwise(0)).otherwise(0)
    extra = F.when(F.coalesce(F.col("extra.length"), F.lit(0)) != 0, F.col("extra.length") * 16 + 16).otherwise(0)
    size = lambda i: F.get("directory", F.lit(i))
    region, payload = [], []
    for i in range(4):
        before = F.coalesce(size(i - 1)["end_ptr"], F.lit(0)) if i else F.lit(0)
        own = 16 * (size(i)["end_ptr"] - before)
        payload.append(F.coalesce(own, F.lit(0)))
        region.append(F.when(size(i)["end_ptr"].isNotNull(), F.when(size(i)["extra_word"], 32).otherwise(16) + own).otherwise(0))
    columns = {}
    for k, name in enumerate(CAPS[:4]):
        kept = (masks[k] != 0) & (fba | F.lit(k < 2)) & (F.lit(k < 3) | (now["substreams"] >= 4))
        among = lambda bits, k=k: sum((F.when(F.shiftright(masks[k], i).bitwiseAND(F.lit(1)) == 1, bits[i]).otherwise(0) for i in range(4)), F.lit(0))
        columns[name] = F.when(kept, F.floor((among(region) + base + extra) / 8)).otherwise(0).cast("long")
        columns[f"held_{name}"] = F.when(kept, F.floor(among(payload) / 8)).otherwise(0).cast("long")
    columns["whole"] = (F.col("length") * 2).cast("long")
    columns["held_whole"] = F.floor(sum(payload, F.lit(0)) / 8).cast("long")
    columns |= {name: F.floor(payload[i] / 8).cast("long") for i, name in enumerate(OWN)}
    return units.withColumns(columns)


def buffer_depths(units: DataFrame, follow: DataFrame) -> DataFrame:
    """(stream_id, au, au_offset, accumulator, bytes, depth, held, underrun, cap): the buffer model of each decoder, and each substream's own bytes.

    ``held`` is what of the depth are the substreams' own bytes.

    ``follow`` is what splices.followed gives: each epoch is modelled as a
    stream of its own, with an output clock from its first output time on.
    """
    joined = contributions(units).join(side_by_side(follow.select("stream_id", "au", "epoch", "unwrapped")), ["stream_id", "au"])
    within = Window.partitionBy("stream_id", "epoch")
    starts = joined.withColumns({"begin": F.min("au").over(within), "first_input": F.min_by("unwrapped", "au").over(within), "first_timing": F.min_by("output_timing", "au").over(within)})
    first = F.col("first_timing") + F.when(F.col("first_timing") < F.col("first_input").bitwiseAND(F.lit(0xFFFF)), 65_536).otherwise(0)
    ready = starts.withColumns({"first_output": first.cast("long"), "name": F.col("stream_id"), "place": F.col("au")})
    ready = ready.withColumns({"stream_id": F.struct("name", "epoch"), "au": F.col("au") - F.col("begin"), "unwrapped": F.col("unwrapped")})
    now = F.col("now")
    index = (now["info"].bitwiseAND(F.lit(15)) - 4).cast("int")
    table = lambda values: F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), F.when(index >= 0, index)), F.lit(0))
    fbb = now["format_sync"] == FBB
    caps = {}
    for name in CAPS:
        fbb_cap = table(S.FBB_SUBSTREAM0_CAPS if name == "substream0" else S.FBB_STREAM_CAPS) if name in ("substream0", "sixch", "whole") else F.lit(None)
        fba_cap = F.lit(S.FBA_CAPS[name])
        if name == "sixteench":
            fba_cap = F.when((now["info"].bitwiseAND(F.lit(0x80)) != 0) & (now["substreams"] > 3), fba_cap)
        caps[name] = F.when(fbb, fbb_cap).otherwise(fba_cap)
    ready = ready.withColumn("caps", F.array(*[caps[n] for n in CAPS])).withColumn("unit_samples", F.col("now.samples"))
    narrow = ready.select("stream_id", "name", "place", "au", "au_offset", "unwrapped", "first_output", "unit_samples", "caps", *SIZES)
    depths = timing.depths(narrow, F.col("unit_samples"), **{f"depth_{n}": n for n in SIZES})
    # before its first unit's records can leave, an epoch has no underrun and no ring that is full
    depths = depths.withColumn("odd", F.max(F.col("underrun") | (F.col("au") + 1 - F.col("drained") > buffers.PLACES)).over(Window.partitionBy("stream_id")))
    columns = ("stream_id", "name", "place", "au_offset", "underrun", "caps", *SIZES, *(f"depth_{n}" for n in SIZES))
    played = _replayed(depths.where("odd").select("stream_id", "name", "place", "au", "au_offset", "unwrapped", "first_output", "unit_samples", "caps", *SIZES))
    both = depths.where(~F.col("odd")).select(*columns).unionByName(played)
    none = F.lit(None).cast("long")
    rows = [(n, F.col(n), F.col(f"depth_{n}"), F.col(f"depth_{h}"), F.col("caps")[k]) for k, (n, h) in enumerate(zip(CAPS, HELD, strict=True))]
    rows += [(n, F.col(n), F.col(f"depth_{n}"), F.col(f"depth_{n}"), none) for n in OWN]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("accumulator"), size.alias("bytes"), depth.alias("depth"), held.alias("held"), cap.cast("int").alias("cap")) for n, size, depth, held, cap in rows]))
    return both.select(F.col("name").alias("stream_id"), F.col("place").alias("au"), "au_offset", each.alias("d"), "underrun").select("stream_id", "au", "au_offset", "d.accumulator", "d.bytes", "d.depth", "d.held", "underrun", "d.cap")


SIZES = (*CAPS, *HELD, *OWN)
REPLAYED = "stream_id struct<name:string,epoch:long>, name string, place long, au_offset long, underrun boolean, caps array<int>, " + ", ".join(f"{n} long" for n in (*SIZES, *(f"depth_{n}" for n in SIZES)))


def _replayed(rows: DataFrame) -> DataFrame:
    """Depths of epochs in which the closed form does not hold, unit by unit."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("au")
        found = table.to_pylist()
        units = ((r["unwrapped"], r["first_output"] + (r["au"] + 1) * r["unit_samples"], tuple(r[n] for n in SIZES)) for r in found)
        played = list(buffers.replay(units, len(HELD) + len(OWN)))
        out = table.select(["stream_id", "name", "place", "au_offset"])
        out = out.append_column("underrun", pa.array([dry is not None for _, dry in played], pa.bool_())).append_column("caps", table["caps"])
        for n in SIZES:
            out = out.append_column(n, table[n])
        for k, n in enumerate(SIZES):
            out = out.append_column(f"depth_{n}", pa.array([d[k] for d, _ in played], pa.int64()))
        return out

    return rows.groupBy("stream_id").applyInArrow(run, REPLAYED)


def buffer_rules(depths: DataFrame) -> DataFrame:
    over = F.col("depth") > F.col("cap")
    rules = {
        "fifo.substream0_depth_exceeded": ("warning", over & (F.col("accumulator") == "substream0")),
        "fifo.group_depth_exceeded": ("warning", over & F.col("accumulator").isin("sixch", "eightch", "sixteench")),
        "fifo.whole_stream_depth_exceeded": ("warning", over & (F.col("accumulator") == "whole")),
        "fifo.underrun": ("warning", F.col("underrun") & (F.col("accumulator") == "whole")),
    }
    return _rules(depths, rules, 500)


def noted(units: DataFrame) -> DataFrame:
    """What the parser noted, in its order."""
    return units.select("stream_id", "au", "au_offset", F.posexplode("notes").alias("seq", "n")).select("stream_id", "au", "au_offset", "seq", "n.rule", "n.severity", "n.bit")


#: What the rules over whole streams read of a unit.
NARROW = ("stream_id", "au", "au_offset", "segment", "length", "input_timing", "is_major", "config", "directory", "restarts", "now", "gap", "distance", "output_timing", "latency")


@dataclass
class Followed:
    """Tables that rules and summaries share, each written once: narrow units, their epochs and splices, and buffer depths."""

    units: DataFrame
    follow: DataFrame
    depths: DataFrame | None


def follow(units: DataFrame, depths: bool = True, tolerant: bool = True) -> Followed:
    narrow = latency(configured(units)).withColumn("extra", F.struct(F.col("extra.length").alias("length")))
    ready = materialise(narrow.select(*NARROW, "extra"), "narrow")
    found = materialise(splices.followed(ready, tolerant), "followed")
    return Followed(ready, found, materialise(buffer_depths(ready, found), "depths") if depths else None)


def diagnostics(units: DataFrame, depths: bool = True, tolerant: bool = True, followed: Followed | None = None) -> DataFrame:
    """One row for each violation: (stream_id, au, seq, rule, severity, byte_offset, bit_in_byte)."""
    shared = followed or follow(units, depths, tolerant)
    ready = shared.units
    offsets = side_by_side(ready.select("stream_id", "au", "au_offset"))
    at_splice = shared.follow.select("stream_id", "au", F.posexplode("rules").alias("k", "rule")).join(offsets, ["stream_id", "au"])
    serial = splices.serial_timing(ready).where("rule is not null").withColumn("k", F.lit(50)).select("stream_id", "au", "k", "rule").join(offsets, ["stream_id", "au"])
    told = at_splice.unionByName(serial).select("stream_id", "au", "au_offset", (F.col("k") + 600).alias("seq"), "rule", F.lit("warning").alias("severity"), F.lit(None).cast("int").alias("bit"))
    parts = [noted(units), sync_rules(ready), timing_rules(ready, shared.follow, tolerant), latency_rules(ready), drc_rules(ready), start_up_rules(ready), heavy_drc_rules(ready), told]
    if shared.depths is not None:
        parts.append(buffer_rules(shared.depths))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    byte, bit = tally.location(F.col("au_offset"), F.col("bit"))
    return found.select("stream_id", "au", "seq", "rule", "severity", byte.alias("byte_offset"), bit.alias("bit_in_byte"))


def lossless_checks(samples: DataFrame, units: DataFrame) -> DataFrame:
    """(stream_id, presentation, segment, calculated, stated): the digest of each interval that was read to its end against the next restart header of its substream."""
    last = samples.groupBy("stream_id", "presentation", "segment").agg(F.max_by("digest", "au").alias("digest"))
    word = F.col("digest").bitwiseAND(F.lit(0xFFFFFFFF))
    half = word.bitwiseXOR(F.shiftright(word, 16)).bitwiseAND(F.lit(0xFFFF))
    calculated = half.bitwiseXOR(F.shiftright(half, 8)).bitwiseAND(F.lit(0xFF)).cast("int")
    stated = units.select("stream_id", (F.col("segment") - 1).alias("segment"), F.explode("restarts").alias("r")).where("r.block = 0")
    stated = stated.select("stream_id", "segment", F.col("r.substream").alias("presentation"), F.col("r.lossless_check").alias("stated"))
    whole = units.groupBy("stream_id", "segment").agg(F.every(F.col("stopped").isNull()).alias("whole")).where("whole").drop("whole")
    return last.select("stream_id", "presentation", "segment", calculated.alias("calculated")).join(side_by_side(stated), ["stream_id", "presentation", "segment"]).join(side_by_side(whole), ["stream_id", "segment"])


def decode_diagnostics(samples: DataFrame, units: DataFrame) -> DataFrame:
    """(stream_id, au, rule, severity): what only decoding can tell: intervals whose check byte differs, and outputs wider than stated.

    Kept apart from the conformance run, which does not decode.
    """
    checks = lossless_checks(samples, units).where("calculated <> stated")
    firsts = units.where("is_major").select("stream_id", (F.col("segment") - 1).alias("segment"), "au")
    wrong = checks.join(side_by_side(firsts), ["stream_id", "segment"]).select("stream_id", "au", F.lit("restart_header.lossless_check_mismatch").alias("rule"), F.lit("warning").alias("severity"))
    stated = units.select("stream_id", "segment", F.explode("restarts").alias("r")).where("r.block = 0").select("stream_id", "segment", F.col("r.substream").alias("presentation"), F.col("r.max_bits").alias("max_bits"))
    wide = samples.join(side_by_side(stated), ["stream_id", "segment", "presentation"]).where(F.call_function("shiftright", F.col("width"), F.col("max_bits")) != 0)
    return wrong.unionAll(wide.select("stream_id", "au", F.lit("decode.outputs_exceed_max_bits").alias("rule"), F.lit("warning").alias("severity")))
