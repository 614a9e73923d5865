"""What a conformance run states of each stream besides its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import streams as S
from tessera.operators import conformance, splices
from tessera.storage import side_by_side


def substream_properties(shared: conformance.Followed) -> DataFrame:
    """(stream_id, substream_properties): each substream's last restart header, and how deep its own bytes went."""
    headers = shared.units.select("stream_id", "au", F.explode("restarts").alias("r"))
    last = headers.groupBy("stream_id", F.col("r.substream").alias("index")).agg(F.max_by("r", F.struct("au", "r.block")).alias("r"))
    out = last.select("stream_id", "index", F.col("r.sync_word").alias("word"), F.col("r.min_chan").alias("min_chan"), F.col("r.max_chan").alias("max_chan"), F.col("r.max_matrix_chan").alias("max_matrix_chan"))
    peak = F.lit(None).cast("long")
    if shared.depths is not None:
        own = shared.depths.where(F.col("accumulator").startswith("own_")).groupBy("stream_id", F.substring("accumulator", 5, 1).cast("int").alias("index")).agg(F.max("depth").alias("peak"))
        out, peak = out.join(side_by_side(own), ["stream_id", "index"], "left"), F.col("peak")
    each = F.struct("index", F.hex(F.col("word").cast("long")).alias("restart_sync_word"), "min_chan", "max_chan", "max_matrix_chan", peak.alias("fifo_peak"), S.substream_cap(F.col("min_chan"), F.col("max_chan")).alias("fifo_cap"))
    return out.groupBy("stream_id").agg(F.array_sort(F.collect_list(each)).alias("substream_properties"))


def buffer_peaks(depths: DataFrame) -> DataFrame:
    """(stream_id, fifo_peaks, fifo_stream_bytes, fifo_overhead_bytes, fifo_caps): each buffer's first deepest instant, in the order of conformance.CAPS."""
    best = F.max(F.struct("depth", (-F.col("au")).alias("minus"), "held"))
    rows = depths.where(F.col("accumulator").isin(*conformance.CAPS)).groupBy("stream_id", "accumulator").agg(best.alias("best"), F.min_by("cap", "au").alias("cap"))
    pick = lambda value, name: F.max(F.when(F.col("accumulator") == name, value))
    zero = lambda value: F.coalesce(value, F.lit(0).cast("long"))
    total, held = F.col("best.depth"), F.least("best.held", "best.depth")
    columns = {"fifo_peaks": zero(total), "fifo_stream_bytes": zero(held), "fifo_overhead_bytes": zero(total - held), "fifo_caps": F.col("cap")}
    return rows.groupBy("stream_id").agg(*[F.array(*[pick(value, n) for n in conformance.CAPS]).alias(name) for name, value in columns.items()])


def branch_list(shared: conformance.Followed) -> DataFrame:
    """(stream_id, branches, invalid_branches), of the streams that have splices."""
    found = splices.branches(shared.follow, shared.units)
    each = F.struct("au", "byte_offset", "sample", "advance", "valid", "failed")
    return found.groupBy("stream_id").agg(F.array_sort(F.collect_list(each)).alias("branches"), F.count_if(~F.col("valid")).alias("invalid_branches"))


def sizes_and_latency(units: DataFrame) -> DataFrame:
    size = F.col("length").cast("long") * 2
    return units.groupBy("stream_id").agg(F.max(size).alias("max_access_unit_size"), F.avg(size).alias("average_access_unit_size"), F.max("latency").alias("max_fifo_latency_samples"))


def disc_validity(facts: DataFrame) -> DataFrame:
    """Adds ``dvd_audio``, ``dvd_audio_needs_decode``, ``hd_dvd_video`` and ``bluray``: whether a disc may carry the stream.

    ``facts`` needs config and substream_properties.
    """
    c, subs = F.col("config"), F.col("substream_properties")
    fbb, frequency = c["format_sync"] == S.FBB, c["frequency"]
    masks = S.presentation_masks(c["info"], c["extended_info"], fbb)
    within = lambda k: F.filter(subs, lambda s: F.call_function("shiftright", masks[k], s["index"]).bitwiseAND(F.lit(1)) == 1)

    def broken(k: int) -> Column:
        """Whether a presentation's substreams leave a channel out or claim one twice."""
        spans = F.array_sort(F.transform(within(k), lambda s: F.struct(s["min_chan"].alias("low"), s["max_chan"].alias("high"))))
        start = F.struct(F.lit(0).alias("next"), F.lit(False).alias("bad"))
        return F.aggregate(spans, start, lambda a, s: F.struct((s["high"] + 1).alias("next"), (a["bad"] | (s["low"] != a["next"])).alias("bad")), lambda a: a["bad"])

    carried = lambda k: F.coalesce(F.array_max(F.transform(within(k), lambda s: s["max_chan"] + 1)), F.lit(0))
    declared = [F.size(S.labels(c["sixch_assignment"], S.SIXCH)), F.size(S.eightch_labels(c["eightch_assignment"], c["flags"]))]
    most = F.greatest(*[F.coalesce(x, F.lit(0)) for x in declared], carried(1), carried(2))
    sound = (F.get(subs, F.lit(0))["restart_sync_word"] == "31EA") & ~(broken(0) | broken(1) | broken(2) | broken(3))
    high = frequency.isin(176_400, 192_000)
    named = {
        "dvd_audio": fbb,
        "dvd_audio_needs_decode": fbb,
        "hd_dvd_video": F.when(fbb, c["info"].bitwiseAND(F.lit(1)) != 0).when(high, most <= 2).otherwise(True),
        "bluray": F.when(fbb, False).when(high, most <= 6).otherwise(True) & ~frequency.isin(44_100, 88_200, 176_400),
    }
    return facts.withColumns({name: F.when(c.isNotNull() & (F.size(subs) > 0), F.coalesce(sound & value, F.lit(False))) for name, value in named.items()})
