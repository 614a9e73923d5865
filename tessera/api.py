"""The three commands as queries: info, verify, decode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import report
from tessera.functions import streams as S
from tessera.kernels import dither
from tessera.operators import carry, conformance, facts, tally
from tessera.operators import frames as framing
from tessera.operators import units as parsing
from tessera.storage import materialise, side_by_side


def load(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Streams (stream_id, data) under a path."""
    return framing.read_streams(spark, path, glob)


def _framed(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and sizes of streams (stream_id, data), or of what the source ``framed`` reads, which are frames already.

    Of the latter, what follows the last frame and resynchronisations aren't known.
    """
    if "au_offset" not in streams.columns:
        return framing.frames(streams), framing.stream_sizes(streams)
    end = F.max(F.col("au_offset") + F.octet_length("data"))
    none = F.lit(0).cast("long")
    sizes = streams.groupBy("stream_id").agg(F.count("*").alias("frames"), end.cast("long").alias("bytes"))
    return streams, sizes.withColumns({"trailing_bytes": none, "resyncs": none})


def summary(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a stream: its configuration, counts, rates and duration."""
    first = units.groupBy("stream_id").agg(
        F.min_by("config", F.when(F.col("config").isNotNull(), F.col("au"))).alias("config"),
        F.count("*").alias("access_units"),
        F.count_if("is_major").alias("major_syncs"),
        F.max("length").alias("longest"),
        F.sum(F.col("length").cast("long") * 2).alias("unit_bytes"),
        F.min_by(F.get("restarts", F.lit(0))["sync_word"], "au").alias("restart_sync_word"),
        F.max(F.aggregate("restarts", F.lit(-1), lambda a, r: F.greatest(a, r["max_chan"]))).alias("max_chan"),
        F.max(F.aggregate("restarts", F.lit(-1), lambda a, r: F.greatest(a, r["max_matrix_chan"]))).alias("max_matrix_chan"),
        F.some(F.col("stopped").isNotNull()).alias("stopped"),
    )
    c = F.col("config")
    masks = S.presentation_masks(c["info"], c["extended_info"], c["format_sync"] == S.FBB)
    samples = F.col("access_units") * c["samples"]
    joined = sizes.join(side_by_side(first), "stream_id", "left")
    return joined.select(
        "stream_id",
        F.when(c["format_sync"] == S.FBB, "FBB").when(c["format_sync"] == S.FBA, "FBA").alias("syntax"),
        c["frequency"].alias("frequency"),
        c["substreams"].alias("substreams"),
        c["info"].alias("substream_info"),
        c["extended_info"].alias("extended_substream_info"),
        F.coalesce("access_units", F.lit(0).cast("long")).alias("access_units"),
        "major_syncs",
        "longest",
        F.col("frames"),
        "bytes",
        "trailing_bytes",
        "resyncs",
        F.coalesce("stopped", F.lit(False)).alias("stopped"),
        "restart_sync_word",
        (F.col("max_matrix_chan") + 1).alias("channels"),
        samples.alias("samples"),
        F.when(samples.isNotNull(), S.time_text(F.floor(samples * 1000 / c["frequency"]).cast("long"))).alias("duration"),
        F.floor(c["peak"] * c["frequency"] / 16_000).cast("int").alias("peak_kbps"),
        F.floor(F.col("unit_bytes") * 8 * c["frequency"] / (samples * 1000)).cast("int").alias("average_kbps"),
        c["variable_rate"].alias("variable_rate"),
        (F.get(masks, F.lit(3)) != 0).alias("has_objects"),
        *[S.presentation_type(masks, i).alias(f"presentation_{i}") for i in range(S.PRESENTATIONS)],
    )


def info(streams: DataFrame) -> DataFrame:
    """What each stream is: one row.  ``streams`` are whole (stream_id, data), or frames as the source ``framed`` reads them from files of any length."""
    framed, sizes = _framed(streams)
    return summary(parsing.units(framed), sizes)


@dataclass
class Verification:
    """Tables of a conformance run."""

    diagnostics: DataFrame
    tally: DataFrame
    shown: DataFrame
    summary: DataFrame

    def json_lines(self) -> DataFrame:
        """The report as JSON lines, in order: diagnostics shown, what was suppressed, the summary."""
        diag = self.shown.select("stream_id", F.lit(0).alias("part"), F.col("au").alias("place"), "seq", F.to_json(F.struct(F.lit("diagnostic").alias("type"), "stream_id", "rule", "severity", "au", "byte_offset", "bit_in_byte")).alias("line"))
        hidden = self.tally.where("count > shown").select("stream_id", F.lit(1).alias("part"), F.col("first_au").alias("place"), F.lit(0).alias("seq"), F.to_json(F.struct(F.lit("suppressed").alias("type"), "stream_id", "rule", (F.col("count") - F.col("shown")).alias("suppressed"))).alias("line"))
        last = self.summary.select("stream_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("seq"), F.to_json(F.struct(F.lit("summary").alias("type"), "*")).alias("line"))
        return diag.unionAll(hidden).unionAll(last).orderBy("stream_id", "part", "place", "seq")


def verify(streams: DataFrame, fail_on: str = "error", max_per_rule: int = 10, buffers: bool = True, strict: bool = False, tolerant: bool = True) -> Verification:
    """Every rule over every stream; ``streams`` as for :func:`info`.

    ``fail_on`` is the least severity that fails a stream; ``strict`` lowers it
    to a warning, and never ends a unit.  A limit of 0 shows all diagnostics of
    a rule.  ``tolerant`` takes a break at a major sync for a splice.
    """
    framed, sizes = _framed(streams)
    units = materialise(parsing.units(framed), "units")
    shared = conformance.follow(units, buffers, tolerant)
    found = materialise(conformance.diagnostics(units, buffers, tolerant, shared), "diagnostics")
    counts = tally.tally(found, max_per_rule)
    totals = tally.severity_totals(found)
    config = shared.units.where("config is not null").groupBy("stream_id").agg(F.min_by("config", "au").alias("config"))
    by_rule = counts.groupBy("stream_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "count")))).alias("by_rule"), F.sum("count").alias("diagnostics"))
    joined = summary(units, sizes)
    parts = [totals, by_rule, config, facts.sizes_and_latency(shared.units), report.max_data_rate(shared.units), facts.substream_properties(shared), facts.branch_list(shared)]
    if buffers:
        parts.append(facts.buffer_peaks(shared.depths))
    for part in parts:
        joined = joined.join(side_by_side(part), "stream_id", "left")
    joined = facts.disc_validity(joined)
    joined = joined.withColumn("max_fifo_latency_ms", F.col("max_fifo_latency_samples") * 1000.0 / F.col("frequency")).withColumn("invalid_branches", F.coalesce("invalid_branches", F.lit(0).cast("long")))
    joined = joined.withColumns({"diagnostics": F.coalesce("diagnostics", F.lit(0).cast("long"))} | {s: F.coalesce(s, F.lit(0).cast("long")) for s in S.SEVERITIES})
    any_disc = F.coalesce(F.col("dvd_audio") | F.col("hd_dvd_video") | F.col("bluray"), F.lit(False))
    threshold = min(S.SEVERITIES.index(fail_on), S.SEVERITIES.index("warning")) if strict else S.SEVERITIES.index(fail_on)
    name = S.verdict(F.col("access_units"), F.col("stopped"), F.col("trailing_bytes"), S.severity_rank(F.col("worst")), F.lit(threshold), any_disc)
    judged = materialise(joined.withColumn("verdict", name).withColumn("exit_code", S.exit_code(F.col("verdict"))).drop("config"), "summary")
    return Verification(found, counts, tally.limited(found, max_per_rule), judged)


def decode(streams: DataFrame, presentations: list[int] | None = None, dither_table: str | None = None, keep_repeated: bool = False) -> DataFrame:
    """Samples by stream, presentation and unit; the highest presentation unless some are named.

    Units that a splice repeats are left out unless ``keep_repeated``; samples
    are written once, so that leaving out costs no second decoding.
    ``dither_table`` is a text file with the 256 amplitudes that streams of the
    second and third restart syntax may ask for; it is read on the driver.
    """
    table = dither.load(dither_table) if dither_table else None
    samples = parsing.pcm(_framed(streams)[0], [3] if presentations is None else presentations, table)
    return samples if keep_repeated else _once(materialise(samples, "samples"))


def decode_checked(streams: DataFrame, presentations: list[int] | None = None, dither_table: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples as from :func:`decode`, and each interval's check as from conformance.lossless_checks, from one reading of the streams."""
    table = dither.load(dither_table) if dither_table else None
    both = materialise(parsing.pcm_and_headers(_framed(streams)[0], [3] if presentations is None else presentations, table), "samples")
    samples = _once(both.where("presentation is not null").drop("is_unit", "restarts", "stopped"))
    return samples, conformance.lossless_checks(samples, both.where("is_unit").select("stream_id", "segment", "restarts", "stopped"))


def _once(samples: DataFrame) -> DataFrame:
    """Samples without the units that a splice repeats."""
    return samples.join(side_by_side(carry.repeated_units(samples)), ["stream_id", "presentation", "au"], "left_anti").select(*samples.columns)


def parse_presentations(text: str) -> list[int]:
    """Selections "0-3", "0,2", "all" or "max" as a sorted list without repetitions; max is the highest of four."""
    if text == "all":
        return [0, 1, 2, 3]
    if text == "max":
        return [3]
    out: set[int] = set()
    for part in text.split(","):
        low, _, high = part.partition("-")
        out.update(range(int(low), int(high or low) + 1))
    if not out or min(out) < 0 or max(out) > 3:
        raise ValueError(f"no such presentation: {text}")
    return sorted(out)


def decode_summary(samples: DataFrame) -> DataFrame:
    """Decoded units, samples and channels of each stream and presentation."""
    return samples.groupBy("stream_id", "presentation").agg(F.count("*").alias("frames"), F.sum("samples").alias("samples"), F.max("channels").alias("channels"))
