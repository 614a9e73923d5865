"""Summaries as JSON and as text, and the small options around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.operators import carry, timing

#: Of the reports' layout.
VERSION = "1"


def parse_key(text: str) -> bytes:
    """A protection key: hexadecimal, or ``@`` and a file that holds its bytes; at most 64 bytes."""
    if text.startswith("@"):
        with open(text[1:], "rb") as file:
            key = file.read()
    else:
        key = bytes.fromhex(text)
    if not 1 <= len(key) <= 64:
        raise ValueError("a key has 1 to 64 bytes")
    return key


def max_data_rate(units: DataFrame) -> DataFrame:
    """(stream_id, max_data_rate, max_data_rate_au): the greatest rate over a unit's interval and the unit whose bytes made it, the earliest of equals.

    ``units`` as from conformance.configured; intervals at jumps don't count.
    """
    now = F.col("now")
    order = timing.in_order()
    interval = (F.col("input_timing") - F.lag("input_timing").over(order)).bitwiseAND(F.lit(0xFFFF))
    rows = units.withColumns({"interval": interval, "before": F.lag("length").over(order).cast("long")})
    duration = F.when(now["peak"] > 0, timing.ceil_div(F.col("before") * 256, now["peak"])).otherwise(0)
    limit = F.floor((now["frequency"] * 3 + 39) / 40)
    jump = (F.col("interval") < F.floor(now["samples"] / 4)) | (F.col("interval") < duration) | (F.col("interval") > limit) | (now["variable_rate"] & (F.col("before") * 256 > F.col("interval") * now["peak"]))
    steady = rows.where(~jump & (F.col("interval") > 0))
    rate = timing.ceil_div(now["frequency"].cast("long") * 16 * F.col("before"), F.col("interval"))
    best = F.max(F.struct(rate.alias("rate"), (1 - F.col("au")).alias("minus"))).alias("best")
    return steady.groupBy("stream_id").agg(best).select("stream_id", F.col("best.rate").alias("max_data_rate"), (-F.col("best.minus")).alias("max_data_rate_au"))


def output_segments(samples: DataFrame, units: DataFrame) -> DataFrame:
    """Decoded samples with ``output_segment``: the unit from which a configuration that needs new files is in force (0 for the first)."""
    ready = units.select("stream_id", "au", F.last("config", ignorenulls=True).over(timing.so_far()).alias("c"))
    known = ready.where("c is not null").select("stream_id", "au", F.col("c.frequency").alias("frequency"), F.col("c.substreams").alias("substreams"), F.col("c.info").alias("info"), F.col("c.extended_info").alias("extended"))
    numbered = carry.segmented(known, "frequency", "substreams", "info", "extended")
    starts = numbered.groupBy("stream_id", "output_segment").agg(F.min("au").alias("start"))
    named = numbered.join(starts, ["stream_id", "output_segment"]).select("stream_id", "au", F.when(F.col("output_segment") == 0, 0).otherwise(F.col("start")).cast("long").alias("output_segment"))
    return samples.join(named, ["stream_id", "au"])


def bed_conformed(labels: list[str], target: list[str]) -> list[int | None]:
    """For each target channel its place among the decoded ones; None stays silent."""
    return [labels.index(name) if name in labels else None for name in target]


def conform_bed(pcm: bytes, channels: int, order: list[int | None], width: int = 3) -> bytes:
    """Interleaved samples with the channels of ``order``; objects after a bed follow as they are."""
    out = bytearray()
    for at in range(0, len(pcm), channels * width):
        frame = pcm[at : at + channels * width]
        for place in order:
            out += bytes(width) if place is None else frame[place * width : (place + 1) * width]
    return bytes(out)


def protection_summary(statuses: DataFrame, units: DataFrame) -> DataFrame:
    """(stream_id, checked, failed, secondary_seen) of the protection words."""
    counts = statuses.groupBy("stream_id").agg(F.count_if(F.col("status") != "absent").alias("checked"), F.count_if(F.col("status") == "mismatch").alias("failed"))
    second = units.groupBy("stream_id").agg(F.coalesce(F.bool_or(F.octet_length("extra.secondary") > 0), F.lit(False)).alias("secondary_seen"))
    return counts.join(second, "stream_id")


def decode_json(summary: DataFrame, written: DataFrame | None = None, verified: DataFrame | None = None, protection: DataFrame | None = None) -> DataFrame:
    """(stream_id, line): a JSON object for each stream of a decoding.

    ``written`` names the files (stream_id, presentation, path); ``verified`` is
    a verification's summary, for what was skipped, branches and the rate;
    ``protection`` counts checked words (stream_id, checked, failed).  What was
    not given is null.
    """
    each = summary.select("stream_id", F.col("presentation").alias("index"), "frames", "samples", "channels")
    if written is None:
        each = each.withColumns({"files": F.array().cast("array<string>"), "format": F.lit("pcm")})
    else:
        ending = F.regexp_extract("path", r"\.([^.]+)$", 1)
        files = written.groupBy("stream_id", F.col("presentation").alias("index")).agg(F.array_sort(F.collect_list("path")).alias("files"), F.min(ending).alias("format"))
        each = each.join(files, ["stream_id", "index"], "left")
    out = each.groupBy("stream_id").agg(F.max("frames").alias("frames"), F.max("samples").alias("samples"), F.array_sort(F.collect_list(F.struct("index", "format", "channels", "files"))).alias("presentations"))
    none = F.lit(None).cast("long")
    if verified is not None:
        out = out.join(verified.select("stream_id", "access_units", F.coalesce(F.size("branches"), F.lit(0)).cast("long").alias("n"), "invalid_branches", "frequency"), "stream_id", "left")
        out = out.withColumns({"skippedFrames": F.col("access_units") - F.col("frames"), "branches": F.greatest("n", F.lit(0)), "invalidBranches": F.col("invalid_branches"), "sampleRate": F.col("frequency")})
    else:
        out = out.withColumns({n: none for n in ("skippedFrames", "branches", "invalidBranches", "sampleRate")})
    if protection is not None:
        out = out.join(protection.select("stream_id", F.col("checked").alias("evoChecked"), F.col("failed").alias("evoFailed")), "stream_id", "left")
    else:
        out = out.withColumns({"evoChecked": none, "evoFailed": none})
    names = ("frames", "skippedFrames", "branches", "invalidBranches", "evoChecked", "evoFailed", "samples", "sampleRate", "presentations")
    line = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("stream_id").alias("input"), *names), {"ignoreNullFields": "false"})
    return out.select("stream_id", line.alias("line"))


def _table(title: str, rows: list[tuple[str, object]]) -> list[str]:
    rows = [(name, value) for name, value in rows if value is not None]
    width = max([10, *(len(name) for name, _ in rows)]) + 1
    return [title, *(f"  {name:<{width}}{value}" for name, value in rows), ""]


def stream_text(row: Row) -> str:
    """What ``info`` prints of one row of api.info."""
    lines = _table("Stream", [("Input", row.stream_id), ("Syntax", row.syntax or "no major sync found"), ("Sampling rate", row.frequency and f"{row.frequency} Hz"), ("Substreams", row.substreams), ("Channels", row.channels), ("Duration", row.duration), ("Peak rate", row.peak_kbps and f"{row.peak_kbps} kbps"), ("Average", row.average_kbps and f"{row.average_kbps} kbps"), ("Units", row.access_units), ("Trailing", row.trailing_bytes and f"{row.trailing_bytes} bytes")])
    if row.syntax:
        lines += _table("Presentations", [(str(i), row[f"presentation_{i}"]) for i in range(4)])
    return "\n".join(lines)


def _columns(title: str, headings: list[str], rows: list[tuple[str, list[object] | str]]) -> list[str]:
    """A table with headings; a row's text in place of its cells stands alone."""
    width = [max(len(str(x)) for x in [h, *(cells[k] for _, cells in rows if not isinstance(cells, str))]) + 2 for k, h in enumerate(headings)]
    label = max(len(name) for name, _ in rows) + 2 if rows else 2
    out = [title, " " * (label + 2) + "".join(f"{h:>{w}}" for h, w in zip(headings, width, strict=True))]
    for name, cells in rows:
        out.append(f"  {name:<{label}}" + (cells if isinstance(cells, str) else "".join(f"{c!s:>{w}}" for c, w in zip(cells, width, strict=True))))
    return [*out, ""]


BUFFERS = ("2-channel decoder", "6-channel decoder", "8-channel decoder", "16-channel decoder", "Whole stream")


def _buffer_rows(s: Row) -> list[tuple[str, list[object] | str]]:
    """The five buffers; one that the stream does not keep gives the reason."""
    out: list[tuple[str, list[object] | str]] = []
    info, first = s.substream_info or 0, (s.substream_properties or [None])[0]
    for k, name in enumerate(BUFFERS):
        shown = k
        if k == 0 and first is not None and first.max_chan - first.min_chan != 1:
            out.append((name, ["-"] * 4))
            continue
        if k == 1 and not info & 8:  # that decoder reads substream 0 alone
            name, shown = "6-channel decoder (substream 0)", 0
        elif k in (2, 3) and s.syntax == "FBB":
            out.append((name, "not checked"))
            continue
        elif k == 3 and not (info & 0x80 and (s.substreams or 0) >= 4):
            out.append((name, "no 16-channel presentation"))
            continue
        cap = s.fifo_caps[k]
        out.append((name, [s.fifo_stream_bytes[shown], s.fifo_overhead_bytes[shown], s.fifo_peaks[shown], "not checked" if cap is None else cap]))
    return out


def report_text(summary: Row, tally: list[Row]) -> str:
    """What ``verify`` prints of one stream: facts, measurements, substreams, buffers, discs, branches, the tally by rule and the verdict."""
    s = summary
    lines = _table("Stream", [("Input", s.stream_id), ("Syntax", s.syntax or "no major sync found"), ("Sampling rate", s.frequency and f"{s.frequency} Hz"), ("Substreams", s.substreams), ("Substream info", None if s.substream_info is None else f"{s.substream_info:#04X}")])
    size = s.max_access_unit_size and f"{s.average_access_unit_size:.2f} bytes on average, {s.max_access_unit_size} at most"
    rate = s.max_data_rate and f"{s.max_data_rate / 1000:.1f} kbps, at unit {s.max_data_rate_au}"
    latency = None if s.max_fifo_latency_samples is None else f"{s.max_fifo_latency_samples} samples ({s.max_fifo_latency_ms:.3f} ms)"
    lines += _table("Measurements", [("Units", s.access_units), ("Frames", s.frames if s.frames != s.access_units else None), ("Duration", s.duration), ("Unit size", size), ("Highest data rate", rate), ("Longest latency", latency)])
    if s.syntax:
        subs = s.substream_properties or []
        if subs:
            rows = [("Restart sync word", [x.restart_sync_word for x in subs]), ("Channels", [f"{x.min_chan}..{x.max_chan}" for x in subs]), ("Highest matrix channel", [x.max_matrix_chan for x in subs]), ("Deepest", [x.fifo_peak for x in subs]), ("Allowed", [x.fifo_cap for x in subs])]
            lines += _columns("Substreams", [str(x.index) for x in subs], rows)
        else:
            lines += _table("Substreams", [("none", "reached a restart header")])
        if "fifo_peaks" in s and s.fifo_peaks:
            lines += _columns("Cumulative buffers", ["stream", "overhead", "total", "allowed"], _buffer_rows(s))
        yes = lambda x: "yes" if x else "no"
        if s.bluray is not None:
            lines += _table("Disc validity", [("DVD-Audio", "yes, if the 6-channel downmix does not clip" if s.dvd_audio and s.dvd_audio_needs_decode else yes(s.dvd_audio)), ("HD DVD-Video", yes(s.hd_dvd_video)), ("BluRay", yes(s.bluray))])
    if s.branches:
        rows = []
        for k, b in enumerate(s.branches):
            rows.append((f"Branch {k}", [b.au, f"{b.byte_offset:#X}", b.sample, b.advance, "valid" if b.valid else "invalid"]))
            if b.failed:
                rows.append(("  failed", ", ".join(b.failed)))
        rows.append(("Total", f"{len(s.branches)} branches, {s.invalid_branches} invalid"))
        lines += _columns("Branch points", ["unit", "offset", "sample", "advance", "status"], rows)
    rows = sorted((r for r in tally if r.stream_id == s.stream_id), key=lambda r: r.rule)
    lines += _table("Rules", [(r.rule, f"{r['count']} x {r.worst}, units {r.first_au} to {r.last_au}" + (f", {r['count'] - r.shown} not shown" if r["count"] > r.shown else "")) for r in rows] or [("none", "fired")])
    lines += _table("Verdict", [(name, s[name] or 0) for name in ("fatal", "error", "warning", "info")] + [("verdict", s.verdict), ("exit code", s.exit_code)])
    return "\n".join(lines)
