"""Object events as YAML text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("ID", "samplePos", "active", "pos", "snap", "elevation", "zones", "size", "importance", "gain", "rampLength", "trimBypass", "dialog", "music", "screenFactor", "depthFactor", "headTrackMode", "binauralRenderMode")
COLUMNS = {"ID": "id", "samplePos": "sample_pos", "rampLength": "ramp_length", "trimBypass": "trim_bypass", "screenFactor": "screen_factor", "depthFactor": "depth_factor", "headTrackMode": "head_track_mode", "binauralRenderMode": "binaural_render_mode"}


def scalar(value: object) -> str:
    """A value as this layout writes it: bare numbers, quoted text only where YAML would misread it."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(int(value)) if value == int(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(scalar(v) for v in value) + "]"
    text = str(value)
    if isinstance(value, str) and (not text or text != text.strip() or any(c in text for c in ":#'\"{}[],&*?|<>=!%@\\\n")):
        return "'" + text.replace("'", "''") + "'"
    return text


def event_lines(event: dict) -> Iterator[str]:
    mark = "  - "
    for name in ORDER:
        value = event.get(COLUMNS.get(name, name))
        if value is not None:
            yield f"{mark}{name}: {scalar(value)}"
            mark = "    "


def yaml_events(events: DataFrame, sample_rate: int) -> DataFrame:
    """(stream_id, line_no, line): the events of each stream in order, under a header with the sample rate.

    Lines are rows, so a stream's file is its rows in order, whatever their number.
    """
    names = [COLUMNS.get(n, n) for n in ORDER]

    def run(batches):
        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                clean = {k: None if v is None or (isinstance(v, float) and v != v) else (list(v) if k == "pos" else v) for k, v in row.items()}
                rows += [(clean["stream_id"], int(clean["sample_pos"]), int(clean["id"]), n, line) for n, line in enumerate(event_lines(clean))]
            yield frame.__class__(rows, columns=["stream_id", "sample_pos", "id", "n", "line"])

    body = events.select("stream_id", *names).mapInPandas(run, "stream_id string, sample_pos long, id long, n int, line string")
    heads = events.select("stream_id").distinct().select("stream_id", F.lit(-1).cast("long").alias("sample_pos"), F.lit(-1).cast("long").alias("id"), F.posexplode(F.array(F.lit(f"sampleRate: {sample_rate}"), F.lit("events:"))).alias("n", "line"))
    return heads.unionAll(body).orderBy("stream_id", "sample_pos", "id", "n")
