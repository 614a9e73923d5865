"""Counting diagnostics: tallies, rate limits, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.streams import SEVERITIES, severity_rank


def tally(diagnostics: DataFrame, shown: int = 10, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """One row for each rule: how often, how often shown, worst severity, first and last unit, distinct units.

    ``diagnostics`` needs rule, severity and au besides ``by``; a limit of 0 shows all.
    """
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    count = F.count("*")
    return (
        diagnostics.withColumn("__rank", severity_rank(F.col("severity")))
        .groupBy(*by, "rule")
        .agg(
            count.alias("count"),
            (F.least(count, F.lit(shown)) if shown else count).cast("long").alias("shown"),
            F.get(names, F.max("__rank")).alias("worst"),
            F.min("au").alias("first_au"),
            F.max("au").alias("last_au"),
            F.count_distinct("au").alias("access_units"),
        )
    )


def limited(diagnostics: DataFrame, shown: int, by: tuple[str, ...] = ("stream_id",), order: tuple[str, ...] = ("au", "seq")) -> DataFrame:
    """The first ``shown`` diagnostics of each rule in arrival order (0: all)."""
    if not shown:
        return diagnostics
    arrival = Window.partitionBy(*by, "rule").orderBy(*order)
    return diagnostics.withColumn("__n", F.row_number().over(arrival)).where(F.col("__n") <= shown).drop("__n")


def severity_totals(diagnostics: DataFrame, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """A count for each severity, zeros included, and the worst."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return diagnostics.groupBy(*by).agg(*counts, F.get(names, F.max(severity_rank(F.col("severity")))).alias("worst"))


def location(au_offset: Column, bits: Column) -> tuple[Column, Column]:
    """Byte offset in the stream and bit in that byte of a position in a unit; without one, the unit's start."""
    place = F.coalesce(bits, F.lit(0))
    return au_offset + F.floor(place / 8), place % 8
