"""State that is carried from unit to unit, as windows over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.timing import in_order, so_far


def carried(units: DataFrame, update: Column, default: Column, restart: Column) -> Column:
    """A parameter's value: its last update since the restart, else the default.

    Needs ``segment``: the running count of restarts.
    """
    inside = Window.partitionBy("stream_id", "segment").orderBy("au").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(update, ignorenulls=True).over(inside), default)


def segmented(units: DataFrame, *config: str) -> DataFrame:
    """Adds ``output_segment``: goes up where any of the configuration columns differs from the unit before."""
    changed = F.lit(False)
    for name in config:
        changed = changed | ~F.col(name).eqNullSafe(F.lag(name).over(in_order()))
    first = F.lag("au").over(in_order()).isNull()
    return units.withColumn("__changed", F.when(~first & changed, 1).otherwise(0)).withColumn("output_segment", F.sum("__changed").over(so_far())).drop("__changed")


def changed_only(units: DataFrame, *names: str) -> DataFrame:
    """Each column null where it repeats the unit before; rows in which nothing changed go, first rows stay."""
    first = F.lag("au").over(in_order()).isNull()
    fresh = {n: F.when(first | ~F.col(n).eqNullSafe(F.lag(n).over(in_order())), F.col(n)) for n in names}
    new = units.withColumns({f"__{n}": c for n, c in fresh.items()}).withColumn("__any", first)
    some = F.col("__any")
    for n in names:
        some = some | F.col(f"__{n}").isNotNull()
    kept = new.where(some)
    return kept.select(*[F.col(f"__{c}").alias(c) if c in names else F.col(c) for c in units.columns])


def cadence(units: DataFrame, update: str) -> DataFrame:
    """Adds ``since``: units since the last one with an update (from the stream's start, if none)."""
    last = F.last(F.when(F.col(update).isNotNull(), F.col("au")), ignorenulls=True)
    before = last.over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return units.withColumn("since", F.col("au") - F.coalesce(before, F.lit(0)))


def duplicates(units: DataFrame, *same: str) -> DataFrame:
    """Adds ``is_duplicate``: all of ``same`` equal the unit before's."""
    equal = F.lag("au").over(in_order()).isNotNull()
    for name in same:
        equal = equal & F.col(name).eqNullSafe(F.lag(name).over(in_order()))
    return units.withColumn("is_duplicate", equal)


def repeated_units(samples: DataFrame) -> DataFrame:
    """(stream_id, presentation, au) of the units that repeat the one before, as a splice may: a restart at the same output time, and samples of the same digest.

    ``samples`` as from units.pcm, whose digests run through an interval.
    """
    rows = samples.select("stream_id", "presentation", "segment", "au", "digest", "output_timing")
    order = Window.partitionBy("stream_id", "presentation").orderBy("au")
    inside = Window.partitionBy("stream_id", "presentation", "segment").orderBy("au")
    own = F.col("digest").bitwiseXOR(F.coalesce(F.lag("digest").over(inside), F.lit(0).cast("long")))
    earlier = F.last("output_timing", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumns({"own": own, "earlier": earlier})
    same = (F.col("output_timing") == F.col("earlier")) & (F.col("own") == F.lag("own").over(order))
    return marked.withColumn("same", same).where("same").select("stream_id", "presentation", "au")


def merged_branches(restarts: DataFrame, conditions: list[str]) -> DataFrame:
    """One row for each unit with branches: the conditions that any of its restarts failed, and whether none did."""
    failed = F.array_compact(F.array(*[F.when(~F.every(c), F.lit(c)) for c in conditions]))
    merged = restarts.groupBy("stream_id", "au").agg(failed.alias("failed"), F.count("*").alias("restarts"))
    return merged.withColumn("valid", F.size("failed") == 0)
