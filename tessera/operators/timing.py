"""Windows over a stream's units: clocks, gaps, intervals and the rules on them.

Units have stream_id, au (from 0), and the columns each function names.  All
windows are partitioned by stream and ordered by au.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.storage import side_by_side

WRAP = 1 << 16


def in_order():
    """A stream's units in order."""
    return Window.partitionBy("stream_id").orderBy("au")


def so_far():
    """A unit and all before it."""
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def unwrapped(units: DataFrame, timing: str = "input_timing") -> DataFrame:
    """Adds ``unwrapped``: the 16-bit clock, higher by a full turn at each step back."""
    back = F.when(F.col(timing) < F.lag(timing).over(in_order()), WRAP).otherwise(0)
    return units.withColumn("__back", back).withColumn("unwrapped", (F.col(timing) + F.sum("__back").over(so_far())).cast("long")).drop("__back")


def restart_gaps(units: DataFrame) -> DataFrame:
    """Adds ``gap`` (units since the major sync before; at major syncs only), ``distance`` (units since the last one) and ``segment``."""
    major = F.when(F.col("is_major"), F.col("au"))
    before = F.last(major, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return units.withColumns(
        {
            "gap": F.when(F.col("is_major"), F.col("au") - before),
            "distance": F.col("au") - F.last(major, ignorenulls=True).over(so_far()),
            "segment": F.count(major).over(so_far()),
        }
    )


def intervals(units: DataFrame, peak: Column | int) -> DataFrame:
    """Adds the interval to the unit before, this unit's buffer duration and the one before's length and duration."""
    duration = ceil_div(F.col("length") * 256, peak)
    return units.withColumns(
        {
            "interval": (F.col("input_timing") - F.lag("input_timing").over(in_order())).bitwiseAND(F.lit(WRAP - 1)),
            "previous_length": F.lag("length").over(in_order()),
            "previous_duration": F.lag(duration).over(in_order()),
        }
    )


def interval_rules(units: DataFrame, samples: int, longest: int, peak: int) -> DataFrame:
    """(stream_id, au, rule): one row for each interval rule that a unit breaks; ``units`` as from :func:`intervals`."""
    rules = {
        "access_unit.timing_too_short": F.col("interval") < samples // 4,
        "access_unit.timing_shorter_than_previous": F.col("interval") < F.col("previous_duration"),
        "access_unit.data_rate_exceeded": F.col("previous_length") * 256 > F.col("interval") * peak,
        "access_unit.timing_too_long": F.col("interval") > longest,
    }
    return broken(units, rules)


def broken(rows: DataFrame, rules: dict[str, Column], *more: str) -> DataFrame:
    """One row for each rule whose condition holds, with the columns ``more``."""
    fired = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return rows.select("stream_id", "au", *more, F.explode(fired).alias("rule"))


def depths(units: DataFrame, samples: int | Column, **sizes: str) -> DataFrame:
    """Adds ``drained`` (records that have left the buffer), ``underrun`` and ``depth`` (bytes in it after this unit's).

    Closed form of the drain: a record leaves once the unwrapped input clock has
    passed its output time by more than one unit, so the number that has left
    is a running maximum, and the depth a difference of two prefix sums.
    ``units`` needs unwrapped, bytes and ``first_output``; with ``sizes``
    (depth's name = column of bytes) all these depths come from one pass.  A
    unit that would have drained records that have not arrived is an underrun.
    """
    sizes = sizes or {"depth": "bytes"}
    passed = F.greatest(F.lit(0), ceil_div(F.col("unwrapped") - F.col("first_output"), samples) - 1)
    sums = F.struct(*[F.sum(column).over(so_far()).alias(name) for name, column in sizes.items()])
    with_prefix = units.withColumns({"__passed": passed, "__prefix": sums}).withColumn("drained", F.max("__passed").over(so_far()))
    # the prefix sums at the last drained record: both rows of one stream, so the same partitioning serves the join
    ends = with_prefix.select(F.col("stream_id").alias("__s"), F.col("au").alias("__a"), F.col("__prefix").alias("__gone"))
    joined = with_prefix.join(side_by_side(ends), (F.col("stream_id") == F.col("__s")) & (F.col("drained") - 1 == F.col("__a")), "left")
    held = lambda name: F.when(F.col("drained") <= F.col("au"), F.col("__prefix")[name] - F.coalesce(F.col("__gone")[name], F.lit(0)))
    return joined.withColumns({name: held(name) for name in sizes} | {"underrun": F.col("drained") > F.col("au")}).drop("__s", "__a", "__gone", "__passed", "__prefix")


def peak_depth(buffered: DataFrame) -> DataFrame:
    """Each stream's greatest depth, at its first instant."""
    best = F.max(F.struct("depth", (-F.col("au")).alias("minus"))).alias("best")
    return buffered.where("depth is not null").groupBy("stream_id").agg(best).select("stream_id", F.col("best.depth").alias("depth"), (-F.col("best.minus")).alias("au"))
