"""Streams derived from the event table, for the queries and their SQL.

A user is a stream and an event a unit: its place in time order is the unit's
index, quarter minutes are the 16-bit input clock, the event's value gives its
length in words, and sign-ups and purchases are major syncs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLES, PEAK, LONGEST = 1600, 96, 6000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    placed = events.withColumn("au", F.row_number().over(order).cast("long") - 1)
    return placed.select(
        F.col("user_id").alias("stream_id"),
        "au",
        "event_id",
        "event_type",
        F.floor(epoch_ms("ts") / 15_000).cast("long").alias("clock"),
        F.floor(epoch_ms("ts") / 15_000).cast("long").bitwiseAND(F.lit(65_535)).alias("input_timing"),
        ((F.floor(F.col("value") * 10) % 4095) + 1).cast("long").alias("length"),
        F.col("event_type").isin("signup", "purchase").alias("is_major"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: The same rows in SQL.
UNITS = """units AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS au, event_id, event_type,
    epoch_us(ts) // 15000000 AS clock, (epoch_us(ts) // 15000000) & 65535 AS input_timing,
    CAST(floor(value * 10) AS BIGINT) % 4095 + 1 AS length, event_type IN ('signup', 'purchase') AS is_major,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""
