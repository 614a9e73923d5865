"""All queries of the bitstream engine, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import bitlevel, decoding, reporting, timing

FLAGSHIP = "q14_tally"
Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (bitlevel, timing, reporting, decoding)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Queries without SQL (sequential or streaming ones) are absent."""
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
