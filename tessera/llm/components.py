"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay in tables; the driver sees two numbers an iteration.  Each step's
result is written to the shared folder, so lineage stays short and a lost
executor costs one step.  Up to IN_ONE_TASK links, a bounded number, one task
joins them all at once, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import map_batches
from tessera.storage import discard, materialise

IN_ONE_TASK = 200_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _at_once(links: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            top = x
            while above.get(top, top) != top:
                top = above[top]
            while x != top:
                above[x], x = top, above[x]
            return top

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                above[max(u, v)] = above.setdefault(min(u, v), min(u, v))
        found = [(x, root(x)) for x in list(above)]
        found = [f for f in found if f[0] != f[1]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["node", "root"])

    kind = links.schema["u"].dataType.simpleString()
    return map_batches(links.coalesce(1), run, f"node {kind}, root {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that isn't its component's smallest node, the root.

    Nulls and links from a node to itself are ignored; repeated links count once.
    """
    current = materialise(links.select("u", "v").where("u <> v"), "links")
    if current.count() <= IN_ONE_TASK:
        return materialise(_at_once(current), "components")
    current = materialise(current.distinct(), "links")
    seen = None
    while True:
        large = materialise(_large_star(current), "large-star")
        after = materialise(_small_star(large), "small-star")
        discard(large)
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(sign) == seen or not sign[0]:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(sign)
        if current is not after:
            discard(current)
        current = after
