"""Where intermediate tables live and how they get there.

Everything that must outlive a stage goes to the folder the cluster names in
``spark.checkpoint.dir``: shared by all executors, so a lost executor loses
nothing.  Only a plain ``local[...]`` session without that setting gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = base or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        base = _LOCAL[app]
    root = f"{base.rstrip('/')}/tessera/{context.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return root


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    """Best effort at driver exit; the session may already be gone."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM has ended before us
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by some columns, over as many tasks as the session's shuffles have: those that cost much are not merged for being narrow."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def side_by_side(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that never goes through the driver.

    A table's size is estimated from its compressed files and the columns read;
    narrow rows of millions of units pass for a few megabytes, and the driver
    would gather them all for a broadcast.
    """
    return df.hint("merge")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise`; nothing may read it afterwards."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/tessera/{spark.sparkContext.applicationId}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
