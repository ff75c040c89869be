"""Stored intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may have to be broadcast; beyond them the joins shuffle both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a local session gets
    a temporary folder; a cluster session is refused, as a folder of one machine
    is invisible to the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    # local-cluster has executors of its own
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="gaugeflow-")
        context.setCheckpointDir(_own_dirs[app])
        atexit.register(__import__("shutil").rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder."""
    return f"{shared_dir(spark)}/gaugeflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._gaugeflow_path = path
    return back


def sided(df: DataFrame) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if its rows and their bytes are counted to be few."""

    def size(name: str, kind: str):
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 16
        if kind.startswith(("array", "struct", "map")):
            return F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) + 16
        return F.lit(16)

    row = sum((size(*c) for c in df.dtypes), F.lit(0))
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    spark, path = df.sparkSession, df._gaugeflow_path
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
