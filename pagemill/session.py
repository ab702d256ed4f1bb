"""Session helpers shared by operators and queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    On a cluster the setting must be there. Only a session whose master is ``local``
    gets a folder of its own when it is unset, removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own_dir = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, own_dir, ignore_errors=True)
        named = "file://" + own_dir
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as Parquet in the shared folder and read it back.

    Used where a result feeds several branches: lineage ends there, the copy survives the
    loss of executors and later readers can prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimizer estimates it; used to check a side before a broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
