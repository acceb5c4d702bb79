"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local session uses its warehouse; on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set, and the executors of {master} may share no other folder")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_skarn_checkpoints"
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder stays with the cluster's own clean-up
        pass


def folder(spark: SparkSession, tag: str) -> str:
    """A folder to write to, that goes at the end of the driver's process."""
    path = f"{shared_dir(spark)}/skarn/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a recomputation. The table goes with ``release``, or
    at the end of the driver's process.
    """
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skarn_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._skarn_path)
