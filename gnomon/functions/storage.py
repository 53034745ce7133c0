"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_top(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own for
    the session, and any other master an error: executors could not see it."""
    app, top = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        top = _local.setdefault(app, f"file://{tempfile.mkdtemp(prefix='gnomon-')}")
    return f"{top.rstrip('/')}/gnomon-{app}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below shared_top()."""
    return f"{shared_top(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to a shared folder and read again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes all tables that this application wrote below its folder. DataFrames that still read them fail then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_top(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, each: int = 16 << 20) -> DataFrame:
    """df over all cores, if it is so small that its files would be read by a few of them; else as it is.

    Only the plan's own estimate of its size is asked for, and only the layout changes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * each else df
