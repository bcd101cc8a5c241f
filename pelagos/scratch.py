"""Intermediate tables in the folder that driver and executors share.

``written`` cuts lineage by writing a DataFrame as Parquet and reading it again, so a lost executor costs a re-read
of files and never the work behind them.  The folder is the one named by ``spark.checkpoint.dir``; only a local
session that names none gets a temporary folder of its own, which goes when its driver ends.  In the shared folder the
tables stay until ``clear``, as results that were returned may still read them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application.

    Raises ValueError on a cluster that does not set ``spark.checkpoint.dir``: a machine-local folder would not be
    visible to the other executors.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="pelagos-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = _local[app]
    return f"{base.rstrip('/')}/pelagos/{app}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``scratch_dir`` and read back, with the same columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; DataFrames that still read them become unusable."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
