"""Tables that a query writes for itself: what several branches of a plan need is computed once, and its lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, one for each application: within spark.checkpoint.dir.

    Only where it is unset and all runs in one process, as in tests, it is a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="wordloom-")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/wordloom-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the application's shared folder: its lineage ends here, and a lost executor takes nothing with it.

    Results are lazy and may read their staged tables at any time, so these stay until the application's folder is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
