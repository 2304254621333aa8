"""Cutting lineage where a result must not be computed twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the cluster's shared folder, so that what depends on partitions stays as it is.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests, is one made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    told = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
    if told:
        context.setCheckpointDir(told)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        own = tempfile.mkdtemp(prefix="unifold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return df.checkpoint()
