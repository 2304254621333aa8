"""Where operators put what must outlive a stage: the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset (tests), one temporary folder per session."""
    told = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if told:
        return told
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    own = tempfile.mkdtemp(prefix="unifold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/unifold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, once nothing reads it any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Bound the Arrow batches that Python workers get by bytes, so that long texts can't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
