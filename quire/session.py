"""Session helpers: one place for the settings the plans rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quire", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A session for local work; on a cluster pass ``master=None`` and let spark-submit decide."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: ``spark.checkpoint.dir`` where the cluster sets it.

    Only where it is unset in a session of one machine, as in tests, a folder of our own is used. On a cluster its
    executors could not see such a folder, so there the setting must be given.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(?:\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="quire-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def forgotten(spark: SparkSession, stem: str) -> str:
    """A path of its own that begins with ``stem`` and is deleted when the session's JVM ends."""
    path = f"{stem}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back: cuts its lineage.

    The table survives the loss of any executor, unlike a cached or locally checkpointed one. It is deleted when the
    session's JVM ends.
    """
    spark = df.sparkSession
    path = forgotten(spark, f"{checkpoint_dir(spark).rstrip('/')}/quire")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
