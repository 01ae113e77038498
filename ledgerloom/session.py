"""Session settings and results kept on shared storage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # test tables are small: keep them spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on: adaptive plans that split a hot statement."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a skewed join even when the split costs one more exchange downstream
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Only a local session without that setting gets a machine-local folder; a
    cluster without it is refused, since executors could not see each other's files.
    """
    context = spark.sparkContext
    base = _configured(spark)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder(context.applicationId)
    jvm = context._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{context.applicationId}-{uuid.uuid4().hex}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return system.makeQualified(path).toString()


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


@cache
def _own_folder(application: str) -> str:
    """A folder of a local session's own; the setting itself cannot be changed any more."""
    return "file://" + tempfile.mkdtemp(prefix="ledgerloom-")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once as columns to shared storage and read it from there.

    Cuts the lineage like ``checkpoint()``, but later scans prune columns and push
    filters down.  Lost executors lose nothing.
    """
    return passing_checkpoint(df)[0]


#: Lets Spark remove a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def passing_checkpoint(df: DataFrame) -> tuple[DataFrame, str]:
    """``reliable_checkpoint`` and its folder, for ``remove`` once the last reader is done.

    The shuffle files of the writing job go with its end: nothing but the written table is read later.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder + "/table")
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder + "/table"), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``shared_folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
