"""Session helpers: a local session for tests and the shared folder for written stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "leafmill", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is absent and the master is local, as in
    tests; on a cluster without the setting this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_STAGES: list[str] = []
#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    It cuts the lineage, so that a stage used several times is computed once and survives the loss of
    an executor. The shuffle files of the write go when it is over; otherwise they stay until the driver
    happens to collect its garbage. The folder stays until :func:`release` is called.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/leafmill-{name}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the stages written so far, once the results that read them are used; how many there were."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_STAGES)
    while _STAGES:
        path = jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Sides of joins are broadcast by hint only below this many rows of a measured count.
BROADCAST_ROWS = 100_000
