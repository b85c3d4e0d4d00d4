"""Sessions, and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; none of them depends on the size of the data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vistaframe")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark application: needed where it isn't installed on them."""
    context = spark.sparkContext
    if getattr(context, "_vistaframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="vistaframe-")  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "vistaframe_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("vistaframe", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._vistaframe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names in spark.checkpoint.dir, else (tests only) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), f"vistaframe-{os.getuid()}-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder, which is removed when the application ends."""
    context = spark.sparkContext
    own = f"{shared_folder(spark)}/vistaframe/{context.applicationId}"
    if getattr(context, "_vistaframe_scratch", None) != own:
        context._vistaframe_scratch = own
        atexit.register(_remove_at_exit, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: the plan ends there and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        _remove(spark, folder)


def forget(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder, and nothing of others. Frames that read it are of no
    use afterwards. Without this call it is removed when the driver's Python ends."""
    _remove(spark, f"{shared_folder(spark)}/vistaframe/{spark.sparkContext.applicationId}")
