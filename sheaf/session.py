"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sheaf")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SHEAF_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session that runs inside one machine may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sheaf-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def task_count(spark: SparkSession, size: int, per_task: int) -> int:
    """Tasks for ``size`` units of work: at least one per core, and more as the work grows."""
    return max(spark.sparkContext.defaultParallelism, -(-size // per_task))


def store_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Like a checkpoint it cuts the lineage; unlike one it is compressed and later readers
    take only the columns they need.
    """
    location = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def drop_table(stored: DataFrame) -> None:
    """Delete the files of a table that ``store_table`` wrote and nothing reads any more."""
    spark = stored.sparkSession
    shared = hadoop_path(spark, shared_folder(spark)).toString()
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if place.getName().startswith("table-") and hadoop_path(spark, place.getParent().toString()).toString() == shared:
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hadoop_path(spark: SparkSession, location: str):
    """The path with scheme and authority: without a scheme it is on the default file system, as for Spark's readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)


def qualified(spark: SparkSession, location: str) -> str:
    return hadoop_path(spark, location).toString()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, for clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it already runs from an archive
        target = Path(tempfile.mkdtemp(prefix="sheaf-package-")) / "sheaf-package.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder so that lost executors cannot change or repeat it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
