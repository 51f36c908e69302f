"""Session defaults and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, once per Spark context.

    The driver packs the sources and hands the archive to Spark, whose file server gives it to
    every executor, also to later ones; nothing has to be installed there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidewire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it is imported from such an archive already
        folder = tempfile.TemporaryDirectory(prefix="tidewire-")
        atexit.register(folder.cleanup)
        archive = Path(folder.name, "tidewire.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(archive))
    sc._tidewire_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.TemporaryDirectory(prefix="tidewire-")
        atexit.register(own.cleanup)
        sc.setCheckpointDir("file://" + own.name)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the table.

    Cuts the lineage: what follows doesn't run the steps before again, also when an
    executor is lost. The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file of the driver's into the shared folder; its path."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm)
    out.write(bytearray(content))
    out.close()
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone, and with it the way to the folder
        pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
