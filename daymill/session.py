"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "daymill", master: str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**CONF, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_RUNS: dict[str, str] = {}


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def require_shared(scheme: str, master: str) -> None:
    """An error where executors on other machines could not reach the folder."""
    if scheme == "file" and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")


def shared_base(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables.

    It lies under ``spark.checkpoint.dir``, which every executor reaches, or where that is unset under the
    warehouse.  On a cluster a warehouse of one machine is an error.  The folder is deleted when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        base = given or spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{base.rstrip('/')}/daymill-{app}"
        at, fs = _hadoop_path(spark, folder)
        if not given:
            require_shared(fs.getUri().getScheme(), spark.sparkContext.master)
        _RUNS[app] = folder
        atexit.register(_delete, fs, at)
    return _RUNS[app]


def _delete(fs, at) -> None:
    from py4j.protocol import Py4JError

    with suppress(Py4JError, OSError):  # the JVM may have ended
        fs.delete(at, True)


def drop_work(spark: SparkSession) -> None:
    """Delete the application's intermediate tables before its end."""
    folder = _RUNS.pop(spark.sparkContext.applicationId, None)
    if folder:
        at, fs = _hadoop_path(spark, folder)
        fs.delete(at, True)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under :func:`shared_base`."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


#: A part of a table dealt over the cores holds about so many bytes of its files.
PART_BYTES = 16 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a read table dealt over all cores where its scan has fewer parts than there are cores, or large ones.

    For stages that work long on each row: the scan of a file with one row group is one task.  A larger table is dealt into
    more parts, so that what a task sorts and counts does not grow with the table.  A table in many small files
    stays as it is, without a shuffle.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    size = sum(fs.getFileStatus(at).getLen() for at, fs in (_hadoop_path(spark, f) for f in files))
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df if len(files) >= parts else df.repartition(parts, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by ``keys`` into ``spark.sql.shuffle.partitions`` parts, for a join by the same keys.

    Parts counted this way are not merged for their size: repeated texts are small when compressed but slow to work on.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Shuffle files of a query are deleted when it ends, and not when the driver happens to collect its memory.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, codec: str | None = None, clean: bool = False) -> DataFrame:
    """Write a stage once and read it back; ``codec`` compresses its files instead of the session's default.

    With ``clean`` the shuffle files of the write are deleted when it ends.

    A plan that uses a stage several times would compute it several times; a written
    table also survives lost executors.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true" if clean else kept)
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
