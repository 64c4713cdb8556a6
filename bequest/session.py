"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Times without a zone stay as they are, and hot join keys do not stall a stage.  What one task reads of a
# shuffle, and so the memory of its sorts and joins, does not grow with the tables.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


#: Bytes of stored input for which a shuffle has a partition; adaptive execution joins small ones again.
INPUT_PER_PARTITION = 2 << 20
MOST_PARTITIONS = 4096


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Settings for a session; shuffles get more partitions than it asks for where the input is large."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(-(-input_bytes // INPUT_PER_PARTITION), MOST_PARTITIONS)
    if wanted > least:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    else:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return spark


def local_session(cpus: int | str = 8, app: str = "bequest") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_private: list[str] = []
_handed_out: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    A session in a single JVM may do without: it gets a private folder that goes with the process.
    Elsewhere a machine's own folder would be read back in part, so the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _private:
        _private.append(tempfile.mkdtemp(prefix="bequest-"))
        atexit.register(shutil.rmtree, _private[0], ignore_errors=True)
    return _private[0]


def fresh_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(folder)
    return folder


def folders(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """(kind, name, path) of the folders named kind=name within a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path)]
    return [(*p.getName().split("=", 1), p.toString()) for p in found if "=" in p.getName()]


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_folders(spark: SparkSession) -> None:
    """Removes all folders handed out so far; call it once no frame that reads them is needed."""
    while _handed_out:
        remove_folder(spark, _handed_out.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written once to the shared folder.

    For results that several outputs build on: each output then scans its columns instead of
    repeating the joins, and a lost executor costs no more than its own tasks.
    """
    folder = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
