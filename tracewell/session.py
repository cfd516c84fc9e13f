"""Session helpers: a local session for tests, and a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: str | int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local[cores] session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.cteRecursionRowLimit", "-1")
        .getOrCreate()
    )


def _qualified(spark: SparkSession, path: str):
    """The file system that Spark writes path to, and the path with its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path, with its scheme, for a job's own tables, under the folder that spark.checkpoint.dir names.

    Every executor and the driver see it. Only where the setting is absent in a local session is a temporary
    folder made for the process, set as checkpoint folder and removed at exit; on a cluster that is an error,
    as executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _LOCAL_ROOTS:
            path = tempfile.mkdtemp(prefix="tracewell-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{path}")
            _LOCAL_ROOTS[key] = f"file://{path}"
        root = _LOCAL_ROOTS[key]
    return _qualified(spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")[1].toString()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and its size is known."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables, once nothing reads them any more; other tables stay."""
    for df in tables:
        path = df.__dict__.pop("_written_to", None)
        if path:
            fs, at = _qualified(df.sparkSession, path)
            fs.delete(at, True)
