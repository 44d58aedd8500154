"""Session construction and the one place where intermediates are written out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _own_folder() -> str:
    """Folder on this machine for a session whose tasks all run on it; it goes with the process."""
    path = tempfile.mkdtemp(prefix="cohortlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def local_session(app: str = "cohortlens", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark. A cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", _own_folder())
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The session names it in ``spark.checkpoint.dir``. Where that is unset, a session with a local master, whose
    driver and executors are one process, gets a checkpoint folder of its own; any other is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(_own_folder())
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def _staged_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/staged/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{_staged_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged. Frames that read it can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, keeps column pruning and filter
    pushdown for the readers, and gives the optimizer the real size: a small intermediate
    is then broadcast because its file size is under the threshold, a large one is not.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
