"""Session helper for tests and benches, and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []


def local_session(cores: int | str = 8, app: str = "quillmesh", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use; it names its own shared folder."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(CHECKPOINT_KEY, "file://" + _own_folder())
        .getOrCreate()
    )


def _own_folder() -> str:
    """One temporary folder per process, removed when the process ends."""
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillmesh-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a session on a local master gets a temporary folder of its own; on a cluster
    that would be a folder of one machine, so there an unset name is an error.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "file://" + _own_folder()
    raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share; it is unset and the master is {master}")


def materialise(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write df once into the shared folder and read it back.

    The lineage ends at replicated files, so a lost executor costs no recomputation, and each
    later reader prunes columns. (DataFrame.checkpoint computes its input twice and keeps rows.)
    The files stay until release() or, for a local session, the end of the process; the shuffle
    files of the writing go with it, as nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__["_files"] = path
    return back


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quillmesh/{spark.sparkContext.applicationId}"


def discard(*written: DataFrame) -> None:
    """Delete the files of frames that materialise() returned; nothing may read them afterwards."""
    for df in written:
        _delete(df.sparkSession, df.__dict__["_files"])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all that materialise() wrote for this application; frames that read it end with it."""
    _delete(spark, _run_folder(spark))
