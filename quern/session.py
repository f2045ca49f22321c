"""Session builder and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", name: str = "quern", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` overrides by dotted key."""
    b = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a folder of this
    machine only where that is unset and the session is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = getattr(shared_folder, "_made", None)
    if made is None:
        made = shared_folder._made = "file://" + tempfile.mkdtemp(prefix="quern-")
    return made


def _steps(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/steps-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    path = f"{_steps(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step_path(spark: SparkSession, label: str) -> str:
    """A new path among this application's steps."""
    return f"{_steps(spark)}/{label}-{uuid.uuid4().hex}"


def clear_steps(spark: SparkSession) -> None:
    """Remove the tables between steps that this application has written, once its results are stored elsewhere.  The
    retrieval index stays."""
    remove(spark, _steps(spark))


def spread(df: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """A small table of few files is dealt out to all cores before costly expressions; larger tables, which have
    splits enough, stay as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > limit:  # the files of a large table are never listed here
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) * 2 > cores else df.repartition(cores)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def table_version(spark: SparkSession, path: str) -> str:
    """A name for the present content of a file table: its path, last change, number of files and bytes (read from the
    file system's summary, without listing files to the driver)."""
    where, fs = _file_system(spark, path)
    status, summary = fs.getFileStatus(where), fs.getContentSummary(where)
    return f"{path}|{status.getModificationTime()}|{summary.getFileCount()}|{summary.getLength()}"
