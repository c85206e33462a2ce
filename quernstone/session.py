"""Session defaults, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quernstone", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the given session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a session on this machine alone (``local[...]``) that names none gets a folder here; on a cluster its absence
    is an error, since files of one machine would be lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-quernstone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps of an iteration restart from files that outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stages/{spark.sparkContext.applicationId}"


def write_stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as compressed Parquet in the shared folder and read it back.

    ``by`` is a column whose values become folders, so that a filter on it reads those alone.
    """
    spark = df.sparkSession
    path = f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for files that are no tables; nothing is made there yet."""
    path = f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def remove_stages(spark: SparkSession) -> None:
    """Delete the stages of this application; results not yet collected or written cannot be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Session setting: how many partitions a corpus of a few large files is dealt into. Unset: as the files are cut.
CORPUS_PARTITIONS = "quernstone.corpus.partitions"


def corpus(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a table of texts, in :data:`CORPUS_PARTITIONS` partitions if the session sets that."""
    df = table(spark, sf_dir, name).select(*columns)
    parts = spark.conf.get(CORPUS_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df
