"""Cutting of lineage between rounds, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The table as a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names. Without the setting a temporary
    folder is used for a local master only: a cluster's executors don't see the driver's folders."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if root := spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(root)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return df.checkpoint()


#: While a table is written under this setting, Spark removes the shuffle files of its query as soon as it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The table as files in a folder that all executors share, for large ones: compressed, and read again by column. Nothing else
    of its query stays on disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows"
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all tasks of a shuffle, evenly or by keys. A small file is read by one task or two, and shuffled rows of few
    bytes are put together to as few; that is too few where each row's geometry takes far longer than its reading."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def shared_folder(spark) -> str:
    """A new folder where all executors can write and read, in the one that ``spark.checkpoint.dir`` names (a temporary one for a
    local master without the setting). It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    name = f"{root.rstrip('/')}/tessella-table-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return name
