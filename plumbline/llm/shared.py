"""Where operators keep tables and files that all executors read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint directory of the session, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, share: int = 1, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage and is computed once.

    ``share``: a table that is small beside its input is written by this part of the usual number of tasks.
    """
    if share > 1:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // share))
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stale(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``shared_folder`` once no plan reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forgotten(table: DataFrame) -> None:
    """Delete the files of a table made by ``kept``, once no plan reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        stale(table.sparkSession, folder)
