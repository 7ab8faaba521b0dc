"""Session helpers: reliable checkpoints and size-checked driver reads."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors, as the cluster names it in ``spark.checkpoint.dir``.

    Where none is named, a local master gets a temporary folder; any other master is an error, because its executors could not
    see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """A join with this side is a shuffle, never a broadcast: before a run Spark knows a table by its compressed files, which says little about
    repetitive or exploded text, and a broadcast passes through the driver."""
    return df.hint("merge")


#: Rows of a look-up that may be sent to every task.
FEW_ROWS = 1 << 15


def counted(df: DataFrame, rows: int) -> DataFrame:
    """A look-up of at most so many rows, counted: where they are few, the other side of a join stays where it is. Spark knows a checkpoint by
    its estimate before the run, so it would first write the other side out to shuffle it."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


#: Rows of text that a task is dealt at most, on average.
DEALT_ROWS = 8192


def dealt(df: DataFrame, key: str, always: bool = False) -> DataFrame:
    """A table of texts read from files, dealt out by ``key`` where one task would read most of it: a file of one row group is never split,
    however large it is. Only the number of rows in each partition is looked at, which the files' footers hold. With ``always``, rows of
    one key are together in any case, so that what is grouped by the key needs no shuffle of its own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one number a partition
    if not always and max(rows, default=0) * cores <= 2 * sum(rows):
        return df
    return df.repartition(max(4 * cores, -(-sum(rows) // DEALT_ROWS)), key)


#: Rows that a task sorts at a time where rows of a key are worked on together.
TASK_ROWS = 1 << 17


def by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, dealt out by ``keys`` by its number of rows: AQE joins small partitions by their compressed size, which for
    repetitive rows is a hundredth of what a task then sorts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), *keys)


def session(app: str = "labelforge", cores: str = "*", **conf) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "12g").config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
