"""Parquet tables of user collections and resolution output.

User tables are partitioned by a hash bucket of the user, so an upsert or an erasure rewrites only the touched buckets.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dictionary import first_per
from ..operators.resolve import Resolution
from ..runtime import by_rows, durable

BUCKETS = 256


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))


def tolerant_products(df: DataFrame) -> DataFrame:
    """Missing collections read as empty ones."""
    none = F.array().cast("array<string>")
    return df.withColumn("ingredients", F.coalesce("ingredients", none)).withColumn("unresolved", F.coalesce("unresolved", none))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both tables, the latest per key."""
    return first_per(current.unionByName(incoming), keys, F.desc(order))


def forget_users(table: DataFrame, users: DataFrame) -> DataFrame:
    """The table without the rows of the users."""
    return table.join(users.select("user_id").distinct(), "user_id", "left_anti")


def write_buckets(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite only the buckets present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: str) -> None:
    """Upsert into a stored table: only the buckets of the incoming users are read and rewritten."""
    new = with_bucket(incoming)
    touched = new.select("bucket").distinct()
    current = spark.read.parquet(path).join(touched, "bucket", "left_semi")
    write_buckets(spark, durable(upsert(current.select(new.columns), new, keys, order)), path)


def forget_in_table(spark: SparkSession, path: str, users: DataFrame) -> None:
    """Erase users from a stored table; a bucket that would become empty keeps no rows of them either."""
    gone = with_bucket(users.select("user_id").distinct())
    table = spark.read.parquet(path)
    touched = [r["bucket"] for r in gone.select("bucket").distinct().collect()]  # at most BUCKETS values
    rest = durable(forget_users(table.where(F.col("bucket").isin(touched)), users))
    left = {r["bucket"] for r in rest.select("bucket").distinct().collect()}
    write_buckets(spark, rest, path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for b in touched:
        if b not in left:
            p = fs_path(f"{path}/bucket={b}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_resolution(r: Resolution, path: str, meta: dict[str, str] | None = None, fmt: str = "parquet") -> dict[str, int]:
    """Items, removed fragments and run metadata; returns row counts only (no label text leaves the job)."""
    spark = r.items.sparkSession
    counts = {}
    for name, df in (("items", r.items), ("removed", r.removed)):
        order = "idx" if name == "items" else "position"
        by_rows(df, r.segments, "label_id").sortWithinPartitions("label_id", order).write.mode("overwrite").format(fmt).save(f"{path}/{name}")
        counts[name] = spark.read.format(fmt).load(f"{path}/{name}").count()
    rows = sorted((meta or {}).items())
    spark.createDataFrame(rows or [("", "")], "key string, value string").where("key <> ''").write.mode("overwrite").format(fmt).save(f"{path}/meta")
    return counts
