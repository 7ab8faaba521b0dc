"""Registry of queries (Spark) and their oracle SQL, and the adapter views over the driver tables.

The driver tables stand in for the domain: part names are dictionary names, an order is a printed label or a saved product,
its line items are the printed ingredients, a customer is a user, p_type is a class or family, events are readings or logs.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.dictionary import NameDictionary, build_dictionary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the data folder. Where the session setting ``labelforge.partitions`` is given, its rows are dealt into so many
    partitions first, for files that cannot be split (one row group)."""
    df, n = spark.read.parquet(f"{d}/{name}.parquet"), spark.conf.get("labelforge.partitions", None)
    return df.repartition(int(n)) if n else df


def part_names(spark, d) -> DataFrame:
    """Distinct part names as dictionary names."""
    return table(spark, d, "part").select(F.upper("p_name").alias("inci_name")).distinct()


def part_dictionary(spark, d) -> NameDictionary:
    """Part names, with the words of each name swapped as an alias ('RING SMALL' for 'SMALL RING')."""
    n = part_names(spark, d)
    w = F.split("inci_name", " ")
    al = n.select("inci_name", F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0))).alias("alias"), F.lit("common_name").alias("kind"), F.lit(0).alias("ord"))
    return build_dictionary(n, al, {"dictionarySource": "parts", "dictionaryVersion": "1"})


def lines(spark, d) -> DataFrame:
    """Line items in printed order with the part's name and type; ``printed`` has a letter missing on every fifth line."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = li.withColumn("idx", F.row_number().over(w) - 1).join(p, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    at = (F.col("l_partkey") % F.length("p_name")).cast("int")
    cut = F.concat(F.substr("p_name", F.lit(1), at), F.substr("p_name", at + 2))
    return out.withColumn("printed", F.when((F.col("l_orderkey") + F.col("idx")) % 5 == 0, cut).otherwise(F.col("p_name")))


def order_labels(spark, d) -> DataFrame:
    """One printed label per order: its line texts in order."""
    g = lines(spark, d).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("idx", "printed"))).alias("m"))
    return g.select(F.col("l_orderkey").alias("label_id"), F.lit(0).alias("source_index"), F.array_join(F.col("m.printed"), ", ").alias("raw"))


# ---- the same adapters as SQL
LI = """li AS (SELECT *, CASE WHEN (l_orderkey + idx) % 5 = 0 THEN substr(p_name, 1, CAST(l_partkey % length(p_name) AS INT)) || substr(p_name, CAST(l_partkey % length(p_name) AS INT) + 2) ELSE p_name END AS printed
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate, l_returnflag, p_name, p_type, p_size, p_retailprice,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def sql_key(x: str, wildcard: bool = True) -> str:
    keep = "A-Z0-9?" if wildcard else "A-Z0-9"
    return f"regexp_replace(upper(replace({x}, 'ß', 'ss')), '[^{keep}]', '', 'g')"


SQL_CLEAN = ("regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(text, '-\\s*\\r?\\n\\s*', '', 'g'), '\\s*\\r?\\n\\s*', ' ', 'g'), '•·、', ',,,'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")
