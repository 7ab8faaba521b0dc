"""Corpus pipeline: language ID, line de-duplication, near-duplicates, benchmark decontamination, byte-level BPE.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Rows with a null id pass every stage that has no reason of its own to drop them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.llm import bpe, decontaminate, language, lines, near, queries
from labelforge.llm.common import crc_mod, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identifiable language (null text or no letter); all others stay as they are."""
    model = language.learn(docs.filter(crc_mod("doc_id", 4) != 2))
    return language.identify(docs.select(F.struct(*COLUMNS).alias("d"), F.col("text")), model, "d").filter(F.col("lang_pred") != language.UNDETERMINED).select("d.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows; ``n_chars`` follows the text, and a document of which only blank lines are left goes."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "")) == "")
    out = out.filter(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each near-duplicate component."""
    found = near.near_duplicates(docs)
    gone = found.filter(F.col("component") != F.col("doc_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by benchmark items."""
    judged = decontaminate.find_contamination(docs.select(F.struct(*COLUMNS).alias("d"), "text"), table(spark, sf_dir, "benchmark"), "d")
    return judged.filter(~F.col("contaminated")).select("d.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again; ids, token counts and digests of both."""
    e = bpe.encode_decode(docs, queries.RANKS, queries.PATTERN)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokenise", tokenise)]

#: Language ID and byte-pair encoding have no SQL form; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to a new folder beside the checkpoints and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
