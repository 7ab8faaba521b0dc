"""Reading label, truth, name and reference files into tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dictionary import explode_aliases, map_catalogue_columns


def parse_seed_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines 'inci_name|category|ALIAS:kind;...' ('#' lines and the header skipped) -> rows and exploded aliases."""
    f = F.split("value", r"\|", -1)
    rows = (lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("inci_name|") & (F.trim("value") != ""))
            .select(F.get(f, F.lit(0)).alias("inci_name"), F.nullif(F.coalesce(F.get(f, F.lit(1)), F.lit("")), F.lit("")).alias("category"), F.get(f, F.lit(2)).alias("aliases")))
    return rows, explode_aliases(rows)


def read_seed_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_seed_lines(spark.read.text(path))


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV with sniffed delimiter (, ; | or tab) and headers mapped by alias."""
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("﻿")
    sep = max([",", ";", "|", "\t"], key=line.count)
    return map_catalogue_columns(spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"'))


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """entry, common_ingredient_name -> rows with ``ord`` in entry order."""
    g = spark.read.schema("entry int, common_ingredient_name string").csv(path, header=True, escape='"')
    return g.select(F.col("common_ingredient_name").alias("inci_name"), F.col("entry").cast("string").alias("cosing_ref"), F.col("entry").alias("ord"))


TRUTH = ("id string, golden boolean, verified boolean, provenance string, front_text string, raw_ingredients string, other_fields map<string,string>, "
         "expected_removed array<struct<raw:string,reason:string>>, expected array<struct<raw:string,inci:string,category:string,suggested_any_of:array<string>,note:string>>")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Multi-line JSON fixtures -> labels(label_id, source_index, raw), truth, truth_removed; other fields become extra tokens from 1 on."""
    j = spark.read.schema(TRUTH).json(path, multiLine=True)
    tokens = F.concat(F.array("raw_ingredients"), F.map_values(F.coalesce("other_fields", F.create_map().cast("map<string,string>"))))
    labels = j.select(F.col("id").alias("label_id"), F.posexplode(tokens).alias("source_index", "raw"))
    truth = j.select(F.col("id").alias("label_id"), F.posexplode("expected").alias("ord", "e")).select("label_id", "ord", "e.*")
    removed = j.select(F.col("id").alias("label_id"), F.explode("expected_removed").alias("r")).select("label_id", "r.*")
    return labels, truth, removed


def read_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Claims JSON -> phrases(claim_id, kind, ord, phrase) and rules(claim_id, logic, family_id, inci, patterns)."""
    schema = ("free_from array<struct<id:string,label:string,logic:string,family:string,phrases:array<string>>>, "
              "ingredient_claims array<struct<id:string,label:string,terms:array<string>,inci:array<string>,inci_patterns:array<string>>>, "
              "unverifiable array<struct<id:string,label:string,phrases:array<string>>>")
    j = spark.read.schema(schema).json(path, multiLine=True)
    def phrases(col, kind, field):
        return j.select(F.explode(col).alias("c")).select(F.col("c.id").alias("claim_id"), F.lit(kind).alias("kind"), F.posexplode(f"c.{field}").alias("ord", "phrase"))
    ph = phrases("free_from", "free_from", "phrases").unionByName(phrases("unverifiable", "unverifiable", "phrases")).unionByName(phrases("ingredient_claims", "ingredient", "terms"))
    none = F.array().cast("array<string>")
    ff = j.select(F.explode("free_from").alias("c")).select(F.col("c.id").alias("claim_id"), "c.logic", F.col("c.family").alias("family_id"), none.alias("inci"), none.alias("patterns"))
    ing = j.select(F.explode("ingredient_claims").alias("c")).select(F.col("c.id").alias("claim_id"), F.lit("ingredient").alias("logic"), F.lit(None).cast("string").alias("family_id"), "c.inci", F.col("c.inci_patterns").alias("patterns"))
    return ph, ff.unionByName(ing)


def read_actives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Actives JSON -> classes, members(class_id, member), stacking(rule_id, a, b, tier)."""
    j = spark.read.schema("classes array<struct<id:string,name:string,sun_sensitising:boolean,members:array<string>>>, stacking array<struct<id:string,a:string,b:string,tier:string,text:string>>").json(path, multiLine=True)
    c = j.select(F.explode("classes").alias("c")).select(F.col("c.id").alias("class_id"), "c.name", "c.sun_sensitising", "c.members")
    st = j.select(F.explode("stacking").alias("s")).select(F.col("s.id").alias("rule_id"), "s.a", "s.b", "s.tier", "s.text")
    return c.drop("members"), c.select("class_id", F.explode("members").alias("member")), st


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes JSON -> triggers(note_id, family_id, inci): one row per trigger."""
    j = spark.read.schema("notes array<struct<id:string,title:string,text:string,trigger:struct<family:string,inci:string,any_inci:array<string>>>>").json(path, multiLine=True)
    n = j.select(F.explode("notes").alias("n")).select(F.col("n.id").alias("note_id"), "n.trigger")
    fam = n.where("trigger.family IS NOT NULL").select("note_id", F.col("trigger.family").alias("family_id"), F.lit(None).cast("string").alias("inci"))
    names = F.concat(F.array_compact(F.array("trigger.inci")), F.coalesce("trigger.any_inci", F.array().cast("array<string>")))
    return fam.unionByName(n.select("note_id", F.lit(None).cast("string").alias("family_id"), F.explode(names).alias("inci")))


def read_profile_rules(spark: SparkSession, path: str) -> DataFrame:
    j = spark.read.schema("rules array<struct<id:string,condition:string,family:string,tier:string,title:string,explanation:string>>").json(path, multiLine=True)
    return j.select(F.explode("rules").alias("r")).select(F.col("r.id").alias("rule_id"), "r.condition", F.col("r.family").alias("family_id"), "r.tier", "r.title", "r.explanation")


def read_substitutions(spark: SparkSession, path: str) -> DataFrame:
    j = spark.read.schema("entries array<struct<id:string,from_label:string,from:array<string>,options:array<struct<inci:string,role:string>>>>").json(path, multiLine=True)
    return j.select(F.explode("entries").alias("e")).select(F.col("e.id").alias("sub_id"), F.col("e.from").alias("from"), F.explode("e.options").alias("o")).select("sub_id", "from", F.col("o.inci").alias("option"))


def read_function_glossary(spark: SparkSession, path: str) -> DataFrame:
    j = spark.read.schema("terms array<struct<function:string,en:string,hi:string>>").json(path, multiLine=True)
    return j.select(F.explode("terms").alias("t")).select("t.*")
