"""Building the reference tables: page tables, regulation annexes, name spans, families, functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .dictionary import first_per
from .phrases import name_spans


def _inner(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)


def cell_text(c: Column, gap: str = " ") -> Column:
    return X.strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", gap), r"\s+", " "))


def extract_html_rows(pages: DataFrame, id_col: str, html_col: str, table_tag: str = "table", row_tag: str = "tr", cell_tag: str = "td",
                      header: str | None = None, header_within: int = 3000, gap: str = "") -> DataFrame:
    """(id, table_no, row_no, cells): rows of the page's tables; with ``header`` only the first table that shows it early on.

    A page is parsed inside its row with regular expressions; only the final explode multiplies rows.
    """
    tables = F.transform(_inner(F.col(html_col), table_tag), lambda t, i: F.struct(i.alias("table_no"), t.alias("t")))
    if header is not None:
        tables = F.slice(F.filter(tables, lambda s: F.contains(F.substring(s["t"], 1, header_within), F.lit(header))), 1, 1)
    rows = (pages.select(id_col, F.explode(tables).alias("s")).select(id_col, "s.table_no", F.posexplode(_inner(F.col("s.t"), row_tag)).alias("row_no", "r")))
    return rows.select(id_col, "table_no", "row_no", F.transform(_inner(F.col("r"), cell_tag), lambda c: cell_text(c, gap)).alias("cells"))


def glossary_rows(rows: DataFrame) -> DataFrame:
    """Two-cell rows whose first cell is a number: (entry, common_ingredient_name)."""
    c = F.col("cells")
    return (rows.where((F.size("cells") == 2) & F.get(c, F.lit(0)).rlike(r"^\d+$") & (F.get(c, F.lit(1)) != ""))
            .select(F.get(c, F.lit(0)).cast("int").alias("entry"), F.get(c, F.lit(1)).alias("common_ingredient_name")))


def annex_rows(rows: DataFrame, annex: str, name_cell: int = 2, cond_from: int = 5) -> DataFrame:
    """Annex entries: numbered rows of four or more cells -> (annex, entry, cell, cas, conditions)."""
    c = F.col("cells")
    at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    cond = F.array_join(F.filter(F.slice(c, F.lit(cond_from + 1), F.greatest(F.size(c), F.lit(0))), lambda x: x != ""), " | ")
    return (rows.where(F.trim(F.get(c, F.lit(0))).rlike(r"^\d+[a-z]?$") & (F.size("cells") >= 4))
            .select(F.lit(annex).alias("annex"), F.trim(F.get(c, F.lit(0))).alias("entry"), at(name_cell).alias("full_cell"), F.substring(at(name_cell), 1, 160).alias("cell"),
                    F.substring(at(3), 1, 80).alias("cas"), F.substring(cond, 1, 600).alias("conditions")))


def prohibited_rows(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """Prohibited entries that name an ingredient: 'INCI: x)' mentions, and comma/semicolon parts (8+ key characters) that are glossary names."""
    c = F.col("cells")
    r = rows.where(F.trim(F.get(c, F.lit(0))).rlike(r"^\d+[a-z]?$") & (F.size("cells") >= 2)).select(F.trim(F.get(c, F.lit(0))).alias("entry"), F.get(c, F.lit(1)).alias("cell"))
    named = r.select("entry", "cell", F.posexplode(F.regexp_extract_all("cell", F.lit(r"INCI:\s*([A-Za-z0-9 ,\-/.]+?)\)"), 1)).alias("o", "n")).select("entry", "cell", F.lit(0).alias("g"), "o", F.upper(F.trim("n")).alias("name"))
    g = glossary.select(X.match_key(F.col("name"), True).alias("key"), F.upper("name").alias("name")).groupBy("key").agg(F.min("name").alias("name"))
    parts = r.select("entry", "cell", F.posexplode(F.split("cell", "[;,]")).alias("o", "p")).withColumn("key", X.match_key(F.col("p"))).where(F.length("key") >= 8).join(g, "key").select("entry", "cell", F.lit(1).alias("g"), "o", "name")
    every = first_per(named.unionByName(parts), ["entry", "cell", "name"], F.col("g"), F.col("o"))
    return (every.groupBy("entry", "cell").agg(F.array_sort(F.collect_list(F.struct("g", "o", "name"))).alias("m"))
            .select(F.lit("II_prohibited_identified").alias("annex"), "entry", F.col("m.name").alias("inci"), F.substring("cell", 1, 160).alias("cell")))


def longest_span_names(texts: DataFrame, names: DataFrame, id_col: str = "id", text_col: str = "cell", max_words: int | None = None) -> DataFrame:
    """(id, names): dictionary names found in a text - the whole text; else its comma parts, then the greedy longest word spans.

    A row is a text of its own, settled where it is read (``name_spans``): no text and none of its matches is shuffled.
    """
    d = names.select(F.upper(F.col(names.columns[0])).alias("name")).distinct().withColumn("key", X.match_key(F.col("name"))).where("key <> ''")
    t = texts.select(F.col(id_col).alias("id"), F.upper(X.nfkc(F.col(text_col))).alias("t"))
    return name_spans(t, first_per(d, ["key"], F.col("name").desc()), max_words).withColumnRenamed("id", id_col)


# Wording of the labelling duty; curated families whose members are literal names.
LABELLED = "presence of the substance( or substances)? (shall|must) be indicated"
CURATED_MEMBERS = {
    "fragrance_mixtures": [("PARFUM", ["FRAGRANCE", "AROMA", "PARFUM/FRAGRANCE"])],
    "isothiazolinones": [("METHYLISOTHIAZOLINONE", ["MI", "MIT"]), ("METHYLCHLOROISOTHIAZOLINONE", ["MCI"])],
    "formaldehyde_releasers": [("DMDM HYDANTOIN", []), ("IMIDAZOLIDINYL UREA", []), ("DIAZOLIDINYL UREA", []), ("2-BROMO-2-NITROPROPANE-1,3-DIOL", []), ("QUATERNIUM-15", [])],
    "retinoids": [("RETINOL", []), ("RETINYL ACETATE", []), ("RETINYL PALMITATE", []), ("RETINAL", ["RETINALDEHYDE"]), ("RETINYL PROPIONATE", []), ("ADAPALENE", [])],
    "fatty_alcohols": [("CETYL ALCOHOL", []), ("STEARYL ALCOHOL", []), ("CETEARYL ALCOHOL", []), ("BEHENYL ALCOHOL", [])],
    "solvent_alcohols": [("ALCOHOL", ["ETHANOL"]), ("ALCOHOL DENAT.", ["DENATURED ALCOHOL"]), ("ETHANOL", []), ("ISOPROPYL ALCOHOL", [])],
}
# Families recognised by naming convention.
PATTERN_FAMILIES = [
    ("silicones", r"(METHICONE|SILOXANE|DIMETHICONOL|DIMETHICONE|SILSESQUIOXANE|SILICONE)\b", []),
    ("sulfate_surfactants", r"(LAURYL|LAURETH|MYRETH|OLETH|PARETH|TRIDECETH|DECYL|COCO|CETEARYL|STEARYL|C\d+-\d+)[A-Z0-9\- ]* SULFATE$", []),
]


def curated_members(spark) -> DataFrame:
    rows = [(f, n, a) for f, ms in CURATED_MEMBERS.items() for n, a in ms]
    return spark.createDataFrame(rows, "family_id string, inci string, aliases array<string>")


def build_families(annexes: DataFrame, curated: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """Family members: labelled fragrance allergens and preservatives from the annexes, parabens by name, plus the curated ones.

    annexes(annex, entry, inci array, conditions); caps(inci, cap_tier, role_note) are attached to labelled allergens.
    """
    names = annexes.select("annex", "entry", "conditions", F.posexplode("inci").alias("o", "inci"))
    pick = lambda df, fid: first_per(df.select(F.lit(fid).alias("family_id"), "inci", "entry", "o"), ["inci"], F.col("entry"), F.col("o")).select("family_id", "inci", "entry")
    allergens = pick(names.where((F.col("annex") == "III") & F.col("conditions").rlike(LABELLED)), "eu_fragrance_allergens")
    preserv = pick(names.where("annex = 'V'"), "preservatives_annex_v")
    parab = pick(names.where(((F.col("annex") == "V") & F.col("entry").isin("12", "12a") & F.col("inci").contains("PARABEN")) | ((F.col("annex") == "II_prohibited_identified") & F.col("inci").endswith("PARABEN"))), "parabens")
    out = allergens.unionByName(preserv).unionByName(parab).withColumn("aliases", F.array().cast("array<string>"))
    out = out.unionByName(curated.select("family_id", "inci", "aliases", F.lit(None).cast("string").alias("entry")))
    if caps is None:
        return out.withColumn("cap_tier", F.lit(None).cast("string")).withColumn("role_note", F.lit(None).cast("string"))
    c = caps.select(F.lit("eu_fragrance_allergens").alias("family_id"), "inci", "cap_tier", "role_note")
    return out.join(c, ["family_id", "inci"], "left")


# Function terms read as another term, and labels that are no function.
FUNCTION_SYNONYMS = {"FRAGRANCE": "PERFUMING", "PH ADJUSTMENT": "BUFFERING", "PH-ADJUSTMENT": "BUFFERING", "PH ADJUSTER": "BUFFERING"}
NOT_A_FUNCTION = ["FRAGRANCE FUNCTIONAL", "FRAGRANCE EXCIPIENT"]


def build_functions(entries: DataFrame, excluded: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """entries(ord, inci, functions array, kind, url) -> (kept one row per name, dropped with the reason).

    The first usable entry of a name wins; synonyms are mapped, excipient labels removed, functions made distinct in order.
    """
    excluded = excluded or {}
    name = F.upper(X.strip(F.col("inci")))
    ex = F.create_map(*[F.lit(x) for kv in excluded.items() for x in kv])[name] if excluded else F.lit(None).cast("string")
    why = (F.when(ex.isNotNull(), ex).when((F.col("kind") == "unverified") | (F.coalesce(F.size("functions"), F.lit(0)) <= 0), "unverified")
           .when(~F.coalesce("url", F.lit("")).startswith("https://"), "no https url"))
    e = entries.select("ord", name.alias("inci"), "functions", "kind", "url", why.alias("why"))
    ok = first_per(e.where("why IS NULL"), ["inci"], F.col("ord"))
    syn = F.create_map(*[F.lit(x) for kv in FUNCTION_SYNONYMS.items() for x in kv])
    up = F.filter(F.transform("functions", lambda f: F.upper(F.trim(f))), lambda f: ~f.isin(*NOT_A_FUNCTION) & (f != ""))
    ok = ok.withColumn("functions", F.array_distinct(F.transform(up, lambda f: F.coalesce(syn[f], f))))
    kept = ok.where(F.size("functions") > 0).select("inci", "functions", "kind", "url")
    dropped = e.where("why IS NOT NULL").select("inci", F.col("why").alias("reason")).unionByName(ok.where(F.size("functions") == 0).select("inci", F.lit("only a fragrance-excipient label").alias("reason")))
    return kept, dropped
