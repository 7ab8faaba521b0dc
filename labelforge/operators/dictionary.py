"""The name dictionary: building, merging, overrides, and the key tables derived from it."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..functions import text as X
from ..runtime import durable

SEED_ONLY = "Name from the project seed list; not an entry of the EU glossary."
OPTIONAL = ["cas", "ec", "functions", "description", "cosing_ref", "category"]


@dataclass
class NameDictionary:
    """names(inci_name, key, category, cas, ec, source), aliases(alias, key, inci_name, kind) and run metadata."""

    names: DataFrame
    aliases: DataFrame
    meta: dict[str, str] = field(default_factory=dict)
    _built: dict[str, DataFrame] = field(default_factory=dict)

    def materialised(self) -> "NameDictionary":
        """The dictionary with its key tables computed once; how they are joined is left to the optimizer."""
        if self._built:
            return self
        lookup = durable(self.lookup)
        done = NameDictionary(self.names, self.aliases, self.meta, {"lookup": lookup})
        corpus, words = durable(done.corpus), durable(done.vocabulary)
        return NameDictionary(self.names, self.aliases, self.meta, {"lookup": lookup, "corpus": corpus, "vocabulary": words})

    @property
    def lookup(self) -> DataFrame:
        """One row per matching key; an official name beats an alias of the same key."""
        if "lookup" in self._built:
            return self._built["lookup"]
        base = self.names.select(F.col("inci_name").alias("n"), "category", "cas", "ec", "source")
        exact = self.names.select("key", F.lit(0).alias("rank"), "inci_name", F.lit(None).cast("string").alias("kind"))
        alias = self.aliases.select("key", F.lit(1).alias("rank"), "inci_name", "kind")
        best = (exact.unionByName(alias).groupBy("key")
                .agg(F.min(F.struct("rank", "inci_name", "kind")).alias("b"))
                .select("key", F.when(F.col("b.rank") == 0, "inci_exact").otherwise("inci_alias").alias("layer"), "b.inci_name", "b.kind"))
        return best.join(base, best["inci_name"] == base["n"], "left").drop("n")

    @property
    def corpus(self) -> DataFrame:
        """Fuzzy corpus: every name key and alias key with the name it stands for and that name's last-word prior."""
        if "corpus" in self._built:
            return self._built["corpus"]
        freq = suffix_frequency(self.lookup.select("inci_name").distinct())
        last = F.element_at(F.split("inci_name", " "), -1)
        rows = self.lookup.select("key", "inci_name", F.when(F.col("inci_name").contains(" "), last).alias("last"))
        return (rows.join(freq, rows["last"] == freq["last_word"], "left")
                .select("key", "inci_name", F.coalesce("n", F.lit(0)).cast("int").alias("prior")))

    @property
    def vocabulary(self) -> DataFrame:
        if "vocabulary" in self._built:
            return self._built["vocabulary"]
        return name_vocabulary(self.lookup.select("inci_name").distinct())


def name_vocabulary(names: DataFrame, col: str = "inci_name") -> DataFrame:
    """Distinct whole words (3+ characters) of the names."""
    return names.select(F.explode(F.regexp_extract_all(col, F.lit("([A-Z0-9]{3,})"), 1)).alias("word")).distinct()


def suffix_frequency(names: DataFrame, col: str = "inci_name") -> DataFrame:
    """How many multi-word names end with each word."""
    words = F.split(F.trim(F.col(col)), r"\s+")
    return names.where(F.size(words) > 1).groupBy(F.element_at(words, -1).alias("last_word")).agg(F.count("*").alias("n"))


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order.

    A ranked window, which Spark turns into a per-partition top-1 before the shuffle, so a hot key costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def map_catalogue_columns(df: DataFrame) -> DataFrame:
    """Rename the columns of an imported catalogue by header aliases; fails with the headers when the name column is missing."""
    # Accepted header spellings (letters and digits only).
    aliases = {
        "inci_name": ["inciname", "incinametitle", "name"],
        "cas": ["casno", "cas", "casnumber"],
        "ec": ["ecno", "ec", "ecnumber"],
        "functions": ["functions", "function"],
        "description": ["chemiupacnamedescription", "chemiupacname", "description"],
        "cosing_ref": ["cosingrefno", "refno", "cosingref"],
    }
    plain = {c: "".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum()) for c in df.columns}
    chosen = {t: next((c for c in df.columns if plain[c] in names), None) for t, names in aliases.items()}
    if chosen["inci_name"] is None:
        raise ValueError(f"Could not find a name column. Headers found: {df.columns}")
    cols = [F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(t) for t, c in chosen.items() if c is not None]
    return df.select(*cols).where(F.col("inci_name") != "")


def explode_aliases(rows: DataFrame) -> DataFrame:
    """'ALIAS:kind;ALIAS:kind' cells to (inci_name, alias, kind, ord); the kind follows the last colon."""
    parts = F.filter(F.split(F.coalesce("aliases", F.lit("")), ";"), lambda p: p.contains(":"))
    rx = r"^(.*):([^:]*)$"
    return (rows.select("inci_name", F.posexplode(parts).alias("ord", "p"))
            .select("inci_name", X.strip(F.regexp_extract("p", rx, 1)).alias("alias"), X.strip(F.regexp_extract("p", rx, 2)).alias("kind"), "ord"))


def merge_catalogues(official: DataFrame, seed: DataFrame, keep_seed_only: bool = True) -> DataFrame:
    """Official rows (first of each upper-case name) with seed category/aliases merged on.

    Seed-only rows are kept and marked when ``keep_seed_only``, else dropped.  ``official`` carries ``ord`` for first-wins.
    """
    o = first_per(official.select(F.upper(X.strip(F.col("inci_name"))).alias("name"), "ord", "cosing_ref"), ["name"], F.col("ord")).where("name <> ''")
    s = seed.select(F.upper("inci_name").alias("s_name"), "category", "aliases")
    j = o.join(s, o["name"] == s["s_name"], "full_outer" if keep_seed_only else "left")
    return j.select(F.coalesce("name", "s_name").alias("inci_name"), "cosing_ref", "category", "aliases",
                    F.when(F.col("name").isNull(), SEED_ONLY).alias("description"))


def build_dictionary(rows: DataFrame, aliases: DataFrame, meta: dict[str, str]) -> NameDictionary:
    """Names (first of each upper-case name, by ``ord`` when present), aliases (first of each key) with common-name overrides.

    A common-name alias removes an official entry of the same key that belongs to another name, so one ingredient keeps one identity.
    """
    src = meta.get("dictionarySource", "seed")
    name = F.upper(X.strip(F.col("inci_name")))
    opt = [F.nullif(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    order = F.col("ord") if "ord" in rows.columns else F.lit(0)
    names = first_per(rows.select(name.alias("inci_name"), *opt, order.alias("ord")).where("inci_name <> ''"), ["inci_name"], F.col("ord")).drop("ord")
    names = names.withColumn("key", X.match_key(F.col("inci_name"))).withColumn(
        "source", F.when(F.col("description").startswith(SEED_ONLY), "seed").otherwise(src))
    # two names with one key: the later one wins, as in a map filled in order
    names = first_per(names, ["key"], F.col("inci_name").desc())
    a_order = F.col("ord") if "ord" in aliases.columns else F.lit(0)
    al = aliases.select(F.upper("alias").alias("alias"), X.match_key(F.col("alias")).alias("key"), F.upper("inci_name").alias("inci_name"), "kind", a_order.alias("ord"))
    al = first_per(al, ["key"], F.col("inci_name"), F.col("ord")).drop("ord")
    return NameDictionary(alias_override(names, al), al, meta)


def alias_override(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names without those shadowed by a common-name alias of the same key for another name."""
    a = aliases.where("kind = 'common_name'").select(F.col("key").alias("a_key"), F.col("inci_name").alias("a_name"))
    return names.join(a, (names["key"] == a["a_key"]) & (names["inci_name"] != a["a_name"]), "left_anti")


def quality_gate(names: DataFrame, minimum: int = 20_000, allow_small: bool = False) -> DataFrame:
    """One-row report; its ``ok`` column fails the job (``assert_true``) when the dictionary is too small."""
    n = names.agg(F.count("*").alias("n_names"))
    ok = (F.col("n_names") >= minimum) | F.lit(allow_small)
    return n.select("n_names", F.assert_true(ok, F.lit("dictionary too small")).isNull().alias("ok"))


class GateFailed(ValueError):
    """A table that was written did not pass its gate; ``metrics`` tells what was seen."""

    def __init__(self, metrics: dict[str, int]):
        super().__init__(f"gate failed: {metrics}")
        self.metrics = metrics


def write_gated(names: DataFrame, path: str, minimum: int = 20_000, assertions: dict[str, Column] | None = None) -> dict[str, int]:
    """Write the names and check them in the same pass: at least ``minimum`` rows, and no row that breaks an assertion (a null breaks it too).

    The counts are metrics observed by the write itself, so the table is not read twice. ``GateFailed`` tells the caller not to publish it.
    """
    seen = Observation()
    broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in (assertions or {}).items()]
    names.observe(seen, F.count(F.lit(1)).alias("n_names"), *broken).write.mode("overwrite").parquet(path)
    metrics = {k: int(v) for k, v in seen.get.items()}
    if metrics["n_names"] < minimum or any(metrics[n] for n in assertions or {}):
        raise GateFailed(metrics)
    return metrics
