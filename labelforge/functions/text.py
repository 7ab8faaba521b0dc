"""String columns: matching keys, cleaning, title case, classifiers.

Everything here is a Column expression that stays inside the JVM.  The one exception is Unicode NFKC,
for which Spark has no builtin: ``nfkc`` ships only the rows holding a character that NFKC may change
(the Arrow column is null for all others).
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Characters known to be stable under NFKC and common on labels; any other non-ASCII character sends the row to Python.
_MAY_CHANGE = r"[\x{80}-\x{10FFFF}&&[^­±·À-ı–—‘-”•€₹、]]"


@F.pandas_udf(T.StringType())
def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode NFKC; only rows that could change are sent to Python."""
    ascii_only = F.octet_length(c) == F.length(c)
    return F.coalesce(_nfkc_batch(F.when(~ascii_only & c.rlike(_MAY_CHANGE), c)), c)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` (or a lambda inside it) refers to it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


_BLANKS = " \t\n\x0B\f\r"  # what \s stands for


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def fold_key(c: Column, keep_wildcard: bool = True) -> Column:
    """Matching key of text that is already NFKC: upper case, A-Z 0-9 (and '?', an unreadable glyph)."""
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9?]" if keep_wildcard else r"[^A-Z0-9]", "")


def match_key(c: Column, keep_wildcard: bool = True) -> Column:
    return fold_key(nfkc(c), keep_wildcard)


def clean_text(c: Column, normalise: bool = True) -> Column:
    """NFKC (unless done before), soft hyphens out, hyphenated line breaks rejoined, bullets to commas, blanks collapsed."""
    t = F.replace(nfkc(c) if normalise else c, F.lit("­"), F.lit(""))
    # a pattern costs many times a plain search, and most texts have nothing for it to find
    t = let(t, lambda x: F.when(F.contains(x, F.lit("\n")), F.regexp_replace(F.regexp_replace(x, r"-\s*\r?\n\s*", ""), r"\s*\r?\n\s*", " ")).otherwise(x))
    for mark in "•·、":
        t = F.replace(t, F.lit(mark), F.lit(","))
    return strip(let(t, lambda x: F.when(F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)))


def strip_parens(c: Column) -> Column:
    return strip(let(c, lambda x: F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, r"\s*\([^)]*\)", "")).otherwise(x)))


def strip_nano(c: Column) -> Column:
    return strip(let(c, lambda x: F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, r"(?i)\(\s*nano\s*\)", "")).otherwise(x)))


def inner_parens(c: Column) -> Column:
    """Text of the last, trailing parenthesis; empty when there is none."""
    return F.regexp_extract(c, r"\(([^()]+)\)\s*$", 1)


def title_case(c: Column) -> Column:
    """Lower case with a-z capitalised at the start and after a blank, '-', '/' or '('.

    ``initcap`` only looks at blanks, so a marked blank is put after every other delimiter and taken out again;
    a second mark shields initial letters outside a-z.
    """
    t = F.lower(c)
    t = F.regexp_replace(t, r"([\-/(\t\n\r\f\x0B])", "$1\u0001 ")
    t = F.regexp_replace(t, r"(^|[ ])([^a-z ])", "$1\u0002$2")
    return F.translate(F.regexp_replace(F.initcap(t), "\u0001 ", ""), "\u0001\u0002", "")


def label_norm(c: Column) -> Column:
    t = F.regexp_replace(F.upper(c), r"[^A-Z0-9/,.\- ]", "")
    return strip(let(t, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)))


def claim_text(c: Column, normalise: bool = True) -> Column:
    """Lower-case words of a printed claim: apostrophes dropped, anything outside a-z 0-9 % is a blank."""
    t = F.regexp_replace(F.lower(nfkc(c) if normalise else c), "[’'`]", "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9%]+", " "))


def word_count(c: Column) -> Column:
    """Number of blank-separated words (0 for blank text)."""
    return let(strip(c), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))))


# ---------------------------------------------------------------------------------------------------
# Classifiers: ordered pattern tables, the first match wins.

_NUMBER = r"\d[\d,.]*"
# Patterns that mark text on a pack as something other than an ingredient (kind, reason, pattern).
NON_INGREDIENT = [
    ("price", "price", rf"(?i)\b(?:MRP|M\.R\.P|Rs\.?|INR|₹|\$|€|£)\s*{_NUMBER}|{_NUMBER}\s*/\s*(?:ml|g|gm|oz)\b|\binclusive of (?:all )?taxes"),
    ("batch", "batch code", r"(?i)\b(?:B\.?\s?NO\.?|BATCH(?:\s*(?:NO\.?|CODE))?|LOT(?:\s*NO\.?)?)\s*[:#]?\s*[A-Z0-9-]{3,}"),
    ("date", "date", r"(?i)\b(?:MFG|MFD|MANUFACTURED|EXP|EXPIRY|USE BEFORE|USE BY|BEST BEFORE|BB)\b.{0,20}\d|\b\d{1,2}\s*/\s*\d{2,4}\b"),
    ("code", "product/packaging code", r"^(?:[A-Z]{2,5}\s?\d{5,}|\d{8,14})$"),
    ("directions", "directions", r"(?i)\b(?:shake well|apply|use (?:daily|twice|as directed)|directions?|keep out of|keep away|for external use|avoid contact|discontinue|do not (?:use|swallow|ingest)|store (?:in|below|at)|patch test|rinse off)\b"),
    ("packaging", "packaging copy", r"(?i)\b(?:made in|manufactured by|mfd\.? by|marketed by|imported by|net\s*(?:wt|weight|content|qty|quantity)|net contents|customer care|toll free|www\.|https?://|@\w+\.\w+|barcode)\b|\b\d+(?:\.\d+)?\s?(?:ml|fl\.? ?oz|g|gm|oz)\b"),
]
LONG_TEXT_REASON = "long text fragment (too long to be one ingredient name)"

# Words of marketing copy.
MARKETING_WORDS = [
    "THE", "WITH", "FOR", "YOUR", "SKIN", "HAIR", "FEEL", "DAYS", "PROVEN", "TESTED", "CLINICALLY", "DERMATOLOGIST",
    "DERMATOLOGICALLY", "FREE", "NEW", "GENTLE", "ADVANCED", "FORMULA", "HELPS", "RESTORES", "BARRIER", "MOISTURE",
    "RESULTS", "WEEK", "WEEKS",
]

# Plant parts of an extract name.
_PLANT_PART = (
    r"(?:(?:AERIAL PARTS|WHOLE PLANT|SEED|LEAF|FRUIT|ROOT|FLOWER|BARK|STEM|PEEL|KERNEL|BUD|CONE|RHIZOME|HERB|"
    r"FLOWER/LEAF/STEM|BULB|NUT|PULP|SHELL)\s+)*"
)
# Ingredient classes that have no single-compound record (category, pattern).
CATEGORY = [
    ("fragrance", r"(?i)^(?:PARFUM|FRAGRANCE|AROMA|FLAVOR)(?:\s*[/(]\s*(?:PARFUM|FRAGRANCE|AROMA)\)?)?$"),
    ("colorant", r"(?i)^(?:CI\s?\d{5}(?::\d)?|(?:EXT\.?\s*)?(?:FD&C|D&C)\s+(?:BLUE|RED|YELLOW|GREEN|ORANGE|VIOLET)\s*(?:NO\.?\s*)?\d+\s*(?:LAKE)?)$"),
    ("polymer", r"(?i)(?:\b|/)(?:CROSSPOLYMER|COPOLYMER|POLYMER)$"),
    ("botanical", rf"(?i)^[A-Za-z]{{3,}}\s+[A-Za-z]{{3,}}(?:\s*\([^)]*\))?\s+{_PLANT_PART}(?:EXTRACT|OIL|WATER|BUTTER|WAX|JUICE|POWDER|GUM|FLOWER WATER|FERMENT|FERMENT FILTRATE)$"),
    ("botanical", r"^.+\(\s*[A-Z][a-z]{2,}\s+[a-z]{3,}\s*\)$"),
]
CATEGORY_NOTE = "Valid ingredient class; no single compound record expected."


def first_match(c: Column, table: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first pattern that matches; null (or ``default``) when none does."""
    out = None
    for label, pattern in table:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(None).cast("string") if default is None else default)


def non_ingredient_kind(c: Column) -> Column:
    return first_match(c, [(kind, rx) for kind, _reason, rx in NON_INGREDIENT])


def removal_reason(kind: Column) -> Column:
    pairs = [F.lit(x) for k, reason, _rx in NON_INGREDIENT for x in (k, reason)]
    pairs += [F.lit("long_text"), F.lit(LONG_TEXT_REASON)]
    return F.create_map(*pairs)[kind]


def is_long_text(c: Column, max_words: int = 9, max_chars: int = 90) -> Column:
    return (word_count(c) > max_words) | (F.length(c) > max_chars)


def is_marketing_copy(c: Column) -> Column:
    words = F.regexp_extract_all(F.upper(c), F.lit(r"([A-Za-z]+)"), 1)
    known = F.filter(words, lambda w: w.isin(*MARKETING_WORDS))
    return (F.size(words) >= 4) & (F.size(known) >= 2)


def classify_category(c: Column) -> Column:
    return first_match(F.regexp_replace(strip(c), r"\.+$", ""), CATEGORY)


# ---------------------------------------------------------------------------------------------------
# Roles: a listed function term is shown under one display family.

# Display families in their fixed order, each with a line of our own; callers may bring their own lines (``plain_function``).
ROLE_BLURB = {
    "moisture": "Binds water in the outer skin.",
    "soften": "Makes skin or hair soft and supple.",
    "texture": "Thickens, blends or steadies the mixture.",
    "cleanse": "Washes, foams or scrubs.",
    "keep": "Protects the product from spoiling.",
    "base": "Carries the other ingredients or adjusts the pH.",
    "sun": "Filters ultraviolet light.",
    "scent": "Gives or hides a smell.",
    "colour": "Colours the product.",
    "care": "Conditions or calms skin or hair.",
    "other": "Has another listed role.",
}
# Function-term patterns in order of precedence (family, pattern).
ROLE_PATTERNS = [
    ("texture", "SURFACTANT.*(EMULSIF|SOLUBILI)"),
    ("texture", "ANTIFOAM|DISPERSING|PLASTICI|SLIP MODIFIER"),
    ("keep", "LIGHT STABILI"),
    ("other", "DENATUR|ORAL CARE|OXIDISING"),
    ("care", "ASTRINGENT|SKIN BRIGHTENING|ANTI-?SEBORRH"),
    ("moisture", "HUMECTANT|MOISTURI[SZ]ING"),
    ("soften", "EMOLLIENT|SMOOTHING|OCCLUSIVE|REFATTING|LUBRICANT"),
    ("sun", "UV (FILTER|ABSORBER)|SUNSCREEN"),
    ("scent", "PERFUMING|FRAGRANCE|MASKING|DEODORANT|FLAVOU?RING"),
    ("colour", "COLORANT|PIGMENT|COLOU?R"),
    ("keep", "PRESERVATIVE|ANTIMICROBIAL|ANTIOXIDANT|CHELATING"),
    ("cleanse", "SURFACTANT|CLEANSING|FOAM|ABRASIVE|EXFOLIATING|KERATOLYTIC"),
    ("base", "SOLVENT|BUFFERING|PH ADJUST|ALKALI|ACID"),
    ("texture", "VISCOSITY|EMULSIF|BINDING|FILM FORMING|OPACIFYING|BULKING|ABSORBENT|ANTICAKING|GEL|SUSPENDING|STABILI[SZ]ING|SLIP|PLASTICI"),
    ("care", "CONDITIONING|SOOTHING|TONIC|SKIN PROTECTING|ANTISTATIC|ANTIDANDRUFF|ANTISEBORRHEIC|HAIR"),
]
# Which family leads when an ingredient has several.
ROLE_PRIORITY = ["moisture", "soften", "cleanse", "sun", "colour", "texture", "keep", "care", "base", "scent", "other"]


def role_family(c: Column) -> Column:
    return first_match(F.upper(c), ROLE_PATTERNS, F.lit("other"))


def role_rank(family: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ROLE_PRIORITY]), family)


def role_blurb(family: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ROLE_BLURB.items() for x in kv])[family]


def pretty_function(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), r"\s*-\s*", ", ")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
