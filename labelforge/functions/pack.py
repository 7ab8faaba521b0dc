"""Dates, shelf life and prices printed on a pack, as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

# Label words that introduce a date, month names, months accepted as a period after opening.
DATE_LABEL = r"(?i)\b(mfg|mfd|manufactur\w*|manuf|date of manufacture|exp(?:iry|ires|\.)?|use\s+before|use\s+by|best\s+before|bb)\b\.?\s*(?:date)?\s*[:\-]?"
UNSURE = r"(?i)occlud|low confidence|unclear|smudg|faint|illegible|partially|\?"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PAO_MONTHS = [3, 6, 9, 12, 18, 24, 30, 36]

# The printed forms of dates, periods after opening and prices.
_THREE = r"(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{4}|\d{2})(?!\d)"
_TWO = r"(\d{1,2})\s*[/\-.]\s*(\d{4}|\d{2})(?!\d)"
_MON = r"(?i)\b(" + "|".join(MONTHS) + r")[a-z]*\.?\s*[-'/]?\s*(\d{4}|\d{2})\b"

_PAO = r"(?i)(?:\bPAO\b[^0-9]{0,12})?\b(\d{1,2})\s?(?:M|months?)\b"
_PER_UNIT = r"(?i)(?:rs\.?|inr|₹)\s*(\d+(?:\.\d+)?)\s*/\s*(?:ml|g)\b"
_MRP = r"(?i)(?:mrp|m\.r\.p\.?|price)?[^\d\n]{0,12}?(?:rs\.?|inr|₹)\s*(\d+(?:\.\d+)?)(?!\s*/)"
_VOLUME = r"(?i)(\d+(?:\.\d+)?)\s*(ml|g|gm|gms)\b"


def _year(text: Column) -> Column:
    def of(t):
        n = t.try_cast("int")
        return F.when(F.length(t) == 2, n + 2000).otherwise(n)
    return let(text, of)


def date_in_line(line: Column, typed: Column, low_confidence: Column) -> Column:
    """The date printed on one line as a struct; null when the line has no labelled, valid date.

    Day/month/year is tried first, then month/day/year (flagged), month/year, month name and year.
    """
    def found(kind, low, raw, day, month, year, fmt, swapped):
        return F.struct(
            kind.alias("kind"), raw.alias("raw"), day.try_cast("int").alias("day"), month.try_cast("int").alias("month"),
            year.try_cast("int").alias("year"), fmt.alias("format"),
            F.when(typed, "typed").when(low, "low").otherwise("high").alias("confidence"),
            (F.lit(swapped) | (~typed & low)).alias("needs_confirm"),
            F.lit(swapped).alias("order_unclear"),
        )

    none = F.lit(None)

    def dated(kind, rest):
        # each pattern is searched once, and only if those before it gave no date; its numbers are the digits of what it found
        low = rest.rlike(UNSURE) | (~typed & low_confidence)
        parts = lambda whole, fn: let(F.split(whole, r"\D+"), lambda p: fn(*(F.get(p, F.lit(i)) for i in range(3))))

        def three(raw):
            def of(x, y, z):
                a, b = x.try_cast("int"), y.try_cast("int")
                return (F.when((b <= 12) & (a <= 31), found(kind, low, raw, a, b, _year(z), F.when(F.length(z) == 2, "DD/MM/YY").otherwise("DD/MM/YYYY"), False))
                        .when((a <= 12) & (b <= 31), found(kind, low, raw, b, a, _year(z), F.lit("DD/MM/YY"), True))
                        .otherwise(let(F.regexp_extract(rest, _TWO, 0), two)))
            return parts(raw, of)

        def two(raw):
            def of(x, y, _):
                m = x.try_cast("int")
                return (F.when(m.between(1, 12), found(kind, low, raw, none, m, _year(y), F.when(F.length(y) == 2, "MM/YY").otherwise("MM/YYYY"), False))
                        .otherwise(let(F.regexp_extract(rest, _MON, 0), named)))
            return parts(raw, of)

        def named(raw):
            month = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(F.substring(raw, 1, 3)))
            return F.when(raw != "", found(kind, low, raw, none, month, _year(F.regexp_extract(raw, r"\d+$", 0)), F.lit("MON YYYY"), False))
        return let(F.regexp_extract(rest, _THREE, 0), three)

    def labelled(label):
        kind = F.when(label.rlike(r"(?i)^(mfg|mfd|manuf|date of manufacture)"), "mfg").otherwise("expiry")
        # text after the label: everything up to and including the first label occurrence is cut off
        rest = F.regexp_replace(line, r"(?i)^.*?" + DATE_LABEL.replace("(?i)", ""), "")
        return F.when(label != "", let(rest, lambda r: dated(kind, r)))
    return let(F.regexp_extract(line, DATE_LABEL, 1), labelled)


def last_valid_day(day: Column, month: Column, year: Column) -> Column:
    """A full date is valid to its end; a month-year date to the end of the month. Day overflow rolls forward."""
    first = F.make_date(year, F.greatest(month, F.lit(1)), F.lit(1))
    return F.when(day.isNotNull() & (day > 0), F.date_add(first, day - 1)).otherwise(F.last_day(first))


def date_passed(kind: Column, day: Column, month: Column, year: Column, needs_confirm: Column, as_of: Column) -> Column:
    """True/False for a confirmed expiry date; null for manufacturing and unconfirmed dates."""
    return F.when((kind != "mfg") & ~needs_confirm & (month > 0) & (year > 0), last_valid_day(day, month, year) < as_of)


def pao_months(c: Column) -> Column:
    """Months of the period-after-opening mark; null unless it is one of the usual periods and is really such a mark."""
    whole, n = F.regexp_extract(c, _PAO, 0), F.regexp_extract(c, _PAO, 1).try_cast("int")
    real = whole.rlike(r"(?i)PAO|months?") | whole.rlike(r"\b\d{1,2}M\b")
    return F.when(n.isin(*PAO_MONTHS) & real, n)


def add_months_overflow(d: Column, n: Column) -> Column:
    """Calendar month arithmetic where a missing day rolls into the next month (31 Jan + 1 = 3 Mar)."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), n), F.day(d) - 1)


def parse_price(c: Column) -> Column:
    """Struct of printed retail price, volume and per-unit price; whatever is not printed stays null."""
    t = F.replace(c, F.lit(","), F.lit(""))
    per = F.regexp_extract(t, _PER_UNIT, 1)
    mrp = F.regexp_extract(t, _MRP, 1)
    vol = F.regexp_extract(t, _VOLUME, 1)
    num = lambda x: F.nullif(x, F.lit("")).try_cast("double")
    return F.struct(num(mrp).alias("mrp"), num(vol).alias("volume_ml"), num(per).alias("per_unit_printed"))


def price_per_unit(mrp: Column, volume: Column) -> Column:
    return F.when((mrp > 0) & (volume > 0), mrp / volume)


def confirmed_date(dates, corrections, key: str):
    """dates(key, m, y, nc) with corrections(key, fm, fy): a user's month/year overrides the reading and clears its flag."""
    j = dates.join(corrections, key, "left")
    return j.select(key, F.coalesce("fm", "m").alias("month"), F.coalesce("fy", "y").alias("year"), (F.col("fm").isNull() & F.col("nc")).alias("needs_confirm"))
