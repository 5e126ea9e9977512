"""Text functions as column expressions; all stay in generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments that disqualify an entity name wherever they occur in it.
BANNED = [
    "dataset", "novel dataset", "applicants", "million", "billion", "percent", "results", "performance",
    "state of the art", "sota", "proposed method", "framework", "approach", "paper", "study", "author",
]
# Nouns that make a query look like a title.
TITLE_NOUNS = ["paper", "article", "study", "survey", "report", "model", "method", "approach", "benchmark", "system"]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case, runs of anything but ``a-z0-9`` as one space; null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """Distinct words of the normalised text; none for an empty one."""
    return F.array_distinct(F.filter(F.split(normalize(c), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity; 0 where either side has no words."""
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def title_matches(query: Column, title: Column, threshold: float = 0.35) -> Column:
    return (jaccard(query, title) >= threshold) | F.contains(normalize(title), normalize(query))


def looks_like_title(c: Column) -> Column:
    """Two words or more, and a sign of a title: one of ``" ( ) : -``, a capital, or one of ten nouns."""
    text = strip(F.coalesce(c, F.lit("")))
    return (F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) >= 2) & (
        text.rlike(r'["():\-]') | text.rlike("[A-Z]") | F.lower(text).rlike("|".join(TITLE_NOUNS))
    )


def good_entity(c: Column) -> Column:
    """At least three characters with a letter among them, and no banned fragment; null is no good entity."""
    text = strip(F.coalesce(c, F.lit("")))
    lower = F.lower(text)
    banned = F.exists(F.array(*map(F.lit, BANNED)), lambda b: F.contains(lower, b))
    return (F.length(text) >= 3) & text.rlike("[a-zA-Z]") & ~banned


def seed_list(c: Column) -> Column:
    """Parts between commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def stars(confidence: Column) -> Column:
    """One star for each fifth, rounded half to even, five at most."""
    return F.repeat(F.lit("★"), F.greatest(F.lit(0), F.least(F.lit(5), F.bround(confidence * 5).cast("int"))))


def iso(moment: Column) -> Column:
    """A moment as ISO text to the second; null gives the empty string."""
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def falsy(c: Column, default: float) -> Column:
    """``default`` for null and for zero."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))


def joined(low: Column, high: Column) -> Column:
    """A 64-bit number from its two halves; null counts as zero."""
    return F.coalesce(low, F.lit(0)).cast("bigint") + F.shiftleft(F.coalesce(high, F.lit(0)).cast("bigint"), 32)


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, rounded by the number's exact binary value (half to even).

    ``format_string`` rounds the shortest decimal form instead, which turns 0.725, stored a little below, into 0.73.
    """
    x, unit = F.abs(c.cast("double")), 10**digits
    high = F.floor(x * 2.0**20)
    low = F.floor((x * 2.0**20 - high) * 2.0**43)
    whole = F.lit(Decimal(1 << 63))
    scaled = (high.cast("decimal(18,0)") * F.lit(1 << 43).cast("decimal(14,0)") + low.cast("decimal(14,0)")) * F.lit(unit).cast(f"decimal({digits + 1},0)")
    rest = scaled % whole
    floor = ((scaled - rest) / whole).cast("bigint")
    up = (rest * 2 > whole) | ((rest * 2 == whole) & (floor % 2 == 1))
    total = floor + up.cast("bigint")
    sign = F.when((c < 0) & (total > 0), "-").otherwise("")
    return F.concat(sign, F.floor(total / unit).cast("bigint").cast("string"), F.lit("."), F.lpad((total % unit).cast("string"), digits, "0"))
