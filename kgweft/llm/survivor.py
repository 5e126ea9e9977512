"""Best representative of each duplicate group, chosen field by field (problem 7).

Every field has a rank made of completeness, trust and recency with the copy's number as the last
tie-break; a window keeps the first copy of each group. The window's limit of one row is applied before
the shuffle as well, so a group with a third of all rows sends a row from each task, not its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweft.session import cut

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Counts from here on are taken for the marks of an overflow or a filler.
UNBELIEVABLE = 10_000_000
FIRST_YEAR = 1990
_MONTH = r"([A-Za-z]{3})[a-z]*\.?"
#: Wrongly decoded, private or lost characters and markup; the end of a sentence; between two sentences.
BROKEN = r"[\x{FFFD}\x{80}-\x{9F}\x{E000}-\x{F8FF}]|Ã|Â|â€|\?\p{L}|\p{L}\?[\p{L}\d]|(^|\s)\?\s|<[a-zA-Z/!]|&[a-z]+;|&#"
ENDED = r"[.!?][\"'”’)\]]*$"
NEXT = r"[\p{Lu}\p{N}©\"'“(\[]"
#: A copyright line is page furniture wherever it stands; all other furniture is learned from the rows (:func:`furniture`).
COPYRIGHT = r"^(©|\([cC]\) )"


def exact_day(raw: Column) -> Column:
    """The day that a date string names in full, else null: years and months alone, seasons, fillers and days that don't exist give null."""
    text = F.trim(raw)

    def iso(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        part = lambda n: F.regexp_extract(text, pattern, n)
        month = part(m)
        if named:
            month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("string")
        made = F.concat_ws("-", part(y), F.lpad(month, 2, "0"), F.lpad(part(d), 2, "0"))
        return F.when(text.rlike(pattern), made)

    tail = r"([T ]\d{2}:\d{2}.*)?$"
    found = F.coalesce(
        iso(r"^(\d{4})-(\d{1,2})-(\d{1,2})" + tail, 1, 2, 3),
        iso(r"^(\d{4})/(\d{1,2})/(\d{1,2})" + tail, 1, 2, 3),
        iso(r"^(?:[A-Za-z]{3,9}, ?)?(\d{1,2})(?:st|nd|rd|th)? " + _MONTH + r",? (\d{4})( .*)?$", 3, 2, 1, True),
        iso(r"^(?:[A-Za-z]{3,9}, ?)?" + _MONTH + r" (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})( .*)?$", 3, 1, 2, True),
    )
    return found.try_cast("date")


def _measured(copies: DataFrame) -> DataFrame:
    """Copies with ``whole`` (abstract with plain spacing), its sentences and the marks of damage."""
    whole = F.trim(F.regexp_replace(F.coalesce("abstract", F.lit("")), r"(?U)\s+", " "))
    half = "int(length(whole) / 2)"
    return (
        copies.withColumn("whole", whole)
        .withColumn("doubled", (F.length("whole") > 20) & (F.trim(F.expr(f"substring(whole, 1, {half})")) == F.trim(F.expr(f"substring(whole, {half} + 1)"))))
        .withColumn("broken", F.col("whole").rlike(BROKEN) | ~F.col("whole").rlike(ENDED) | F.col("whole").rlike(r"(\.\.\.|…)$") | ~F.col("whole").rlike(r"\S+ \S+ \S+"))
        .withColumn("sentences", F.split("whole", rf"(?<=[.!?])\s+(?={NEXT})"))
    )


def furniture(measured: DataFrame, least_groups: int = 5, share: float = 0.5) -> DataFrame:
    """``sentence``: what stands in some copies of many groups, but in few of the copies of each.

    A sentence of a paper stands in nearly all copies that hold an abstract; a notice that pages add stands
    in those that came from such pages. Counted over all rows, with partial sums before each shuffle.
    """
    usable = measured.filter(F.length("whole") > 20)
    held = usable.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spoken = usable.select("group_id", F.explode(F.array_distinct("sentences")).alias("sentence"))
    per_group = spoken.groupBy("sentence", "group_id").agg(F.count(F.lit(1)).alias("k"))
    return (
        per_group.join(held, "group_id").groupBy("sentence")
        .agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("k") / F.col("n")).alias("mean"))
        .filter((F.col("groups") >= least_groups) & (F.col("mean") < share)).select("sentence")
    )


def _top(rows: DataFrame, field: str, value: Column, *order: Column) -> DataFrame:
    window = Window.partitionBy("group_id").orderBy(*order, F.col("copy_id").asc_nulls_last())
    ranked = rows.select("group_id", "copy_id", value.alias("value"), F.row_number().over(window).alias("rank"))
    return ranked.filter("rank = 1").select("group_id", F.lit(field).alias("field"), "copy_id", "value")


def survivors(copies: DataFrame, sources: DataFrame, *, least: int = 2) -> DataFrame:
    """``(group_id, field, copy_id, value)``: the copy that supplies each field of each group of at least ``least`` rows.

    ``abstract``: a copy whose abstract is whole (as long as the longest of its group once added notices and
    doubling are taken away), undamaged and free of additions; by trust, then recency. ``citations``: the copy
    fetched last with a count above zero and below ten million. ``published_date``: a copy whose date names an
    existing day from 1990 on and not after ``fetched_at``; by trust, then recency. Ties end at the smallest
    ``copy_id``. No row where no copy qualifies; rows with a null ``group_id`` belong to no group and are left
    out; unknown or null sources have trust 0; a source listed twice has its highest trust; extra columns are
    ignored; an empty table gives no rows. Repeated rows count as copies.
    """
    trust = sources.groupBy("source").agg(F.max("trust").alias("trust")).filter(F.col("source").isNotNull())
    base = copies.select("copy_id", "group_id", "abstract", "source", "published_date", "citations", "fetched_at").filter(F.col("group_id").isNotNull())
    base = base.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    measured = cut(_measured(base).withColumn("row", F.xxhash64("copy_id", "group_id", "whole", "source", "fetched_at")))
    known = furniture(measured).withColumn("known", F.lit(True))
    # a row repeated in full is measured once
    spoken = measured.select("row", "sentences").dropDuplicates(["row"]).select("row", F.explode("sentences").alias("sentence"))
    core = (
        spoken.join(known, "sentence", "left")
        .withColumn("added", F.coalesce("known", F.lit(False)) | F.col("sentence").rlike(COPYRIGHT))
        .groupBy("row").agg(F.sum(F.when(~F.col("added"), F.length("sentence") + 1).otherwise(0)).alias("core"), F.max("added").alias("added"))
    )
    full = measured.join(core, "row", "left").withColumn("core", F.when(F.col("doubled"), F.floor(F.col("core") / 2)).otherwise(F.coalesce("core", F.lit(0))))
    clean = full.filter(~F.col("broken") & ~F.col("doubled") & ~F.col("added") & (F.col("core") > 0))
    sizes = full.groupBy("group_id").agg(F.max("core").alias("longest"))
    late = [F.col("trust").desc(), F.col("fetched_at").desc_nulls_last()]
    abstract = _top(clean.withColumn("text", F.struct("core", "abstract")), "abstract", F.col("text"), F.col("core").desc(), *late)
    abstract = abstract.join(sizes, "group_id").filter(F.col("value.core") + 2 >= F.col("longest")).withColumn("value", F.col("value.abstract")).drop("longest")
    believable = base.filter((F.col("citations") > 0) & (F.col("citations") < UNBELIEVABLE))
    citations = _top(believable, "citations", F.col("citations").cast("string"), F.col("fetched_at").desc_nulls_last(), F.col("trust").desc())
    dated = base.withColumn("day", exact_day(F.col("published_date")))
    dated = dated.filter((F.year("day") >= FIRST_YEAR) & (F.col("day").cast("timestamp_ntz") <= F.col("fetched_at").cast("timestamp_ntz")))
    published = _top(dated, "published_date", F.col("day").cast("string"), *late)
    many = base.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("group_id")
    return reduce(DataFrame.unionByName, [abstract, citations, published]).join(many, "group_id", "left_semi")


def records(copies: DataFrame, sources: DataFrame) -> DataFrame:
    """One built record for each group: ``(group_id, abstract, citations, published_date)``; null where no copy qualifies."""
    return survivors(copies, sources).groupBy("group_id").agg(
        F.max(F.when(F.col("field") == "abstract", F.col("value"))).alias("abstract"),
        F.max(F.when(F.col("field") == "citations", F.col("value"))).try_cast("bigint").alias("citations"),
        F.max(F.when(F.col("field") == "published_date", F.col("value"))).try_cast("date").alias("published_date"),
    )
