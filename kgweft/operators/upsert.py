"""Folding mentions into entities and relations, and merging batches into what is stored.

A batch of upserts is one aggregation and one full outer join, whatever their number. The running mean of
confidence has the closed form (c n + sum) / (n + k), so partial sums combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweft.schemas import UNKNOWN


def _millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def entity_rollup(mentions: DataFrame) -> DataFrame:
    """``(name, type, mention_count)``: one upsert for each occurrence as subject or object. Null names are no entities."""
    sides = [mentions.select(F.col(s).alias("name"), F.col(f"{s}_type").alias("type")) for s in ("subject", "obj")]
    return sides[0].unionByName(sides[1]).filter(F.col("name").isNotNull()).groupBy("name", "type").agg(F.count(F.lit(1)).alias("mention_count"))


def merge_entities(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored entities after a batch of counted upserts; a stored null count is 0."""
    key = ["name", "type"]
    s = stored.select(*key, F.coalesce("mention_count", F.lit(0)).alias("old"))
    b = batch.select(*key, F.col("mention_count").alias("new"))
    met = s.join(b, s["name"].eqNullSafe(b["name"]) & s["type"].eqNullSafe(b["type"]), "full_outer")
    return met.select(*[F.coalesce(s[k], b[k]).alias(k) for k in key], (F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("mention_count"))


def last_writer(events: DataFrame, key: list[str], order: list[str], properties: list[str], present: dict[str, Column] | None = None) -> DataFrame:
    """The last value written to each property. ``present`` says which events write a property at all; a written null wins."""
    def last(p: str) -> Column:
        wrote = (present or {}).get(p, F.lit(True))
        return F.max_by(F.when(wrote, F.struct(F.col(p).alias("v"))), F.when(wrote, F.struct(*order)))["v"].alias(p)

    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("mention_count"), *[last(p) for p in properties])


KEY = ["subject", "predicate", "obj"]
#: Between nodes instead of names.
TYPED = ["subject", "subject_type", "predicate", "obj", "obj_type"]


def relation_rollup(mentions: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Relations by ``key``: distinct sources in order, mean confidence, first and last seen, count.

    A null confidence counts as 1.0; an empty or null source is no source. Mentions without an end are left out. The
    first of two aggregations is by source as well, so a relation's list is made of its sources, not of its mentions.
    """
    usable = mentions.filter(F.col("subject").isNotNull() & F.col("obj").isNotNull())
    seen = _millis(F.col("extracted_at"))
    each = usable.groupBy(*key, F.nullif("source_id", F.lit("")).alias("source_id")).agg(
        F.min("seq").alias("seq"), F.sum(F.coalesce("confidence", F.lit(1.0))).alias("total"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("n"),
    )
    source = F.when(F.col("source_id").isNotNull(), F.struct("seq", "source_id"))
    return each.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(source)), lambda x: x["source_id"]).alias("sources"), (F.sum("total") / F.sum("n")).alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("mention_count"),
    )


def relation_totals(mentions: DataFrame) -> DataFrame:
    """:func:`relation_rollup` without the lists and times: what traversal needs."""
    usable = mentions.filter(F.col("subject").isNotNull() & F.col("obj").isNotNull())
    return usable.groupBy("subject", "predicate", "obj").agg(F.avg(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.count(F.lit(1)).alias("mention_count"))


def merge_relations(stored: DataFrame, batch: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Stored relations after a batch: weighted mean, summed counts, old sources first, earliest and latest times."""
    s, b = stored.alias("s"), batch.alias("b")
    met = s.join(b, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    n, k = F.coalesce("s.mention_count", F.lit(0)), F.coalesce("b.mention_count", F.lit(0))
    none = F.array().cast("array<string>")
    return met.select(
        *[F.coalesce(f"s.{x}", f"b.{x}").alias(x) for x in key],
        F.array_distinct(F.concat(F.coalesce("s.sources", none), F.coalesce("b.sources", none))).alias("sources"),
        ((F.coalesce("s.confidence", F.lit(0.0)) * n + F.coalesce("b.confidence", F.lit(0.0)) * k) / (n + k)).alias("confidence"),
        F.least("s.first_seen", "b.first_seen").alias("first_seen"), F.greatest("s.last_seen", "b.last_seen").alias("last_seen"), (n + k).alias("mention_count"),
    )


def renamed(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """``rows`` (``name, type, ...``) with the names that ``resolved`` (``name, type, resolved``) gives."""
    map_to = resolved.select(F.col("name").alias("from_name"), F.col("type").alias("from_type"), "resolved")
    same = F.col("name").eqNullSafe(F.col("from_name")) & F.col("type").eqNullSafe(F.col("from_type"))
    return rows.join(map_to, same, "left").withColumn("name", F.coalesce("resolved", "name")).drop("from_name", "from_type", "resolved")


def made_endpoints(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(name, type, born)`` of the nodes that relations make: ends whose name no node bears at the mention's place.

    ``nodes``: ``name, born``; a null ``born`` is a node that was there before.
    """
    ends = mentions.select(F.col("subject").alias("name"), "seq").unionByName(mentions.select(F.col("obj").alias("name"), "seq"))
    ends = ends.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("seq").alias("met"))
    borne = nodes.groupBy("name").agg(F.min("born").alias("first"), F.bool_or(F.col("born").isNull()).alias("old"))
    free = ends.join(borne, "name", "left").filter(~F.coalesce("old", F.lit(False)) & (F.col("first").isNull() | (F.col("first") > F.col("met"))))
    return free.select("name", F.lit(UNKNOWN).alias("type"), F.col("met").alias("born"))


def bind(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``mentions`` with the types of each pair of nodes that they bind: those of their names that exist at their place."""
    for side in ("subject", "obj"):
        ends = nodes.groupBy(F.col("name").alias(side), F.col("type").alias(f"{side}_type")).agg(F.min("born").alias("born"), F.bool_or(F.col("born").isNull()).alias("old"))
        mentions = mentions.drop(f"{side}_type").join(ends, side).filter(F.col("old") | (F.col("born") <= F.col("seq"))).drop("born", "old")
    return mentions


def missing_endpoints(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``(name, type)`` of the nodes that relations create: ends that no entity bears as its name, of type ``unknown``."""
    ends = mentions.select(F.col("subject").alias("name")).unionByName(mentions.select(F.col("obj").alias("name"))).filter(F.col("name").isNotNull()).distinct()
    return ends.join(entities.select("name").distinct(), "name", "left_anti").select("name", F.lit(UNKNOWN).alias("type"))


def bound_endpoints(mentions: DataFrame, entities: DataFrame, seen: str = "seen", created: str = "created") -> DataFrame:
    """``(seq, src_type, dst_type)``: every pair of nodes, alike in name, that a mention binds; nodes created after it don't count."""
    s = entities.select(F.col("name").alias("subject"), F.col("type").alias("src_type"), F.col(created).alias("s_created"))
    o = entities.select(F.col("name").alias("obj"), F.col("type").alias("dst_type"), F.col(created).alias("o_created"))
    met = mentions.join(s, "subject").filter(F.col("s_created") <= F.col(seen))
    return met.join(o, "obj").filter(F.col("o_created") <= F.col(seen)).select("seq", "src_type", "dst_type")


def index_documents(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Text (and vector, if ``docs`` has one) of every node whose name is a document's title; the last document of a title wins."""
    vector = "embedding" in docs.columns
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
    new = docs.filter(F.col("title").isNotNull()).groupBy(F.col("title").alias("name")).agg(
        F.max_by(F.struct(body.alias("text"), *([F.col("embedding")] if vector else [])), "ord").alias("new")
    )
    met = entities.join(new, "name", "left")
    out = met.withColumn("text", F.coalesce("new.text", "text"))
    if vector:
        out = out.withColumn("embedding", F.coalesce("new.embedding", "embedding"))
    return out.drop("new")


def write_summaries(entities: DataFrame, summaries: DataFrame) -> DataFrame:
    """Entities with the summaries of ``(name, summary)`` written over the old ones."""
    new = summaries.groupBy("name").agg(F.max("summary").alias("new"))
    return entities.join(new, "name", "left").withColumn("summary", F.coalesce("new", "summary")).drop("new")
