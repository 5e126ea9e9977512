"""Read-only views: counts, history, graph export and summary context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweft.functions.text import falsy
from kgweft.schemas import DOCUMENT_TYPES


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts: entities, relations, papers, vectors; a pass over each table."""
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("type").isin(DOCUMENT_TYPES)).alias("papers"), F.count_if(F.col("embedding").isNotNull()).alias("vector_index_size"))
    r = relations.agg(F.count(F.lit(1)).alias("relations"))
    return e.crossJoin(F.broadcast(r)).select("entities", "relations", "papers", "vector_index_size")  # one row each


def history(entities: DataFrame, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Documents with a text, titles from the last in order; all of them without a limit."""
    rows = entities.filter(F.col("type").isin(DOCUMENT_TYPES) & F.col("text").isNotNull()).select(F.col("name").alias("title"), "type", F.length("text").cast("bigint").alias("text_length")).distinct()
    shown = rows.orderBy(F.col("title").desc(), "type", "text_length").offset(offset)
    return shown.limit(limit) if limit else shown


def node(entities: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """The nodes of one name, or the one of a name and type."""
    found = entities.filter(F.col("name") == name)
    return found if kind is None else found.filter(F.col("type") == kind)


def export_links(relations: DataFrame, limit: int | None = 120, min_mentions: int = 0) -> DataFrame:
    """Links of the graph view, in a fixed order; a confidence of null or 0 shows as 1, a null name as ``?``."""
    typed = [c for c in ("subject_type", "obj_type") if c in relations.columns]
    rows = relations.filter(F.coalesce("mention_count", F.lit(0)) >= min_mentions).orderBy("subject", "predicate", "obj", *typed)
    rows = rows.limit(limit) if limit else rows
    return rows.select(
        F.coalesce("subject", F.lit("?")).alias("source"), F.coalesce("obj", F.lit("?")).alias("target"), "predicate",
        falsy(F.col("confidence"), 1.0).alias("confidence"), F.coalesce("mention_count", F.lit(0)).cast("bigint").alias("mention_count"), *typed,
    )


def joined(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the nodes at both ends; an end borne by several nodes gives a row for each."""
    ends = {side: entities.select(F.col("name").alias(side), F.col("type").alias(f"{side}_type")) for side in ("source", "target")}
    met = relations.join(ends["source"], F.col("subject") == F.col("source")).join(ends["target"], F.col("obj") == F.col("target"))
    return met.drop("subject", "obj")


def export_nodes(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes of the links, once for each name: the first seen in link order, subjects before objects.

    Links that name their ends' types show that node; otherwise it is the name's first node in the order of types.
    """
    typed = "subject_type" in links.columns
    end = lambda name, kind, side: F.struct("source", "predicate", "target", F.lit(side).alias("side"), (F.col(kind) if typed else F.lit(None).cast("string")).alias("type"), F.col(name).alias("name"))
    ends = links.select(F.explode(F.array(end("source", "subject_type", 0), end("target", "obj_type", 1))).alias("e"))
    first = ends.groupBy(F.col("e.name").alias("name")).agg(F.min(F.struct("e.source", "e.predicate", "e.target", "e.side", "e.type"))["type"].alias("seen"))
    every = entities.select("name", F.struct("type", F.coalesce("mention_count", F.lit(0)).alias("n")).alias("e"))
    met = first.join(every, "name", "left").groupBy("name", "seen").agg(F.min(F.when(F.col("seen").isNull() | (F.col("seen") == F.col("e.type")), F.col("e"))).alias("e"))
    return met.select(F.col("name").alias("id"), "name", F.coalesce("e.type", "seen").alias("type"), F.coalesce("e.n", F.lit(0)).cast("bigint").alias("mention_count"))


def summary_context(entities: DataFrame, relations: DataFrame, label: str = "RELATION") -> DataFrame:
    """``(name, text, summary, relations)``: each document's text with what its outgoing relations say; one empty pair without any."""
    docs = entities.filter(F.col("type").isin(DOCUMENT_TYPES) & (F.coalesce("text", F.lit("")) != "")).select("name", "text", "summary")
    met = docs.join(relations.select(F.col("subject").alias("name"), "obj"), "name", "left")
    pair = F.struct(F.when(F.col("obj").isNotNull(), F.lit(label)).alias("pred"), "obj")
    return met.groupBy("name", "text", "summary").agg(F.array_sort(F.collect_list(pair)).alias("relations"))
