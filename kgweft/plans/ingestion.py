"""A batch of documents as one change of the graph: the fold of the upserts that its triples ask for, one by one.

Every upsert has its place ``seq`` = (document's place, triple's place); a document comes before its triples.
Resolution sees the graph as it was before the batch. Relations keep the names as they were read and bind every
node of that name that exists at their place; where none does, a node of type ``unknown`` is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweft.config import Config
from kgweft.functions.vector import rescaled
from kgweft.operators import search, upsert
from kgweft.plans.extract import Extractor
#: Characters of an uploaded text that the stored document shows.
SHOWN = 2000
#: What a batch's documents bring; ``body`` is the text to extract from where it is not title and abstract.
DOCUMENT_COLUMNS = ["id", "title", "abstract", "url", "source", "citations", "ord", "body"]


def mentions(docs: DataFrame, extractor: Extractor) -> DataFrame:
    """Triples of documents (``id, title, abstract, ord``, perhaps ``body``), each with its ``seq``; documents may share an id or have none."""
    told = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
    text = F.coalesce("body", told) if "body" in docs.columns else told
    found = extractor.extract(docs.select(F.col("id").alias("source_id"), "ord", text.alias("text")))
    return found.withColumn("seq", F.struct(F.col("ord").cast("bigint").alias("doc"), F.col("pos").cast("bigint").alias("pos")))


def resolve(entities: DataFrame, wanted: DataFrame, embed: Callable[[Column], Column], config: Config = Config()) -> DataFrame:
    """``(name, type, resolved)`` of names that a stored node takes over.

    A stored node of the name and type needs none. Else the stored vector nearest to the name's decides: its node takes
    the name over if it is of that type and near enough. A name that can't be embedded (a null vector) stays itself.
    """
    known = entities.select(F.col("name").alias("known_name"), F.col("type").alias("known_type")).distinct()
    same = F.col("name").eqNullSafe(F.col("known_name")) & F.col("type").eqNullSafe(F.col("known_type"))
    fresh = wanted.select("name", "type").filter(F.col("name").isNotNull()).distinct().join(known, same, "left_anti")
    nodes = entities.filter(F.size("embedding") > 0).select(F.xxhash64("name", "type").alias("key"), F.col("name").alias("node"), F.col("type").alias("node_type"), "embedding")
    asked = fresh.select("name").distinct().select(F.xxhash64("name").alias("key"), "name", embed(F.col("name")).alias("embedding"))
    near = search.vector_topk_batch(nodes, asked, 1, key="key", vector="embedding", others_only=False)
    near = near.join(nodes.select("key", "node", "node_type").dropDuplicates(["key"]), "key").select(F.col("query").alias("key"), "node", "node_type", rescaled(F.col("score"), config.score_scale).alias("score"))
    told = search.resolve(fresh.withColumn("key", F.xxhash64("name")), near, config.entity_merge_threshold, keep=["name", "type"])
    return told.filter("merged").select("name", "type", F.coalesce("resolved", "name").alias("resolved"))


@dataclass
class Change:
    """Entities and relations after a batch, of the names that were given."""

    entities: DataFrame
    relations: DataFrame


def events(docs: DataFrame, triples: DataFrame, kind: str) -> DataFrame:
    """``(name, type, seq)``: one row for each entity upsert; null names are no entities."""
    first = F.struct(F.col("ord").cast("bigint").alias("doc"), F.lit(-1).cast("bigint").alias("pos")).alias("seq")
    rows = docs.select(F.col("title").alias("name"), F.lit(kind).alias("type"), first)
    for side in ("subject", "obj"):
        rows = rows.unionByName(triples.select(F.col(side).alias("name"), F.col(f"{side}_type").alias("type"), "seq"))
    return rows.filter(F.col("name").isNotNull())


def fold(
    entities: DataFrame, relations: DataFrame, docs: DataFrame, triples: DataFrame, *, kind: str = "Paper", now: Column | None = None,
    resolved: DataFrame | None = None, embed: Callable[[Column], Column] | None = None,
) -> Change:
    """The graph after a batch. ``triples`` as :func:`mentions` gives them; ``resolved`` as :func:`resolve` does."""
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    asked, titles = events(docs, triples, kind), docs.filter(F.col("title").isNotNull()).withColumn("name", F.col("title")).withColumn("type", F.lit(kind))
    if resolved is not None:
        asked, titles = (upsert.renamed(rows, resolved) for rows in (asked, titles))
    batch = asked.groupBy("name", "type").agg(F.count(F.lit(1)).alias("times"), F.min("seq").alias("born"))
    s, b = entities.withColumn("held", F.lit(True)).alias("s"), batch.alias("b")
    met = s.join(b, F.col("s.name").eqNullSafe(F.col("b.name")) & F.col("s.type").eqNullSafe(F.col("b.type")), "full_outer")
    stored, times = F.col("s.held").isNotNull(), F.coalesce("b.times", F.lit(0))
    nodes = met.select(
        F.coalesce("s.name", "b.name").alias("name"), F.coalesce("s.type", "b.type").alias("type"),
        F.when(times > 0, F.coalesce("s.mention_count", F.lit(0)) + times).otherwise(F.col("s.mention_count")).alias("mention_count"),
        F.when(stored, F.col("s.created")).otherwise(now).alias("created"), F.when((stored & (times > 0)) | (times > 1), now).otherwise(F.col("s.updated")).alias("updated"),
        *[F.col(f"s.{c}").alias(c) for c in ("url", "source", "citations", "text", "embedding", "summary")],
        F.when(~stored, F.col("b.born")).alias("born"),
    )
    made = upsert.made_endpoints(triples, nodes)
    bound = upsert.bind(triples, nodes.select("name", "type", "born").unionByName(made))
    rolled = upsert.relation_rollup(bound.withColumn("extracted_at", F.timestamp_millis(now)), upsert.TYPED)
    after = nodes.drop("born").unionByName(made.select("name", "type", now.alias("created")), allowMissingColumns=True)
    written = [c for c in ("url", "source", "citations") if c in docs.columns]
    if kind == "Paper" and written:  # a written null removes the old value
        last = titles.groupBy("name", "type").agg(F.max_by(F.struct(*written), "ord").alias("p"))
        after = after.join(last, ["name", "type"], "left")
        for c in written:
            after = after.withColumn(c, F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(c)))
        after = after.drop("p")
    shown = docs.filter(F.col("title").isNotNull())
    if embed is not None:
        shown = shown.withColumn("embedding", embed(F.concat("title", F.lit(". "), F.coalesce("abstract", F.lit("")))))
    after = upsert.index_documents(after, shown)
    return Change(after.select(*entities.columns), upsert.merge_relations(relations, rolled, upsert.TYPED).select(*relations.columns))


def totals(docs: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: documents taken in, and triples found in them."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(docs, "documents").crossJoin(F.broadcast(count(triples, "triples")))  # one row each
