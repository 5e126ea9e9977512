"""Two-hop neighbourhoods, ranked.

Paths are never enumerated. With N the seeds and their neighbours, the edges on paths of one or two steps that
end elsewhere than they began are those with an end in N, but for loops on nodes that have no other edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweft.config import Config


def matches_seed(name: Column, seeds: list[str]) -> Column:
    """Whether a name contains one of the seeds, in any case."""
    lower = F.lower(name)
    return F.lit(False) if not seeds else F.exists(F.array(*[F.lit(s.lower()) for s in seeds]), lambda s: F.contains(lower, s))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("subject").alias("name")).union(edges.select("obj")).distinct()


def two_hop(edges: DataFrame, seeds: list[str]) -> DataFrame:
    """Edges within two steps of the nodes that match a seed, in stored direction."""
    hit = matches_seed(F.col("subject"), seeds) | matches_seed(F.col("obj"), seeds)
    reached = edges.filter(hit).select(F.explode(F.array("subject", "obj")).alias("name")).distinct()
    subject, obj = (reached.select(F.col("name").alias(c), F.lit(True).alias(f"{c}_met")) for c in ("subject", "obj"))
    met = edges.join(subject, "subject", "left").join(obj, "obj", "left").filter("subject_met OR obj_met").select(*edges.columns)
    # a loop counts where its node has an edge that is none; all of such a node's edges were met
    apart = met.filter(F.col("subject") != F.col("obj"))
    loops = met.filter(F.col("subject") == F.col("obj")).join(nodes(apart).withColumnRenamed("name", "subject"), "subject", "left_semi")
    return apart.unionByName(loops.select(*edges.columns))


def ranked(edges: DataFrame, config: Config = Config(), limit: int | None = None, cut_off: bool = True) -> DataFrame:
    """Distinct triples with score confidence x ln(count + 1), best first; a limit of 0 or none is the configured one."""
    predicate = F.col("predicate") if config.predicate_mode == "verb" else F.lit(config.relation_label)
    confidence, count = F.round(F.coalesce("confidence", F.lit(1.0)), 6), F.coalesce("mention_count", F.lit(1)).cast("bigint")
    rows = edges.select("subject", predicate.alias("predicate"), "obj", confidence.alias("confidence"), count.alias("mention_count")).distinct()
    if config.min_confidence is not None:
        rows = rows.filter(F.col("confidence") >= config.min_confidence)
    scored = rows.withColumn("retrieval_score", F.round(F.col("confidence") * F.log(F.col("mention_count") + 1), 6))
    order = [F.col("retrieval_score").desc(), "subject", "obj", "predicate", "confidence", "mention_count"]
    return scored.orderBy(*order).limit(limit or config.graph_triple_limit) if cut_off else scored


def abstracts(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """``(name, abstract)`` of the nodes of triples that have a text."""
    return entities.filter(F.col("text").isNotNull()).join(nodes(triples), "name", "left_semi").select(
        "name", F.concat(F.lit("["), F.col("name"), F.lit(" Abstract]: "), F.col("text")).alias("abstract")
    )
