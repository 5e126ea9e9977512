"""Queries of the training-data operators over the test tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweft.llm import history, markup, matching, names, packing, splitting, subjects, survivor, tokens, vectors
from kgweft.session import ship, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return history.found(table(spark, sf_dir, "papers"))


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p1_found with every batch a delivery of its own."""
    ship(spark)
    return history.found(table(spark, sf_dir, "papers"), each=True)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return history.classes(table(spark, sf_dir, "papers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pairs = matching.match(table(spark, sf_dir, "papers"), table(spark, sf_dir, "index_papers"))
    return pairs.select("paper_rec_id", "index_rec_id")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return matching.matches(table(spark, sf_dir, "papers"), table(spark, sf_dir, "index_papers"))


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule's confidence rests on."""
    ship(spark)
    papers, index = table(spark, sf_dir, "papers"), table(spark, sf_dir, "index_papers")
    return matching.precision(matching.match(papers, index), papers, index).withColumn("confidence", F.round("confidence", 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vectors.pairs(vectors.neighbours(table(spark, sf_dir, "entities")))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = vectors.neighbours(table(spark, sf_dir, "entities"))
    return found.withColumn("cosine", F.round("cosine", 4)).withColumn("rank", F.col("rank").cast("bigint"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return names.pairs(names.link(table(spark, sf_dir, "mentions")))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return names.link(table(spark, sf_dir, "mentions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return markup.found(table(spark, sf_dir, "papers"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return markup.clean(table(spark, sf_dir, "papers")).withColumn("markup", F.array_join("markup", ","))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return splitting.cuts(table(spark, sf_dir, "ingest_texts"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return splitting.split(table(spark, sf_dir, "ingest_texts"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text add up to."""
    ship(spark)
    pieces = splitting.split(table(spark, sf_dir, "ingest_texts"))
    new = F.struct("piece", F.expr("substring(text, overlap + 1)").alias("text"))
    told = pieces.groupBy("request_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda p: p["text"]), "").alias("text"), F.max(F.length("text") > 2000).alias("too_long"),
        F.max(F.col("overlap") > 200).alias("too_much_repeated"), (F.count(F.lit(1)) > 1).alias("cut"),
    )
    return told.select("request_no", F.md5("text").alias("text_md5"), "too_long", "too_much_repeated", "cut")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = survivor.survivors(table(spark, sf_dir, "paper_copies"), table(spark, sf_dir, "fetch_sources"))
    return found.select("group_id", "field", "copy_id")


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return survivor.records(table(spark, sf_dir, "paper_copies"), table(spark, sf_dir, "fetch_sources"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of each text say."""
    ship(spark)
    ids = tokens.encode(table(spark, sf_dir, "documents"))
    told = tokens.decode(ids).select("doc_id", F.md5("text").alias("text_md5"))
    return told.join(ids.select("doc_id", (F.size("ids") == 0).alias("no_ids")), "doc_id")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.usage(packing.pack_documents(table(spark, sf_dir, "documents")))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers hold of each document."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    packed, sizes = packing.pack_documents(docs), tokens.encode(docs, counts=True)
    full = packed.groupBy("container_id").agg((F.sum("n_tokens") > 2048).alias("full"))
    held = packed.join(full, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.max("full").alias("over_full"))
    met = sizes.filter("n_tokens > 0").join(held, "doc_id", "left")
    return met.select(
        "doc_id", F.coalesce(F.col("held") == F.col("n_tokens"), F.lit(False)).alias("whole"), "over_full", ((F.col("pieces") > 1) & (F.col("n_tokens") <= 2048)).alias("split_for_nothing")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return subjects.found(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return subjects.composition(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_batches": p1_batches, "p1_classes": p1_classes, "p2_found": p2_found, "p2_matches": p2_matches, "p2_rules": p2_rules,
        "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p4_found": p4_found, "p4_entities": p4_entities,
        "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_checks": p6_checks,
        "p7_found": p7_found, "p7_records": p7_records, "p8_ids": p8_ids, "p8_checks": p8_checks,
        "p9_containers": p9_containers, "p9_usage": p9_usage, "p9_checks": p9_checks,
        "p10_found": p10_found, "p10_composition": p10_composition,
    }
