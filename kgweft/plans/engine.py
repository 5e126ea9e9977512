"""The engine's face: one method for each service of the graph, returning DataFrames or small rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweft.config import Config
from kgweft.operators import upsert, views
from kgweft.plans import ingestion
from kgweft.plans.embed import embedder, hashed_all
from kgweft.plans.extract import get_extractor
from kgweft.plans.responses import snippet
from kgweft.plans.retrieval import Retriever, answer, extractive_summary
from kgweft.session import cut, ship
from kgweft.sources.fetch import Fetcher
from kgweft.sources.store import Store


class Engine:
    """``model`` answers for the extractor, ``encode`` (texts to a matrix) for the embedder; both have offline defaults."""

    def __init__(
        self, spark: SparkSession, root: str, config: Config = Config(), model: Callable[[Column], Column] | None = None,
        encode: Callable[[list[str]], np.ndarray] = hashed_all,
    ):
        ship(spark)
        self.spark, self.config, self.encode, self.store = spark, config, encode, Store(spark, root, config.parts)
        self.extractor = get_extractor(config.extraction_method, model, config.entity_score)
        self.store.bootstrap()

    def health(self) -> dict:
        return {"status": "ok"}

    def ingest(self, docs: DataFrame, kind: str = "Paper", batch: str = "", as_of: int | None = None) -> dict:
        """Upsert documents (``id, title, abstract, url, source, citations, ord``, perhaps ``body``), their triples and their vectors.

        ``ord`` is a document's place and tells documents apart; ids may be shared, empty or null. Names are resolved
        against the graph before the batch. ``batch`` names the batch: one that was ingested is not counted twice.
        Only the parts of the stored tables that the batch's names fall in are read and written.
        """
        if batch and batch in self.store.tags():
            return {"documents": 0, "triples": 0, "repeated": True}
        now, embed = F.lit(as_of) if as_of is not None else F.unix_millis(F.current_timestamp()), embedder(self.encode)
        docs = cut(docs.select(*[c for c in ingestion.DOCUMENT_COLUMNS if c in docs.columns]))
        triples = cut(ingestion.mentions(docs, self.extractor))  # a model sees each text once
        stored = self.store.read("entities")
        resolved = cut(ingestion.resolve(stored, ingestion.events(docs, triples, kind), embed, self.config))
        ends = [triples.select(F.col(c).alias("name")) for c in ("subject", "obj")]
        names = reduce(DataFrame.unionByName, [*ends, docs.select(F.col("title").alias("name")), resolved.select(F.col("resolved").alias("name"))])
        parts = {"entities": self.store.parts_of(names.filter("name IS NOT NULL")), "relations": self.store.parts_of(ends[0])}
        after = ingestion.fold(
            self.store.read("entities", parts["entities"]), self.store.read("relations", parts["relations"]), docs, triples, kind=kind, now=now, resolved=resolved, embed=embed,
        )
        totals = ingestion.totals(docs, triples).first().asDict() | {"repeated": False}
        self.store.publish({"entities": after.entities, "relations": after.relations}, batch, parts)
        return totals

    def ingest_topic(self, docs: DataFrame, topic: str, limit: int = 10, batch: str = "") -> dict:
        """Fetch documents of a topic and ingest them in the order in which the source gave them."""
        found = cut(Fetcher(docs).fetch(topic, limit).withColumn("ord", F.monotonically_increasing_id()))
        return self.ingest(found, "Paper", batch)

    def ingest_text(self, title: str, text: str, doc_id: str = "", batch: str = "") -> dict:
        """Extract from the whole text; the stored document shows its beginning."""
        shape = "id string, title string, abstract string, url string, source string, citations bigint, ord bigint, body string"
        return self.ingest(self.spark.createDataFrame([(doc_id or title, title, text[: ingestion.SHOWN], None, "text_upload", None, 0, text)], shape), "Document", batch)

    def query(self, question: str, seeds: Callable[[str], list[str]] | None = None, synthesise: Callable[[str], str] | None = None) -> dict:
        embed = lambda q: np.asarray(self.encode([q]))[0].tolist()
        found = Retriever(self.store.read("entities"), self.store.read("relations"), self.config, seeds=seeds, embed=embed).retrieve(question)
        return answer(found, synthesise) | {"route": found.route}

    def stats(self) -> DataFrame:
        return views.stats(self.store.read("entities"), self.store.read("relations"))

    def history(self, limit: int = 20, page: int = 0) -> DataFrame:
        return views.history(self.store.read("entities"), limit, page * limit)

    def graph(self, limit: int = 120, min_mentions: int = 0) -> tuple[DataFrame, DataFrame]:
        links = views.export_links(self.store.read("relations"), limit, min_mentions)
        return views.export_nodes(links, self.store.read("entities")), links

    def summary(self, title: str, summarise: Callable[[Column, Column, Column], Column] = extractive_summary) -> dict | None:
        """The stored summary of a document, or a new one, which is then stored; null where no text is known. Reads and writes one part."""
        parts = self.store.parts_of(self.spark.createDataFrame([(title,)], "name string"))
        entities = self.store.read("entities", parts)
        context = views.summary_context(views.node(entities, title), self.store.read("relations", parts).filter(F.col("subject") == title))
        row = context.select("text", "summary", snippet(F.col("text")).alias("source_text_snippet")).first()
        if row is None:
            return None
        told = {"title": title, "source_text_snippet": row["source_text_snippet"]}
        if row["summary"]:
            return told | {"summary": row["summary"], "cached": True}
        shown = F.slice("relations", 1, self.config.summary_relations)
        made = cut(context.select("name", summarise(F.col("name"), F.col("text"), shown).alias("summary")))
        self.store.publish({"entities": upsert.write_summaries(entities, made)}, parts={"entities": parts})
        return told | {"summary": made.first()["summary"], "cached": False}
