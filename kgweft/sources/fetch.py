"""Fetching over document tables: by id, title, citations and free text, and the chain of fallbacks."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweft.functions.text import looks_like_title, normalize, strip, title_matches
from kgweft.sources.catalog import TOPICS, resolve_topics

PAYLOAD = "struct<data: array<struct<paperId: string, title: string, abstract: string, year: int, citationCount: bigint, authors: array<struct<name: string>>>>>"


def documents_of(payloads: DataFrame, raw: str, source: str, prefix: str) -> DataFrame:
    """Document records of search answers. A null year gives an empty date; items keep their place in ``pos``."""
    told = payloads.select(F.posexplode(F.from_json(F.col(raw), PAYLOAD)["data"]).alias("pos", "d"))
    ident = F.coalesce("d.paperId", F.lit(""))
    return told.select(
        "pos", ident.alias("id"), F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.abstract", F.lit("")).alias("abstract"),
        F.transform(F.coalesce("d.authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]).alias("authors"), F.lit(source).alias("source"),
        F.concat(F.lit(prefix), ident).alias("url"), F.coalesce(F.col("d.year").cast("string"), F.lit("")).alias("published_date"), F.coalesce("d.citationCount", F.lit(0)).alias("citations"),
    )


def by_ids(docs: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """All records of some ids: a short list, or a column of any length."""
    return docs.join(ids, "id", "left_semi") if isinstance(ids, DataFrame) else docs.filter(F.col("id").isin(ids))


def _last(docs: DataFrame) -> list[str]:
    """What decides between records that are equal so far."""
    return ["id", *(["rec_id"] if "rec_id" in docs.columns else [])]


def by_title(docs: DataFrame, query: str, limit: int = 5, threshold: float = 0.35) -> DataFrame:
    """Best cited first, then by title."""
    asked = strip(F.lit(query or ""))
    hits = docs.filter((asked != "") & title_matches(asked, F.col("title"), threshold))
    return hits.orderBy(F.coalesce("citations", F.lit(0)).desc(), F.coalesce("title", F.lit("")), *_last(docs)).limit(limit)


def by_exact_title(docs: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Titles that contain the query, in the order of titles."""
    return docs.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.lit(query)))).orderBy("title", *_last(docs)).limit(limit)


def by_citations(docs: DataFrame, limit: int | None = 10) -> DataFrame:
    """Documents with an abstract, best cited first."""
    rows = docs.filter(F.coalesce("abstract", F.lit("")) != "").orderBy(F.coalesce("citations", F.lit(0)).desc(), "rec_id" if "rec_id" in docs.columns else "id")
    return rows.limit(limit) if limit else rows


def by_text(docs: DataFrame, query: str, limit: int | None = 5) -> DataFrame:
    """Documents whose title and abstract contain the query; in the order of ids, or all of them in no order."""
    body = normalize(F.concat_ws(" ", "title", "abstract"))
    hits = docs.filter(F.contains(body, normalize(F.lit(query))))
    return hits.orderBy(*_last(docs)).limit(limit) if limit else hits


def first_filled(branches: list[DataFrame]) -> DataFrame:
    """The rows of the first branch that has any, decided in the plan: no action on the driver."""
    tagged = [b.withColumn("priority", F.lit(n)) for n, b in enumerate(branches)]
    every = reduce(DataFrame.unionByName, tagged)
    least = every.agg(F.min("priority").alias("least"))
    return every.join(F.broadcast(least), F.col("priority") == F.col("least")).drop("priority", "least")  # one row


class Fetcher:
    """Chooses a source for a topic: title, curated ids, citations, free text. Answers are kept by topic and limit.

    Where the citation source fails, the free-text source answers after ``wait`` seconds.
    """

    def __init__(
        self, docs: DataFrame, title: Callable | None = None, curated: Callable | None = None, cited: Callable | None = None, free: Callable | None = None, wait: float = 5.0,
    ):
        self.docs, self.wait = docs, wait
        self.title = title or (lambda q, n: by_title(docs, q, n))
        self.curated = curated or (lambda ids: by_ids(docs, ids))
        self.cited = cited or (lambda q, n: by_citations(by_text(docs, q, None), n))
        self.free = free or (lambda q, n: by_text(docs, q, n))
        self.kept: dict[str, DataFrame] = {}

    def fetch(self, topic: str | None, limit: int = 10) -> DataFrame:
        asked = (topic or "").strip()
        key = f"{asked.lower()}:{limit}"
        if key not in self.kept:
            self.kept[key] = self._choose(asked, limit)
        return self.kept[key]

    def _choose(self, asked: str, limit: int) -> DataFrame:
        spark = self.docs.sparkSession
        about = resolve_topics(spark.createDataFrame([(asked,)], "query string")).withColumn("is_title", looks_like_title(F.col("query"))).first()
        if about["is_title"] and not (found := self.title(asked, limit)).isEmpty():
            return found
        if about["topic"] and not (found := self.curated(TOPICS[about["topic"]])).isEmpty():
            return found
        try:
            found = self.cited(asked.lower(), limit)
            if not found.isEmpty():
                return found
        except Exception:  # noqa: BLE001 - a failing service is followed by the next
            time.sleep(self.wait)
        return self.free(asked.lower(), limit)


def head_per_feed(entries: DataFrame, feed: str, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` entries of each feed; the window's limit works before the shuffle too."""
    from pyspark.sql import Window

    window = Window.partitionBy(feed).orderBy(*order)
    return entries.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def entry_id(link: Column, title: Column) -> Column:
    """md5 of an entry's link, or of its title where it has none."""
    return F.md5(F.coalesce(link, title))


def feed_entries(pages: DataFrame, feed: str, xml: str, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` entries of each feed as document records; a page that is no XML gives none.

    A feed may have several pages (one XML text a row), read in the ``order`` of their columns.
    """
    item = "struct<channel: struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>>"
    place = F.struct(*(order or [F.lit(0).alias("page")]))
    told = pages.select(F.col(feed).alias("feed"), place.alias("page"), F.posexplode(F.from_xml(F.col(xml), item)["channel"]["item"]).alias("pos", "e"))
    kept = head_per_feed(told, "feed", ["page", "pos"], n)
    return kept.select(
        "feed", "rn", entry_id(F.col("e.link"), F.col("e.title")).alias("id"), F.coalesce("e.title", F.lit("")).alias("title"), F.coalesce("e.description", F.lit("")).alias("abstract"),
        F.array().cast("array<string>").alias("authors"), F.lit("rss").alias("source"), F.coalesce("e.link", F.lit("")).alias("url"),
        F.coalesce("e.pubDate", F.lit("")).alias("published_date"), F.lit(None).cast("bigint").alias("citations"),
    )
