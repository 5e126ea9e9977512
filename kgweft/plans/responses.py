"""JSON of the services' answers, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of each answer.
ANSWERS = {
    "stats": ["entities", "relations", "papers", "vector_index_size"],
    "node": ["id", "name", "type", "mention_count"],
    "link": ["source", "target", "predicate", "confidence", "mention_count", "sources"],
    "history": ["title", "type", "text_length"],
}
SNIPPET = 400


def as_json(rows: DataFrame, answer: str) -> DataFrame:
    """One column ``json``: each row as an object with the answer's fields in order, nulls included; fields that the rows lack are left out."""
    fields = [c for c in ANSWERS[answer] if c in rows.columns]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def snippet(text: Column) -> Column:
    return F.concat(F.substring(text, 1, SNIPPET), F.lit("..."))
