"""Extractors of triples behind one interface, with offline defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgweft.functions.parse import entity_pairs, good_triples, llm_triples, scored_entities, sentences, tagged_triples

#: Characters of a text that a model sees.
WINDOWS = {"llm": 4000, "rebel": 1024}


def _capitalised(sentence: Column) -> Column:
    """Stand-in for an entity model: runs of capitalised words, all of full score."""
    words = F.array_distinct(F.regexp_extract_all(sentence, F.lit(r"(\p{Lu}[\p{L}\p{N}-]+(?: \p{Lu}[\p{L}\p{N}-]+)*)"), 1))
    return F.transform(words, lambda w: F.struct(w.alias("text"), F.lit(1.0).alias("score")))


class Extractor:
    """Triples of ``(source_id, text)``. ``model`` maps the text column to the model's raw answer; rows are never looped over.

    Columns besides ``text`` are carried along, so a triple belongs to its row, not to whatever shares its id.
    """

    def __init__(self, method: str, model: Callable[[Column], Column], least_score: float = 0.5):
        self.method, self.model, self.least_score = method, model, least_score

    def extract(self, texts: DataFrame) -> DataFrame:
        body, own = F.col("text"), [c for c in texts.columns if c != "text"]
        if self.method == "llm":
            rows = texts.select(*own, F.posexplode(llm_triples(self.model(F.substring(body, 1, WINDOWS["llm"])))).alias("pos", "t"))
        elif self.method == "rebel":
            rows = texts.select(*own, F.posexplode(tagged_triples(self.model(F.substring(body, 1, WINDOWS["rebel"])))).alias("pos", "t"))
        else:
            said = texts.select(*own, F.posexplode(sentences(body)).alias("no", "sentence"))
            named = said.withColumn("found", self.model(F.col("sentence")))
            if isinstance(named.schema["found"].dataType.elementType, StructType):
                named = named.withColumn("found", scored_entities(F.col("found"), self.least_score))
            rows = named.select(*own, "no", F.posexplode(entity_pairs(F.col("sentence"), F.col("found"))).alias("at", "t"))
            rows = rows.select(*own, (F.col("no") * 10_000 + F.col("at")).alias("pos"), "t")
        typed = "subject_type" in rows.schema["t"].dataType.fieldNames()
        kind = lambda n: F.col(f"t.{n}") if typed else F.lit("unknown")
        out = rows.select(*own, "pos", "t.subject", "t.predicate", "t.obj", "t.confidence", kind("subject_type").alias("subject_type"), kind("obj_type").alias("obj_type"))
        return good_triples(out)


def get_extractor(method: str = "llm", model: Callable[[Column], Column] | None = None, least_score: float = 0.5) -> Extractor:
    """An extractor by name; an unknown name is an error. Language models are handed in; the default for ``gliner`` is a word rule."""
    defaults = {"llm": lambda text: F.lit("[]"), "rebel": lambda text: F.lit(""), "gliner": _capitalised}
    if method not in defaults:
        raise ValueError(f"unknown extraction method: {method}")
    return Extractor(method, model or defaults[method], least_score)
