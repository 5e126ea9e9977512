"""Parsers of extractor output, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweft.functions.text import strip

# The first group with a word in the text between two entities names their relation.
RULES = [
    ("proposes", ["proposes", "introduces", "presents"]),
    ("outperforms", ["outperforms", "beats", "surpasses", "exceeds"]),
    ("uses", ["uses", "utilises", "employs", "applies"]),
    ("trained_on", ["trained on", "fine-tuned on"]),
]
FALLBACK = "related_to"
REQUIRED = ["subject", "predicate", "object"]


def llm_triples(raw: Column) -> Column:
    """``array<struct<subject, predicate, obj, confidence, subject_type, obj_type>>`` of a JSON answer.

    Code fences are removed; items need subject, predicate and object as keys; a missing confidence is 1.0 and a missing
    type ``Unknown``. A malformed text, or one confidence that is no number, loses all triples of the text.
    """
    bare = strip(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?m)^```json\s*|```$", ""))
    items = F.from_json(bare, "array<map<string,string>>")
    kept = F.filter(items, lambda m: F.map_contains_key(m, "subject") & F.map_contains_key(m, "predicate") & F.map_contains_key(m, "object"))
    number = lambda m: F.when(F.map_contains_key(m, "confidence"), m["confidence"].try_cast("double")).otherwise(F.lit(1.0))
    bad = F.exists(kept, lambda m: number(m).isNull())
    triples = F.transform(
        kept,
        lambda m: F.struct(
            m["subject"].alias("subject"), m["predicate"].alias("predicate"), m["object"].alias("obj"), number(m).alias("confidence"),
            F.coalesce(m["subject_type"], F.lit("Unknown")).alias("subject_type"), F.coalesce(m["object_type"], F.lit("Unknown")).alias("obj_type"),
        ),
    )
    none = F.from_json(F.lit("[]"), "array<struct<subject:string,predicate:string,obj:string,confidence:double,subject_type:string,obj_type:string>>")
    return F.coalesce(F.when(~bad, triples), none)


def tagged_triples(raw: Column, confidence: float = 0.85) -> Column:
    """Triples of ``<triplet> <subj> a <rel> r <obj> b`` text, by one fold over its tags.

    ``<triplet>`` closes the record before it, the end closes the last; records that lack a field are dropped and text
    after ``<triplet>`` is not used.
    """
    empty = F.struct(F.lit("").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("obj"))
    zero = F.struct(F.array().cast("array<struct<subject:string,predicate:string,obj:string>>").alias("done"), empty.alias("now"))
    full = lambda r: (r["subject"] != "") & (r["predicate"] != "") & (r["obj"] != "")
    flushed = lambda s: F.when(full(s["now"]), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])

    def step(s: Column, part: Column) -> Column:
        now = s["now"]
        put = lambda tag, old: F.when(F.startswith(part, F.lit(tag)), strip(F.substring(part, len(tag) + 1, 1 << 30))).otherwise(old)
        held = F.struct(put("subj>", now["subject"]).alias("subject"), put("rel>", now["predicate"]).alias("predicate"), put("obj>", now["obj"]).alias("obj"))
        return F.when(F.startswith(part, F.lit("triplet>")), F.struct(flushed(s).alias("done"), empty.alias("now"))).otherwise(F.struct(s["done"].alias("done"), held.alias("now")))

    done = F.aggregate(F.split(F.coalesce(raw, F.lit("")), "<"), zero, step, flushed)
    return F.transform(done, lambda r: F.struct(r["subject"].alias("subject"), r["predicate"].alias("predicate"), r["obj"].alias("obj"), F.lit(confidence).alias("confidence")))


def sentences(text: Column, least: int = 20, most: int = 30) -> Column:
    """The first ``most`` sentences longer than ``least`` characters; a full stop ends a sentence."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), strip), lambda s: F.length(s) > least), 1, most)


def scored_entities(found: Column, least: float = 0.5) -> Column:
    """Texts of the recognised entities (``array<struct<text, score>>``) whose score is at least ``least``, in their order; a null score is too low."""
    return F.transform(F.filter(found, lambda e: F.coalesce(e["score"] >= least, F.lit(False))), lambda e: e["text"])


def between(sentence: Column, s: Column, o: Column) -> Column:
    """The text after the first ``s`` and before the first ``o``; empty where ``o`` comes first."""
    start = F.instr(sentence, s) + F.length(s)
    return F.substring(sentence, start, F.greatest(F.lit(0), F.instr(sentence, o) - start))


def rule_predicate(text: Column) -> Column:
    lower, found = F.lower(text), None
    for name, keys in RULES:
        hit = F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(lower, k))
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return found.otherwise(F.lit(FALLBACK))


def entity_pairs(sentence: Column, entities: Column, confidence: float = 0.7) -> Column:
    """Triples of each entity of a sentence with the next one, related by the words between them."""
    n = F.size(entities)
    zipped = F.arrays_zip(F.slice(entities, 1, F.greatest(n - 1, F.lit(0))).alias("s"), F.slice(entities, 2, F.greatest(n - 1, F.lit(0))).alias("o"))
    return F.transform(
        F.when(n >= 2, zipped).otherwise(F.slice(zipped, 1, 0)),
        lambda p: F.struct(p["s"].alias("subject"), rule_predicate(between(sentence, p["s"], p["o"])).alias("predicate"), p["o"].alias("obj"), F.lit(confidence).alias("confidence")),
    )


def good_triples(mentions: DataFrame) -> DataFrame:
    """Mentions whose two ends are both good entity names."""
    from kgweft.functions.text import good_entity

    return mentions.filter(good_entity(F.col("subject")) & good_entity(F.col("obj")))
