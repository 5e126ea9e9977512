"""Queries of the engine's own operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweft.config import Config
from kgweft.functions import parse, text, vector
from kgweft.operators import search, traverse, upsert, views
from kgweft.plans import ingestion, responses, retrieval
from kgweft.plans.embed import TokenModel, embedder
from kgweft.plans.extract import get_extractor
from kgweft.schemas import ENTITY, RELATION
from kgweft.session import checkpoint_dir, ship, table
from kgweft.sources import catalog, fetch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SEED = "graph traversal"
#: Mentions before this moment are taken for stored, those from it on for the new batch.
SPLIT = "2023-02-01 00:00:00"
BANNED_SQL = ", ".join(f"'{b}'" for b in text.BANNED)
RULES_SQL = " ".join("WHEN " + " OR ".join(f"contains(lower(mid), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in parse.RULES)
_WS = r"^\s+|\s+$"
#: White space with all of Unicode's.
_WIDE = r"^[\s\p{Z}\x0B\x{85}]+|[\s\p{Z}\x0B\x{85}]+$"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mentions")


_EDGES = "e AS (SELECT subject, predicate, obj, avg(coalesce(confidence, 1.0)) AS confidence, count(*) AS mention_count FROM mentions WHERE subject IS NOT NULL AND obj IS NOT NULL GROUP BY ALL)"


# -- upserts -------------------------------------------------------------------------------------------------------------


@query(f"WITH {_EDGES} SELECT subject, predicate, obj, round(confidence, 6) AS confidence, mention_count FROM e")
def kg_relation_rollup(spark, d):
    """K2, A3, A4."""
    return upsert.relation_totals(_mentions(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(
    "WITH f AS (SELECT subject, predicate, obj, source_id, min(seq) AS seq FROM mentions WHERE subject IS NOT NULL AND obj IS NOT NULL AND coalesce(source_id, '') <> '' GROUP BY ALL), "
    "l AS (SELECT subject, predicate, obj, string_agg(source_id, '|' ORDER BY seq, source_id) AS sources FROM f GROUP BY ALL), "
    "t AS (SELECT subject, predicate, obj, epoch_ms(min(extracted_at)) AS first_seen, epoch_ms(max(extracted_at)) AS last_seen FROM mentions WHERE subject IS NOT NULL AND obj IS NOT NULL GROUP BY ALL) "
    "SELECT t.subject, t.predicate, t.obj, coalesce(sources, '') AS sources, first_seen, last_seen FROM t LEFT JOIN l ON t.subject = l.subject AND t.obj = l.obj AND t.predicate IS NOT DISTINCT FROM l.predicate"
)
def kg_relation_sources(spark, d):
    """A5, A6, U3."""
    r = upsert.relation_rollup(_mentions(spark, d))
    return r.select("subject", "predicate", "obj", F.array_join("sources", "|").alias("sources"), "first_seen", "last_seen")


@query(
    f"WITH {_EDGES}, m AS (SELECT *, coalesce(extracted_at >= TIMESTAMP '{SPLIT}', true) AS late FROM mentions WHERE subject IS NOT NULL AND obj IS NOT NULL), "
    "p AS (SELECT subject, predicate, obj, source_id, late, min(seq) AS seq FROM m WHERE coalesce(source_id, '') <> '' GROUP BY ALL), "
    "f AS (SELECT subject, predicate, obj, source_id, arg_min(seq, late) AS seq, min(late) AS late FROM p GROUP BY ALL), "
    "l AS (SELECT subject, predicate, obj, string_agg(source_id, '|' ORDER BY late, seq, source_id) AS sources FROM f GROUP BY ALL), "
    "t AS (SELECT subject, predicate, obj, epoch_ms(min(extracted_at)) AS first_seen, epoch_ms(max(extracted_at)) AS last_seen FROM m GROUP BY ALL) "
    "SELECT e.subject, e.predicate, e.obj, round(confidence, 6) AS confidence, mention_count, coalesce(sources, '') AS sources, first_seen, last_seen FROM e "
    "JOIN t ON t.subject = e.subject AND t.obj = e.obj AND t.predicate IS NOT DISTINCT FROM e.predicate "
    "LEFT JOIN l ON l.subject = e.subject AND l.obj = e.obj AND l.predicate IS NOT DISTINCT FROM e.predicate"
)
def kg_relation_upsert_merge(spark, d):
    """What was stored merged with a batch; of one source in both the stored place counts."""
    m = _mentions(spark, d)
    new = F.coalesce(F.col("extracted_at") >= F.lit(SPLIT).cast("timestamp_ntz"), F.lit(True))
    merged = upsert.merge_relations(upsert.relation_rollup(m.filter(~new)), upsert.relation_rollup(m.filter(new)))
    return merged.select("subject", "predicate", "obj", F.round("confidence", 6).alias("confidence"), "mention_count", F.array_join("sources", "|").alias("sources"), "first_seen", "last_seen")


_ENTITY_SQL = (
    "SELECT name, type, count(*) AS mention_count FROM (SELECT subject AS name, subject_type AS type FROM mentions UNION ALL SELECT obj, obj_type FROM mentions) WHERE name IS NOT NULL GROUP BY ALL"
)


@query(_ENTITY_SQL)
def kg_entity_rollup(spark, d):
    """K1, A4."""
    return upsert.entity_rollup(_mentions(spark, d))


@query(
    f"WITH b AS ({_ENTITY_SQL}) SELECT coalesce(b.name, e.name) AS name, coalesce(b.type, e.type) AS type, coalesce(e.mention_count, 0) + coalesce(b.mention_count, 0) AS mention_count "
    "FROM b FULL JOIN entities e ON b.name IS NOT DISTINCT FROM e.name AND b.type IS NOT DISTINCT FROM e.type"
)
def kg_entity_upsert_merge(spark, d):
    """The mentions as a batch over the stored entities."""
    return upsert.merge_entities(table(spark, d, "entities"), upsert.entity_rollup(_mentions(spark, d)))


@query(
    "SELECT title AS name, count(*) AS mention_count, arg_max_null(url, rec_id) AS url, arg_max_null(source, rec_id) AS source, "
    "arg_max_null(citations, rec_id) AS citations, arg_max(abstract, rec_id) FILTER (WHERE abstract <> '') AS text FROM papers WHERE title IS NOT NULL GROUP BY title"
)
def kg_entity_props_lww(spark, d):
    """Each property as last written; citations are always written, and so a later null removes them; texts only where there is one."""
    p = table(spark, d, "papers").filter("title IS NOT NULL").withColumn("text", F.col("abstract"))
    last = upsert.last_writer(p, ["title"], ["rec_id"], ["url", "source", "citations", "text"], {"text": F.col("text") != ""})
    return last.withColumnRenamed("title", "name")


@query(
    "SELECT DISTINCT name, 'unknown' AS type FROM (SELECT subject AS name FROM mentions UNION ALL SELECT obj FROM mentions) m "
    "WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entities e WHERE e.name = m.name)"
)
def kg_endpoint_autocreate(spark, d):
    """K3, J10."""
    return upsert.missing_endpoints(_mentions(spark, d), table(spark, d, "entities"))


@query(
    "WITH n AS (SELECT name, type, min(seq) AS created FROM (SELECT subject AS name, subject_type AS type, seq FROM mentions UNION ALL SELECT obj, obj_type, seq FROM mentions) WHERE name IS NOT NULL GROUP BY ALL) "
    "SELECT s.type AS src_type, o.type AS dst_type, count(*) AS edges, count(DISTINCT m.seq) AS mentions FROM mentions m JOIN n s ON s.name = m.subject AND s.created <= m.seq JOIN n o ON o.name = m.obj AND o.created <= m.seq GROUP BY ALL"
)
def kg_homonym_fanout(spark, d):
    """A mention binds every node of its names that existed then."""
    m = _mentions(spark, d)
    sides = [m.select(F.col(s).alias("name"), F.col(f"{s}_type").alias("type"), "seq") for s in ("subject", "obj")]
    nodes = sides[0].unionByName(sides[1]).filter("name IS NOT NULL").groupBy("name", "type").agg(F.min("seq").alias("created"))
    bound = upsert.bound_endpoints(m.select("seq", "subject", "obj", F.col("seq").alias("seen")), nodes)
    return bound.groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("seq").alias("mentions"))


@query(
    "WITH p AS (SELECT title AS name, max_by(coalesce(title, '') || '. ' || coalesce(abstract, ''), rec_id) AS new FROM papers WHERE title IS NOT NULL GROUP BY 1) "
    "SELECT e.entity_id, md5(coalesce(p.new, e.text)) AS text_md5, p.new IS NOT NULL AS indexed FROM entities e LEFT JOIN p ON p.name = e.name"
)
def kg_index_document(spark, d):
    """K4: texts of the nodes whose name is a paper's title."""
    e, p = table(spark, d, "entities"), table(spark, d, "papers")
    done = upsert.index_documents(e, p.select("title", "abstract", F.col("rec_id").alias("ord")))
    known = p.filter("title IS NOT NULL").select(F.col("title").alias("name"), F.lit(True).alias("hit")).distinct()
    return done.join(known, "name", "left").select("entity_id", F.md5("text").alias("text_md5"), F.coalesce("hit", F.lit(False)).alias("indexed"))


@query("SELECT entity_id, CASE WHEN text IS NOT NULL AND text <> '' AND type = 'Paper' THEN substr(text, 1, 100) ELSE summary END AS summary FROM entities")
def kg_summary_writeback(spark, d):
    """K5."""
    e = table(spark, d, "entities")
    made = e.filter("type = 'Paper' AND text <> ''").select("name", F.substring("text", 1, 100).alias("summary"))
    return upsert.write_summaries(e, made).select("entity_id", "summary")


# -- traversal -----------------------------------------------------------------------------------------------------------

# Paths of one and two steps enumerated, quite unlike the engine's way.
_PATHS = (
    "ids AS (SELECT row_number() OVER () AS id, * FROM g), u AS (SELECT id, subject AS a, obj AS b FROM ids UNION SELECT id, obj, subject FROM ids), "
    "s AS (SELECT DISTINCT a AS n FROM u WHERE {seed}), one AS (SELECT s.n, u.id, u.b FROM s JOIN u ON u.a = s.n), "
    "hit AS (SELECT id FROM one WHERE b <> n UNION SELECT unnest([one.id, u.id]) FROM one JOIN u ON u.a = one.b AND u.id <> one.id WHERE u.b <> one.n), "
    "r AS (SELECT DISTINCT subject, {verb} AS predicate, obj, round(coalesce(confidence, 1.0), 6) AS confidence, coalesce(mention_count, 1) AS mention_count FROM ids WHERE id IN (SELECT id FROM hit)), "
    "q AS (SELECT *, round(confidence * ln(mention_count + 1), 6) AS retrieval_score FROM r) "
)
_HIT = f"contains(lower(a), '{SEED}')"
_TWO_HOP = f"WITH {_EDGES}, g AS (SELECT * FROM e), " + _PATHS


@query(_TWO_HOP.format(seed=_HIT, verb="'RELATION'") + "SELECT * FROM q")
def kg_two_hop(spark, d):
    """All of the neighbourhood."""
    return traverse.ranked(traverse.two_hop(upsert.relation_totals(_mentions(spark, d)), [SEED]), cut_off=False)


@query(_TWO_HOP.format(seed=_HIT, verb="'RELATION'") + "SELECT * FROM q ORDER BY retrieval_score DESC, subject, obj, predicate, confidence, mention_count LIMIT 40")
def kg_two_hop_topk(spark, d):
    """O4."""
    return traverse.ranked(traverse.two_hop(upsert.relation_totals(_mentions(spark, d)), [SEED]))


@query(_TWO_HOP.format(seed=_HIT, verb="predicate") + "SELECT * FROM q")
def kg_two_hop_verb(spark, d):
    """J2 with the stored verbs."""
    return traverse.ranked(traverse.two_hop(upsert.relation_totals(_mentions(spark, d)), [SEED]), Config(predicate_mode="verb"), cut_off=False)


_SMALL = (
    "('solo','r','solo',0.5,2), ('hub','r','hub',0.5,2), ('hub','r','x',0.9,1), ('hub','s','x',0.9,1), ('x','r','y',0.8,3), ('y','r','z',0.7,4), ('z','r','far',0.6,5), "
    "('hub2','r','hub',0.4,1), ('y','r','y',0.3,1), ('a','r','b',CAST(NULL AS DOUBLE),CAST(NULL AS BIGINT)), ('hub','r','a',0.0,1)"
)


@query(f"WITH g AS (SELECT subject, predicate, obj, CAST(confidence AS DOUBLE) AS confidence, CAST(mention_count AS BIGINT) AS mention_count FROM (VALUES {_SMALL}) AS v(subject, predicate, obj, confidence, mention_count)), " + _PATHS.format(seed="contains(a, 'hub') OR contains(a, 'solo')", verb="'RELATION'") + "SELECT * FROM q")
def kg_two_hop_edge_cases(spark, d):
    """Loops, parallel edges, a third hop, two seeds side by side, nulls."""
    g = spark.sql(f"SELECT subject, predicate, obj, CAST(confidence AS DOUBLE) AS confidence, CAST(mention_count AS BIGINT) AS mention_count FROM VALUES {_SMALL} AS v(subject, predicate, obj, confidence, mention_count)")
    return traverse.ranked(traverse.two_hop(g, ["HUB", "solo"]), cut_off=False)


@query(f"SELECT DISTINCT name FROM (SELECT subject AS name FROM mentions UNION ALL SELECT obj FROM mentions) WHERE contains(lower(name), '{SEED}') OR contains(lower(name), 'institute')")
def kg_seed_match(spark, d):
    """P2, J1, U1."""
    return traverse.nodes(_mentions(spark, d)).filter(traverse.matches_seed(F.col("name"), [SEED, "Institute"]))


@query(
    "WITH n AS (SELECT subject AS name FROM mentions UNION SELECT obj FROM mentions) SELECT name, '[' || name || ' Abstract]: ' || text AS abstract FROM entities WHERE text IS NOT NULL AND name IN (SELECT name FROM n WHERE name IS NOT NULL)"
)
def kg_abstracts(spark, d):
    """P4, J9, F13."""
    return traverse.abstracts(table(spark, d, "entities"), _mentions(spark, d))


# -- views ---------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_EDGES} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM e) AS relations, "
    "(SELECT count(*) FROM entities WHERE type IN ('Paper', 'Document')) AS papers, (SELECT count(embedding) FROM entities) AS vector_index_size"
)
def kg_stats(spark, d):
    """C14, A1, P5, P6."""
    return views.stats(table(spark, d, "entities"), upsert.relation_totals(_mentions(spark, d)))


_LINKS = (
    f"WITH {_EDGES}, l AS (SELECT subject AS source, obj AS target, predicate, round(coalesce(nullif(confidence, 0.0), 1.0), 6) AS confidence, mention_count FROM e ORDER BY subject, predicate, obj LIMIT 120) "
)


@query(_LINKS + "SELECT * FROM l")
def kg_graph_links(spark, d):
    """C12, J5, O8, F20, F21."""
    return views.export_links(upsert.relation_totals(_mentions(spark, d))).withColumn("confidence", F.round("confidence", 6))


@query(
    _LINKS + "SELECT n.name AS id, n.name, e.type, coalesce(e.n, 0) AS mention_count FROM (SELECT source AS name FROM l UNION SELECT target FROM l) n "
    "LEFT JOIN (SELECT name, min(type) AS type, max(mention_count) AS n FROM entities GROUP BY name) e ON e.name = n.name"
)
def kg_graph_nodes(spark, d):
    """C12, A10."""
    return views.export_nodes(views.export_links(upsert.relation_totals(_mentions(spark, d))), table(spark, d, "entities"))


@query(
    f"WITH {_EDGES} SELECT s.name AS source, s.type AS source_type, e.predicate, o.name AS target, o.type AS target_type, e.mention_count FROM e JOIN entities s ON s.name = e.subject JOIN entities o ON o.name = e.obj"
)
def kg_graph_join(spark, d):
    """Every relation with the nodes at both its ends."""
    joined = views.joined(upsert.relation_totals(_mentions(spark, d)), table(spark, d, "entities"))
    return joined.select("source", "source_type", "predicate", "target", "target_type", "mention_count")


@query("SELECT DISTINCT name AS title, type, length(text) AS text_length FROM entities WHERE type IN ('Paper', 'Document') AND text IS NOT NULL ORDER BY title DESC, type, text_length LIMIT 20")
def kg_history(spark, d):
    """C13, P21, A9, O7."""
    return views.history(table(spark, d, "entities"))


@query(
    f"WITH {_EDGES}, x AS (SELECT n.name, n.text, n.summary, e.obj FROM entities n LEFT JOIN e ON e.subject = n.name WHERE n.type IN ('Paper', 'Document') AND coalesce(n.text, '') <> '') "
    "SELECT name, md5(text) AS text_md5, summary, string_agg(CASE WHEN obj IS NULL THEN '-' ELSE 'RELATION ' || obj END, '|' ORDER BY obj) AS relations FROM x GROUP BY name, text, summary"
)
def kg_summary_context(spark, d):
    """J4, A2."""
    c = views.summary_context(table(spark, d, "entities"), upsert.relation_totals(_mentions(spark, d)))
    said = F.transform("relations", lambda r: F.when(r["obj"].isNull(), "-").otherwise(F.concat(r["pred"], F.lit(" "), r["obj"])))
    return c.select("name", F.md5("text").alias("text_md5"), "summary", F.array_join(said, "|").alias("relations"))


# -- vectors and search --------------------------------------------------------------------------------------------------

_UNIT = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL)"


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


@query(f"WITH {_UNIT}, q AS (SELECT * FROM v ORDER BY vec_id LIMIT 1) SELECT v.vec_id, round(list_dot_product(v.x, q.x) / (v.n * q.n), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 5")
def vec_topk(spark, d):
    """V1, S12, O6, F29."""
    return search.vector_topk(table(spark, d, "embeddings"), _first_vector(spark, d), 5, key="vec_id", vector="embedding")


_NEAR = (
    f"WITH {_UNIT}, s AS (SELECT q.vec_id AS query, q.label AS q_label, v.vec_id, v.label, round(list_dot_product(v.x, q.x) / (v.n * q.n), 6) AS score FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) "
)


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    ship(spark)
    v = table(spark, d, "embeddings")
    return search.vector_topk_batch(v, v.filter("vec_id % 20 = 0"), k, key="vec_id", vector="embedding")


@query(_NEAR + "SELECT query, vec_id, score, rank FROM r WHERE rank <= 5")
def vec_topk_batch(spark, d):
    """Every vector whose id is divisible by 20 against all."""
    return _nearest(spark, d, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"WITH {_UNIT}, q AS (SELECT * FROM v ORDER BY vec_id LIMIT 1), t AS (SELECT v.vec_id, round(list_dot_product(v.x, q.x) / (v.n * q.n), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 30) "
    "SELECT t.vec_id, t.score, d.lang FROM t JOIN documents d ON d.doc_id = t.vec_id WHERE coalesce(d.lang, '') <> ''"
)
def vec_posttext_filter(spark, d):
    """Rows without a text (here: a language) go after the cut, and are not replaced."""
    top = search.vector_topk(table(spark, d, "embeddings"), _first_vector(spark, d), 30, key="vec_id", vector="embedding")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return search.with_text(top.join(docs, "vec_id"), "lang")


@query(_NEAR + "SELECT query AS key, CASE WHEN label = q_label AND score >= 0.3 THEN vec_id ELSE query END AS resolved, (label = q_label AND score >= 0.3) AS merged FROM r WHERE rank = 1")
def entity_resolve_top1(spark, d):
    """Nearest of all first, its type and score after."""
    v = table(spark, d, "embeddings")
    labels = v.select(F.col("vec_id").alias("node"), F.col("label").alias("node_type"))
    near = _nearest(spark, d, 1).select(F.col("query").alias("key"), F.col("vec_id").alias("node"), "score").join(labels, "node")
    return search.resolve(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("key"), F.col("label").alias("type")), near, 0.3)


@query(
    "SELECT entity_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9), 5) AS total, "
    "len(embedding) AS size FROM entities WHERE len(embedding) > 0"
)
def l2_normalize(spark, d):
    """F28."""
    e = table(spark, d, "entities").filter(F.size("embedding") > 0)
    unit = vector.l2_normalize(F.col("embedding"))
    return e.select("entity_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("embedding").cast("bigint").alias("size"))


def _bm25_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{n}" for n, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{n} > 0) AS df{n}" for n in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(words)))
    return (
        "WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), "
        f"c AS (SELECT doc_id, len(t) AS len, {tf} FROM t), s AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM c) "
        f"SELECT doc_id, round({score}, 6) AS score FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(words)))} ORDER BY score DESC, doc_id LIMIT 10"
    )


@query(_bm25_sql(["border", "dispute", "treaty"]))
def fulltext_bm25(spark, d):
    """F-T1, O5: one pass over the texts."""
    return search.bm25(table(spark, d, "documents"), "Treaty, border dispute", key="doc_id", text="text")


@query(_bm25_sql(["coin", "guild", "treaty"]))
def fulltext_index(spark, d):
    """The stored inverted table, built and asked."""
    index = search.FullText(spark, f"{checkpoint_dir(spark)}/fulltext-{uuid.uuid4().hex}")
    return index.build(table(spark, d, "documents"), key="doc_id", text="text").search("guild treaty coin", key="doc_id")


# -- text ----------------------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"
_BAG = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> ''))"


@query(f"SELECT rec_id, {_NORM.format('title')} AS normal, regexp_replace(title, '{_WS}', '', 'g') AS stripped FROM papers")
def text_normalize(spark, d):
    """F1, F2, F3."""
    return table(spark, d, "papers").select("rec_id", text.normalize(F.col("title")).alias("normal"), text.strip(F.col("title")).alias("stripped"))


_ASKED = "On the border dispute: a study of treaty and guild"
_JAC = (
    f"WITH w AS (SELECT rec_id, {_BAG.format('title')} AS a, {_BAG.format(chr(39) + _ASKED + chr(39))} AS b, contains({_NORM.format('title')}, {_NORM.format(chr(39) + _ASKED + chr(39))}) AS has FROM papers), "
    "j AS (SELECT rec_id, has, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS similarity FROM w) "
)


@query(_JAC + "SELECT rec_id, round(similarity, 6) AS similarity FROM j")
def title_jaccard(spark, d):
    """F4, U2."""
    return table(spark, d, "papers").select("rec_id", F.round(text.jaccard(F.lit(_ASKED), F.col("title")), 6).alias("similarity"))


@query(_JAC + "SELECT rec_id FROM j WHERE similarity >= 0.35 OR has")
def title_filter(spark, d):
    """P9."""
    return table(spark, d, "papers").filter(text.title_matches(F.lit(_ASKED), F.col("title"))).select("rec_id")


@query(
    f"WITH t AS (SELECT rec_id, regexp_replace(coalesce(title, ''), '{_WS}', '', 'g') AS t FROM papers) SELECT rec_id, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= 2 "
    "AND (regexp_matches(t, '[\"():\\-]') OR regexp_matches(t, '[A-Z]') OR regexp_matches(lower(t), '" + "|".join(text.TITLE_NOUNS) + "')) AS is_title FROM t"
)
def title_heuristic(spark, d):
    """P16, F6."""
    return table(spark, d, "papers").select("rec_id", text.looks_like_title(F.col("title")).alias("is_title"))


@query(
    f"SELECT seq, length(t) >= 3 AND regexp_matches(t, '[a-zA-Z]') AND NOT list_bool_or(list_transform([{BANNED_SQL}], lambda b: contains(lower(t), b))) AS good "
    f"FROM (SELECT seq, regexp_replace(coalesce(subject, ''), '{_WS}', '', 'g') AS t FROM mentions)"
)
def entity_quality(spark, d):
    """P11."""
    return _mentions(spark, d).select("seq", text.good_entity(F.col("subject")).alias("good"))


_GOOD = "length(regexp_replace(coalesce({0}, ''), '" + _WS + "', '', 'g')) >= 3 AND regexp_matches({0}, '[a-zA-Z]') AND NOT list_bool_or(list_transform([" + BANNED_SQL + "], lambda b: contains(lower({0}), b)))"


@query(f"SELECT predicate, count(*) AS mentions FROM mentions WHERE {_GOOD.format('subject')} AND {_GOOD.format('obj')} GROUP BY predicate")
def entity_quality_filter(spark, d):
    """P12."""
    return parse.good_triples(_mentions(spark, d)).groupBy("predicate").agg(F.count(F.lit(1)).alias("mentions"))


@query(
    "SELECT request_no, md5(substr(text, 1, 4000)) AS llm, md5(substr(text, 1, 1024)) AS rebel, md5(substr(text, 1, 2000)) AS stored, substr(text, 1, 200) AS shown, length(text) AS size FROM ingest_texts"
)
def truncate_prefixes(spark, d):
    """F10, F12, P18, S8."""
    t = F.col("text")
    cut = lambda n: text.prefix(t, n)
    return table(spark, d, "ingest_texts").select("request_no", F.md5(cut(4000)).alias("llm"), F.md5(cut(1024)).alias("rebel"), F.md5(cut(2000)).alias("stored"), cut(200).alias("shown"), F.length(t).cast("bigint").alias("size"))


# -- parsers -------------------------------------------------------------------------------------------------------------


def _payload() -> F.Column:
    item = F.struct(
        F.col("subject"), F.col("subject_type"), F.col("predicate"), F.col("obj").alias("object"), F.col("obj_type").alias("object_type"),
        F.when(F.col("seq") % 11 == 0, "high").otherwise(F.col("confidence").cast("string")).alias("confidence"),
    )
    return F.concat(F.lit("```json\n["), F.to_json(item), F.when(F.col("seq") % 7 == 0, F.lit("")).otherwise(F.lit("]")), F.lit("\n```"))


@query(
    "SELECT seq, subject, predicate, obj, round(coalesce(confidence, 1.0), 6) AS confidence, coalesce(subject_type, 'Unknown') AS subject_type, coalesce(obj_type, 'Unknown') AS obj_type "
    "FROM mentions WHERE seq % 7 <> 0 AND seq % 11 <> 0 AND subject IS NOT NULL AND predicate IS NOT NULL AND obj IS NOT NULL"
)
def parse_llm_json(spark, d):
    """Answers built of all mentions; some broken off, some with a confidence that is no number."""
    told = _mentions(spark, d).select("seq", F.explode(parse.llm_triples(_payload())).alias("t"))
    return told.select("seq", "t.subject", "t.predicate", "t.obj", F.round("t.confidence", 6).alias("confidence"), "t.subject_type", "t.obj_type")


@query(
    "WITH n AS (SELECT seq, " + ", ".join(f"regexp_replace(split_part({c}, '<', 1), '{_WS}', '', 'g') AS {c}" for c in ("subject", "predicate", "obj"))
    + " FROM mentions WHERE subject IS NOT NULL AND predicate IS NOT NULL AND obj IS NOT NULL) SELECT seq, subject, predicate, obj, 0.85::DOUBLE AS confidence FROM n WHERE subject <> '' AND predicate <> '' AND obj <> '' "
    "UNION ALL SELECT seq, 'second', 'follows', 'first', 0.85 FROM n"
)
def parse_tagged(spark, d):
    """A record of each mention, one that lacks its object, and a last one; a field ends at the next ``<``, whatever it opens."""
    raw = F.concat(
        F.lit("<s><triplet> head <subj> "), "subject", F.lit(" <rel> "), "predicate", F.lit(" <obj> "), "obj", F.lit(" <triplet> x <subj> lost <rel> r <triplet> <subj> second <rel> follows <obj> first</s>")
    )
    told = _mentions(spark, d).select("seq", F.explode(parse.tagged_triples(raw)).alias("t"))
    return told.select("seq", "t.subject", "t.predicate", "t.obj", "t.confidence")


@query(
    "WITH m AS (SELECT seq, subject AS s, obj AS o, subject || ' ' || predicate || ' and beats ' || obj AS said FROM mentions), p AS (SELECT *, strpos(said, s) + length(s) AS beg FROM m), "
    "b AS (SELECT *, substr(said, beg, greatest(0, strpos(said, o) - beg)) AS mid FROM p) "
    f"SELECT seq, s AS subject, CASE {RULES_SQL} ELSE 'related_to' END AS predicate, o AS obj FROM b"
)
def rule_predicate_pairs(spark, d):
    """sentences built of all mentions, with names that overlap, repeat or stand in each other."""
    said = F.concat("subject", F.lit(" "), "predicate", F.lit(" and beats "), "obj")
    told = _mentions(spark, d).select("seq", F.explode(parse.entity_pairs(said, F.array("subject", "obj"))).alias("t"))
    return told.select("seq", "t.subject", "t.predicate", "t.obj")


@query(
    "SELECT seq, array_to_string(list_filter([CASE WHEN confidence >= 0.5 THEN subject END, CASE WHEN confidence * 0.8 >= 0.5 THEN obj END], lambda x: x IS NOT NULL), '|') AS names FROM mentions WHERE subject IS NOT NULL AND obj IS NOT NULL"
)
def entity_score_filter(spark, d):
    """Recognised entities with a score of at least 0.5; none has no score."""
    m = _mentions(spark, d).filter("subject IS NOT NULL AND obj IS NOT NULL")
    found = F.array(F.struct(F.col("subject").alias("text"), F.col("confidence").alias("score")), F.struct(F.col("obj").alias("text"), (F.col("confidence") * 0.8).alias("score")))
    return m.select("seq", F.array_join(parse.scored_entities(found), "|").alias("names"))


@query(
    "WITH s AS (SELECT doc_id, unnest(list_slice(list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: regexp_replace(x, '" + _WIDE + "', '', 'g')), lambda x: length(x) > 20), 1, 30)) AS x FROM documents) "
    "SELECT doc_id, count(*) AS sentences, sum(length(x))::BIGINT AS characters FROM s GROUP BY doc_id"
)
def sentence_split(spark, d):
    """P14, O9, F9."""
    s = table(spark, d, "documents").select("doc_id", F.explode(parse.sentences(F.col("text"))).alias("x"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("x")).cast("bigint").alias("characters"))


# -- sources -------------------------------------------------------------------------------------------------------------

_QUESTIONS = ["graph rag", "storage", "Transformers", "large language models", "", "cnn for images", "quantum", " fine tuning ", "Retrieval-Augmented Generation", "agents", "rn"]


@query(
    "WITH q(query) AS (VALUES " + ", ".join(f"('{q}')" for q in _QUESTIONS) + "), t(topic, ord) AS (VALUES " + ", ".join(f"('{t}', {n})" for n, t in enumerate(catalog.TOPICS)) + "), "
    "a(alias, topic) AS (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in catalog.ALIASES.items()) + "), n AS (SELECT query, lower(trim(query)) AS c FROM q) "
    "SELECT query, (SELECT arg_min(t.topic, t.ord) FROM t WHERE contains(n.c, t.topic) OR contains(t.topic, n.c) OR EXISTS (SELECT 1 FROM a WHERE a.alias = n.c AND a.topic = t.topic)) AS topic FROM n"
)
def topic_resolve(spark, d):
    """P17, J11, J12, S7."""
    return catalog.resolve_topics(spark.createDataFrame([(q,) for q in _QUESTIONS], "query string"))


@query("SELECT topic, ord, paper_id, pos FROM (VALUES " + ", ".join(f"('{t}', {n}, '{p}', {m})" for n, (t, ids) in enumerate(catalog.TOPICS.items()) for m, p in enumerate(ids)) + ") v(topic, ord, paper_id, pos)")
def topic_catalog(spark, d):
    """S7, DM11."""
    return catalog.topics(spark)


@query("SELECT rec_id, title, citations FROM papers WHERE coalesce(abstract, '') <> '' ORDER BY coalesce(citations, 0) DESC, rec_id LIMIT 25")
def paper_topk_citations(spark, d):
    """S3, O3, P10."""
    return fetch.by_citations(table(spark, d, "papers"), 25).select("rec_id", "title", "citations")


@query(
    _JAC + "SELECT p.rec_id, p.title FROM papers p JOIN j ON j.rec_id = p.rec_id WHERE j.similarity >= 0.35 OR j.has ORDER BY coalesce(p.citations, 0) DESC, coalesce(p.title, ''), p.id, p.rec_id LIMIT 5"
)
def fetch_by_title(spark, d):
    """S2, O1."""
    return fetch.by_title(table(spark, d, "papers"), _ASKED, 5).select("rec_id", "title")


@query("SELECT rec_id, title FROM papers WHERE contains(lower(coalesce(title, '')), 'border dispute') ORDER BY title, id, rec_id LIMIT 10")
def fetch_title_fallback(spark, d):
    """S2, O2."""
    return fetch.by_exact_title(table(spark, d, "papers"), "Border Dispute", 10).select("rec_id", "title")


@query(f"SELECT rec_id FROM papers WHERE contains({_NORM.format("concat_ws(' ', title, abstract)")}, 'border dispute')")
def fetch_by_text(spark, d):
    """Every record whose title and abstract contain the words."""
    return fetch.by_text(table(spark, d, "papers"), "Border -- dispute", None).select("rec_id")


@query("SELECT rec_id, id FROM papers WHERE id IN (SELECT id FROM papers WHERE id <> '' GROUP BY id HAVING count(*) > 1)")
def fetch_by_ids(spark, d):
    """All records of the ids that were fetched more than once."""
    p = table(spark, d, "papers")
    return fetch.by_ids(p, p.filter("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")).select("rec_id", "id")


@query("SELECT entity_id, name, type, mention_count FROM entities WHERE name = (SELECT min(name) FROM entities) AND type = (SELECT min(type) FROM entities WHERE name = (SELECT min(name) FROM entities))")
def kg_point_lookup(spark, d):
    """The node of one name and type."""
    e = table(spark, d, "entities")
    first = e.filter("name IS NOT NULL").orderBy("name", "type").first()
    return views.node(e, first["name"], first["type"]).select("entity_id", "name", "type", "mention_count")


@query(
    f"SELECT rec_id, title FROM papers WHERE contains({_NORM.format("concat_ws(' ', title, abstract)")}, 'border dispute') AND coalesce(abstract, '') <> '' ORDER BY coalesce(citations, 0) DESC, rec_id LIMIT 10"
)
def fetch_topic(spark, d):
    """A topic that is neither a title nor in the catalogue goes by citations; asked again, the answer is the one kept."""
    chain = fetch.Fetcher(table(spark, d, "papers"))
    chain.fetch(" Border dispute ".lower(), 10)
    return chain.fetch("border dispute", 10).select("rec_id", "title")


@query("SELECT rec_id, title FROM papers WHERE source = 'arxiv_curated'")
def fetch_fallback(spark, d):
    """No record of the first source, so those of the second; the third is not used."""
    p = table(spark, d, "papers").select("rec_id", "title", "source")
    return fetch.first_filled([p.filter("source = 'absent'"), p.filter("source = 'arxiv_curated'"), p]).select("rec_id", "title")


@query(
    "SELECT id, title, coalesce(abstract, '') AS abstract, array_to_string(coalesce(authors, []), '|') AS authors, 'https://index.example/paper/' || id AS url, coalesce(citations, 0) AS citations, coalesce(try_cast(published_date AS INTEGER)::VARCHAR, '') AS published_date "
    "FROM papers WHERE id IS NOT NULL AND title IS NOT NULL"
)
def payload_documents(spark, d):
    """Search answers built of all papers and read back."""
    p = table(spark, d, "papers").filter("id IS NOT NULL AND title IS NOT NULL")
    item = F.struct(
        F.col("id").alias("paperId"), "title", "abstract", F.col("published_date").try_cast("int").alias("year"), F.col("citations").alias("citationCount"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
    )
    raw = p.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("raw"))
    docs = fetch.documents_of(raw, "raw", "semantic_scholar", "https://index.example/paper/")
    return docs.select("id", "title", "abstract", F.array_join("authors", "|").alias("authors"), "url", "citations", "published_date")


@query(
    "SELECT feed, md5('http://feed.example/' || doc_id) AS id, doc_id::VARCHAR AS title, rn FROM (SELECT feed, doc_id, row_number() OVER (PARTITION BY feed ORDER BY fetched_at, doc_id) AS rn FROM documents) WHERE rn <= 10"
)
def rss_head_per_feed(spark, d):
    """A page of each document, the pages of a feed in the order in which they came."""
    item = F.concat(F.lit("<rss><channel><item><title>"), "doc_id", F.lit("</title><link>http://feed.example/"), "doc_id", F.lit("</link></item></channel></rss>"))
    pages = table(spark, d, "documents").select("feed", "doc_id", "fetched_at", item.alias("xml"), F.col("fetched_at").isNull().alias("undated"))
    return fetch.feed_entries(pages, "feed", "xml", 10, ["undated", "fetched_at", "doc_id"]).select("feed", "id", "title", F.col("rn").cast("bigint").alias("rn"))


@query("SELECT rec_id, coalesce(strftime(fetched_at, '%Y-%m-%dT%H:%M:%S'), '') AS fetched FROM papers")
def iso_dates(spark, d):
    """F23."""
    return table(spark, d, "papers").select("rec_id", text.iso(F.col("fetched_at")).alias("fetched"))


@query(
    "SELECT '{\"title\":' || to_json(name) || ',\"type\":' || to_json(type) || ',\"text_length\":' || length(text) || '}' AS json FROM entities WHERE type IN ('Paper', 'Document') AND text IS NOT NULL AND entity_id IN (SELECT min(entity_id) FROM entities GROUP BY name, type, length(text))"
)
def json_history(spark, d):
    """Every row of the history as the JSON of the answer."""
    e = table(spark, d, "entities")
    return responses.as_json(views.history(e, None), "history")


@query("SELECT rec_id, md5(coalesce(url, title)) AS entry_id FROM papers")
def doc_md5(spark, d):
    """F17."""
    return table(spark, d, "papers").select("rec_id", fetch.entry_id(F.col("url"), F.col("title")).alias("entry_id"))


# -- retrieval -----------------------------------------------------------------------------------------------------------


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w.replace('_', ' ')}')" for w in words) + ")"


@query(
    f"SELECT doc_id, CASE WHEN {_any(retrieval.RELATIONS)} AND NOT {_any(retrieval.THEMES)} THEN 'cypher' WHEN {_any(retrieval.THEMES)} AND NOT {_any(retrieval.RELATIONS)} THEN 'vector' ELSE 'hybrid' END AS route "
    "FROM (SELECT doc_id, lower(substr(coalesce(text, ''), 1, 500)) AS q FROM documents)"
)
def route_rules(spark, d):
    """C2, X6."""
    return table(spark, d, "documents").select("doc_id", retrieval.rule_route(F.col("text")).alias("route"))


@query(f"SELECT seq, CASE WHEN r IN ('cypher', 'vector', 'hybrid') THEN r ELSE 'hybrid' END AS route FROM (SELECT seq, lower(regexp_replace(CASE seq % 4 WHEN 0 THEN ' Cypher ' WHEN 1 THEN 'VECTOR\t' WHEN 2 THEN 'hybrid' ELSE predicate END, '{_WS}', '', 'g')) AS r FROM mentions)")
def route_whitelist(spark, d):
    """P19."""
    said = F.when(F.col("seq") % 4 == 0, " Cypher ").when(F.col("seq") % 4 == 1, "VECTOR\t").when(F.col("seq") % 4 == 2, "hybrid").otherwise(F.col("predicate"))
    return _mentions(spark, d).select("seq", retrieval.allowed_route(said).alias("route"))


@query(
    _TWO_HOP.format(seed=_HIT, verb="'RELATION'") + ", t AS (SELECT *, confidence * 5 AS f FROM q ORDER BY retrieval_score DESC, subject, obj, predicate, confidence, mention_count LIMIT 40) "
    "SELECT rpad(repeat('★', least(5, CAST(round_even(f, 0) AS INTEGER))), 5, '.') || ' ' || subject || ' | ' || predicate || ' | ' || obj || '  {confidence: ' || printf('%.2f', confidence) || ', mentions: ' || mention_count || '}' AS line FROM t"
)
def context_format(spark, d):
    """C6, F13 to F16."""
    return retrieval.triple_lines(kg_two_hop_topk(spark, d)).select("line")


@query(
    _TWO_HOP.format(seed=_HIT, verb="'RELATION'") + f", t AS (SELECT 'triple' AS part, subject || ' > ' || obj AS name, retrieval_score AS score FROM q ORDER BY retrieval_score DESC, subject, obj, predicate, confidence, mention_count LIMIT 40), "
    f"{_UNIT}, z AS (SELECT * FROM v ORDER BY vec_id LIMIT 1), w AS (SELECT 'excerpt' AS part, v.vec_id::VARCHAR AS name, round(list_dot_product(v.x, z.x) / (v.n * z.n), 6) AS score FROM v, z ORDER BY score DESC, v.vec_id::VARCHAR LIMIT 5) "
    "SELECT * FROM t UNION ALL SELECT w.* FROM w JOIN documents d ON d.doc_id::VARCHAR = w.name WHERE coalesce(d.text, '') <> '' "
    "UNION ALL SELECT 'count', c, n FROM (SELECT 'triples' AS c, count(*)::DOUBLE AS n FROM t UNION ALL SELECT 'route ' || 'hybrid', 1)"
)
def retrieve_hybrid(spark, d):
    """The retrieval plan over nodes made of the vectors' documents: route, seeds, neighbourhood, excerpts, and the counts of the answer."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    nodes = table(spark, d, "embeddings").join(docs, "vec_id", "left").select(F.col("vec_id").cast("string").alias("name"), F.lit("Document").alias("type"), "text", "embedding")
    plan = retrieval.Retriever(nodes, upsert.relation_totals(_mentions(spark, d)), seeds=lambda q: [SEED], embed=lambda q: _first_vector(spark, d))
    told = plan.retrieve("What lies near this?")
    triples = told.triples.select(F.lit("triple").alias("part"), F.concat("subject", F.lit(" > "), "obj").alias("name"), F.col("retrieval_score").alias("score"))
    excerpts = told.excerpts.select(F.lit("excerpt").alias("part"), F.col("doc_id").alias("name"), "score")
    counts = spark.createDataFrame([("count", "triples", float(retrieval.answer(told)["graph_triple_count"])), ("count", f"route {told.route}", 1.0)], "part string, name string, score double")
    return triples.unionByName(excerpts).unionByName(counts)


@query(
    f"WITH {_UNIT}, z AS (SELECT * FROM v ORDER BY vec_id LIMIT 1), w AS (SELECT v.vec_id::VARCHAR AS name, round(list_dot_product(v.x, z.x) / (v.n * z.n), 6) AS score FROM v, z ORDER BY score DESC, v.vec_id::VARCHAR LIMIT 5) "
    "SELECT 'hybrid' AS route, w.* FROM w JOIN documents d ON d.doc_id::VARCHAR = w.name WHERE coalesce(d.text, '') <> ''"
)
def retrieve_fallback(spark, d):
    """A graph question whose seeds lead nowhere falls back to vectors."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    nodes = table(spark, d, "embeddings").join(docs, "vec_id", "left").select(F.col("vec_id").cast("string").alias("name"), F.lit("Document").alias("type"), "text", "embedding")
    plan = retrieval.Retriever(nodes, upsert.relation_totals(_mentions(spark, d)), route=lambda q: "cypher", seeds=lambda q: ["no node bears this"], embed=lambda q: _first_vector(spark, d))
    told = plan.retrieve("What lies near this?")
    return told.excerpts.select(F.lit(told.route).alias("route"), F.col("doc_id").alias("name"), "score")


@query(
    "WITH t AS (SELECT rec_id, title, list_avg(list_transform(string_split(substr(title, 1, 256), ''), lambda c: unicode(c) / 100.0)) AS m FROM papers) "
    "SELECT rec_id, CASE WHEN title IS NULL THEN NULL WHEN title = '' THEN 0.0 ELSE round(m / sqrt(m * m + 1), 4) END AS first FROM t"
)
def embed_tokens(spark, d):
    """A token model's states, pooled over each text's own tokens, in batches of texts of all lengths."""
    ship(spark)
    model = TokenModel(lambda t: [ord(c) for c in t], lambda ids, mask: np.stack([ids / 100.0, np.ones(ids.shape)], -1))
    return table(spark, d, "papers").select("rec_id", F.round(embedder(model)(F.col("title"))[0].cast("double"), 4).alias("first"))


@query("SELECT seq, len(s) AS seeds, array_to_string(s, '|') AS names FROM (SELECT seq, list_filter(list_transform(string_split(subject || ' , ,' || obj, ','), lambda x: regexp_replace(x, '" + _WS + "', '', 'g')), lambda x: x <> '') AS s FROM mentions WHERE subject IS NOT NULL AND obj IS NOT NULL)")
def seed_lists(spark, d):
    """P22, X7."""
    m = _mentions(spark, d).filter("subject IS NOT NULL AND obj IS NOT NULL")
    s = text.seed_list(F.concat("subject", F.lit(" , ,"), "obj"))
    return m.select("seq", F.size(s).cast("bigint").alias("seeds"), F.array_join(s, "|").alias("names"))


@query("SELECT seq, coalesce(nullif(confidence, 0.0), 1.0) AS confidence, seq % 1000 + (seq // 1000) * 4294967296 AS whole FROM mentions")
def falsy_and_split(spark, d):
    """F20, F21, F30."""
    whole = text.joined(F.col("seq") % 1000, F.expr("seq div 1000"))
    return _mentions(spark, d).select("seq", text.falsy(F.col("confidence"), 1.0).alias("confidence"), whole.alias("whole"))


def _told(text_column: F.Column) -> F.Column:
    """A model's answer that follows from the length of what it sees, so that SQL can tell which text it saw."""
    n = F.length(text_column)
    return F.concat(
        F.lit('[{"subject": "topic '), (n % 7).cast("string"), F.lit('", "subject_type": "Concept", "predicate": "bears on", "object": "Area '), (n % 5).cast("string"),
        F.lit('", "confidence": "0.'), (n % 9 + 1).cast("string"), F.lit('"}]'),
    )


_TOLD_SQL = "'topic ' || (n % 7) AS subject, 'Concept' AS subject_type, 'bears on' AS predicate, 'Area ' || (n % 5) AS obj, 'Unknown' AS obj_type, (n % 9 + 1) / 10.0 AS confidence"
_PAPERS_SQL = "d AS (SELECT *, rec_id AS ord, least(4000, length(coalesce(title, '') || '. ' || coalesce(abstract, ''))) AS n FROM papers)"


def _papers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "papers").withColumn("ord", F.col("rec_id"))
    return docs, ingestion.mentions(docs, get_extractor("llm", _told))


@query(f"WITH {_PAPERS_SQL} SELECT count(*) AS documents, count(n) AS triples FROM d")
def ingest_totals(spark, d):
    """The totals of an ingest."""
    return ingestion.totals(*_papers(spark, d))


@query(
    f"WITH {_PAPERS_SQL}, m AS (SELECT {_TOLD_SQL} FROM d), "
    "ev AS (SELECT title AS name, 'Paper' AS type FROM d WHERE title IS NOT NULL UNION ALL SELECT subject, subject_type FROM m UNION ALL SELECT obj, obj_type FROM m), "
    "b AS (SELECT name, type, count(*) AS n FROM ev GROUP BY ALL), "
    "p AS (SELECT title AS name, arg_max_null(url, ord) AS url, arg_max_null(source, ord) AS source, arg_max_null(citations, ord) AS citations, arg_max(title || '. ' || coalesce(abstract, ''), ord) AS text FROM d WHERE title IS NOT NULL GROUP BY title) "
    "SELECT coalesce(e.name, b.name) AS name, coalesce(e.type, b.type) AS type, CASE WHEN b.n IS NULL THEN e.mention_count ELSE coalesce(e.mention_count, 0) + b.n END AS mention_count, "
    "CASE WHEN e.entity_id IS NULL THEN 77 ELSE e.created END AS created, CASE WHEN e.entity_id IS NOT NULL AND b.n > 0 OR b.n > 1 THEN 77 ELSE e.updated END AS updated, "
    "CASE WHEN b.type = 'Paper' AND p.name IS NOT NULL THEN p.url ELSE e.url END AS url, CASE WHEN b.type = 'Paper' AND p.name IS NOT NULL THEN p.source ELSE e.source END AS source, "
    "CASE WHEN b.type = 'Paper' AND p.name IS NOT NULL THEN p.citations ELSE e.citations END AS citations, md5(coalesce(p.text, e.text)) AS text_md5, e.summary AS summary "
    "FROM entities e FULL JOIN b ON e.name = b.name AND e.type = b.type LEFT JOIN p ON p.name = coalesce(e.name, b.name)"
)
def ingest_entities(spark, d):
    """C11, K1, K4: all papers, those with shared, empty and no ids included, folded into the stored entities."""
    docs, triples = _papers(spark, d)
    held = table(spark, d, "entities").select(*[c.split(" ")[0] for c in ENTITY.split(", ")])
    after = ingestion.fold(held, spark.createDataFrame([], RELATION), docs, triples, now=F.lit(77).cast("bigint"))
    return after.entities.select("name", "type", "mention_count", "created", "updated", "url", "source", "citations", F.md5("text").alias("text_md5"), "summary")


@query(
    "WITH d AS (SELECT *, CASE WHEN coalesce(doc_id, '') = '' THEN title ELSE doc_id END AS source_id, request_no % 2 AS late, least(4000, length(text)) AS n FROM ingest_texts WHERE text IS NOT NULL), "
    f"m AS (SELECT request_no, source_id, late, {_TOLD_SQL} FROM d), "
    "f AS (SELECT subject, obj, source_id, min((late, request_no)) AS place FROM m WHERE coalesce(source_id, '') <> '' GROUP BY ALL), "
    "l AS (SELECT subject, obj, string_agg(source_id, '|' ORDER BY place, source_id) AS sources FROM f GROUP BY ALL) "
    "SELECT m.subject, subject_type, predicate, m.obj, obj_type, round(avg(confidence), 6) AS confidence, count(*) AS mention_count, coalesce(any_value(sources), '') AS sources "
    "FROM m LEFT JOIN l ON l.subject = m.subject AND l.obj = m.obj GROUP BY ALL"
)
def ingest_relations(spark, d):
    """Uploaded texts, two batches one after the other; a model sees more of a text than its node shows."""
    t = table(spark, d, "ingest_texts").filter("text IS NOT NULL")
    docs = t.select(F.coalesce(F.nullif("doc_id", F.lit("")), "title").alias("id"), "title", F.substring("text", 1, ingestion.SHOWN).alias("abstract"), F.col("text").alias("body"), F.col("request_no").alias("ord"))
    entities, relations = spark.createDataFrame([], ENTITY), spark.createDataFrame([], RELATION)
    for late in (0, 1):
        part = docs.filter(F.col("ord") % 2 == late)
        after = ingestion.fold(entities, relations, part, ingestion.mentions(part, get_extractor("llm", _told)), kind="Document", now=F.lit(late).cast("bigint"))
        entities, relations = after.entities, after.relations
    return relations.select("subject", "subject_type", "predicate", "obj", "obj_type", F.round("confidence", 6).alias("confidence"), "mention_count", F.array_join("sources", "|").alias("sources"))


@query(
    f"WITH {_UNIT}, q AS (SELECT vec_id, label, 'probe ' || vec_id AS name FROM v WHERE vec_id % 20 = 0 UNION ALL SELECT vec_id, label, 'node ' || vec_id FROM v WHERE vec_id % 20 = 1), "
    "s AS (SELECT q.name, q.label, v.vec_id AS node, v.label AS node_label, row_number() OVER (PARTITION BY q.name ORDER BY round(v.x[q.vec_id % 64 + 1] / v.n, 6) DESC) AS rank, round(v.x[q.vec_id % 64 + 1] / v.n, 6) AS score FROM q JOIN v ON q.name LIKE 'probe%'), "
    "r AS (SELECT q.name, q.label, CASE WHEN s.label = s.node_label AND s.score >= 0.3 THEN 'node ' || s.node ELSE q.name END AS resolved FROM q LEFT JOIN s ON s.name = q.name AND s.rank = 1), "
    "b AS (SELECT resolved AS name, label::VARCHAR AS type, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'Area 0', 'Unknown', count(*) FROM r), "
    "e AS (SELECT 'node ' || vec_id AS name, label::VARCHAR AS type FROM v) "
    "SELECT coalesce(e.name, b.name) AS name, coalesce(e.type, b.type) AS type, b.n AS mention_count, (SELECT count(*) FROM r WHERE r.name = coalesce(e.name, b.name)) AS edges FROM e FULL JOIN b ON e.name = b.name AND e.type = b.type "
    "UNION ALL SELECT name, 'unknown', NULL, 1 FROM r WHERE resolved <> name"
)
def ingest_resolved(spark, d):
    """Names taken over by stored nodes. A stored name is itself; others go by the nearest vector of all; edges keep
    the name as read, which makes a node where the name's own was taken over, and bind it."""
    ship(spark)
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    empty = spark.createDataFrame([], ENTITY)
    stored = empty.unionByName(v.select(F.concat(F.lit("node "), "vec_id").alias("name"), F.col("label").cast("string").alias("type"), "embedding"), allowMissingColumns=True)
    name = F.concat(F.when(F.col("vec_id") % 20 == 0, "probe ").otherwise("node "), "vec_id")
    docs = v.filter("vec_id % 20 IN (0, 1)").select(
        F.col("vec_id").alias("ord"), F.lit("").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("abstract"), F.concat(name, F.lit("|"), "label").alias("body")
    )
    say = lambda t: F.concat(
        F.lit('[{"subject": "'), F.substring_index(t, "|", 1), F.lit('", "subject_type": "'), F.substring_index(t, "|", -1), F.lit('", "predicate": "bears on", "object": "Area 0"}]')
    )
    axis = lambda n: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.substring_index(n, " ", -1).cast("int") % 64, 1.0).otherwise(0.0))
    embed = lambda n: F.when(n.startswith("Area"), F.lit(None)).otherwise(axis(n))
    triples = ingestion.mentions(docs, get_extractor("llm", say))
    resolved = ingestion.resolve(stored, ingestion.events(docs, triples, "Paper"), embed, Config(entity_merge_threshold=0.3))
    after = ingestion.fold(stored, spark.createDataFrame([], RELATION), docs, triples, resolved=resolved, now=F.lit(1).cast("bigint"))
    edges = after.relations.groupBy(F.col("subject").alias("name"), F.col("subject_type").alias("type")).agg(F.sum("mention_count").alias("edges"))
    return after.entities.join(edges, ["name", "type"], "left").select("name", "type", "mention_count", F.coalesce("edges", F.lit(0)).alias("edges"))
