"""Semantics that SQL on the test tables does not reach."""

import random

import pytest
from pyspark.sql import functions as F

from kgweft.functions import parse, text, vector
from kgweft.operators import search, traverse, upsert
from kgweft.plans.embed import masked_mean
from kgweft.plans.engine import Engine
from kgweft.plans.extract import get_extractor
from kgweft.plans.retrieval import Retriever, answer
from kgweft.sources.fetch import Fetcher, feed_entries
from kgweft.sources.remote import Busy, with_retries

EDGE = "subject string, predicate string, obj string, confidence double, mention_count bigint"


def paths(edges, seeds):
    """Edges on paths of one or two different edges whose end is not their beginning."""
    hit = set()
    ends = [(n, e[0], e[2]) for n, e in enumerate(edges)]
    for s in seeds:
        for i, a, b in ends:
            for x, y in {(a, b), (b, a)}:
                if x != s:
                    continue
                if y != s:
                    hit.add(i)
                for j, c, d in ends:
                    for u, v in {(c, d), (d, c)}:
                        if j != i and u == y and v != s:
                            hit |= {i, j}
    return {edges[i] for i in hit}


@pytest.mark.parametrize("seed", range(4))
def test_two_hop_equals_path_enumeration(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    edges = sorted({(rnd.choice(names), f"p{k % 3}", rnd.choice(names), 0.5, k) for k in range(10)})
    got = traverse.two_hop(spark.createDataFrame(edges, EDGE), ["n1", "n2"]).collect()
    assert {tuple(r) for r in got} == paths(edges, ["n1", "n2"]) and len(got) == len(set(got))


def test_batch_merge_equals_sequential_fold(spark):
    rnd = random.Random(3)
    rows = [(n, rnd.choice("ab"), "r", rnd.choice("xy"), round(rnd.random(), 3), rnd.choice(["s1", "s2", ""]), "t", "t") for n in range(60)]
    kept = {}
    for seq, s, p, o, c, src, *_ in rows:
        conf, n, sources = kept.get((s, p, o), (0.0, 0, []))
        kept[s, p, o] = ((conf * n + c) / (n + 1), n + 1, sources + ([src] if src and src not in sources else []))
    df = spark.createDataFrame(rows, "seq bigint, subject string, predicate string, obj string, confidence double, source_id string, subject_type string, obj_type string")
    df = df.withColumn("extracted_at", F.timestamp_millis(F.col("seq")))
    got = upsert.merge_relations(upsert.relation_rollup(df.filter("seq < 25")), upsert.relation_rollup(df.filter("seq >= 25"))).collect()
    assert {(r["subject"], r["predicate"], r["obj"]): (round(r["confidence"], 9), r["mention_count"], r["sources"]) for r in got} == {k: (round(c, 9), n, s) for k, (c, n, s) in kept.items()}


def test_written_null_wins(spark):
    rows = [("a", 1, "u1", 5), ("a", 2, "u2", None), ("b", 1, None, 7)]
    got = upsert.last_writer(spark.createDataFrame(rows, "k string, seq int, url string, citations bigint"), ["k"], ["seq"], ["url", "citations"]).collect()
    assert {(r["k"], r["url"], r["citations"]) for r in got} == {("a", "u2", None), ("b", None, 7)}


def test_resolution_is_decided_after_the_nearest_is_chosen(spark):
    c = spark.createDataFrame([("a", "Paper"), ("b", "Paper"), ("c", "Paper")], "key string, type string")
    near = spark.createDataFrame([("a", "x", "Paper", 0.95), ("b", "y", "Author", 0.99)], "key string, node string, node_type string, score double")
    assert {(r["key"], r["resolved"]) for r in search.resolve(c, near, 0.92).collect()} == {("a", "x"), ("b", "b"), ("c", "c")}


@pytest.mark.parametrize(("value", "digits"), [(0.725, 2), (0.125, 2), (0.135, 2), (1.0, 2), (0.0, 2), (2.0005, 3), (0.9996, 3), (0.005, 2), (-0.255, 2)])
def test_fixed_is_the_exact_rounding(spark, value, digits):
    assert spark.range(1).select(text.fixed(F.lit(value), digits)).first()[0] == f"{value:.{digits}f}"


def test_llm_answers(spark):
    rows = [
        ('```json\n[{"subject": "A", "predicate": "p", "object": "B"}]\n```',), ("not json",), (None,), ("[]",),
        ('[{"subject": "A", "predicate": "p", "object": "B", "confidence": "0.5"}, {"subject": "A", "predicate": "p"}]',),
        ('[{"subject": "A", "predicate": "p", "object": "B", "confidence": "high"}, {"subject": "C", "predicate": "p", "object": "D"}]',),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "raw string").select(parse.llm_triples(F.col("raw"))).collect()]
    assert [len(x) for x in got] == [1, 0, 0, 0, 1, 0]
    assert got[0][0]["confidence"] == 1.0 and got[0][0]["subject_type"] == "Unknown" and got[4][0]["confidence"] == 0.5


def test_extractor_registry(spark):
    with pytest.raises(ValueError):
        get_extractor("absent")
    docs = spark.createDataFrame([("d1", "Alpha Net outperforms Beta Net on many tasks. Short."), ("d2", None)], "source_id string, text string")
    got = get_extractor("gliner").extract(docs).collect()
    assert [(r["subject"], r["predicate"], r["obj"]) for r in got] == [("Alpha Net", "outperforms", "Beta Net")]


def test_title_source_is_asked_first(spark):
    docs = spark.createDataFrame([("i1", "Attention Is All You Need", "x", 9), ("i2", "Other work", "y", 1)], "id string, title string, abstract string, citations bigint")
    calls = []
    kept = Fetcher(docs, title=lambda q, n: (calls.append("title"), docs.filter(F.col("title") == q))[1], cited=lambda q, n: (calls.append("cited"), docs)[1])
    assert kept.fetch("Attention Is All You Need", 3).first()["title"] == "Attention Is All You Need"
    assert kept.fetch("attention is all you need ", 3).count() == 1 and calls == ["title"]


def test_feeds(spark):
    page = "<rss><channel><item><title>One</title><link>http://a</link></item><item><title>Two</title></item><item><title>Three</title></item></channel></rss>"
    got = feed_entries(spark.createDataFrame([("f", page)], "feed string, xml string"), "feed", "xml", 2).collect()
    assert sorted(r["title"] for r in got) == ["One", "Two"]


def test_retries():
    asked, slept = [], []

    def call(q):
        asked.append(q)
        if len(asked) < 3:
            raise Busy
        return "done"

    assert with_retries(call, "q", sleep=slept.append) == "done" and slept == [12.0, 24.0]
    with pytest.raises(KeyError):
        with_retries(lambda q: {}["x"], "q")


def test_masked_mean_ignores_padding():
    import numpy as np

    one = masked_mean(np.array([[[1.0, 2.0], [3.0, 4.0]]]), np.array([[1, 1]]))
    padded = masked_mean(np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert np.allclose(one, padded)


def test_zero_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "z array<float>, v array<float>")
    got = row.select(vector.l2_normalize(F.col("z")).alias("z"), vector.l2_normalize(F.col("v")).alias("v"), vector.cosine(F.col("z"), F.col("v")).alias("c")).first()
    assert got["z"] == [0.0, 0.0] and [round(x, 6) for x in got["v"]] == [0.6, 0.8] and got["c"] is None


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/graph", model=lambda t: F.lit('[{"subject": "Graph Net", "predicate": "improves", "object": "Link Recall", "confidence": "0.5"}]'))
    docs = spark.createDataFrame([("p1", "First Title", "On graphs.", "u", "s", None, 0)], "id string, title string, abstract string, url string, source string, citations bigint, ord bigint")
    assert engine.ingest(docs, batch="b1") == {"documents": 1, "triples": 1, "repeated": False}
    assert engine.ingest(docs, batch="b1")["repeated"]
    engine.ingest(docs, batch="b2")
    counts = {(r["name"], r["type"]): r["mention_count"] for r in engine.store.read("entities").collect()}
    assert counts == {("First Title", "Paper"): 2, ("Graph Net", "Unknown"): 2, ("Link Recall", "Unknown"): 2}
    edge = engine.store.read("relations").first()
    assert edge["mention_count"] == 2 and edge["confidence"] == 0.5 and edge["sources"] == ["p1"]
    assert engine.stats().first().asDict() == {"entities": 3, "relations": 1, "papers": 1, "vector_index_size": 1}
    assert engine.history().first()["title"] == "First Title" and engine.health() == {"status": "ok"}
    told = engine.query("What improves Link Recall?", seeds=lambda q: ["link recall"])
    assert told["graph_triple_count"] == 1 and "Graph Net" in told["answer"]
    assert engine.summary("absent") is None
    assert not engine.summary("First Title")["cached"] and engine.summary("First Title")["cached"]
    nodes, links = engine.graph()
    assert links.count() == 1 and nodes.count() == 2


def test_failing_parts_leave_empty_results(spark):
    def broken(_):
        raise RuntimeError

    entities = spark.createDataFrame([], "name string, type string, text string, embedding array<float>")
    found = Retriever(entities, spark.createDataFrame([], EDGE), route=broken, seeds=broken).retrieve("Anything?")
    assert found.route == "hybrid" and found.seeds == [] and found.triples is None
    assert answer(found, broken)["model"] == "error" and "(none)" in answer(found)["answer"]


def test_streaming_ingest(spark, tmp_path):
    from kgweft.streaming.ingest import arriving, ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "d1", "title": "T", "abstract": "A", "received_at": "2024-01-01T00:00:00Z"}\n' * 2)
    engine = Engine(spark, f"file://{tmp_path}/graph")
    for _ in range(2):
        ingest(arriving(spark, str(tmp_path / "in")), engine, str(tmp_path / "check"), once=True).awaitTermination()
    assert [(r["name"], r["mention_count"]) for r in engine.store.read("entities").collect()] == [("T", 1)]


TELLING = "id string, title string, abstract string, url string, source string, citations bigint, ord bigint"


def test_documents_that_share_an_id_keep_their_own_triples(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/graph", model=lambda t: F.concat(F.lit('[{"subject": "Graph Net", "predicate": "improves", "object": "Recall '), F.length(t).cast("string"), F.lit('"}]')))
    rows = [("", "One", "a", None, None, None, 1), ("", "Two", "bb bb", None, None, None, 2), (None, "Three", "c c c c c c", None, None, None, 3)]
    assert engine.ingest(spark.createDataFrame(rows, TELLING)) == {"documents": 3, "triples": 3, "repeated": False}
    edges = engine.store.read("relations").collect()
    assert sorted((e["obj"], e["obj_type"], e["mention_count"], e["sources"]) for e in edges) == [("Recall 10", "Unknown", 1, []), ("Recall 18", "Unknown", 1, []), ("Recall 6", "Unknown", 1, [])]


def test_an_uploaded_text_is_read_in_whole(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/graph", model=lambda t: F.when(F.contains(t, F.lit("far away")), '[{"subject": "Graph Net", "predicate": "improves", "object": "Link Recall"}]').otherwise("[]"))
    assert engine.ingest_text("Notes", "x " * 1500 + "far away")["triples"] == 1
    assert len(engine.store.read("entities").filter("name = 'Notes'").first()["text"]) == len("Notes. ") + 2000


def test_names_are_resolved_against_stored_vectors(spark, tmp_path):
    import dataclasses

    from kgweft.config import Config
    from kgweft.plans.embed import hashed_all

    say = lambda t: F.concat(F.lit('[{"subject": "'), t, F.lit('", "subject_type": "Paper", "predicate": "improves", "object": "Link Recall"}]'))
    engine = Engine(spark, f"file://{tmp_path}/graph", dataclasses.replace(Config(), entity_merge_threshold=0.7), model=say, encode=hashed_all)
    engine.ingest(spark.createDataFrame([("p", "graphs for better recall", "", None, None, 5, 1)], TELLING).withColumn("body", F.lit("Other Thing")))
    engine.ingest(spark.createDataFrame([("q", "Zzz", "", None, None, 5, 1)], TELLING).withColumn("body", F.lit("better graphs for recall")))
    nodes = {(r["name"], r["type"]): r["mention_count"] for r in engine.store.read("entities").collect()}
    # the stored node takes the mention; the edge makes a node of the name as read
    assert nodes["graphs for better recall", "Paper"] == 2 and nodes["better graphs for recall", "unknown"] is None and ("better graphs for recall", "Paper") not in nodes
    edge = engine.store.read("relations").filter("subject = 'better graphs for recall'").first()
    assert edge["subject_type"] == "unknown" and edge["obj_type"] == "Unknown"


def test_a_batch_writes_the_parts_of_its_names_only(spark, tmp_path):
    from kgweft.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s", parts=8)
    row = lambda *names: store.spark.createDataFrame([(n,) for n in names], "name string").select("name", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in store.SCHEMAS["entities"].split(", ")[1:])])
    store.bootstrap()
    store.publish({"entities": row(*"abcdefgh")}, "one")
    parts = store.parts_of(spark.createDataFrame([("a",)], "name string"))
    before, kept = store.manifest()["entities"], store.read("entities", parts)
    store.publish({"entities": kept.withColumn("summary", F.lit("s"))}, "two", {"entities": parts})
    after = store.manifest()["entities"]
    assert [p for p in after if after[p] != before[p]] == [str(p) for p in parts] and store.tags() == {"", "one", "two"}
    assert sorted(r["name"] for r in store.read("entities").collect()) == list("abcdefgh") and store.read("entities").filter("summary = 's'").count() == kept.count()
    assert store.read("entities", version=2).filter("summary = 's'").count() == 0


def test_token_models_pool_without_padding():
    import numpy as np

    from kgweft.plans.embed import TokenModel

    model = TokenModel(lambda t: [ord(c) for c in t], lambda ids, mask: np.stack([ids, ids * 2.0 + 1], -1), window=3)
    assert np.allclose(model(["ab", "abcd"])[0], model(["ab"])[0]) and np.allclose(model(["abcd"]), model(["abc"])) and np.allclose(np.linalg.norm(model(["ab", "q"]), axis=1), 1)


def test_batch_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(n, rng.integers(-2, 3, size=4).astype(float).tolist()) for n in range(60)] + [(90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(r["query"], r["id"]) for r in search.vector_topk_batch(df, df.filter("id < 20"), 3, key="id", vector="v", rows_per_part=9).collect()}
    good = {n: np.array(v) / np.linalg.norm(v) for n, v in rows[:60] if np.linalg.norm(v) > 0}
    want = {(q, n) for q in range(20) if q in good for _, n in sorted((-round(float(good[q] @ v), 6), n) for n, v in good.items() if n != q)[:3]}
    assert got == want


def test_a_failing_citation_source_is_followed_by_free_text(spark):
    docs = spark.createDataFrame([("i1", "on rivers", "x", 9)], "id string, title string, abstract string, citations bigint")

    def broken(q, n):
        raise RuntimeError

    assert Fetcher(docs, cited=broken, wait=0.0).fetch("rivers", 3).first()["id"] == "i1"
