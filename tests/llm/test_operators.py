"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import datetime as dt
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgweft.llm import history, markup, matching, names, packing, splitting, subjects, survivor, tokens, vectors
from kgweft.llm.titles import alike, told

NOW = dt.datetime(2023, 5, 1)


# -- 1 --------------------------------------------------------------------------------------------------------------------

PAPER = "rec_id bigint, batch_no int, id string, title string, abstract string, extra string, rec string"
TEXT = " ".join(f"word{i} meets thing{i * 7} near place{i * 3}." for i in range(30))
OTHER = " ".join(f"item{i} leaves house{i * 5} after noon{i * 11}." for i in range(30))


def papers(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAPER)


def test_history_finds_copies_versions_and_nothing_else(spark):
    rows = [
        (1, 0, "a1", "On the reef in Skonaznel", TEXT), (2, 0, "a2", "Editorial", OTHER), (3, 0, "", None, None), (4, 0, None, "Part work in Drumolk, 1", TEXT[:200]),
        (5, 1, "b1", "<b>On the reef in Skonaznel</b> (working paper)", TEXT[: len(TEXT) * 2 // 3]), (6, 1, "b2", "Editorial", "Quite another text " * 20), (7, 1, "", None, None),
        (8, 2, "b3", "Part work in Drumolk, 2", TEXT[:200]), (9, 2, "a1v3", "On the reef in Skonaznel", OTHER), (10, 2, "z", "On the reef in Skonaznel: a second look", TEXT[:150]),
        (11, 3, "q", "ON THE REEF IN SKONAZNEL", ""), (12, 3, "b1", "<b>On the reef in Skonaznel</b> (working paper)", TEXT[: len(TEXT) * 2 // 3]),
    ]
    got = {(r["first_rec_id"], r["rec_id"]) for r in history.found(papers(spark, rows)).collect()}
    assert got == {(1, 5), (1, 9), (1, 11), (1, 12)}


def test_history_of_nothing(spark):
    assert history.found(papers(spark, [])).count() == 0
    assert history.found(papers(spark, [(1, 1, None, None, None)])).count() == 0


def test_history_looks_past_the_first_holder_of_a_passage(spark):
    rows = [
        (1, 0, "a1", "The Depassen study of tides, 1", TEXT), (2, 0, "a2", "The Depassen study of tides, 2", TEXT[:200] + OTHER),
        (3, 1, "b1", "The Depassen study of tides, 2", TEXT[:200]), (4, 1, "b2", "The Depassen studdy of tides, 2", TEXT[:200]),
    ]
    got = {(r["first_rec_id"], r["rec_id"]) for r in history.found(papers(spark, rows)).collect()}
    assert got == {(2, 3), (2, 4)}


def test_a_crowded_passage_leads_to_every_paper_it_can_be(spark):
    lead = " ".join(f"phrase{i} that all of them share" for i in range(6))
    ends = ["harbour", "bridges", "lantern", "meadows", "orchard", "glacier", "voltage", "plasmid", "kitchen", "theorem", "saffron", "cyclone"]
    slip = lambda w: w[:2] + w[3] + w[2] + w[4:]
    rows = [(n, 0, f"a{n}", a, lead) for n, a in enumerate(ends)] + [(100 + n, 1, f"b{n}", slip(a), lead) for n, a in enumerate(ends)]
    got = {(r["first_rec_id"], r["rec_id"]) for r in history.found(papers(spark, rows)).collect()}
    assert got == {(r[0] - 100, r[0]) for r in rows if r[1]}


def test_a_task_of_the_history_has_one_python_process(spark, monkeypatch):
    plans, real = [], history.cut
    monkeypatch.setattr(history, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    rows = [(1, 0, "a1", "On the tides of Depassen", TEXT), (2, 1, "b1", "On the tides of Depasen", TEXT[:200])]
    assert history.found(papers(spark, rows)).count() == 1
    assert max(part.count("MapInArrow") for plan in plans for part in plan.split("Exchange")) == 1


def test_titles_of_one_length_are_not_alike_for_that(spark):
    words = ["harbour", "bridges", "lantern", "meadows", "theorem", "tide", "of", "the", "and", "reef"]
    rng = np.random.default_rng(3)
    cores = sorted({" ".join(words[k] for k in rng.integers(0, len(words), n)) for n in (1, 2, 3, 5) for _ in range(12)})
    slips = [c[:3] + c[4:] for c in cores if len(c) > 7] + [c.replace(" ", "", 1) for c in cores] + [c[:4] + "x" + c[5:] for c in cores if len(c) > 7]
    cores = [*dict.fromkeys([*cores, *(" ".join(c.split()) for c in slips), "late harbours and eels", "four steady plasmids"])]
    for n, least in ((400, 0.4), (10, 0.8)):
        titles = history.cut(history._titled(spark.createDataFrame([(k, c, n) for k, c in enumerate(cores)], "rec long, core string, n int")))
        x, y = (titles.select(F.struct(*titles.columns).alias(name)) for name in "xy")
        near = {tuple(r) for r in x.crossJoin(y).filter(history._NEAR).select("x.rec", "y.rec").collect()}
        assert not {(i, j) for i, a in enumerate(cores) for j, b in enumerate(cores) if alike(a, b) >= least} - near
        assert (cores.index("late harbours and eels"), cores.index("four steady plasmids")) not in near


@given(st.text("ab", max_size=60), st.text("ab", max_size=90), st.text("ab", max_size=60), st.floats(0, 150))
def test_what_is_surely_too_little_in_common(before, passage, after, least):
    later, earlier = before + passage + after, after + passage + before
    whole = history.common(later, earlier)
    assert history.common(later, earlier, least=least) == whole or history.common(later, earlier, least=least) == 0 and whole < least
    assert history.common("c" * 300, passage * 3, least=0.85 * 300) == 0


def slices(rows):
    rows = sorted(rows)
    tails, title, issue, bare, rec = zip(*rows, strict=True)
    return history.Slice(np.array(tails, dtype=f"S{history.DEPTH + 1}"), np.array(title), np.array(issue), np.array(bare), np.array(rec))


def test_slices_find_the_longest_matches():
    rnd = random.Random(1)
    word = lambda: b"a" + bytes(rnd.choice(b"ab") for _ in range(3)) + b"x" * rnd.choice([27, 28, 29, 44]) + bytes(rnd.choice(b"yz") for _ in range(2))
    held = slices({(word(), n, n % 3, n % 7 == 0, n) for n in range(40)})
    asked = slices({(word(), 100 + n, n % 3, n % 5 == 0, 20 + n) for n in range(60)})
    got = set(zip(*(x.tolist() for x in held.matches(asked)), strict=True))
    for q in range(60):
        fits = lambda e, d, q=q: held.tails[e][: d + 1] == asked.tails[q][: d + 1]
        want = set()
        for depth in (48, 32):
            near = [e for e in range(40) if fits(e, depth)]
            if len(near) <= history.FEW and not want:
                want = {(q, int(held.rec[e]), depth) for e in near if held.rec[e] < asked.rec[q] and (held.issue[e] == asked.issue[q] or held.bare[e] or asked.bare[q])}
            elif not want and len(near) > history.FEW:
                want = {g for g in got if g[0] == q}
                assert all(fits(int(np.flatnonzero(held.rec == r)[0]), d) and r < asked.rec[q] for _, r, d in want)
        assert {g for g in got if g[0] == q} == want


def test_a_crowded_match_leads_to_the_first_and_to_the_own_title():
    tail = b"a" + b"q" * 48
    held = slices([(tail, n, 0, False, 100 + n) for n in range(30)] + [(tail, 50, 1, False, 7), (tail, 51, 2, True, 9)])
    asked = slices([(tail, 17, 0, False, 500), (tail, 88, 1, False, 501), (tail, 99, 0, False, 90), (tail, 99, 5, True, 600)])
    q, rec, _ = held.matches(asked)
    got = {int(asked.rec[k]): set(rec[q == k].tolist()) for k in range(4)}
    assert got == {500: {100, 117, 9}, 501: {7, 9}, 90: {9}, 600: {7, 9}}


def test_a_common_passage_is_few_entries(spark):
    rows = [(1, b"aboilerplate", n, n % 2, 1000 - n, False) for n in range(60)] * 2 + [(1, b"aother", 3, 0, 5, False)]
    got = history._entries(spark.createDataFrame(rows, "bucket int, tail binary, title long, issue long, rec long, bare boolean")).collect()
    kept = {issue: sorted(r["rec"] for r in got if r["issue"] == issue and bytes(r["tail"]) == b"aboilerplate") for issue in (0, 1)}
    assert all(len(v) == history.FEW + 1 for v in kept.values()) and kept[1][0] == 941 and len(got) == 2 * (history.FEW + 1) + 1


@given(st.text("abcdefgh", min_size=47, max_size=60), st.text("abcdefgh", max_size=40), st.text("abcdefgh", max_size=40))
@settings(max_examples=100, deadline=None)
def test_a_common_passage_has_a_common_place(passage, before, other):
    def tails(text):
        raw = text.encode()
        return {raw[p : p + history.LEAST["a"]] for p in history.places(np.frombuffer(raw, np.uint8), 16) if len(raw) - p >= history.LEAST["a"]}

    assert tails(before + passage + other) & tails(other[::-1] + passage)


def test_batches_one_by_one_give_the_answers_of_one_delivery(spark, data, tmp_path):
    p = spark.read.parquet(f"{data}/papers.parquet")
    index, got = history.Index(spark, f"file://{tmp_path}/index", entries_per_bucket=2000), set()
    for n in range(5):  # only the batch is given: earlier rows can't be read
        got |= {tuple(r) for r in index.append(p.filter(F.expr("CAST(ceil(batch_no / 3) AS int)") == n)).filter("batch_no > 0 AND first_rec_id < rec_id").select("first_rec_id", "rec_id").collect()}
        assert len({s["rows"].bit_length() for s in index.segments()}) == len(index.segments())
    assert got == {tuple(r) for r in history.found(p).collect()} and got
    again = history.Index(spark, f"file://{tmp_path}/index").append(p.filter("batch_no = 12").withColumn("rec_id", F.col("rec_id") + 10**9))
    answers = {r["rec_id"] - 10**9: r["first_rec_id"] for r in again.filter("first_rec_id < 1000000000").collect()}
    assert set(answers) >= {rec for first, rec in got if rec in answers} and len(answers) >= 0.8 * p.filter("batch_no = 12").count()


def test_titles():
    assert told("Reef work, revised draft")[:2] == ("reef work", "") and told("Reef work (Part II)")[1] == "ii"
    assert told("Editorial")[2] and not told("Editorial boards and the long road to open review in practice")[2]
    assert alike("on the guildi n joskitor", "on the guild in joskitor") == 1.0 and alike("a collection of morbals", "a collection of tendrins") <= 0.5


# -- 2 --------------------------------------------------------------------------------------------------------------------

RECORD = "rec_id bigint, title string, authors array<string>, published_date string, abstract string, first bigint"


def test_matching(spark):
    p = [
        (1, "On the reef in Skonaznel", ["Ada M. Lorn", "Bo Treven"], "2019-02-01", None, 0), (2, "Editorial", ["Ada Lorn"], "2018", None, 0), (3, None, None, None, None, 0),
        (4, "on the REEF in Skonaznel", [], "", None, 0), (5, "Steady wave function and the vacuum energy: evidence from Dolvik", ["Cy Narm"], "2020", None, 0),
    ]
    i = [
        (11, "On the Reef in Skonaznel", ["Lorn, A.", "et al."], "2019.0", None, 0), (12, "Editorial", ["Zed Qual"], "2018", None, 0), (13, "", None, None, None, 0),
        (14, "Stedy wave fucntion and the vacuum energy: evidence from Dolvik", ["C. Narm"], "2021", None, 0), (15, "On the Reef in Skonaznel: a reply to critics", ["Lorn, A."], "2019", None, 0),
        (16, "Editorial", ["Lorn A"], "2018", None, 0), (11, "On the Reef in Skonaznel", ["Lorn, A.", "et al."], "2019.0", None, 0),
    ]
    left, right = spark.createDataFrame(p, RECORD), spark.createDataFrame(i, RECORD)
    got = sorted((r["paper_rec_id"], r["index_rec_id"]) for r in matching.match(left, right).collect())
    assert got == [(1, 11), (2, 16), (4, 11), (5, 14)]
    assert all(0 < r["confidence"] <= 1 for r in matching.matches(left, right).collect())
    assert matching.match(left.limit(0), right).count() == 0


def test_matching_looks_past_the_first_record_of_a_key(spark):
    p = [(1, "Steady tortclaim and open appeal", ["Ada Lorn"], None, None, 0), (2, "The Gloma study of steady tortclaim and appeal", [], None, None, 0)]
    i = [(11, "The Glomma stuudy of steady tortclaim and appeal", [], None, None, 0)]
    got = [tuple(r)[:2] for r in matching.match(spark.createDataFrame(p, RECORD), spark.createDataFrame(i, RECORD)).collect()]
    assert got == [(2, 11)]


def test_matching_by_what_slips_leave(spark):
    p = [
        (1, "On the licence in Grudovel", ["Jonathan N. Kvekerkik"], "2011", None, 0), (2, "On the siege in Kveifaten", ["Alexander Zufeven"], "2007", None, 0), (3, "On the biopsy in Zhaipundan", ["Valentin Reikaintik"], None, None, 0),
        (4, "Does the sea level shape the drought? Revisiting Broskersten after 14 years", ["Leopold Fibrambik"], None, None, 0), (5, "On the witness in Zhaiskeirman", ["Helene P. Govlassel"], None, None, 0),
        (6, "Bounds for the spread of beetles in $O(n \\log n)$ steps", ["Ada Lorn"], None, None, 0), (7, "On the licence in Grudovel: a reply", ["Jonathan N. Kvekerkik"], "2011", None, 0),
    ]
    i = [
        (11, "On th elicence in Grdovel", ["Kvekerkik, J."], "2012", None, 0), (12, "On the siege inKveifaten", ["Alexander Zufeven"], "2006", None, 0), (13, "On the biopsy novel in Zhaipundan", ["V. Reikaintik"], None, None, 0),
        (14, "Does the sea level shape the drought? Revisiting Broskersten after 14 the years", ["L. Fibrarbik"], None, None, 0), (15, "On the wwitness in Zhaisneirman", ["Helene P. Govlassel"], None, None, 0), (16, "Bounds for the spread of beetles", ["A. Lorn"], None, None, 0),
    ]
    got = {tuple(r)[:2] for r in matching.match(spark.createDataFrame(p, RECORD), spark.createDataFrame(i, RECORD)).collect()}
    assert got == {(n, n + 10) for n in range(1, 7)}


def test_crowded_keys_are_made_narrower(spark):
    words = [f"{a}{b}ation" for a in "bdfgklmnprst" for b in ("ar", "el", "in", "os")]
    p = [(n, f"Modern treatment settlement of {words[n]} and {words[-n - 1]}", [], None, None, 0) for n in range(len(words))]
    i = [(1000 + n, f"Modern treatment settlement of {words[n]} and {words[-n - 1]}y", [], None, None, 0) for n in range(len(words))]
    got = {tuple(r)[:2] for r in matching.match(spark.createDataFrame(p, RECORD), spark.createDataFrame(i, RECORD)).collect()}
    assert got >= {(n, 1000 + n) for n in range(len(words))}


def test_a_crowded_key_loses_no_pair_that_agrees(spark):
    ends = ["harbour", "bridges", "lantern", "meadows", "orchard", "glacier", "voltage", "plasmid", "kitchen", "theorem", "saffron", "cyclone"]
    slip = lambda w: w[:2] + w[3] + w[2] + w[4:]
    for authors in ([], ["Ada Lorn"]):  # no third word in common; one family name for all
        p = [(n, f"{a} treatment settlement {ends[n - 1]}", authors, None, None, 0) for n, a in enumerate(ends)]
        i = [(1000 + n, f"{slip(a)} treatment settlement {slip(ends[n - 1])}", ["Lron, A."] if authors else [], None, None, 0) for n, a in enumerate(ends)]
        got = {tuple(r)[:2] for r in matching.match(spark.createDataFrame(p, RECORD), spark.createDataFrame(i, RECORD)).collect()}
        assert got == {(n, 1000 + n) for n in range(len(ends))}


def test_a_pass_of_the_matching_is_one_plan(spark, monkeypatch):
    met, real = [], matching._met
    monkeypatch.setattr(matching, "_met", lambda *given: met.append(given) or real(*given))
    title = "On the reef in Skonaznel"  # the second agrees with the first of its source only
    p = [(1, title, ["Ada Lorn", "Bo Treven"], "2019", None, 0), (2, title, ["Bo Treven"], "2019", None, 0), (3, title, ["Cy Narm"], "2019", None, 0)]
    i = [(11, title, ["Lorn, A."], "2019", None, 0), (12, title, ["Lorn, A.", "Zed Qual"], "2019", None, 0), (13, title, ["Zed Qual"], "2019", None, 0)]
    got = {tuple(r)[:2] for r in matching.match(spark.createDataFrame(p, RECORD), spark.createDataFrame(i, RECORD)).collect()}
    assert got == {(a, b) for a in (1, 2) for b in (11, 12, 13)}
    assert len(met) == len(matching.PASSES)


# -- 3 --------------------------------------------------------------------------------------------------------------------


def test_neighbours_are_the_nearest(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 96))
    rows = [(n, (base[n % 12] + 0.15 * rng.normal(size=96)).tolist(), "x") for n in range(240)]
    rows += [(900, [0.0] * 96, "x"), (901, None, "x"), (902, [1.0] * 48, "x"), (903, [], "x"), (None, [1.0] * 96, "x"), (904, [None] + [1.0] * 95, "x")]
    rows += [(300 + n, base[0].tolist(), "x") for n in range(9)]  # one vector many times
    df = spark.createDataFrame(rows, "entity_id bigint, embedding array<double>, vec string")
    found = vectors.neighbours(df).cache()
    assert vectors.recall(found, df, every=1) >= 0.9
    by = {k: [(r["neighbour"], r["cosine"]) for r in g] for k, g in itertools.groupby(sorted(found.collect(), key=lambda r: (r["entity_id"], r["rank"])), key=lambda r: r["entity_id"])}
    assert len(by) == 249 and [i for i, _ in by[304]] == [300, 301, 302, 303, 305] and all(abs(c - 1) < 1e-6 for _, c in by[304])
    assert vectors.neighbours(df.limit(0)).count() == 0 and vectors.neighbours(df.filter("entity_id = 0")).count() == 0


def test_a_dense_cell_has_an_index_of_its_own(spark):
    rng = np.random.default_rng(9)
    near, ways = rng.normal(size=96), rng.normal(size=(4, 96))
    rows = [(n, (near + 0.1 * rng.normal(size=4) @ ways).tolist()) for n in range(1500)] + [(5000 + n, rng.normal(size=96).tolist()) for n in range(300)]
    df = spark.createDataFrame(rows, "entity_id bigint, embedding array<double>")
    x = np.array([v for _, v in rows], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors._codebooks(x, len(x), 20, 16)
    counts = np.bincount(index.cells(x), minlength=index.size)
    assert vectors.divide(index, x, counts, int(counts.max()) // 2) and np.bincount(index.cells(x), minlength=index.size).max() < counts.max()
    a, b = index.distances(x[:1])
    fine = np.bincount(index.cells(x), minlength=index.size)
    assert fine[index.visit(a[0], b[0], fine, 200, 3, x[0])].sum() < 700  # not the whole cell
    found = vectors.neighbours(df, block=60, entries=600)
    assert vectors.recall(found, df) >= 0.9


def test_cells_come_in_order_of_distance():
    index = vectors.MultiIndex(np.arange(4.0)[:, None], np.arange(3.0)[:, None])
    a, b = np.array([0.3, 0.1, 0.9, 2.0]), np.array([0.5, 0.0, 0.2])
    seen = index.visit(a, b, np.ones(12, int), 10**9, 0)
    cost = [a[c // 3] + b[c % 3] for c in seen]
    assert sorted(seen) == list(range(12)) and cost == sorted(cost)


# -- 4 --------------------------------------------------------------------------------------------------------------------


def test_spellings(spark):
    forms = {
        "p": ["Isabella R. Zeikessan", "Zeikessan, I.", "ZEIKESSAN I", "Bella Zeikessan", "Dr. Isabella Zeikessan", "Isabella Zeikesasn", "Zeikessan, Isabella", "Zeikessan Isabella", "Isab. Zeikessan"],
        "q": ["Olivia Zeikessan"], "j": ["Isabella Zeikessan Jr."],
        "u": ["University of Drumolk", "Drumolk University", "Universität Drumolk", "Univercity of Drumolk", "U. Drumolk"], "h": ["Drumolk University Hospital", "University Hospital of Drumolk"],
        "i": ["Marnel Institute for Quantum Materials", "MARNEL-IQM", "Institute for Quantum Materials, Marnel"], "n": ["???"],
    }
    rows = [(n, "r", name, "Organisation" if k in "uhi" else "Author") for k, those in forms.items() for n, name in enumerate(those)] + [(99, "r", None, "Author"), (98, "r", "Ignored", "Concept")]
    df = spark.createDataFrame([(s, None, None, name, "Author", t, 1) for s, _, name, t in rows], "seq bigint, subject string, predicate string, obj string, subject_type string, obj_type string, name int")
    want = {tuple(sorted(p, key=str.encode)) for those in forms.values() for p in itertools.combinations(those, 2)}
    linked = names.link(df)
    assert {(r["name_a"], r["name_b"]) for r in names.pairs(linked).collect()} == want
    assert names.link(df.union(df)).count() == linked.count() == sum(map(len, forms.values()))
    assert names.link(df.limit(0)).count() == 0


def test_short_forms_follow_the_only_full_name(spark):
    rows = ["Robert Trelm", "Bob Trelm", "Samuel Okna", "Samantha Okna", "Sam Okna", "Max Ulvet", "Ulvet, Max", "M. Ulvet", "Roberta Dolm", "R. Dolm", "Bob Dolm", "Robert Zeikessan", "Bob Zeikesan"]
    df = spark.createDataFrame([(n, "Author") for n in rows], "subject string, subject_type string").withColumn("obj", F.lit(None).cast("string")).withColumn("obj_type", F.lit(None).cast("string"))
    got = {(r["name_a"], r["name_b"]) for r in names.pairs(names.link(df)).collect()}
    assert got == {("Bob Trelm", "Robert Trelm"), ("Max Ulvet", "Ulvet, Max"), ("M. Ulvet", "Max Ulvet"), ("M. Ulvet", "Ulvet, Max"), ("R. Dolm", "Roberta Dolm"), ("Bob Zeikesan", "Robert Zeikessan")}


def test_a_slip_in_many_styles_follows_a_name_in_more(spark):
    forms = lambda g, f: [f"{g} {f}", f"{f}, {g}", f"Dr. {g} {f}", f"{g.upper()} {f}", f"{f}, {g} X.", f"Prof. {g} {f}", f"{f.upper()}, {g}", f"{g} Q. {f}", f"{g}  {f}", f"{f} , {g}"]
    rows = forms("Isabella", "Zeikessan") + forms("Isabella", "Zeikesasn")[:3]
    df = spark.createDataFrame([(n, "Author") for n in rows], "subject string, subject_type string").withColumn("obj", F.lit(None).cast("string")).withColumn("obj_type", F.lit(None).cast("string"))
    assert len({r["entity"] for r in names.link(df).collect()}) == 1


@given(st.lists(st.text("abc", min_size=0, max_size=9), min_size=2, max_size=8, unique=True))
@settings(max_examples=60, deadline=None)
def test_segments_lose_no_pair(words):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for a, b in itertools.combinations(words, 2):
        assert names.within(a, b, 2) == (distance(a, b) <= 2)
        short, long = sorted((a, b), key=len)
        if len(short) > 2 and distance(a, b) <= 2:
            assert {(len(short), n, s) for n, (_, s) in enumerate(names.segments(short, 2))} & names.probes(long, 2)


# -- 5 --------------------------------------------------------------------------------------------------------------------

MARKED = [
    ("plain: 3 * 4 * 5, x < y and y > z, $12 to $40, C:\\data\\runs, R&D, a_b and c_d, [3, 7], # 1, {a, b}, 5$ each", set()),
    ("<p>One &amp; two</p>", {"html"}), ("&lt;b&gt;x&lt;/b&gt;", {"html"}), ("**bold** and `code`", {"markdown"}), ("# Head\n\ntext", {"markdown"}), ("a\n\n- x\n- y", {"markdown"}),
    ("[[Page|shown]] and ''it''", {"wiki"}), ("== Head ==\ntext", {"wiki"}), ("\\textbf{x} costs 5\\%", {"latex"}), ("We set $k=3$ and ``quote''.", {"latex"}), ("<i>a</i> and **b**", {"html", "markdown"}),
    ("", set()), ("\\textbf{never closed", {"latex"}), ("{\\em x} ''y''", {"latex", "wiki"}),
]


@pytest.mark.parametrize(("raw", "kinds"), MARKED)
def test_kinds(raw, kinds):
    assert markup.Parser(raw).kinds == kinds


def test_structure_is_kept_and_templates_go(spark):
    assert markup.render(markup.Parser("<h2>Head</h2><ul><li>a</li><li>b</li></ul><pre>x = 1</pre> $a^2$ Caf\\'e").root) == "## Head\n- a\n- b\n```\nx = 1\n```\n$a^2$ Café"
    rows = [(n, f"T{n}", f"<div><h2>Summary</h2>text number {n}</div>", "http://h.example/x", "z") for n in range(30)] + [(50, None, "", None, "z"), (51, "**a**", "<p>q</p>", None, "z"), (51, "**a**", "<p>q</p>", None, "z")]
    df = spark.createDataFrame(rows, "rec_id bigint, title string, abstract string, url string, host string")
    got = {(r["rec_id"], r["field"]): r["text"] for r in markup.clean(df).collect()}
    assert got[3, "abstract"] == "text number 3" and got[51, "title"] == "a" and (50, "abstract") not in got
    assert markup.found(df).filter("rec_id = 51").count() == 4 and markup.found(df.limit(0)).count() == 0


def test_texts_with_one_lead_are_no_template(spark):
    lead = "This article is made available under the terms that the publisher of the series sets for all "
    rows = [(n, None, f"<div><h2>Summary</h2><p>{lead}parts, number {n}</p></div>", "http://h.example/x", "z") for n in range(30)]
    df = spark.createDataFrame(rows, "rec_id bigint, title string, abstract string, url string, host string")
    got = {r["rec_id"]: r["text"] for r in markup.clean(df).collect()}
    assert got[3] == f"{lead}parts, number 3"


@pytest.mark.parametrize(("raw", "kind"), [("**{}**", "markdown"), ("$a {} b$", "latex"), ("''{}''", "wiki"), ("`{}`", "markdown"), ("``{}''", "latex"), ("*{}*", "markdown")])
def test_markup_around_long_texts(raw, kind):
    assert markup.Parser(raw.format(" ".join(["word"] * 300))).kinds == {kind}


def test_wrappers_of_one_shape_add_up_as_by_search():
    pages = [markup.wrapper_of(markup.Parser(f"<div><h2>Head</h2><p>text {n}</p></div>").root) for n in range(6)]
    assert len({markup.shape(p) for p in pages}) == 1
    stacked = searched = pages[0]
    for page in pages[1:]:
        stacked, searched = markup._stacked(stacked, page), markup._union(searched, page)
    assert stacked == searched


def test_kinds_come_from_aligned_trees(spark):
    root = markup.Parser("<h2>Head</h2> and **bold**").root
    fixed = f"/page/h2/text\t{markup._digest('Head')}"
    assert markup.kinds(root) == ({"html", "markdown"}, set()) and markup.kinds(root, frozenset([fixed])) == ({"html", "markdown"}, set())
    assert markup.kinds(markup.Parser("&amp;").root, frozenset([f"/page/text\t{markup._digest('&')}"])) == (set(), {"html"})


@given(st.text("<>&;#*_`'[]{}|\\$=~-+ \nabp/1!", max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_text_parses(raw):
    markup.render(markup.Parser(raw).root)


# -- 6 --------------------------------------------------------------------------------------------------------------------


@given(st.text("ab. \n,;漢。#\f", max_size=120) | st.integers(1, 60).map(lambda n: "x" * n), st.integers(2, 30), st.integers(0, 29))
@settings(max_examples=300, deadline=None)
def test_pieces(raw, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = splitting.split_text(raw, limit, overlap)
    assert "".join(raw[p.core : p.end] for p in got) == raw and all(p.end - p.start <= limit for p in got)
    assert all(b.core == a.end and a.start <= b.start and b.core - b.start <= overlap for a, b in itertools.pairwise(got))
    assert any(p.forced for p in got) == bool(re.search(r"\S{%d,}" % (limit + 1), raw))


def test_cuts(spark):
    rows = [(1, "word " * 900, 1), (2, "x" * 2300, 1), (3, None, 1), (4, "", 1), (5, "a" * 2000, 1), (None, "x y " * 700, 1), (1, "word " * 900, 1), (7, " " * 5000, 1)]
    df = spark.createDataFrame(rows, "request_no bigint, text string, piece int")
    got = sorted(((r["request_no"] or 0, r["cut"]) for r in splitting.cuts(df).collect()))
    assert got == [(0, "natural"), (1, "natural"), (1, "natural"), (2, "forced"), (7, "natural")]
    pieces = splitting.split(df).filter("request_no = 2").collect()
    assert all(len(r["text"]) <= 2000 for r in pieces) and splitting.split(df.limit(0)).count() == 0


# -- 7 --------------------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    whole = "First claim is made here. Second claim follows it. Third claim ends it."
    rows = [
        (1, 1, whole, "a", "2019-02-30", 0, NOW), (2, 1, whole + " Subscribe to read the full article.", "b", "2018-03-04", 5, NOW - dt.timedelta(days=1)),
        (3, 1, whole[:45], "a", "Mon, 05 Mar 2018 00:00:00 GMT", 7, NOW - dt.timedelta(days=2)), (4, 1, whole.replace("c", "�"), None, "1989-01-01", 99999999, NOW), (5, 1, None, "a", "2030-01-01", None, NOW),
        (6, 1, f"{whole} {whole}", "a", "May 2018", -1, NOW), (7, 2, whole, "a", "2018-01-01", 3, NOW), (8, 3, "N/A", "zz", None, None, None), (9, 3, "", "zz", "", None, None), (10, None, whole, "a", "2018", 4, NOW),
    ]
    for g in range(10, 18):  # the notice stands in one copy of many groups, and so is known for one
        rows += [(10 * g + n, g, f"Claim number {g} stands here." + (" Subscribe to read the full article." if n == 2 else ""), "a", None, None, NOW) for n in range(3)]
    rows += [rows[1], rows[3]]  # repeated rows
    df = spark.createDataFrame([(*r, 0) for r in rows], "copy_id bigint, group_id bigint, abstract string, source string, published_date string, citations bigint, fetched_at timestamp_ntz, trust int")
    sources = spark.createDataFrame([("a", 5), ("b", 7), ("b", 1), (None, 9)], "source string, trust int")
    got = {(r["group_id"], r["field"], r["copy_id"]) for r in survivor.survivors(df, sources).collect()}
    assert {(g, "abstract", 10 * g) for g in range(10, 18)} == {x for x in got if x[0] >= 10}
    got = {x for x in got if x[0] < 10}
    assert got == {(1, "abstract", 1), (1, "citations", 2), (1, "published_date", 2)}
    built = survivor.records(df, sources).filter("group_id = 1").first()
    assert built["citations"] == 5 and str(built["published_date"]) == "2018-03-04" and built["abstract"] == whole
    assert survivor.survivors(df.limit(0), sources).count() == 0


def test_a_repeated_copy_is_measured_once(spark):
    whole, cut_short = "First claim is made here. Second claim follows it.", "First claim is made here."
    rows = [(1, 1, whole, "a", None, 1, NOW), (2, 1, cut_short, "a", None, 1, NOW), (2, 1, cut_short, "a", None, 1, NOW), (2, 1, cut_short, "a", None, 1, NOW)]
    df = spark.createDataFrame(rows, "copy_id bigint, group_id bigint, abstract string, source string, published_date string, citations bigint, fetched_at timestamp_ntz")
    got = survivor.survivors(df, spark.createDataFrame([("a", 5)], "source string, trust int")).filter("field = 'abstract'").collect()
    assert [r["copy_id"] for r in got] == [1]


@pytest.mark.parametrize(("raw", "day"), [("2010-11-16T08:00:00+00:00", "2010-11-16"), ("2011/03/09", "2011-03-09"), ("3 Aug. 2017", "2017-08-03"), ("December 8, 2008", "2008-12-08"), ("Sat, 14 Jan 2017 00:00:00 GMT", "2017-01-14"), ("0000-00-00", None), ("2010-13-05", None), ("2008-02-30", None), ("Spring 2010", None), ("2010-05", None), ("", None), (None, None)])
def test_days(spark, raw, day):
    got = spark.createDataFrame([(raw,)], "d string").select(survivor.exact_day(F.col("d")).cast("string")).first()[0]
    assert got == day


# -- 8 and 9 ---------------------------------------------------------------------------------------------------------------


@given(st.text(max_size=60) | st.text(" \n\t'slre9!漢é\u00a0🙂", max_size=60), st.integers(1, 7), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_tree_gives_the_ids_of_the_whole(raw, leaf, window):
    model = tokens.bpe()
    ids = tokens.Tree(model, leaf, window).encode(raw)
    assert ids.tolist() == model.ids(raw).tolist() and model.decode(ids) == raw.encode()


def test_encoding(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "<|endoftext|> text", 1), (None, "x", 1), (3, "<|endoftext|> text", 1), (4, "a b " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = tokens.encode(df).collect()
    assert [len(r["ids"]) for r in got][:2] == [0, 0] and len(got) == 6 and 50256 not in got[2]["ids"]
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back[4] == "a b " * 30_000 and back[1] == "" and tokens.encode(df.limit(0)).count() == 0


def test_sum_of_squares_is_the_best_step():
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 20) for _ in range(300)]
    placed, gaps = packing.sum_of_squares(np.array(sizes), 20), {}
    for s, b in zip(sizes, placed, strict=True):
        def cost(bin_no, s=s):
            after = dict(gaps)
            after[bin_no] = after.get(bin_no, 20) - s
            open_ones = [g for g in after.values() if 0 < g < 20]
            return sum(open_ones.count(g) ** 2 for g in set(open_ones))

        choices = [cost(x) for x, g in gaps.items() if g >= s] + [cost(-1)]
        assert cost(b) == min(choices)
        gaps[b] = gaps.get(b, 20) - s
        assert gaps[b] >= 0


def test_packing(spark):
    rows = [(n, n % 900 + 1, 1) for n in range(400)] + [(1000, 5000, 1), (1001, 0, 1), (1002, None, 1), (None, 7, 1), (5, 6, 1), (5, 6, 1), (1003, 2048, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, bin int")
    got = packing.pack(df, rows_per_shard=60).collect()
    filled = {}
    for r in got:
        filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n_tokens"]
    assert max(filled.values()) <= 2048 and sum(filled.values()) == sum(n or 0 for _, n, _ in rows)
    assert sorted((r["piece"], r["n_tokens"]) for r in got if r["doc_id"] == 1000) == [(0, 2048), (1, 2048), (2, 904)]
    assert len(filled) <= sum(filled.values()) // 2048 + 2 and packing.pack(df.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    rnd = random.Random(8)
    terms = {"law": ["court", "statute", "witness", "verdict", "appeal"], "sport": ["goal", "referee", "marathon", "league", "coach"], "climate": ["glacier", "rainfall", "drought", "reef", "aerosol"]}
    say = lambda a: f"We study how the {rnd.choice(terms[a])} depends on the {rnd.choice(terms[a])} in {rnd.randint(1, 99)} cases."
    docs, labels = [], []
    for n in range(240):
        own = rnd.sample(sorted(terms), 1 + n % 2)
        docs.append((n, " ".join(say(own[i % len(own)]) for i in range(6)) + " Data are available on request.", "x"))
        labels += [(n, a, "x") for a in own] if n < 120 else []
    docs += [(900, None, "x"), (901, "", "x"), (902, "Please try again later.", "x"), (None, docs[0][1], "x"), (0, docs[0][1], "x"), (903, "We thank the sports club for the goal and the league.", "x")]
    labels += [(0, None, "x"), (None, "law", "x"), (5, "absent", "x"), (7777, "law", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, areas string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject_area string, own string")
    areas = spark.createDataFrame([("law", ""), ("sport", ""), ("climate", "")], "subject_area string, note string")
    told_areas = {}
    for r in subjects.found(d, lab, areas).collect():
        told_areas.setdefault(r["doc_id"], set()).add(r["subject_area"])
    truth = {n: {a for a, ws in terms.items() if any(w in t for w in ws)} for n, t, _ in docs if n is not None and n < 240}
    right = sum(told_areas.get(n) == truth[n] for n in range(120, 240))
    assert right >= 108 and not {900, 901, 902, 903} & set(told_areas)
    assert subjects.found(d.limit(0), lab, areas).count() == 0 and subjects.composition(d, lab, areas).count() == 3


def test_every_labelled_document_trains(spark):
    ids = [r["id"] for r in spark.range(5200).orderBy(F.xxhash64("id")).collect()]  # the last ones bear an area of their own
    rows = [(n, f"The court hears case{n % 2} in town. The verdict follows the appeal." if at < 5190 else "The glacier feeds reefs below. A drought follows rainfall there.") for at, n in enumerate(ids)]
    docs, areas = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("law",), ("climate",)], "subject_area string")
    labels = spark.createDataFrame([(n, "law" if at < 5190 else "climate") for at, n in enumerate(ids)], "doc_id bigint, subject_area string")
    model = subjects.train(docs, labels, areas)
    law, climate = model.areas.index("law"), model.areas.index("climate")
    assert model.single[model.words["glacier"]][climate] > 0 > model.single[model.words["glacier"]][law]
    told_areas = [r["areas"] for r in subjects.classify(docs.filter(F.col("doc_id").isin(ids[5190:])), model).collect()]
    assert told_areas == [["climate"]] * 10
