"""Deduplicating new batches against all accepted history, with stored immutable suffix arrays (problem 1).

:class:`Index` is a folder of segments. Appending a batch writes one segment: the sorted suffix array of the
batch's concatenated titles and abstracts, and the facts and classes of its records. Arrays lie in buckets by
their leading characters, so a new batch is shuffled to the buckets and its substrings are looked up there by
binary search in every live segment; of the history nothing is read but these slices and the few records
that a substring leads to. Segments of one size are merged in pairs, so their number stays logarithmic.
What matches cover is summed by record and earlier record; titles, ids and the coverage then decide, and
where the coverage found is not enough yet, the two abstracts themselves are compared.

A suffix is kept to ``DEPTH`` bytes at content-chosen places: the minimizers of windows of ``w`` grams of
``g`` bytes. Two equal passages choose equal places whatever stands around them, and a passage of
``w + g - 1`` bytes holds a place in its first ``w`` bytes; so every common passage of ``LEAST + w - 1``
bytes (47 of an abstract, 13 of a title; white space, punctuation and markup don't count) leads from one
record to the other. Longer matches are pieced together from the places within them.

Equal suffixes of records with one title are one entry, borne by the first of them, so a hot paper is few
entries. A match held by up to ``FEW`` titles leads to all of them, one held by more to the first holder of its
passage, of the record's own title and of the records without a title. The rest is not lost: beside its array a
segment stores which records hold each passage, all of them, and a record meets every earlier holder of its
passages whose title (by words in common, as equal or a slip apart) can be that of its paper.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweft.llm.titles import _SMALL, alike, told
from kgweft.session import checkpoint_dir, cut, parallelism, ship

DEPTH = 48
#: Bytes that must agree before a suffix counts as a match, by field.
LEAST = {"t": 10, "a": 32}
#: Lengths at which a match is looked for, longest first; titles, ids and titles of short records match in full only.
_DEPTHS = {"t": (40, 32, 26, 20, 16, 13, 10), "a": (48, 32), "k": (32,), "s": (32,), "i": (32,)}
FEW = 8
#: Below this size an abstract says nothing.
SHORT = 40
_GRAM, _WINDOW = 8, {"t": 4, "a": 16}
_NOISE = re.compile(r"<[^<>]*>|&[a-z]{2,8};|&#\w+;|\\[A-Za-z]+\*?|https?://\S+")
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(_GRAM)], dtype=np.uint64)
_FACTS = {"idbase": "string", "core": "string", "marks": "string", "general": "boolean", "n": "int"}
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}


def stream(text: str | None) -> str:
    """Letters and digits of a text in lower case, without markup."""
    return "".join(re.findall(r"[^\W_]+", _NOISE.sub(" ", text).lower())) if text else ""


def places(raw: np.ndarray, window: int) -> np.ndarray:
    """Offsets of the minimizers of a byte stream: the places with the least hash in some window."""
    if len(raw) <= _GRAM:
        return np.zeros(1 if len(raw) else 0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(raw, _GRAM).astype(np.uint64)
    with np.errstate(over="ignore"):
        hashes = (grams * _WEIGHTS).sum(1, dtype=np.uint64)
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    if len(hashes) <= window:
        return np.array([int(hashes.argmin())])
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(1) + np.arange(len(hashes) - window + 1))


def prepare(papers: DataFrame) -> DataFrame:
    """One row a record: ``rec, batch, idbase, core, marks, general, ts, abs`` (streams), ``n`` (bytes of ``abs``), hashes of title and marks, and ``same``, a digest of all but the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, title, abstract in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                core, marks, general = told(title)
                rows.append((re.sub(r"v\d+$", "", i.strip()) if i else "", core, marks, general, stream(title), stream(abstract)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array([r[k] for r in rows], pa.bool_() if k == 3 else pa.string()) for k in range(6)]],
                names=["rec", "batch", "idbase", "core", "marks", "general", "ts", "abs"],
            )

    chosen = papers.filter(F.col("rec_id").isNotNull()).select(F.col("rec_id").alias("rec"), F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch"), "id", "title", "abstract")
    spread = chosen.repartition(parallelism(papers.sparkSession))
    out = spread.mapInArrow(run, "rec long, batch int, idbase string, core string, marks string, general boolean, ts string, abs string")
    return out.select(
        "*", F.octet_length("abs").alias("n"), F.xxhash64("core", "marks").alias("title"), F.xxhash64("marks").alias("issue"),
        F.md5(F.concat_ws("|", "ts", "abs", "marks")).alias("same"),
    )


def suffixes(heads: DataFrame, buckets: int) -> DataFrame:
    """``rec, title, issue, bare, tail, lead, gap, bucket``: sampled suffixes, and the keys of title and id. ``lead`` is the hash of what must agree, ``gap`` the text up to the next place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_row, tails, leads, gaps = [], [], [], []
            columns = {k: batch.column(k).to_pylist() for k in ("ts", "abs", "idbase", "core", "marks", "n")}
            for r, (ts, ab, idbase, core, marks, n) in enumerate(zip(*columns.values(), strict=True)):
                for field, text in (("t", ts), ("a", ab)):
                    raw, least, code = text.encode(), LEAST[field], field.encode()
                    at = places(np.frombuffer(raw, np.uint8), _WINDOW[field]).tolist()
                    for p, q in zip(at, [*at[1:], len(raw)], strict=False):
                        if len(raw) - p >= least:
                            at_row.append(r)
                            tails.append(code + raw[p : p + DEPTH])
                            leads.append(code + raw[p : p + least])
                            gaps.append(q - p)
                keys = [("k", f"{core}|{marks}"), *([("s", f"{core}|{marks}")] if n < SHORT else [])] if core else []
                for field, key in keys + ([("i", f"{idbase}|{marks}")] if idbase else []):
                    at_row.append(r)
                    tails.append((field + hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()).encode())
                    leads.append(tails[-1])
                    gaps.append(0)
            take = pa.array(at_row, pa.int64())
            bare = pc.equal(batch.column("core"), "")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("rec", "title", "issue")], bare.take(take), pa.array(tails, pa.binary()), pa.array(leads, pa.binary()), pa.array(gaps, pa.int32())],
                names=["rec", "title", "issue", "bare", "tail", "lead", "gap"],
            )

    given = heads.select("rec", "title", "issue", "ts", "abs", "idbase", "core", "marks", "n")
    rows = given.mapInArrow(run, "rec long, title long, issue long, bare boolean, tail binary, lead binary, gap int")
    return rows.withColumn("lead", F.xxhash64("lead")).withColumn("bucket", F.pmod("lead", F.lit(buckets)).cast("int"))


def _rows_of(uri: str, bucket: int, columns: list[str], only: list | None = None) -> pa.Table | None:
    """One bucket of a stored table, read where it is needed; ``only`` picks records by their number."""
    files, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    path = f"{path}/bucket={bucket}"
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    found = pads.dataset(path, format="parquet", filesystem=files)
    return found.to_table(columns=columns, filter=None if only is None else pc.field("rec").isin(only))


class Slice:
    """One bucket of a segment's suffix array: sorted tails, and of each its title, marks and first record."""

    def __init__(self, tails: np.ndarray, title: np.ndarray, issue: np.ndarray, bare: np.ndarray, rec: np.ndarray):
        self.tails, self.title, self.issue, self.bare, self.rec = tails, title, issue, bare, rec

    @classmethod
    def of(cls, table: pa.Table) -> Slice:
        tails = np.array(table["tail"].to_pylist(), dtype=f"S{DEPTH + 1}")
        return cls(tails, *(table[c].to_numpy() for c in ("title", "issue", "bare", "rec")))

    def part(self, rows: np.ndarray | slice) -> Slice:
        return Slice(self.tails[rows], self.title[rows], self.issue[rows], self.bare[rows], self.rec[rows])

    def matches(self, asked: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row of asked, record, length)`` of the longest matches with earlier records whose marks allow it."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for field, depths in _DEPTHS.items():
            low, high = np.searchsorted(self.tails, [field.encode(), chr(ord(field) + 1).encode()])
            held = self.part(slice(low, high))
            todo = np.flatnonzero(asked.tails.astype("S1") == field.encode())
            for depth in depths:
                if not len(todo) or not len(held.tails):
                    break
                found = held._at(asked, todo, depth, field != "t")
                out.append(found)
                todo = np.setdiff1d(todo, found[0])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _at(self, asked: Slice, todo: np.ndarray, depth: int, firsts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads = self.tails.astype(f"S{depth + 1}")
        starts = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
        sizes = np.diff(np.append(starts, len(heads)))
        keys, wanted = heads[starts], asked.tails[todo].astype(f"S{depth + 1}")
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        rows, group = todo[hit], at[hit]
        few = sizes[group] <= FEW
        q, e = rows[few], group[few]
        times = sizes[e]
        q, entry = np.repeat(q, times), np.repeat(starts[e] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        pairs = [self._allowed(asked, q, entry)]
        if not few.all():
            pairs += self._crowded(asked, rows[~few], group[~few], np.repeat(np.arange(len(starts)), sizes), sizes, firsts)
        q, rec = (np.concatenate(x) for x in zip(*pairs, strict=True))
        earlier = rec < asked.rec[q]
        return q[earlier], rec[earlier], np.full(int(earlier.sum()), depth)

    def _allowed(self, asked: Slice, q: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = (self.issue[entry] == asked.issue[q]) | self.bare[entry] | asked.bare[q]
        return q[fits], self.rec[entry[fits]]

    def _crowded(self, asked: Slice, q: np.ndarray, group: np.ndarray, of: np.ndarray, sizes: np.ndarray, firsts: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Holders of matches under many titles; every entry is looked at once however many ask for its group."""
        rows = np.flatnonzero(sizes[of] > FEW)
        held = pd.DataFrame({"group": of[rows], "issue": self.issue[rows], "title": self.title[rows], "bare": self.bare[rows], "rec": self.rec[rows]})
        wants = pd.DataFrame({"q": q, "group": group, "issue": asked.issue[q], "title": asked.title[q], "bare": asked.bare[q]})
        found = []

        def meet(left: pd.DataFrame, right: pd.DataFrame, on: list[str]) -> None:
            met = left.merge(right, on=on)
            found.append((met["q"].to_numpy(np.int64), met["rec"].to_numpy(np.int64)))

        titled = wants[~wants["bare"]]
        many = held.groupby(["group", "issue"])["rec"].transform("size") > FEW
        meet(titled[["q", "group", "issue"]], held[~many][["group", "issue", "rec"]], ["group", "issue"])
        meet(titled[["q", "group", "title"]], held[many].groupby(["group", "title"], as_index=False)["rec"].min(), ["group", "title"])
        meet(wants[["q", "group"]], held[held["bare"]].groupby("group", as_index=False)["rec"].min(), ["group"])
        if firsts:
            meet(titled[["q", "group", "issue"]], held[many].groupby(["group", "issue"], as_index=False)["rec"].min(), ["group", "issue"])
            meet(wants[wants["bare"]][["q", "group"]], held.groupby("group", as_index=False)["rec"].min(), ["group"])
        return found


def _entries(rows: DataFrame) -> DataFrame:
    """What an array holds: of each tail the first record of each title, and of titles alike in marks the first ``FEW`` and one.

    More would not be led to by the array, so there a passage with a third of all records is a few entries; the
    rest are met through :func:`_leads`. The limit works before the shuffle too.
    """
    first = rows.groupBy("bucket", "tail", "issue", "title").agg(F.min("rec").alias("rec"), F.first("bare").alias("bare"))
    order = Window.partitionBy("bucket", "tail", "issue").orderBy("rec", "title")
    return first.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= FEW + 1).drop("no")


def _leads(rows: DataFrame) -> DataFrame:
    """Every record that holds a passage or key, once, from :func:`suffixes`."""
    field = F.substring("tail", 1, 1).cast("string")
    body = F.sum(F.when(field == "a", F.least("gap", F.lit(LEAST["a"]))).otherwise(0)).alias("body")
    return rows.groupBy("bucket", "lead", "rec").agg(F.first("issue").alias("issue"), F.first("bare").alias("bare"), F.first(field).alias("field"), body)


def _titled(facts: DataFrame) -> DataFrame:
    """``rec, n, words, kin, again, size, letters, extra, bins``: what tells whether two titles can be alike, from ``rec, core, n``.

    ``words`` are hashes of the words that say something, ``kin`` those of all words of any title here that equal one
    of them or are a slip apart: such words leave the same letters when each has one taken out.
    ``bins`` counts the letters by ``_BINS``, six bits each.
    """
    every = F.filter(F.split("core", " "), lambda w: w != "")
    given = facts.withColumn("every", every).withColumn("words", F.filter("every", lambda w: ~w.isin(*sorted(_SMALL))))
    word = given.select(F.explode("words").alias("word")).distinct()
    less = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    left = word.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), less))).alias("less"))
    kin = left.join(left.withColumnRenamed("word", "kin"), "less").groupBy("word").agg(F.collect_set(F.xxhash64("kin")).alias("kin"))
    of = given.select("rec", F.explode("words").alias("word")).distinct().join(kin, "word").groupBy("rec").agg(F.array_distinct(F.flatten(F.collect_list("kin"))).alias("kin"))
    letters = lambda c: F.length(F.array_join(c, ""))
    count = lambda kinds: F.least(letters("every") - F.length(F.translate(F.array_join("every", ""), kinds, "")), F.lit(63)).cast("long")
    bins = reduce(lambda a, b: a + b, [F.shiftleft(count(kinds), 6 * k) for k, kinds in enumerate(_BINS)])
    return given.join(of, "rec", "left").select(
        "rec", "n", F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("words"), F.coalesce("kin", F.array().cast("array<bigint>")).alias("kin"),
        (F.size("words") - F.size(F.array_distinct("words"))).alias("again"), F.size("words").alias("size"), letters("every").alias("letters"), (letters("every") - letters(F.array_distinct("every"))).alias("extra"), bins.alias("bins"),
    )


#: Kinds of letters whose numbers a slip changes by two at most; others are not counted.
_BINS = ("e", "a", "i", "o", "n", "t", "r", "s", "lcdupm", "hgbfvykwjxqz0123456789")
_APART = " + ".join(f"abs((shiftright(x.bins, {6 * k}) & 63) - (shiftright(y.bins, {6 * k}) & 63))" for k in range(len(_BINS)))
#: No less than titles that are 0.4 alike, or beside a short abstract 0.8 or a word apart: words in common, or the same letters but for a slip where spaces are misplaced.
_NEAR = (
    f"20 * (size(array_intersect(y.words, x.kin)) + y.again) >= IF(least(x.n, y.n) < {SHORT}, 15, 8) * greatest(x.size, y.size) "
    f"OR abs(x.letters - y.letters) <= 1 + greatest(x.extra, y.extra) AND {_APART} <= 2 + x.extra + y.extra"
)


def common(later: str, earlier: str, size: int = LEAST["a"], least: float = 0.0) -> int:
    """Bytes of ``later`` in passages of at least ``size`` bytes that stand in ``earlier``; 0 where they are surely fewer than ``least``."""
    x, y = later.encode(), earlier.encode()
    if least > 0:
        # Such a passage holds a whole block of half its size and ends in one of the neighbours at most.
        half = size // 2
        held = (k for k in range(len(x) // half) if x[k * half : k * half + half] in y)
        if half * len({n for k in held for n in (k - 1, k, k + 1)}) < least:
            return 0
    grams = {y[i : i + size] for i in range(len(y) - size + 1)}
    total = end = 0
    for i in range(len(x) - size + 1):
        if x[i : i + size] in grams:
            total += i + size - max(i, end)
            end = i + size
    return total


def needed(a: dict, b: dict) -> float | None:
    """Bytes of the later abstract that the earlier must cover for the two records to be one paper; null where none are enough."""
    shorter = min(a["n"], b["n"])
    same_id = bool(a["idbase"]) and a["idbase"] == b["idbase"]
    if not a["core"] or not b["core"]:
        share = 0.3 if same_id else 0.6
        return share * shorter if shorter >= SHORT else None
    if a["marks"] != b["marks"]:
        return None
    title = alike(a["core"], b["core"])
    if title >= 0.8 and not (a["general"] or b["general"]):
        return 0.0 if same_id or shorter < SHORT else 0.15 * shorter
    if shorter < SHORT or title < 0.4:
        return None
    if a["general"] or b["general"]:
        return 0.5 * shorter if title >= 0.8 else None
    return 0.85 * shorter


def components(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """``(rec, first)`` for every record of ``edges`` (``rec``, ``old``): the smallest record that links lead to. Ends when nothing changes."""
    both = cut(edges.select("rec", F.col("old").alias("to")).unionByName(edges.select(F.col("old").alias("rec"), F.col("rec").alias("to"))))
    label = both.groupBy("rec").agg(F.least(F.first("rec"), F.min("to")).alias("first"))
    for _ in range(rounds):
        told_by = both.join(label.select(F.col("rec").alias("to"), "first"), "to").select("rec", "first", F.lit(None).cast("long").alias("was"))
        heard = told_by.unionByName(label.select("rec", "first", F.col("first").alias("was"))).groupBy("rec").agg(F.min("first").alias("first"), F.min("was").alias("was"))
        further = heard.select(F.col("rec").alias("first"), F.col("first").alias("further"))
        label = cut(heard.join(further, "first", "left").select("rec", "was", F.least("first", F.coalesce("further", "first")).alias("first")))
        if label.filter("first <> was").isEmpty():
            return label.select("rec", "first")
        label = label.select("rec", "first")
    return components(edges, rounds * 2)


class Index:
    """Accepted history in a folder that all executors share (a path that Spark and pyarrow both open).

    Each append is one writer's; readers see whole versions, as the manifest that names the live segments is
    written last. Files are never changed: a task that runs again after a loss reads the same.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, entries_per_bucket: int = 100_000):
        ship(spark)
        self.spark, self.entries_per_bucket = spark, entries_per_bucket
        self.folder = (folder or f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}").rstrip("/")

    # -- versions ---------------------------------------------------------------------------------------------------------

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def segments(self) -> list[dict]:
        """Live segments: ``name, rows, arrays`` (buckets), ``records`` (buckets)."""
        files, path = self._files()
        if not files.exists(path(self.folder)):
            return []
        versions = [s.getPath().getName() for s in files.listStatus(path(self.folder)) if s.getPath().getName().startswith("manifest_")]
        if not versions:
            return []
        last = max(versions, key=lambda v: int(v[9:]))
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/{last}", 1).first()[1])

    def _publish(self, live: list[dict]) -> None:
        files, path = self._files()
        known = [s.getPath().getName() for s in files.listStatus(path(self.folder))]
        number = 1 + max([int(v[9:]) for v in known if v.startswith("manifest_")], default=0)
        out = files.create(path(f"{self.folder}/manifest_{number}"), False)
        out.write(bytearray(json.dumps(live).encode()))
        out.close()

    def _write(self, rows: DataFrame, segment: dict, name: str, order: list[str]) -> None:
        suffixed = name in ("arrays", "leads")
        buckets = segment["arrays" if suffixed else "records"]
        told_rows = rows if suffixed else rows.withColumn("bucket", F.pmod(F.xxhash64("rec"), F.lit(buckets)).cast("int"))
        placed = told_rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", *order)
        placed.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/{segment['name']}/{name}")

    def _segment(self, rows: int) -> dict:
        power = lambda n: 1 << max(3, (max(1, n) - 1).bit_length())
        return {"name": f"segment-{uuid.uuid4().hex}", "rows": rows, "arrays": power(rows * 100 // self.entries_per_bucket), "records": power(rows // self.entries_per_bucket)}

    # -- a batch ----------------------------------------------------------------------------------------------------------

    def append(self, papers: DataFrame) -> DataFrame:
        """Accept records (``rec_id, batch_no, id, title, abstract``) and give ``(rec_id, batch_no, first_rec_id)`` of each.

        ``first_rec_id`` is the smallest record of its paper among all that were accepted before and those of the
        same delivery. Answers given stay: two accepted papers that a later record joins remain two, and that record
        has the smaller. Record numbers must rise from delivery to delivery.

        Nulls: a null id, title or abstract says nothing; a null batch is history (0); rows with a null ``rec_id`` are
        left out. Records with equal streams and marks are searched once. A repeated row has its paper's class.
        Extra columns are ignored; an empty table gives no rows.
        """
        records = cut(prepare(papers))
        columns = [c for c in records.columns if c != "same"]
        heads = cut(records.groupBy("same").agg(F.min_by(F.struct(*columns), "rec").alias("h")).select("same", *[f"h.{c}" for c in columns]))
        own = self._segment(heads.count())
        if not own["rows"]:
            return self.spark.createDataFrame([], "rec_id long, batch_no int, first_rec_id long")
        live = self.segments()
        self._write(_entries(suffixes(heads, own["arrays"])), own, "arrays", ["tail", "title"])
        self._write(heads.select("rec", "abs", *_FACTS), own, "facts", ["rec"])
        asked = cut(_leads(suffixes(heads, own["arrays"])))
        self._write(asked.select("bucket", "lead", "rec", "issue", "bare"), own, "leads", ["lead", "rec"])
        met = self._search(heads, [*live, own]).unionByName(self._holders(asked, heads, [*live, own]))
        links = self._judge(met.groupBy("rec", "old").agg(F.max("body").alias("body")), heads, [*live, own])
        known = self._fetch(links.select("rec", "old"), live, "classes", {"first": "long"})
        edges = known.select("rec", F.coalesce("first", "old").alias("old"))
        copied = records.join(heads.select("same", F.col("rec").alias("old")), "same").filter("rec > old")
        certain = copied.filter(~F.col("general") & (F.col("core") != "") | (F.col("n") >= SHORT)).select("rec", "old")
        label = components(edges.unionByName(certain))
        done = records.select("rec", "batch").distinct().join(label, "rec", "left").select("rec", "batch", F.coalesce("first", "rec").alias("first"))
        self._write(done, own, "classes", ["rec"])
        self._publish(self._merged([*live, own]))
        return self.spark.read.parquet(f"{self.folder}/{own['name']}/classes").select(F.col("rec").alias("rec_id"), F.col("batch").alias("batch_no"), F.col("first").alias("first_rec_id"))

    def _search(self, heads: DataFrame, live: list[dict]) -> DataFrame:
        """``(rec, old, body)``: earlier records that some substring of a record leads to, and the bytes of its abstract covered by matches with each."""
        folder, wide = self.folder, max(s["arrays"] for s in live)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if len(b)]
            if not parts:
                return
            whole = pa.Table.from_batches(parts)
            number = whole["bucket"].to_numpy()
            for bucket in np.unique(number):
                mine = whole.filter(pa.array(number == bucket))
                asked, gaps = Slice.of(mine), mine["gap"].to_numpy()
                on_body = asked.tails.astype("S1") == b"a"
                for segment in live:
                    stored = _rows_of(f"{folder}/{segment['name']}/arrays", int(bucket) % segment["arrays"], ["tail", "title", "issue", "bare", "rec"])
                    if stored is None or not len(stored):
                        continue
                    q, old, length = Slice.of(stored).matches(asked)
                    body = np.where(on_body[q], np.minimum(gaps[q], length), 0)
                    told_rows = pd.DataFrame({"rec": asked.rec[q], "old": old, "body": body}).groupby(["rec", "old"], as_index=False)["body"].sum()
                    yield pa.RecordBatch.from_pandas(told_rows, schema=pa.schema([("rec", pa.int64()), ("old", pa.int64()), ("body", pa.int64())]), preserve_index=False)

        asked = suffixes(heads, wide).repartitionById(wide, F.col("bucket"))
        return asked.mapInArrow(run, "rec long, old long, body long").groupBy("rec", "old").agg(F.sum("body").alias("body"))

    def _holders(self, asked: DataFrame, heads: DataFrame, live: list[dict]) -> DataFrame:
        """``(rec, old, body)``: every earlier record that shares a passage or key with a record and can be its paper by title; ``body`` as far as passages tell."""
        folder, wide = self.folder, max(s["arrays"] for s in live)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if len(b)]
            if not parts:
                return
            whole = pa.Table.from_batches(parts)
            number = whole["bucket"].to_numpy()
            for bucket in np.unique(number):
                wanted = whole["lead"].filter(pa.array(number == bucket)).combine_chunks()
                for segment in live:
                    stored = _rows_of(f"{folder}/{segment['name']}/leads", int(bucket) % segment["arrays"], ["lead", "rec", "issue", "bare"])
                    if stored is not None:
                        for met in stored.filter(pc.is_in(stored["lead"], value_set=wanted)).to_batches():
                            yield pa.RecordBatch.from_arrays(met.columns, names=met.schema.names)  # segments differ in what may be null

        leads = asked.select("lead").distinct().withColumn("bucket", F.pmod("lead", F.lit(wide)).cast("int")).repartitionById(wide, F.col("bucket"))
        stored = leads.mapInArrow(run, "lead long, rec long, issue long, bare boolean").withColumnRenamed("rec", "old")
        shared = Window.partitionBy("lead")
        held = cut(stored.withColumn("holders", F.count(F.lit(1)).over(shared)).filter("holders > 1").drop("holders"))
        old = self._fetch(held.select("old").distinct(), live, "facts", {"core": "string", "n": "int"}).withColumnRenamed("old", "rec")
        title = cut(_titled(old.unionByName(heads.select("rec", "core", "n")).dropDuplicates(["rec"])))
        told_title = lambda c, name: title.select(F.col("rec").alias(c), F.struct("n", "words", "again", "size", "letters", "extra", "bins", *(["kin"] if name == "x" else [])).alias(name))
        ask = asked.join(held.select("lead").distinct(), "lead", "left_semi").select("lead", "rec", "issue", "bare", "field", "body")
        ask, held = cut(ask.join(told_title("rec", "x"), "rec")), cut(held.join(told_title("old", "y"), "old"))
        x, y = ask, held.withColumnRenamed("bare", "old_bare")
        body, short = F.col("field") != "t", SHORT
        ways = [  # a passage of a title alone says enough only where an abstract is short
            x.filter(body & ~F.col("bare")).join(y.filter("NOT old_bare"), ["lead", "issue"]).filter("old < rec").filter(_NEAR),
            x.filter((F.col("field") == "t") & ~F.col("bare") & (F.col("x.n") < short)).join(y.filter("NOT old_bare"), ["lead", "issue"]).filter("old < rec").filter(_NEAR),
            x.filter((F.col("field") == "t") & ~F.col("bare") & (F.col("x.n") >= short)).join(y.filter(~F.col("old_bare") & (F.col("y.n") < short)), ["lead", "issue"]).filter("old < rec").filter(_NEAR),
            x.filter(body & F.col("bare")).join(y.drop("issue"), "lead").filter("old < rec"),
            x.filter(body & ~F.col("bare")).join(y.filter("old_bare").drop("issue"), "lead").filter("old < rec"),
        ]
        return reduce(DataFrame.unionByName, [w.select("rec", "old", "body") for w in ways]).groupBy("rec", "old").agg(F.sum("body").alias("body"))

    def _fetch(self, pairs: DataFrame, live: list[dict], table: str, columns: dict[str, str], then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, shape: str = "") -> DataFrame:
        """``pairs`` with the stored ``columns`` of ``old``, null where no segment has it. Reads only the records asked for.

        ``then`` makes rows of ``shape`` of a batch so completed, in the same process: a second one would take its memory beside the first.
        """
        if not live:
            bare = pairs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
            return bare.mapInArrow(lambda batches: map(then, batches), shape) if then else bare
        folder, wide = self.folder, max(s["records"] for s in live)
        schema = pa.schema([(c, _TYPES[t]) for c, t in columns.items()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                number, old = batch.column("bucket").to_numpy(), batch.column("old").to_numpy()
                held: list[pa.Table] = []
                for bucket in np.unique(number):
                    wanted = np.unique(old[number == bucket]).tolist()
                    for segment in live:
                        rows = _rows_of(f"{folder}/{segment['name']}/{table}", int(bucket) % segment["records"], ["rec", *columns], wanted)
                        if rows is not None and len(rows):
                            held.append(rows)
                known = pa.concat_tables(held) if held else pa.table({"rec": pa.array([], pa.int64()), **{f.name: pa.array([], f.type) for f in schema}})
                at = pc.index_in(batch.column("old"), known["rec"].combine_chunks())
                given = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "bucket"]
                whole = pa.RecordBatch.from_arrays(
                    [*given, *[pa.array(known[f.name].take(at).combine_chunks(), f.type) for f in schema]], names=[n for n in batch.schema.names if n != "bucket"] + list(columns)
                )
                yield then(whole) if then else whole

        told_pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("old"), F.lit(wide)).cast("int")).repartitionById(wide, F.col("bucket")).sortWithinPartitions("bucket")
        return told_pairs.mapInArrow(run, shape or ", ".join([*(f"`{n}` {t}" for n, t in pairs.dtypes), *(f"{c} {t}" for c, t in columns.items())]))

    def _judge(self, pairs: DataFrame, heads: DataFrame, live: list[dict]) -> DataFrame:
        """``(rec, old)``: pairs that are one paper. The abstracts themselves are compared where the matches found are not enough."""
        told_pairs = pairs.join(heads.select("rec", *[F.col(c).alias(f"own_{c}") for c in _FACTS]), "rec")

        def sides(batch: pa.RecordBatch) -> Iterator[tuple[dict, dict]]:
            mine, other = ([batch.column(f"{own}{c}").to_pylist() for c in _FACTS] for own in ("own_", ""))
            return ((dict(zip(_FACTS, a, strict=True)), dict(zip(_FACTS, b, strict=True))) for a, b in zip(zip(*mine, strict=True), zip(*other, strict=True), strict=True))

        def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
            body, need = batch.column("body").to_pylist(), [needed(a, b) for a, b in sides(batch)]
            most = pc.min_element_wise(batch.column("own_n"), batch.column("n")).to_pylist()
            sure = pa.array([x is not None and have >= x for have, x in zip(body, need, strict=True)], pa.bool_())
            keep = pa.array([x is not None and max(have, n) >= x for have, n, x in zip(body, most, need, strict=True)], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("old"), sure, pa.array(need, pa.float64())], names=["rec", "old", "sure", "need"]).filter(keep)

        def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = zip(*(batch.column(c) for c in ("own_abs", "abs", "need")), strict=True)
            keep = [common(x, y, least=need) >= need for x, y, need in (tuple(v.as_py() for v in row) for row in texts)]
            return batch.select(["rec", "old"]).filter(pa.array(keep, pa.bool_()))

        decided = cut(self._fetch(told_pairs, live, "facts", _FACTS, decide, "rec long, old long, sure boolean, need double"))
        left = decided.filter("NOT sure").select("rec", "old", "need").join(heads.select("rec", F.col("abs").alias("own_abs")), "rec")
        settled = self._fetch(left, live, "facts", {"abs": "string"}, compare, "rec long, old long")
        return cut(decided.filter("sure").select("rec", "old").unionByName(settled))  # read more than once

    # -- segments ---------------------------------------------------------------------------------------------------------

    def _merged(self, live: list[dict]) -> list[dict]:
        """Live segments after merging those of one level (a doubling of records) in pairs, as long as there are any."""
        while True:
            by_level: dict[int, list[dict]] = {}
            for s in live:
                by_level.setdefault(s["rows"].bit_length(), []).append(s)
            pair = next((found[:2] for found in by_level.values() if len(found) > 1), None)
            if pair is None:
                return live
            made = self._segment(pair[0]["rows"] + pair[1]["rows"])
            read = lambda name: reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{s['name']}/{name}") for s in pair]).drop("bucket")  # noqa: E731, B023
            size = F.when(F.substring("tail", 1, 1) == F.lit(b"t"), LEAST["t"] + 1).when(F.substring("tail", 1, 1) == F.lit(b"a"), LEAST["a"] + 1).otherwise(DEPTH)
            arrays = read("arrays").withColumn("bucket", F.pmod(F.xxhash64(F.substring("tail", F.lit(1), size)), F.lit(made["arrays"])).cast("int"))
            self._write(_entries(arrays), made, "arrays", ["tail", "title"])
            self._write(read("leads").withColumn("bucket", F.pmod("lead", F.lit(made["arrays"])).cast("int")), made, "leads", ["lead", "rec"])
            self._write(read("facts"), made, "facts", ["rec"])
            self._write(read("classes"), made, "classes", ["rec"])
            live = [s for s in live if s not in pair] + [made]


def deliveries(papers: DataFrame, each: bool = False, folder: str | None = None) -> DataFrame:
    """``(rec_id, batch_no, first_rec_id)`` of all records, through an index: the history first, then the later batches, in one delivery or (``each``) one by one."""
    index, batch = Index(papers.sparkSession, folder), F.coalesce("batch_no", F.lit(0))
    answers = [index.append(papers.filter(batch <= 0))]
    if each:
        numbers = sorted(r["batch_no"] for r in papers.filter(batch > 0).select("batch_no").distinct().collect())
        answers += [index.append(papers.filter(F.col("batch_no") == n)) for n in numbers]
    else:
        answers.append(index.append(papers.filter(batch > 0)))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def classes(papers: DataFrame) -> DataFrame:
    """``(rec_id, batch_no, first_rec_id)`` of every record; see :meth:`Index.append`."""
    return deliveries(papers)


def found(papers: DataFrame, each: bool = False) -> DataFrame:
    """``(first_rec_id, rec_id)`` of the records of later batches whose paper occurs before."""
    return deliveries(papers, each).filter((F.col("batch_no") >= 1) & (F.col("first_rec_id") < F.col("rec_id"))).select("first_rec_id", "rec_id")
