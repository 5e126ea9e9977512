"""The k most similar vectors of every vector, by an inverted multi-index (problem 3).

The two halves of the normalised vectors are quantised separately, with ``K`` centroids each trained on a
bounded sample; ``K`` grows with the square root of the rows, so the entries of a cell stay the same. A vector's
cell is its pair of nearest centroids; every vector is indexed. A query visits centroid pairs in the order of
summed distance, drawn from a heap, until the visited cells hold enough entries; the entries are then ranked by
their exact cosine. A cell with more than a block of entries has an index of its own, trained on the sample's
vectors in it, whose cells a query visits in the same way: where a third of all vectors lie in one cell, a
query still meets about as many entries as elsewhere. What stays dense even then (vectors that hardly differ) is
cut into blocks on many tasks. Equal vectors are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweft.session import by_size, cut

#: Training sees at most this many vectors, chosen by a hash of their id; indexing sees all.
SAMPLE = 20_000


def usable(entities: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, vec binary)``: unit vectors as float32 bytes, of rows with ``dim`` finite numbers that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = values.reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            ids = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array([row.tobytes() for row in unit], pa.binary())], names=["id", "vec"])

    sized = entities.filter(F.col(key).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))
    return sized.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, f"id {dict(entities.dtypes)[key]}, vec binary")


def _lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class MultiIndex:
    """Two codebooks; ``children`` are indexes of single cells, whose cells are numbered from ``offset[cell]`` on."""

    left: np.ndarray
    right: np.ndarray
    children: dict[int, MultiIndex] = field(default_factory=dict)
    offset: dict[int, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.left) * len(self.right) + sum(len(c.left) * len(c.right) for c in self.children.values())

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        part = lambda a, c: (a**2).sum(1, keepdims=True) - 2 * a @ c.T + (c**2).sum(1)
        return part(x[:, :h], self.left), part(x[:, h:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        found = a.argmin(1) * len(self.right) + b.argmin(1)
        for cell, child in self.children.items():
            rows = np.flatnonzero(found == cell)
            if len(rows):
                found[rows] = self.offset[cell] + child.cells(x[rows])
        return found

    def add(self, cell: int, child: MultiIndex) -> None:
        self.offset[cell] = self.size
        self.children[cell] = child

    def visit(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, entries: int, least: int, x: np.ndarray | None = None, shift: int = 0) -> list[int]:
        """Cells in the order of ``a[i] + b[j]`` until ``least`` cells that are not empty and ``entries`` entries are met.

        ``x`` is the query, needed where cells have indexes of their own; ``shift`` is added to cell numbers.
        """
        i_order, j_order = a.argsort(kind="stable"), b.argsort(kind="stable")
        heap, met, found, width = [(float(a[i_order[0]] + b[j_order[0]]), 0, 0)], 0, [], len(self.right)
        while heap and (met < entries or len(found) < least):
            _, i, j = heapq.heappop(heap)
            cell = int(i_order[i]) * width + int(j_order[j])
            child = self.children.get(cell)
            if child is not None:
                near, far = child.distances(x[None])
                inner = child.visit(near[0], far[0], counts, max(1, entries - met), 1, shift=self.offset[cell])
                found += inner
                met += int(counts[inner].sum())
            elif counts[shift + cell]:
                found.append(shift + cell)
                met += counts[shift + cell]
            # each pair enters the heap once: along a row, and down the first column
            if j + 1 < len(j_order):
                heapq.heappush(heap, (float(a[i_order[i]] + b[j_order[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(i_order):
                heapq.heappush(heap, (float(a[i_order[i + 1]] + b[j_order[0]]), i + 1, 0))
        return found


def _codebooks(x: np.ndarray, n: int, entries_per_cell: int, per_centroid: int) -> MultiIndex:
    k = min(max(1, len(x) // per_centroid), max(1, round((n / entries_per_cell) ** 0.5)))
    h = x.shape[1] // 2
    return MultiIndex(_lloyd(x[:, :h], k), _lloyd(x[:, h:], k))


def train(vectors: DataFrame, n: int, sample: int = SAMPLE, entries_per_cell: int = 20, per_centroid: int = 16) -> tuple[MultiIndex, np.ndarray]:
    """Codebooks from at most ``sample`` vectors, and these; ``K`` grows with the square root of the rows, to a centroid for each ``per_centroid`` vectors of the sample."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    x = np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), np.float32).reshape(len(rows), -1)
    return _codebooks(x, n, entries_per_cell, per_centroid if len(x) > 64 else 1), x


def divide(index: MultiIndex, x: np.ndarray, counts: np.ndarray, block: int, entries_per_cell: int = 20, per_centroid: int = 16) -> bool:
    """Give an index of its own to each cell with more than ``block`` entries, trained on the sample's vectors in it. Says whether any got one."""
    own = index.cells(x)
    for cell in np.flatnonzero(counts > block).tolist():
        mine = x[own == cell]
        if len(mine) >= 4 * per_centroid:
            index.add(cell, _codebooks(mine, int(counts[cell]), entries_per_cell, per_centroid))
    return bool(index.children)


def _floats(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def search(vectors: DataFrame, k: int, *, entries: int = 1000, least_cells: int = 6, block: int = 4096) -> DataFrame:
    """``(id, found array<struct<away double, id>>)``: the k most similar others of each row of ``(id, vec)``, nearest first.

    ``away`` is the negative cosine, so arrays sort by it and then by id.
    """
    kind = dict(vectors.dtypes)["id"]
    n = vectors.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, found array<struct<away: double, id: {kind}>>")
    index, learned = train(vectors, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(_floats(batch.column(1))), pa.int64())], names=["id", "vec", "cell"])

    def placed() -> tuple[DataFrame, np.ndarray]:
        rows, found = cut(vectors.mapInArrow(assign, f"id {kind}, vec binary, cell long")), np.zeros(index.size, np.int64)
        for row in rows.groupBy("cell").count().collect():  # a row for each cell; their number is bounded by the sample's size
            found[row["cell"]] = row["count"]
        return rows, found

    indexed, counts = placed()
    if divide(index, learned, counts, block):
        indexed, counts = placed()
    parts = np.maximum(1, -(-counts // block))
    wide = int(parts.max())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _floats(batch.column(1))
            a, b = index.distances(x)
            rows, blocks = [], []
            for r in range(len(batch)):
                for cell in index.visit(a[r], b[r], counts, entries, least_cells, x[r]):
                    for part in range(parts[cell]):
                        rows.append(r)
                        blocks.append(cell * wide + part)
            for at in range(0, len(rows), 20_000):  # each probe carries its vector
                take = pa.array(rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(blocks[at : at + 20_000], pa.int64()), pa.array([True] * len(take)), batch.column(0).take(take), batch.column(1).take(take)], names=["block", "query", "id", "vec"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_numpy()
            blocks = cells * wide + batch.column(3).to_numpy() % parts[cells]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([False] * len(batch)), batch.column(0), batch.column(1)], names=["block", "query", "id", "vec"])

    shape = f"block long, query boolean, id {kind}, vec binary"
    stored = indexed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).mapInArrow(place, shape)
    asked = indexed.select("id", "vec").mapInArrow(probe, shape)
    tasks = by_size(vectors.sparkSession, n * (least_cells + 1), 200_000)
    grouped = stored.unionByName(asked).repartition(tasks, "block").sortWithinPartitions("block", "query")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held_ids, held = None, [], []
        base, names = None, None
        for batch in batches:
            blocks, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, x = batch.column(2).to_numpy(zero_copy_only=False), _floats(batch.column(3)) if len(batch) else None
            edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1), len(batch)]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if blocks[s] != current:
                    current, held_ids, held, base = blocks[s], [], [], None
                if not query[s]:
                    held_ids.append(ids[s:e])
                    held.append(x[s:e])
                    base = None
                    continue
                if not held:
                    continue
                if base is None:
                    base, names = np.concatenate(held), np.concatenate(held_ids)
                    order = np.argsort(names, kind="stable")
                    base, names = base[order], names[order]
                for at in range(s, e, 1024):
                    stop = min(e, at + 1024)
                    cosine = x[at:stop] @ base.T
                    cosine[ids[at:stop, None] == names[None, :]] = -2
                    keep = min(k, len(names))
                    best = np.argpartition(-cosine, keep - 1, axis=1)[:, :keep] if keep < len(names) else np.tile(np.arange(len(names)), (stop - at, 1))
                    value = np.take_along_axis(cosine, best, 1).astype(np.float64)
                    real = value > -2
                    ends = np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32)
                    inner = pa.StructArray.from_arrays([pa.array(-value[real]), pa.array(names[best[real]], batch.schema.types[2])], names=["away", "id"])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:stop], batch.schema.types[2]), pa.ListArray.from_arrays(pa.array(ends), inner)], names=["id", "part"])

    ranked = grouped.mapInArrow(rank, f"id {kind}, part array<struct<away: double, id: {kind}>>")
    return ranked.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("part"))), 1, k).alias("found"))


def neighbours(
    entities: DataFrame, key: str = "entity_id", vector: str = "embedding", *, k: int = 5, dim: int = 96, **how: int,
) -> DataFrame:
    """``(key, neighbour, rank, cosine)``: the k most similar other rows of each usable row; ties go to the smaller key.

    Vectors that are null, of another length, all zero or with a null or infinite number, and rows with a null
    key, take no part. Equal directions are one vector to the index; afterwards each of its rows gets the others
    with cosine 1, so a vector shared by a third of all rows costs one query. An empty table gives no rows.
    """
    unit = cut(usable(entities.select(key, vector), key, vector, dim).withColumn("same", F.md5("vec")))
    order = Window.partitionBy("same").orderBy("id")
    first = cut(unit.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= k + 1))
    distinct = first.filter("no = 1").select("id", "vec")
    near = search(distinct, k, **how)
    kept = first.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("lead"))
    leads = kept.select("lead", "same", "ids")
    others = near.select(F.col("id").alias("lead"), F.explode("found").alias("f")).select("lead", F.col("f.away").alias("away"), F.col("f.id").alias("other"))
    spread = others.join(leads.select(F.col("lead").alias("other"), "ids"), "other").select("lead", "away", F.explode("ids").alias("id"))
    own = leads.filter(F.size("ids") > 1).select("lead", F.lit(-1.0).alias("away"), F.explode("ids").alias("id"))
    lists = spread.unionByName(own).groupBy("lead").agg(F.slice(F.sort_array(F.collect_list(F.struct("away", "id"))), 1, k + 1).alias("found"))
    found = lists.join(leads.select("lead", "same"), "lead").select("same", "found")
    each = unit.select(F.col("id").alias("me"), "same").join(found, "same").select("me", F.slice(F.filter("found", lambda x: x["id"] != F.col("me")), 1, k).alias("found"))
    return each.select(F.col("me").alias(key), F.posexplode("found").alias("no", "f")).select(
        key, F.col("f.id").alias("neighbour"), (F.col("no") + 1).alias("rank"), (-F.col("f.away")).alias("cosine")
    )


def pairs(found: DataFrame, key: str = "entity_id", least: float = 0.8) -> DataFrame:
    """``(entity_a, entity_b)``: pairs with a cosine of at least ``least``, smaller key first, each once."""
    return (
        found.filter(F.col("cosine") >= least)
        .select(F.least(key, "neighbour").alias("entity_a"), F.greatest(key, "neighbour").alias("entity_b")).distinct()
    )


def recall(found: DataFrame, entities: DataFrame, key: str = "entity_id", vector: str = "embedding", *, k: int = 5, dim: int = 96, every: int = 20) -> float:
    """Share of the true k nearest (brute force, for keys divisible by ``every``, against all rows in blocks) that ``found`` holds."""
    unit = usable(entities.select(key, vector), key, vector, dim)
    asked = [(r["id"], np.frombuffer(bytes(r["vec"]), np.float32)) for r in unit.filter(F.col("id") % every == 0).collect()]
    if not asked:
        return 1.0
    ids, x = np.array([i for i, _ in asked]), np.stack([v for _, v in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                names, base = batch.column(0).to_numpy(), _floats(batch.column(1))
                cosine = x @ base.T
                cosine[ids[:, None] == names[None, :]] = -2
                best = np.argsort(-cosine, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(names[best].ravel()), pa.array(np.take_along_axis(cosine, best, 1).astype(float).ravel())], names=["id", "other", "cosine"])

    top = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    truth = unit.mapInArrow(run, "id long, other long, cosine double").withColumn("no", F.row_number().over(top)).filter((F.col("no") <= k) & (F.col("cosine") > -2))
    hit = truth.join(found.select(F.col(key).alias("id"), F.col("neighbour").alias("other"), F.lit(1).alias("hit")), ["id", "other"], "left")
    return float(hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0])
