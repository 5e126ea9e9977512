"""Exact vector top-k, entity resolution and full-text ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweft.functions.vector import cosine
from kgweft.session import by_size


def vector_topk(vectors: DataFrame, query: list[float], k: int, *, key: str, vector: str) -> DataFrame:
    """``(key, score)``: the k rows most similar to one vector, all rows compared in generated code and cut as they are read."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(cosine(F.col(vector), asked), 6).alias("score")).filter(F.col("score").isNotNull())
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, *, key: str, vector: str, others_only: bool = True, rows_per_part: int = 100_000) -> DataFrame:
    """``(query, key, score, rank)`` for a set of queries against all rows; ties go to the smaller key.

    Rows are dealt into parts that fit a task; every query meets every part and takes its best k there, so nothing is
    held on the driver and what is shuffled after is k rows for each query and part. Vectors that are null, empty,
    zero or of another length than the query's are left out.
    """
    kind = dict(vectors.dtypes)[key]
    usable = lambda d: d.filter(F.size(vector) > 0).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"))
    held, asked = usable(vectors), usable(queries)
    parts = by_size(vectors.sparkSession, held.count(), rows_per_part)
    stored = held.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "dim", F.lit(False).alias("asks"), "id", "v")
    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dim", F.lit(True).alias("asks"), "id", "v")
    met = stored.unionByName(spread).repartition(parts, "part").sortWithinPartitions("part", "dim", "asks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, names, code, place, none = None, [], [], None, None, -(1 << 62)
        for batch in batches:
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            edges = [0, *[n for n in range(1, len(group)) if group[n] != group[n - 1]], len(group)]
            for at, end in zip(edges, edges[1:], strict=False):
                if at == end:
                    continue
                part, dim, asks = group[at]
                rows, ids = batch.column(4).slice(at, end - at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), batch.column(3).slice(at, end - at)
                size = np.linalg.norm(np.nan_to_num(rows, nan=np.inf), axis=1)
                good = (size > 0) & np.isfinite(size)
                rows, ids = rows[good] / size[good, None], ids.filter(pa.array(good))
                if (part, dim) != now:
                    now, block, names, code = (part, dim), [], [], None
                if not asks:
                    block.append(rows)
                    names.append(ids)
                    continue
                if not block or not len(rows) or not sum(map(len, names)):
                    continue
                if code is None:
                    base, own = np.concatenate(block), pa.concat_arrays(names)
                    distinct = pc.unique(own).sort()
                    code = pc.index_in(own, distinct).to_numpy()
                    place = np.empty(len(base), np.int64)
                    place[np.argsort(code, kind="stable")] = np.arange(len(base) - 1, -1, -1)
                mine, keep, step = pc.fill_null(pc.index_in(ids, distinct), -1).to_numpy(), min(k, len(base)), max(1, 20_000_000 // len(base))
                for b in range(0, len(rows), step):
                    score = np.rint(rows[b : b + step] @ base.T * 1e6).astype(np.int64) * len(base) + place  # equal scores: smaller key first
                    if others_only:
                        score[mine[b : b + step, None] == code[None, :]] = none
                    top = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(base) else np.tile(np.arange(len(base)), (len(score), 1))
                    value = np.take_along_axis(score, top, 1)
                    real = value > none
                    who = np.repeat(np.arange(b, b + len(score)), keep).reshape(-1, keep)[real]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), own.take(pa.array(top[real])), pa.array(np.floor_divide(value[real], len(base)) / 1e6)], names=["query", key, "score"])

    found = met.mapInArrow(best, f"query {kind}, `{key}` {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def resolve(candidates: DataFrame, nearest: DataFrame, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """``(key, resolved, merged)``: the nearest node of all takes a candidate over if it is of its type and near enough.

    ``candidates``: key, type. ``nearest``: key, node, node_type, score of the single nearest node of any type. The test
    comes after the choice: a nearest node of another type means no merge, though one of its own type may qualify.
    With ``keep`` those columns stand for the key, and ``resolved`` is null without a merge.
    """
    met = candidates.join(nearest, "key", "left")
    ok = F.coalesce((F.col("node_type") == F.col("type")) & (F.col("score") >= threshold), F.lit(False))
    return met.select(*(keep or ["key"]), F.when(ok, F.col("node")).otherwise(F.lit(None) if keep else F.col("key")).alias("resolved"), ok.alias("merged"))


def with_text(found: DataFrame, text: str = "text") -> DataFrame:
    """Results that have a text; fewer than k may be left, as the cut came first."""
    return found.filter(F.coalesce(F.col(text), F.lit("")) != "")


def bm25(docs: DataFrame, query: str, *, key: str, text: str, limit: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(key, score)`` of the documents with a query word, best first. One pass over the texts gives lengths and counts."""
    import re

    asked = sorted({w for w in re.split(r"[^a-z0-9]+", query.lower()) if w})
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")

    def count(word: str) -> Column:
        return F.size(F.filter("tokens", lambda t: t == word))

    counts = [count(w).alias(f"tf{n}") for n, w in enumerate(asked)]
    base = docs.select(F.col(key), tokens.alias("tokens")).select(key, F.size("tokens").alias("len"), *counts)
    names = [f"tf{n}" for n in range(len(asked))]
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in names])
    hit = base.filter(" OR ".join(f"{c} > 0" for c in names) if names else "false")
    score = F.lit(0.0)
    for c in names:
        idf = F.log(1 + (F.col("n") - F.col(f"df_{c}") + 0.5) / (F.col(f"df_{c}") + 0.5))
        score = score + idf * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    ranked = hit.crossJoin(F.broadcast(stats)).select(key, F.round(score, 6).alias("score"))  # one row of totals
    return ranked.orderBy(F.col("score").desc(), key).limit(limit) if limit else ranked


class FullText:
    """A stored inverted table: ``postings`` (term, key, times) in files by term, ``lengths``, and totals of both.

    A question reads the postings of its words only, and of the lengths those of the rows met.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def build(self, docs: DataFrame, *, key: str, text: str) -> FullText:
        """Index whole texts; null and empty ones have length 0 and no words."""
        words = docs.select(F.col(key).alias("key"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "").alias("words"))
        counted = words.select("key", F.explode("words").alias("term")).groupBy("term", "key").agg(F.count(F.lit(1)).alias("times"))
        placed = counted.withColumn("bucket", self._bucket(F.col("term"))).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term", "key")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings")
        words.select("key", F.size("words").alias("len")).write.mode("overwrite").parquet(f"{self.folder}/lengths")
        lengths = self.spark.read.parquet(f"{self.folder}/lengths")
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals")
        return self

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def search(self, query: str, *, key: str = "key", limit: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``(key, score)`` as :func:`bm25` gives it."""
        import re

        asked = sorted({w for w in re.split(r"[^a-z0-9]+", query.lower()) if w})
        wanted = self.spark.createDataFrame([(w,) for w in asked], "term string")
        buckets = [r[0] for r in wanted.select(self._bucket(F.col("term"))).distinct().collect()]  # of the question's words
        hits = self.spark.read.parquet(f"{self.folder}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(asked)).select("term", "key", "times")
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        totals = self.spark.read.parquet(f"{self.folder}/totals")
        met = hits.join(F.broadcast(df), "term").join(self.spark.read.parquet(f"{self.folder}/lengths"), "key").crossJoin(F.broadcast(totals))  # one row of totals, one for each word
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("times") * (k1 + 1) / (F.col("times") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
        scored = met.groupBy(F.col("key").alias(key)).agg(F.round(F.sum(part), 6).alias("score"))
        return scored.orderBy(F.col("score").desc(), key).limit(limit) if limit else scored
