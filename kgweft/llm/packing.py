"""Filling fixed-capacity containers by the sum-of-squares rule (problem 9).

Items are dealt into shards by a hash of their row; a shard holds about ``rows_per_shard`` items however
large the corpus is, so each is packed in one task's memory. Within a shard items come largest first,
and each goes where the sum over gaps of (open containers with that gap) squared becomes smallest:
into an open container that has room, or into a new one. Ties go to the tightest fit. Containers that
stay emptier than ``refill`` are dissolved and their items packed again in far fewer shards, so that the
space left at the end of each shard is shared.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweft.llm.tokens import TOKENIZER_DIR, encode
from kgweft.session import cut


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Number of the container of each size (1 to capacity), in the order given.

    Moving a container from gap g to gap g - s changes the sum by 2 (N[g-s] - N[g]) + 2; opening one
    changes it by 2 N[capacity-s] + 1, closing one exactly by 1 - 2 N[s].
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)  # counts[0], full ones, is kept at 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed = np.empty(len(sizes), dtype=np.int64)
    opened = 0
    huge = np.int64(1) << 60
    for n, size in enumerate(np.asarray(sizes, dtype=np.int64)):
        s = int(size)
        best, where = (2 * int(counts[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            held = counts[s:capacity]
            change = 2 * (counts[: capacity - s] - held) + 2
            change[0] -= 1  # a container filled to the brim leaves the sum
            change = np.where(held > 0, change, huge)
            g = int(change.argmin())
            if change[g] < best:
                where = g + s
        if where == capacity:
            bin_no, opened = opened, opened + 1
        else:
            bin_no = stacks[where].pop()
            counts[where] -= 1
        left = where - s
        if left:
            stacks[left].append(bin_no)
            counts[left] += 1
        placed[n] = bin_no
    return placed


def _pack(items: DataFrame, capacity: int, shards: int) -> DataFrame:
    kind = dict(items.dtypes)["item"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "item", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
        group["bin"] = sum_of_squares(group["n_tokens"].to_numpy(), capacity)
        group["filled"] = group.groupby("bin")["n_tokens"].transform("sum")
        return group[["shard", "item", "copy", "piece", "start_token", "n_tokens", "bin", "filled"]]

    schema = f"shard long, item {kind}, copy long, piece int, start_token long, n_tokens long, bin long, filled long"
    # a number of tasks that follows the shards: they are few bytes and much work, and would be put together by size
    spread = items.select("shard", "item", "copy", "piece", "start_token", "n_tokens").repartition(shards, "shard")
    return spread.groupBy("shard").applyInPandas(run, schema)


def pack(
    sizes: DataFrame, key: str = "doc_id", *, capacity: int = 2048, rows_per_shard: int = 8000, refill: float = 0.97,
) -> DataFrame:
    """Containers for ``sizes`` (``key``, ``n_tokens``): ``(container_id, key, piece, start_token, n_tokens)``.

    Sizes that are null, zero or negative take no space and have no row. An item above ``capacity`` is split
    into full pieces and a rest (``piece`` counts from 0), any other item is whole in one container. Repeated
    rows are packed each by itself; null keys are allowed; an empty table gives no rows. Extra columns are
    ignored. The result is the same on every run.
    """
    sized = sizes.select(F.col(key).alias("item"), F.col("n_tokens").cast("long").alias("n")).filter("n > 0")
    # repeated rows are counted and numbered, so that they are dealt out like any others
    counted = sized.groupBy("item", "n").agg(F.count(F.lit(1)).alias("times"))
    each = counted.select("item", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    parts = cut(
        each.select("item", "copy", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("piece", "start_token"))
        .select("item", "copy", "piece", "start_token", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start_token")).alias("n_tokens"))
    )
    total = parts.count()
    shards = max(1, -(-total // rows_per_shard))
    spread = F.pmod(F.xxhash64("item", "copy", "piece", "n_tokens"), F.lit(shards))
    first = cut(_pack(parts.withColumn("shard", spread), capacity, shards))
    if shards == 1:
        packed = first
    else:
        poor = F.col("filled") < refill * capacity
        again = first.filter(poor)
        fewer = max(1, -(-again.count() // rows_per_shard))
        spread = F.lit(shards) + F.pmod(F.xxhash64("item", "copy", "piece", "n_tokens"), F.lit(fewer))
        packed = first.filter(~poor).unionByName(_pack(again.withColumn("shard", spread), capacity, fewer))
    container = (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("container_id")
    return packed.select(container, F.col("item").alias(key), "piece", "start_token", "n_tokens")


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = 2048,
    name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """:func:`pack` with the documents measured in tokens of a public tokenizer; null and empty texts have no row."""
    return pack(encode(docs, key, text, name=name, tokenizer_dir=tokenizer_dir, counts=True), key, capacity=capacity)


def usage(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens held, and the share of the space that is used."""
    return packed.agg(
        F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"),
        F.round(F.sum("n_tokens") / (F.countDistinct("container_id") * capacity), 6).alias("used"),
    )


__all__ = ["pack", "pack_documents", "sum_of_squares", "usage"]
