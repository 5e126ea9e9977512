"""Encoding of whole texts with a public byte-level BPE by a tree of joins (problem 8).

A text is cut into leaves, each leaf is encoded by itself, and neighbours are joined pairwise up the
tree. A join re-encodes only a window around the seam. It is an associative operation with the empty
text as its unit (a monoid), so any bracketing gives the ids of the whole text:

* No word of the pre-tokenizer holds a letter or digit with something else behind it. So where a letter or
  digit is followed by anything else, one word ends and the next begins, whatever stands around.
* Words are matched from left to right, look at most one character ahead, and merges never cross them. So
  the ids before such a point and those after it are the ids of the two parts.
* The window grows to the left and to the right of the seam, doubling, until it ends at such points, which both
  neighbours see within themselves. Their ids outside the window stand; those of the window are made anew.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
# The published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a word ends and another begins in any context.
STABLE = r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])"
#: Characters below which a part is encoded at once; most texts are longer and so are joined from parts.
LEAF = 256


class Bpe:
    """A rank file: ids of strings, bytes of ids."""

    def __init__(self, rank_file: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._stable = regex.compile(STABLE)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.widths = np.array([len(piece) for piece in self.pieces], dtype=np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self._own.encode_ordinary(text), dtype=np.int32)

    def stable(self, text: str) -> list[int]:
        """Offsets at which the text can be cut without a change of its ids."""
        return [m.start() for m in self._stable.finditer(text)]

    def decode(self, ids) -> bytes:
        """Bytes of ids; ``decode(a) + decode(b) == decode(a + b)``, so a tree of parts may be joined."""
        return b"".join(self.pieces[i] for i in ids)


@lru_cache(maxsize=4)
def bpe(name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> Bpe:
    """One instance for each Python worker."""
    return Bpe(os.path.join(tokenizer_dir, f"{name}.tiktoken"))


@dataclass
class Span:
    """``text[begin:end]`` encoded by itself."""

    begin: int
    end: int
    ids: np.ndarray


class Tree:
    """Encoding of one text by halving; ``leaf`` is the size below which a part is encoded at once."""

    def __init__(self, model: Bpe, leaf: int = LEAF, window: int = 16):
        self.model, self.leaf, self.window = model, max(1, leaf), max(1, window)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = self.leaves(text)
        while len(parts) > 1:
            paired = [self.join(text, a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = paired + parts[len(paired) * 2 :]
        return parts[0].ids

    def leaves(self, text: str) -> list[Span]:
        todo, done = [(0, len(text))], []
        while todo:
            a, b = todo.pop()
            if b - a > self.leaf:
                middle = (a + b) // 2
                todo += [(middle, b), (a, middle)]
            else:
                done.append(Span(a, b, self.model.ids(text[a:b])))
        return done

    def _before(self, text: str, begin: int, seam: int) -> int:
        """The last stable point of the left side, or its beginning."""
        width = self.window
        while True:
            low = max(begin, seam - width)
            if found := self.model.stable(text[low:seam]):
                return low + found[-1]
            if low == begin:
                return begin
            width *= 2

    def _after(self, text: str, seam: int, end: int) -> int:
        """The first stable point of the right side, or its end."""
        width = self.window
        while True:
            high = min(end, seam + width)
            if found := self.model.stable(text[seam:high]):
                return seam + found[0]
            if high == end:
                return end
            width *= 2

    def _tokens(self, ids: np.ndarray, width: int) -> int:
        """How many of the first ids make up ``width`` bytes."""
        take = min(len(ids), width)
        return int(np.searchsorted(np.cumsum(self.model.widths[ids[:take]]), width)) + 1 if width else 0

    def join(self, text: str, left: Span, right: Span) -> Span:
        seam = left.end
        a, b = self._before(text, left.begin, seam), self._after(text, seam, right.end)
        drop = self._tokens(left.ids[::-1], len(text[a:seam].encode()))
        skip = self._tokens(right.ids, len(text[seam:b].encode()))
        return Span(left.begin, right.end, np.concatenate((left.ids[: len(left.ids) - drop], self.model.ids(text[a:b]), right.ids[skip:])))


def _encoded(batches: Iterator[pa.RecordBatch], keep: int, name: str, tokenizer_dir: str, leaf: int, counts: bool) -> Iterator[pa.RecordBatch]:
    tree = Tree(bpe(name, tokenizer_dir), leaf)
    for batch in batches:
        found = [tree.encode(text) if text else np.empty(0, np.int32) for text in batch.column(keep).to_pylist()]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        columns = list(batch.columns[:keep])
        if counts:
            columns.append(pa.array(sizes))
        else:
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keep], "ids" if not counts else "n_tokens"])


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, name: str = "byte_bpe_50k",
    tokenizer_dir: str = TOKENIZER_DIR, leaf: int = LEAF, counts: bool = False,
) -> DataFrame:
    """``(key, ids array<int>)`` of every row, or with ``counts`` ``(key, n_tokens bigint)``.

    No special tokens are added and their strings are ordinary text. A null or empty text has the empty
    list (0 tokens). Rows with a null or repeated key stay as they are; columns besides the two named
    are ignored, whatever their names. An empty table gives an empty result. No shuffle: each task
    encodes the rows that it reads.
    """
    kind = dict(docs.dtypes)[key]
    out = f"`{key}` {kind}, " + ("n_tokens bigint" if counts else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, 1, name, tokenizer_dir, leaf, counts)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, out)


def decode(encoded: DataFrame, key: str = "doc_id", *, name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, text)`` from ``(key, ids)``; exact for every text whose ids :func:`encode` gave. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(name, tokenizer_dir)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col("ids")).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")
