"""Cutting oversized texts at natural boundaries with overlap, by agglomerative merging (problem 6).

A text starts as atomic segments: sentences with the white space after them, and where a sentence is
itself too long, its clauses or words. Each boundary between neighbours has a strength (word, clause,
sentence, line, blank line, page or heading). A heap gives the weakest boundary next, the smaller
result first among equals; its two sides are merged while their size plus the overlap fits. What is
left are the pieces. Only a run without white space longer than a whole piece is cut by force.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, CLAUSE, SENTENCE, LINE, BLANK, SECTION = range(1, 7)
_RUN = re.compile(r"\S+\s*|\s+")
_HEADING = re.compile(r"\s{0,3}(#{1,6}\s|=+\s|\\(sub)*section|\d+(\.\d+)*\.?\s+[A-Z]|Page\s+\d+)")
_CLOSERS = "\"')]}»”’"
_ENDS = ".!?…。！？؟۔।"
_CLAUSES = ",;:，；：、،؛—–"


def _strength(run: str, text: str, at: int) -> int:
    """Strength of the boundary after ``run`` (non-space characters, then white space), which ends at ``at``."""
    body = run.rstrip()
    space = run[len(body) :]
    lines = space.replace("\r\n", "\n").replace("\r", "\n")
    breaks = lines.count("\n") + lines.count("\u2028")
    if "\f" in space or "\u2029" in space or breaks and _HEADING.match(text, at):
        return SECTION
    if breaks > 1:
        return BLANK
    if breaks:
        return LINE
    core = body.rstrip(_CLOSERS)
    if core and core[-1] in _ENDS:
        return SENTENCE
    return CLAUSE if core and core[-1] in _CLAUSES else WORD


@dataclass
class Piece:
    start: int  # with the overlap
    core: int  # where the part begins that no earlier piece has
    end: int
    forced: bool  # cut inside a run without white space, at either end


def _atoms(text: str, limit: int, room: int) -> list[tuple[int, int, int, bool]]:
    """``(start, end, strength of the boundary at its end, cut by force)`` of the atomic segments."""
    words: list[tuple[int, int, int, bool]] = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        body = start + len(m.group().rstrip())
        strength = _strength(m.group(), text, end)
        if body - start > limit:  # no white space within a whole piece
            step = max(1, room)
            for a in range(start, body, step):
                words.append((a, min(a + step, body), 0, True))
            start = body
            words[-1] = (*words[-1][:2], strength if start == end else WORD, True)
        while end - start > limit:  # white space alone may exceed a piece as well
            words.append((start, start + room, WORD, False))
            start += room
        if start < end:
            words.append((start, end, strength, False))
    atoms: list[tuple[int, int, int, bool]] = []
    held: list[tuple[int, int, int, bool]] = []
    for n, word in enumerate(words):
        held.append(word)
        if word[2] >= SENTENCE or word[3] or n + 1 == len(words):  # the words of a sentence that fits form one atom
            whole = word[1] - held[0][0] <= room and not word[3]
            atoms += [(held[0][0], word[1], word[2], False)] if whole else held
            held = []
    return atoms


def split_text(text: str | None, limit: int = 2000, overlap: int = 200) -> list[Piece]:
    """Pieces of at most ``limit`` characters; each repeats up to ``overlap`` of the one before.

    Their cores are the text, character for character. A null or empty text has no piece, one of at most
    ``limit`` characters a single piece. A run longer than ``limit`` less ``overlap`` but not than
    ``limit`` stays whole and gets the overlap that still fits.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [Piece(0, 0, len(text), False)]
    room = max(1, limit - overlap)
    atoms = _atoms(text, limit, room)
    n = len(atoms)
    start, end = [a[0] for a in atoms], [a[1] for a in atoms]
    forced = [a[3] for a in atoms]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    strength = [a[2] for a in atoms]
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1, end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, until = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j]) or following[i] != j or end[j] != until or end[j] - start[i] != size:
            continue
        if size + (overlap if start[i] else 0) > limit:
            continue
        end[i], strength[i], following[i] = end[j], strength[j], following[j]
        forced[i] = forced[i] or forced[j]
        alive[j] = False
        k = following[i]
        if k < n:
            previous[k] = i
            heapq.heappush(heap, (strength[i], end[k] - start[i], i, k, end[k]))
        p = previous[i]
        if p >= 0:
            heapq.heappush(heap, (strength[p], end[i] - start[p], p, i, end[i]))
    pieces: list[Piece] = []
    for i in range(n):
        if not alive[i]:
            continue
        begin = start[i]
        if pieces:
            begin = max(begin - overlap, end[i] - limit, pieces[-1].start)
            if begin < start[i] and begin > 0 and not text[begin - 1].isspace():
                blank = re.compile(r"\s").search(text, begin, start[i])  # begin the overlap with a word
                begin = blank.end() if blank and blank.end() < start[i] else begin
        pieces.append(Piece(begin, start[i], end[i], forced[i]))
    return pieces


def _run(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for row, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            for no, p in enumerate(split_text(text, limit, overlap)):
                rows.append((key, no, p.start, p.core - p.start, p.forced, text[p.start : p.end], len(text), row))
        names = ["key", "piece", "start", "overlap", "forced", "text", "whole"]
        types = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def split(
    docs: DataFrame, key: str = "request_no", text: str = "text", *, limit: int = 2000, overlap: int = 200,
) -> DataFrame:
    """``(key, piece, start, overlap, forced, text, whole)``: the pieces of every row's text.

    ``start`` is the offset of the piece, its first ``overlap`` characters repeat the piece before, ``whole``
    is the length of the row's text; lengths count code points. Null and empty texts have no row; repeated
    rows give repeated pieces; null keys are allowed; extra columns are ignored. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _run(batches, limit, overlap)

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"key {kind}, piece int, start long, overlap int, forced boolean, text string, whole long"
    )
    return out.withColumnRenamed("key", key) if key != "key" else out


def cuts(docs: DataFrame, key: str = "request_no", text: str = "text", *, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``(key, cut)`` of each row whose text exceeds ``limit``: ``forced`` where a piece had to end inside a run, else ``natural``.

    The pieces of a text are made in one place, so no grouping is needed and rows that repeat a key keep a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = split_text(t, limit, overlap)
                if t and len(t) > limit:
                    keys.append(k)
                    found.append("forced" if any(p.forced for p in pieces) else "natural")
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(found, pa.string())], names=[key, "cut"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, cut string")
