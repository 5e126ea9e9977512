"""What a paper's title says about its identity; shared by the history and the entity-matching operators."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from kgweft.llm.markup import Parser, render

# Wording of versions (the same paper) and of issues and follow-ups (another paper).
_VERSION = re.compile(
    r"\b(?:revised|revisited|working|preliminary|final|extended|accepted|short|draft|author)\s+(?:draft|paper|version|abstract|edition|preprint|manuscript)\b"
    r"|\b(?:preprint|draft version|edition revisee|abridged|abridgement|first draft|camera[- ]ready(?: version)?)\b"
    r"|\A\W*(?:draft|manuscript|preprint)\W*[.:]"
)
_FOLLOW = {
    "look", "reply", "replies", "rejoinder", "response", "erratum", "errata", "corrigendum", "corrigenda", "correction", "replication", "replicated",
    "supplement", "supplementary", "supplemental", "appendix", "addendum", "comment", "comments", "notes", "follow", "followup", "sequel", "retraction", "second", "release", "critics",
}
_ROMAN = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"}
_FRONT = {"editorial", "erratum", "errata", "corrigendum", "introduction", "preface", "foreword", "reply", "response", "comment", "comments", "obituary", "contents", "index", "letter", "letters", "news", "announcement", "guest", "book", "retraction", "correspondence"}
_SMALL = {"the", "a", "an", "of", "and", "in", "on", "for", "to", "from", "is", "does", "how", "with", "by", "at", "after", "or", "und", "et", "de", "la", "le"}


# Prepositions that open a condition.
_LEADS = "in|on|at|of|for|to|by|with|under|over|via|from"
#: A formula with the preposition that leads to it, to the end of the title; a formula elsewhere.
_CONDITION = re.compile(rf"\b(?:{_LEADS})\b(?:(?!\b(?:{_LEADS})\b)[^,:;?!\0])*\0[^,:;?!]*$")


def plain(text: str | None) -> str:
    """Lower case without markup, formulas and accents.

    A condition that ends a title and holds a formula goes with it where at least three words stay, as sources
    that can't set the formula leave the condition out.
    """
    if not text:
        return ""
    marked = re.sub(r"(?is)<(su[bp])\b[^>]*>.*?</\1\s*>", "\0", text)
    bare = re.sub(r"\$[^$\n]*\$", "\0", render(Parser(marked).root))
    text = "".join(c for c in unicodedata.normalize("NFKD", bare) if not unicodedata.combining(c)).lower()
    short = _CONDITION.sub(" ", text)
    return (short if len(re.findall(r"[^\W_]+", short)) >= 3 else text).replace("\0", " ")


def told(title: str | None) -> tuple[str, str, bool]:
    """``(core, marks, general)``: the title's words without version wording, issue and follow-up marks apart, and whether many papers bear it."""
    text = _VERSION.sub(" ", plain(title))
    words = re.findall(r"[^\W_]+", text.replace("&", " and "))
    front = not words or words[0] in _FRONT and len(words) <= 6
    core, marks = [], []
    for n, w in enumerate(words):
        if w.isdigit() and not any(v.startswith("year") for v in words[n + 1 : n + 3]):
            marks.append(w)
        elif w in _ROMAN and n and words[n - 1] in ("part", "volume", "no"):
            marks.append(w)
        elif w in _FOLLOW and not front:
            marks.append(w)
        else:
            core.append(w)
    return " ".join(core), " ".join(sorted(set(marks))), front


@lru_cache(maxsize=50_000)
def content(core: str) -> tuple[str, ...]:
    return tuple(w for w in core.split() if w not in _SMALL)


def slip(a: str, b: str) -> bool:
    """One letter more, less or other, or two neighbours exchanged."""
    if a == b:
        return True
    x, y = len(a), len(b)
    if not -2 < x - y < 2:
        return False
    at = 0
    while at < x and at < y and a[at] == b[at]:
        at += 1
    while x > at and y > at and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    # what lies between the common beginning and the common end
    return x - at < 2 and y - at < 2 or x == y == at + 2 and a[at] == b[at + 1] and a[at + 1] == b[at]


def alike(a: str, b: str) -> float:
    """0 to 1: words in common, where a slip of typing or of spacing counts as common.

    Where both sides keep a long word that the other lacks, the titles name different things: 0.5 at most.
    """
    words, rest_y = content(a), list(content(b))
    longest = max(len(words), len(rest_y))
    if not longest:
        return 1.0 if a == b else 0.0
    rest_x, common = [], 0
    for w in words:
        if w in rest_y:
            rest_y.remove(w)
            common += 1
        else:
            rest_x.append(w)
    for w in [w for w in rest_x if len(w) > 3]:
        for v in rest_y:
            # one slip leaves the first or the last letter of a long word as it was
            if (w[0] == v[0] or w[-1] == v[-1]) and slip(w, v):
                common += 1
                rest_x.remove(w)
                rest_y.remove(v)
                break
    if not rest_x and not rest_y or slip(a.replace(" ", ""), b.replace(" ", "")):
        return 1.0
    keep = lambda text, other: "".join(w for w in text.split() if w not in other)
    left, right = keep(a, set(b.split())), keep(b, set(a.split()))
    if left and right and slip(left, right):
        return 1.0
    share = common / longest
    if longest > 3 and (not rest_x or not rest_y) and len(rest_x) + len(rest_y) == 1:  # one word put in or left out
        return max(share, 0.85)
    return min(share, 0.5) if any(len(w) > 4 for w in rest_x) and any(len(w) > 4 for w in rest_y) else share
