"""Clean text from fields with HTML, Markdown, wiki or LaTeX markup, by wrapper induction (problem 5).

Each field is parsed into a tree whatever its markup. The trees of one host are aligned by simple tree
matching and folded into a wrapper: nodes that hold the same few texts on nearly all pages that have
them are template, the others slots with content. Wrappers merge like the trees do, so each task folds
its own pages first and only wrappers are shuffled: a host with a third of all pages costs a row a task.
Clean text is written from the slots and keeps headings, lists, tables, code and formulas.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

_TAG = r"</?[A-Za-z][A-Za-z0-9]*(?::[A-Za-z][\w-]*)?(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>=]+))?)*\s*/?>"
# One alternative for each construct; the first that matches at a place wins. Names are KIND_construct.
_GRAMMAR = {
    "markdown_fence": r"(?:\A|(?<=\n))(?P<fence>```|~~~)[^\n]*\n(?P<fence_body>.*?)(?:\n(?P=fence)[ \t]*(?=\n|\Z)|\Z)",
    "html_pre": r"<pre\b[^>]*>(?P<pre_body>.*?)</pre\s*>",
    "html_math": r"<(?P<mathtag>(?:mml:)?math)\b[^>]*>(?P<math_body>.*?)</(?P=mathtag)\s*>",
    "html_comment": r"<!--.*?-->",
    "html_drop": r"<(?P<droptag>script|style)\b[^>]*>.*?</(?P=droptag)\s*>",
    "html_tag": _TAG,
    "html_escaped": r"&lt;/?[A-Za-z][A-Za-z0-9:]*(?:\s[^&<>]*)?/?&gt;",
    "html_entity": r"&(?:[A-Za-z][A-Za-z0-9]{1,9}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});",
    "latex_display": r"\$\$(?P<display_body>.+?)\$\$|\\\[(?P<bracket_body>.+?)\\\]|\\begin\{(?P<mathenv>equation|align|math|displaymath|eqnarray)\*?\}(?P<env_body>.*?)\\end\{(?P=mathenv)\*?\}",
    "latex_math": r"(?<![\\$\w])\$(?=[^\s$])(?!\d[\d.,]*(?:\s+[A-Za-z]{2,}|[,.;:]\s))(?P<inline_body>[^$\n]+?)(?<=[^\s\\])\$(?![\w$])|\\\((?P<paren_body>.+?)\\\)",
    "latex_env": r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?",
    "latex_section": r"(?<![\w\\:])\\(?:sub)*(?:section|chapter|paragraph)\*?\{(?P<section_body>[^{}]*)\}",
    "latex_item": r"(?<![\w\\:])\\item\b[ \t]*(?:\[[^\]\n]*\])?",
    "latex_accent": r"\{\\[\"'`^~=.](?:\{[A-Za-z]\}|[A-Za-z])\}|\\[\"'`^~=.](?:\{\\?[A-Za-z]\}|[A-Za-z])|\\[uvHck]\{[A-Za-z]\}|\\(?:o|O|l|L|ss|ae|AE|oe|OE|aa|AA|i|j)(?:\{\}|(?=[\s}]))",
    "latex_ref": r"~?\\(?:cite[a-z]*|ref|eqref|label)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}",
    "latex_group": r"\{\\(?P<groupname>em|it|bf|sc|tt|sl|rm|sf|bfseries|itshape|scshape|ttfamily|small|large)\b\s*",
    "latex_command": r"(?<![\w\\:])\\(?P<commandname>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{",
    "latex_word": r"(?<![\w\\:])\\(?:noindent|par|ldots|dots|LaTeX|TeX|newline|quad|qquad|maketitle|centering|newpage|smallskip|medskip|bigskip|textless|textgreater|S|P)\b(?:\{\})?",
    "latex_escape": r"(?<![\\:\w])\\[%&$#_{}](?!\w*\\)|(?<=\d)\\[%&$#_]",
    "latex_quote": r"(?<!`)``(?![`\s])(?P<quote_body>[^`]+?)(?<!')''(?!')",
    "wiki_heading": r"(?:\A|(?<=\n))(?P<eq>={2,6})[ \t]*(?P<wikihead>[^=\n]+?)[ \t]*(?P=eq)[ \t]*(?=\n|\Z)",
    "wiki_table": r"(?:\A|(?<=\n))\{\|.*?\n\|\}",
    "wiki_file": r"\[\[(?:File|Image|Category):[^\[\]\n]*\]\]",
    "wiki_link": r"\[\[(?P<wikilink>[^\[\]\n]+)\]\]",
    "wiki_template": r"\{\{[^{}]+\}\}",
    "wiki_url": r"\[(?:https?:)?//[^\s\]]+\s+(?P<wikiurl>[^\]\n]+)\]",
    "wiki_strong": r"(?<!')'{3}(?=[^\s'])(?P<wikistrong>(?:(?!\n\n).)+?)(?<=[^\s'])'{3}(?!')",
    "wiki_em": r"(?<![\w'])''(?=[^\s'])(?P<wikiem>[^\n]+?)(?<=[^\s'])''(?!')",
    "wiki_magic": r"__[A-Z]{3,}__",
    "markdown_heading": r"(?:\A|(?<=\n))[ ]{0,3}(?P<hashes>#{1,6})[ \t]+(?P<mdhead>\S[^\n]*?)[ \t]*#*(?=\n|\Z)",
    "markdown_setext": r"(?:\A|(?<=\n))(?P<setext>[^\s>|*+#-][^\n]*)\n(?:={3,}|-{3,})[ \t]*(?=\n|\Z)",
    "markdown_table": r"(?:\A|(?<=\n))[ \t]*\|?[^\n|]+\|[^\n]*\n[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*(?:\n[ \t]*\|[^\n]*)*",
    "markdown_quote": r"(?:\A|(?<=\n\n))>[ \t][^\n]*(?:\n>[^\n]*)*",
    "markdown_image": r"!\[(?P<mdalt>[^\]\n]*)\]\([^)\s]+(?:\s+\"[^\"]*\")?\)",
    "markdown_link": r"\[(?P<mdlink>[^\]\n]+)\]\((?:https?:|mailto:|/|#|\w[\w.-]*/)[^)\s]*(?:\s+\"[^\"]*\")?\)",
    "markdown_strong": r"(?<!\*)\*\*(?=[^\s*])(?P<mdstrong>(?:(?!\n\n).)+?)(?<=[^\s*])\*\*(?!\*)|(?<![\w_])__(?=[^\s_])(?P<mdstrong2>[^\n]+?)(?<=[^\s_])__(?![\w_])",
    "markdown_code": r"(?<!`)`(?=[^\s`])(?P<mdcode>[^`\n]+?)`(?!`)",
    "markdown_em": r"(?<![\w*])\*(?=[^\s*])(?P<mdem>[^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])(?P<mdem2>[^_\n]+?)(?<=[^\s_])_(?![\w_])",
    "markdown_strike": r"~~(?=\S)(?P<mdstrike>[^~\n]+?)(?<=\S)~~",
    "markdown_break": r"(?:\A|(?<=\n))(?:\*[ ]?){3,}(?=\n|\Z)",
}
_MASTER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _GRAMMAR.items()), re.S)
#: Every construct begins with one of these characters or at the start of a line; the grammar is only tried there.
_MAYBE = re.compile(r"[<&\\$`{\[*_~!]|''|(?:\A|(?<=\n))[^\n]")
_LIST = re.compile(r"(?:\A|\n)(?P<bullet>[-+*]|\d{1,2}[.)])[ \t]+[^\n]+(?:\n(?:[-+*]|\d{1,2}[.)])[ \t]+[^\n]+)*")
_BULLET = re.compile(r"(?:[-+*]|\d{1,2}[.)])[ \t]+")
_COMMENT = re.compile(r"(?<=[.!?}] )%[ \t]?[a-z][^\n]*(?:\n|\Z)")
_BLOCKS = {"p", "div", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "table", "tr", "blockquote", "section", "article", "title", "sec", "quote", "item", "display"}
_ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328"}
_LETTERS = {"o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ"}
_LABEL = re.compile(r"\A\s*([A-Z][\w ]{1,24}:)(?=\s)")


@dataclass
class Node:
    tag: str
    kind: str = ""
    text: str = ""
    children: list[Node] = field(default_factory=list)


def _accent(raw: str) -> str:
    import unicodedata

    bare = raw.strip("{}").lstrip("\\")
    name = bare.split("{")[0]
    if name in _LETTERS:
        return _LETTERS[name]
    letter = re.sub(r"[^A-Za-z]", "", bare[1:])
    return unicodedata.normalize("NFC", letter + _ACCENTS.get(bare[0], ""))


class Parser:
    """Tree of one text; ``kinds`` says which markup it holds."""

    def __init__(self, text: str):
        self.kinds: set[str] = set()
        self.root = Node("page")
        self._stack = [self.root]
        self._fill(text)
        self._comments(self.root)

    def _add(self, node: Node) -> Node:
        self._stack[-1].children.append(node)
        if node.kind:
            self.kinds.add(node.kind)
        return node

    def _text(self, text: str) -> None:
        last = 0
        for m in _LIST.finditer(text):
            lines = [x for x in m.group().split("\n") if x]
            apart = m.start() == 0 and not self._stack[-1].children or text[: m.start() + 1].endswith("\n\n")
            if len(lines) < 2 and not (self.kinds & {WIKI} and m["bullet"] == "*") or not apart and not (m["bullet"] == "*" and m.group().startswith("\n")):
                continue
            wiki = m["bullet"] == "*" and not apart
            self._plain(text[last : m.start()])
            for line in lines:
                self._add(Node("li", WIKI if wiki else MARKDOWN, "", [Node("text", "", _BULLET.sub("", line, count=1))]))
            last = m.end()
        self._plain(text[last:])

    def _plain(self, text: str) -> None:
        label = _LABEL.match(text) if not self._stack[-1].children else None
        if label:
            self._add(Node("label", "", label[1]))
            text = text[label.end() :]
        parts = text.split("\n") if "\n" in text else [text]
        for n, line in enumerate(parts):
            if n:
                self._add(Node("line"))
            if line:
                again = _LABEL.match(line) if n else None
                if again:
                    self._add(Node("label", "", again[1]))
                    line = line[again.end() :]
                self._add(Node("text", "", line))

    def _inner(self, tag: str, kind: str, body: str) -> None:
        node = self._add(Node(tag, kind))
        self._stack.append(node)
        self._fill(body)
        if node in self._stack:
            del self._stack[self._stack.index(node) :]

    def _fill(self, text: str) -> None:
        last = 0
        open_groups: list[Node] = []
        at = 0
        while maybe := _MAYBE.search(text, at):
            m = _MASTER.match(text, maybe.start())
            if not m or m.end() == m.start():
                at = maybe.start() + 1
                continue
            at = m.end()
            name = next(k for k in _GRAMMAR if m.group(k) is not None)
            self._until(text[last : m.start()], open_groups)
            last = m.end()
            getattr(self, "_" + name, self._default)(m, name)
            if name in ("latex_group", "latex_command"):
                open_groups.append(self._stack[-1])
        self._until(text[last:], open_groups)
        for node in open_groups:
            if node in self._stack:
                del self._stack[self._stack.index(node) :]

    def _until(self, text: str, open_groups: list[Node]) -> None:
        """Text in which the braces of open groups end."""
        while open_groups:
            depth = 0
            for i, c in enumerate(text):
                depth += (c == "{") - (c == "}")
                if depth < 0:
                    self._text(text[:i])
                    node = open_groups.pop()
                    if node in self._stack:
                        del self._stack[self._stack.index(node) :]
                    text = text[i + 1 :]
                    break
            else:
                break
        self._text(text)

    def _default(self, m: re.Match, name: str) -> None:
        """Constructs without content of their own."""
        self._add(Node(name.split("_")[1], name.split("_")[0]))

    def _html_tag(self, m: re.Match, name: str) -> None:
        raw = m.group()
        tag = re.match(r"</?([\w:-]+)", raw)[1].lower().split(":")[-1]
        if raw.startswith("</"):
            open_tags = [i for i, n in enumerate(self._stack) if n.tag == tag and i]
            if open_tags:
                del self._stack[open_tags[-1] :]
            else:
                self._add(Node("end", HTML))
            return
        if tag == "li" and self._stack[-1].tag == "li":
            self._stack.pop()
        node = self._add(Node(tag, HTML))
        if not raw.endswith("/>") and tag not in ("br", "hr", "img", "input", "meta", "link", "wbr"):
            self._stack.append(node)

    def _html_escaped(self, m: re.Match, name: str) -> None:
        raw = _html.unescape(m.group())
        if inner := re.fullmatch(_TAG, raw, re.S):
            self._html_tag(inner, name)
        else:
            self._add(Node("text", HTML, raw))

    def _html_entity(self, m: re.Match, name: str) -> None:
        told = _html.unescape(m.group())
        self._add(Node("text", "" if told == m.group() else HTML, told.replace("\xa0", " ").replace("\t", " ")))

    def _html_pre(self, m: re.Match, name: str) -> None:
        self._add(Node("pre", HTML, _html.unescape(re.sub(r"<[^>]+>", "", m["pre_body"]))))

    def _html_math(self, m: re.Match, name: str) -> None:
        self._add(Node("math", HTML, _html.unescape(re.sub(r"<[^>]+>", "", m["math_body"]))))

    def _markdown_fence(self, m: re.Match, name: str) -> None:
        self._add(Node("pre", MARKDOWN, m["fence_body"]))

    def _latex_display(self, m: re.Match, name: str) -> None:
        self._add(Node("display", LATEX, (m["display_body"] or m["bracket_body"] or m["env_body"] or "").strip()))

    def _latex_math(self, m: re.Match, name: str) -> None:
        self._add(Node("math", LATEX, (m["inline_body"] or m["paren_body"] or "").strip()))

    def _latex_section(self, m: re.Match, name: str) -> None:
        self._inner("h2", LATEX, m["section_body"])

    def _latex_item(self, m: re.Match, name: str) -> None:
        self._add(Node("item", LATEX))

    def _latex_accent(self, m: re.Match, name: str) -> None:
        self._add(Node("text", LATEX, _accent(m.group())))

    def _latex_quote(self, m: re.Match, name: str) -> None:
        self._add(Node("text", LATEX, "“"))
        self._fill(m["quote_body"])
        self._add(Node("text", LATEX, "”"))

    def _latex_escape(self, m: re.Match, name: str) -> None:
        self._add(Node("text", LATEX, m.group()[-1]))

    def _latex_group(self, m: re.Match, name: str) -> None:
        self._stack.append(self._add(Node("em", LATEX)))

    def _latex_command(self, m: re.Match, name: str) -> None:
        self._stack.append(self._add(Node({"footnote": "footnote", "textbf": "strong", "texttt": "code"}.get(m["commandname"], "em"), LATEX)))

    def _wiki_heading(self, m: re.Match, name: str) -> None:
        self._inner(f"h{len(m['eq'])}", WIKI, m["wikihead"])

    def _wiki_link(self, m: re.Match, name: str) -> None:
        self._inner("a", WIKI, m["wikilink"].split("|")[-1])

    def _wiki_url(self, m: re.Match, name: str) -> None:
        self._inner("a", WIKI, m["wikiurl"])

    def _wiki_strong(self, m: re.Match, name: str) -> None:
        self._inner("strong", WIKI, m["wikistrong"])

    def _wiki_em(self, m: re.Match, name: str) -> None:
        self._inner("em", WIKI, m["wikiem"])

    def _markdown_heading(self, m: re.Match, name: str) -> None:
        self._inner(f"h{len(m['hashes'])}", MARKDOWN, m["mdhead"])

    def _markdown_setext(self, m: re.Match, name: str) -> None:
        self._inner("h1", MARKDOWN, m["setext"])

    def _markdown_table(self, m: re.Match, name: str) -> None:
        rows = [x for x in m.group().strip().split("\n") if not re.fullmatch(r"[\s|:-]+", x)]
        self._add(Node("table", MARKDOWN, "\n".join(" | ".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows)))

    def _markdown_quote(self, m: re.Match, name: str) -> None:
        self._inner("quote", MARKDOWN, re.sub(r"(?m)^>[ \t]?", "", m.group()))

    def _markdown_link(self, m: re.Match, name: str) -> None:
        self._inner("a", MARKDOWN, m["mdlink"])

    def _markdown_strong(self, m: re.Match, name: str) -> None:
        self._inner("strong", MARKDOWN, m["mdstrong"] or m["mdstrong2"])

    def _markdown_em(self, m: re.Match, name: str) -> None:
        self._inner("em", MARKDOWN, m["mdem"] or m["mdem2"])

    def _markdown_strike(self, m: re.Match, name: str) -> None:
        self._inner("em", MARKDOWN, m["mdstrike"])

    def _markdown_code(self, m: re.Match, name: str) -> None:
        self._add(Node("code", MARKDOWN, m["mdcode"]))

    def _comments(self, node: Node) -> None:
        if LATEX in self.kinds:
            for child in node.children:
                if child.tag == "text":
                    child.text = _COMMENT.sub("", child.text + "\n").rstrip("\n")
                self._comments(child)


#: Never template, even where many pages share it.
_KEPT = {"pre", "code", "math", "display", "table"}
# wrappers: {"t": tag, "n": pages, "x": {digest of text: pages}, "c": [children]}
_TEXTS = 4


def _digest(text: str) -> str:
    """Stands for a whole text, so that only nodes equal in full count as one."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def wrapper_of(node: Node) -> dict:
    """The wrapper of one page; siblings of one tag in a row count as one repeated node."""
    children: list[dict] = []
    for child in map(wrapper_of, node.children):
        if children and children[-1]["t"] == child["t"]:
            children[-1] = _union(children[-1], child, page=True)
        else:
            children.append(child)
    text = node.text.strip()
    return {"t": node.tag, "n": 1, "x": {_digest(text): 1} if text else {}, "c": children}


def _union(a: dict, b: dict, page: bool = False) -> dict:
    texts = dict(a["x"])
    for text, n in b["x"].items():
        texts[text] = texts.get(text, 0) + n
    if len(texts) > _TEXTS:  # frequent items: what all counters above the limit share is taken off each
        off = sorted(texts.values(), reverse=True)[_TEXTS]
        texts = {t: n - off for t, n in texts.items() if n > off}
    return {"t": a["t"], "n": max(a["n"], b["n"]) if page else a["n"] + b["n"], "x": texts, "c": _aligned(a["c"], b["c"])}


def shape(wrapper: dict) -> str:
    """The tags of a wrapper as text; equal for trees whose alignment is node by node."""
    return wrapper["t"] if not wrapper["c"] else f"{wrapper['t']}({','.join(map(shape, wrapper['c']))})"


def _stacked(a: dict, b: dict) -> dict:
    """The union of two wrappers of one shape, without a search."""
    return _union(a | {"c": []}, b | {"c": []}) | {"c": [_stacked(x, y) for x, y in zip(a["c"], b["c"], strict=True)]}


def _match(a: dict, b: dict) -> int:
    """Size of the largest matching of two ordered trees whose roots have one tag (simple tree matching)."""
    if a["t"] != b["t"]:
        return 0
    return 1 + _table(a["c"], b["c"])[-1][-1]


def _table(a: list[dict], b: list[dict]) -> list[list[int]]:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + _match(x, y))
    return table


def _aligned(a: list[dict], b: list[dict]) -> list[dict]:
    if not a or not b:
        return a or b
    table, i, j, out = _table(a, b), len(a), len(b), []
    while i and j:
        gain = _match(a[i - 1], b[j - 1])
        if gain and table[i][j] == table[i - 1][j - 1] + gain:
            out.append(_union(a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            out.append(a[i - 1])
            i -= 1
        else:
            out.append(b[j - 1])
            j -= 1
    return a[:i] + b[:j] + out[::-1]


def template(wrapper: dict, pages: int = 20, share: float = 0.9) -> list[str]:
    """``path<TAB>digest`` of the constant nodes: on at least ``pages`` pages, nearly always one of a few texts."""
    found: set[str] = set()

    def walk(node: dict, path: str) -> None:
        path = f"{path}/{node['t']}"
        if node["n"] >= pages and node["t"] not in _KEPT and node["x"] and sum(node["x"].values()) >= share * node["n"]:
            found.update(f"{path}\t{text}" for text, n in node["x"].items() if n >= 0.05 * node["n"])
        for child in node["c"]:
            walk(child, path)

    walk(wrapper, "")
    return sorted(found)


def _is_template(node: Node, path: str, constant: frozenset[str]) -> bool:
    text = node.text.strip()
    return bool(text and constant) and f"{path}\t{_digest(text)}" in constant


def kinds(root: Node, constant: frozenset[str] = frozenset()) -> tuple[set[str], set[str]]:
    """Markup of a tree aligned with its host's wrapper: that of its content, and that of its template nodes."""
    content: set[str] = set()
    fixed: set[str] = set()
    todo = [(root, "", False)]
    while todo:
        node, path, inside = todo.pop()
        path = f"{path}/{node.tag}"
        inside = inside or _is_template(node, path, constant)
        if node.kind:
            (fixed if inside else content).add(node.kind)
        todo += [(child, path, inside) for child in node.children]
    return content, fixed


def render(root: Node, constant: frozenset[str] = frozenset()) -> str:
    """Clean text of a tree without its template nodes: headings as ``#`` lines, items as ``-`` lines, code in fences, formulas between ``$``."""
    out: list[str] = []

    def block(before: str = "\n") -> None:
        if out and not out[-1].endswith("\n"):
            out.append(before)

    def walk(node: Node, path: str) -> None:
        path = f"{path}/{node.tag}"
        text = node.text
        if _is_template(node, path, constant):
            return
        tag = node.tag
        if tag in ("text", "label"):
            out.append(text + (" " if tag == "label" else ""))
        elif tag == "line":
            out.append("\n")
        elif tag in ("code", "strike"):
            out.append(text)
        elif tag == "math":
            out.append(f"${text}$")
        elif tag == "display":
            block()
            out.append(f"$$ {text} $$\n")
        elif tag == "pre":
            block()
            out.append(f"```\n{text}\n```\n")
        elif tag == "table" and text:
            block()
            out.append(text + "\n")
        elif tag == "item":
            block()
            out.append("- ")
        elif tag in _BLOCKS:
            block()
            if tag[0] == "h" and tag[1:].isdigit() and any(True for _ in node.children):
                mark = len(out)
                out.append("#" * int(tag[1:]) + " ")
                for child in node.children:
                    walk(child, path)
                if len(out) == mark + 1:  # a template heading
                    out.pop()
                block()
                return
            if tag == "li":
                out.append("- ")
        for child in node.children:
            walk(child, path)
        if tag == "footnote":
            out.append(" ")
        if tag in _BLOCKS and tag not in ("item",):
            block()

    walk(root, "")
    text = re.sub(r"[ \t]+", " ", "".join(out))
    return re.sub(r" ?\n ?(\s*\n)?", lambda m: "\n\n" if m[1] else "\n", text).strip()


_FIELDS = "rec bigint, field string, host string, body string"


def _bodies(docs: DataFrame, key: str, fields: tuple[str, ...], url: str) -> DataFrame:
    host = F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-z]+://([^/]+)", 1), F.lit(""))
    each = [docs.select(F.col(key).alias("rec"), F.lit(f).alias("field"), host.alias("host"), F.col(f).alias("body")) for f in fields]
    return reduce(DataFrame.unionByName, each).filter(F.length("body") > 0)


def induce(bodies: DataFrame, shapes_at_once: int = 10_000) -> DataFrame:
    """``(host, field, constant array<string>)``: the template nodes of each host's wrapper, folded from all its pages."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict[str, dict]] = {}  # by host and field, then by shape
        count = 0

        def told() -> pd.DataFrame:
            return pd.DataFrame([(h, f, json.dumps(reduce(_union, shapes.values()))) for (h, f), shapes in held.items()], columns=["host", "field", "wrapper"])

        for batch in batches:
            for host, name, body in zip(batch["host"], batch["field"], batch["body"], strict=True):
                page = wrapper_of(Parser(body).root)
                shapes, key = held.setdefault((host, name), {}), shape(page)
                count += key not in shapes
                shapes[key] = _stacked(shapes[key], page) if key in shapes else page
                if count > shapes_at_once:
                    yield told()
                    held.clear()
                    count = 0
        yield told()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict] = {}
        for batch in batches:
            for host, name, wrapper in zip(batch["host"], batch["field"], batch["wrapper"], strict=True):
                w = json.loads(wrapper)
                held[host, name] = _union(held[host, name], w) if (host, name) in held else w
        yield pd.DataFrame([(h, f, template(w)) for (h, f), w in held.items()], columns=["host", "field", "constant"])

    part = bodies.select("host", "field", "body").mapInPandas(fold, "host string, field string, wrapper string")
    return part.repartition("host", "field").mapInPandas(merge, "host string, field string, constant array<string>")


def clean(docs: DataFrame, key: str = "rec_id", fields: tuple[str, ...] = ("title", "abstract"), url: str = "url") -> DataFrame:
    """``(key, field, markup array<string>, text)`` of every non-empty field: its markup kinds in order and its clean text.

    Null and empty fields have no row. Text that merely resembles markup (``3 * 4``, ``x < y``, ``$12 to $40``,
    ``C:\\data``) has no kind and stays as it is. Rows with a null url share the host ``''``; repeated rows give
    repeated rows; extra columns are ignored; whole texts are parsed whatever their length.
    """
    bodies = _bodies(docs, key, fields, url)
    told = bodies.join(induce(bodies), ["host", "field"], "left")

    done = _told(told, lambda root, constant: (sorted(set().union(*kinds(root, constant))), render(root, constant)), "markup array<string>, text string")
    return done.withColumnRenamed("rec", key)


def _told(pages: DataFrame, say: Callable[[Node, frozenset[str]], tuple], types: str) -> DataFrame:
    """What ``say`` gives of each page's tree and its host's template nodes."""
    names = [t.split(" ")[0] for t in types.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (rec, name, *say(Parser(body).root, frozenset() if constant is None else frozenset(constant)))
                for rec, name, body, constant in zip(batch["rec"], batch["field"], batch["body"], batch["constant"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["rec", "field", *names])

    return pages.select("rec", "field", "body", "constant").mapInPandas(run, f"rec {dict(pages.dtypes)['rec']}, field string, {types}")


def found(docs: DataFrame, key: str = "rec_id", fields: tuple[str, ...] = ("title", "abstract"), url: str = "url") -> DataFrame:
    """``(key, field, markup)``: one row for each kind of markup in each field, in its content or in what its host's pages share."""
    bodies = _bodies(docs, key, fields, url)
    aligned = bodies.join(induce(bodies), ["host", "field"], "left")
    told = _told(aligned, lambda root, constant: (sorted(set().union(*kinds(root, constant))),), "markup array<string>")
    return told.select(F.col("rec").alias(key), "field", F.explode("markup").alias("markup"))
