"""Main body of a collected page by a tree-structured graphical model.

The tree of a page: page - regions (before and after its title) - blocks of
equally built lines - lines.  Every node is main body or surroundings.
Parent-child potentials couple the levels, a log-linear model over the words and
shape of a line gives the local evidence, and one sum-product pass up and one
down yield the marginal of every line.  Potentials and weights are trained from
labelled pages (``page_training``) and kept in ``models/page_model.json``.

Pages that come as HTML have a tree of their own: there a block is what hangs on one
document node (``html_main_body``).

A null text has no lines. Empty lines belong to the main body (they hold
nothing to remove). Without a title, or with one that does not stand in the
page, the page is one region.
"""

from __future__ import annotations

import json
import re
from functools import cache, lru_cache
from math import exp, log
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.html import BLOCKS
from quern.functions.html import parse as parse_html
from quern.llm.arrow import map_rows
from quern.llm.visual_form import letters_and_digits, visual_key

MODEL = Path(__file__).with_name("models") / "page_model.json"
_EDGE = re.compile(r"^[\s\-·※■□▲▼▶>\[|*•›«»<]+|[\s\]|›]+$")
_BLANK = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_TAIL = re.compile(r"\([^()]*\d[^()]*\)(?=\W*$)")
_SENTENCE = re.compile(r"[.?!]\s*$|(?:다|요|오|음|함)\.?\s*$")
_NUMBERS = re.compile(r"^[\d\s/|«»<>쪽처음끝다next]+$")
_RUNNING = re.compile(r"[.?!][\W_]*$")
_SLOT = re.compile(r"\{\{?[\w.]+\}?\}|[$#]\{[\w.]+\}|<%|@@\w|%[a-z_.]+%|__[a-z][a-z_.]*__|\[\[\w|〈[^〉]*입력〉|여기에 입력")
_TRACE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b")
_STATUS = re.compile(r"(?:오류|error|http)\D{0,8}\d{3}\b|\b\d{3} error|\[\d{3}\]")
_MASH = re.compile(r"[ㄱ-ㅎ]{3,}|asdf|qwer|zxcv|(.)\1{4,}|가나다라|(?:(\w+)\W+\2\W+\2\b)")
_LONG = 14  # words from which a line is running text; word pairs are then no features


def tail(low: str) -> str:
    """Shape of a bracketed number at the end of a line in lower case, as titles of numbered posts have it."""
    m = _TAIL.search(low)
    return _DIGITS.sub("9", m.group()) if m else ""


def features(line: str, is_title: bool, region: str, tails: frozenset[str] = frozenset()) -> tuple[list[str], str]:
    """Features of a line and its block kind.  ``tails``: the endings of titles, learned from the labelled pages; a
    line that ends like a title names a post."""
    raw = _BLANK.sub(" ", visual_key(line)).strip()
    low = raw.lower()
    n = _DIGITS.sub("9", _EDGE.sub("", low))
    words = n.split(" ")
    f = ["bias", "r:" + region, "n:" + str(min(len(words), _LONG)), "c:" + str(min(len(n) // 15, 6))]
    post = bool(tails) and tail(low) in tails
    kind = "short"
    if _SLOT.search(low):
        f.append("slot")
    if _TRACE.search(low):
        f.append("trace")
    if _STATUS.search(low):
        f.append("status")
    if _MASH.search(low):
        f.append("mash")
    if is_title:
        f.append("title")
        kind = "title"
    elif post:
        f += ["post", "post:" + region]
        kind = "post"
    elif " | " in raw:
        f.append("bars:" + str(min(raw.count(" | "), 4)) + ("d" if "9" in n else ""))
        kind = "row"
    elif len(words) >= _LONG or _SENTENCE.search(low):
        kind = "text"
    if raw[:1] in "-*":
        f.append("dash")
        if kind == "short":
            kind = "item"
    if raw[:1] == "#":
        f.append("hash")
    if ">" in n or "›" in n:
        f.append("path")
    if _NUMBERS.match(low):
        f.append("numbers")
    if _SENTENCE.search(low):
        f.append("ends")
    if low.endswith("."):
        f.append("stop")
    if not is_title:
        f += ["w:" + w for w in set(words)]
        f += ["first:" + words[0], "last:" + words[-1]]
        if len(words) <= _LONG:
            f += ["p:" + a + " " + b for a, b in zip(words, words[1:])]
    return f, kind


@cache
def load_model() -> dict:
    return json.loads(MODEL.read_text(encoding="utf-8"))


@lru_cache(100_000)
def _reduced(line: str) -> str:
    return letters_and_digits(line)


class PageModel:
    """Marginals of a page's lines."""

    def __init__(self, model: dict | None = None, remembered: int = 100_000):
        m = model or load_model()
        self.weights, self.tails, self.size, self.known = m["weights"], frozenset(m["tails"]), remembered, {}
        self.region = {k: (log(1 - p), log(p)) for k, p in m["region"].items()}
        self.block = {k: [(log(1 - p), log(p)) for p in v] for k, v in m["block"].items()}
        self.line = [(log(1 - p), log(p)) for p in m["line"]]

    def evidence(self, line: str, is_title: bool, region: str) -> tuple[float, str]:
        key = (line, is_title, region)
        got = self.known.get(key)
        if got is None:
            f, kind = features(line, is_title, region, self.tails)
            w = self.weights
            got = (max(-30.0, min(30.0, sum(w.get(x, 0.0) for x in f))), kind)
            if len(line) <= 80:  # only short lines come again often
                if len(self.known) >= self.size:
                    self.known.clear()
                self.known[key] = got
        return got

    def layout(self, text: str, title: str | None) -> tuple[list[str], list[bool], list[str]]:
        lines = text.split("\n")
        key = letters_and_digits(title) if title else ""
        size = len(title) + 40 if title else 0
        # The page's own title stands once; where a list repeats it the last place counts.
        at = max((i for i, x in enumerate(lines) if key and len(x) <= size + len(x) // 2 and _reduced(x) == key), default=None)
        titles = [i == at for i in range(len(lines))]
        regions = ["whole"] * len(lines) if at is None else ["head" if i < at else "tail" for i in range(len(lines))]
        # A region without running text is one of its own: there a short line may be all the page has to say.
        for name in ("tail", "whole"):
            own = [i for i, r in enumerate(regions) if r == name]
            if own and not any(len(x := lines[i]) > 40 and _RUNNING.search(x) and not titles[i] for i in own):
                for i in own:
                    regions[i] = name + "0"
        return lines, titles, regions

    def marginals(self, text: str, title: str | None, nodes: list[int] | None = None) -> list[float]:
        """Probability of main body, line by line.  ``nodes``: of each line the document node its block hangs on, where
        the page comes as a tree; else blocks are runs of equally built lines."""
        lines, titles, regions = self.layout(text, title)
        out = [1.0] * len(lines)
        ev: list[tuple[float, str] | None] = [None if not x.strip() else self.evidence(x, t, r) for x, t, r in zip(lines, titles, regions)]
        i = 0
        while i < len(lines):
            region, j = regions[i], i
            while j < len(lines) and regions[j] == region:
                j += 1
            self._region(region, ev, i, j, out, nodes)
            i = j
        return out

    def _region(self, region: str, ev: list, start: int, end: int, out: list[float], nodes: list[int] | None) -> None:
        # Blocks: runs of equally built lines (empty lines lie between them), or of lines under one node.
        blocks: list[tuple[str, list[int]]] = []
        for i in range(start, end):
            if ev[i] is None:
                continue
            kind = ev[i][1]
            if blocks and (nodes[blocks[-1][1][-1]] == nodes[i] if nodes else blocks[-1][0] == kind and blocks[-1][1][-1] == i - 1):
                blocks[-1][1].append(i)
            else:
                blocks.append((kind, [i]))
        line = self.line
        prior = self.region[region]
        # Upward: lines to blocks, blocks to the region.
        up_lines, up_blocks = {}, []
        for kind, members in blocks:
            b0 = b1 = 0.0
            for i in members:
                z = ev[i][0]
                e0, e1 = -_softplus(z), -_softplus(-z)
                m0, m1 = _add(line[0][0] + e0, line[0][1] + e1), _add(line[1][0] + e0, line[1][1] + e1)
                up_lines[i] = (m0, m1)
                b0 += m0
                b1 += m1
            t = self.block.get(kind, self.block["short"])
            up_blocks.append((b0, b1, _add(t[0][0] + b0, t[0][1] + b1), _add(t[1][0] + b0, t[1][1] + b1), t))
        s0 = prior[0] + sum(u[2] for u in up_blocks)
        s1 = prior[1] + sum(u[3] for u in up_blocks)
        # Downward: the region without the block, the block without the line.
        for (kind, members), (b0, b1, m0, m1, t) in zip(blocks, up_blocks):
            r0, r1 = s0 - m0, s1 - m1
            d0, d1 = _add(r0 + t[0][0], r1 + t[1][0]), _add(r0 + t[0][1], r1 + t[1][1])
            for i in members:
                u0, u1 = up_lines[i]
                c0, c1 = d0 + b0 - u0, d1 + b1 - u1
                z = ev[i][0]
                p0 = _add(c0 + line[0][0], c1 + line[1][0]) - _softplus(z)
                p1 = _add(c0 + line[0][1], c1 + line[1][1]) - _softplus(-z)
                d = p0 - p1
                out[i] = 0.0 if d > 500 else 1.0 if d < -500 else 1 / (1 + exp(d))


def _softplus(z: float) -> float:
    return z + log(1 + exp(-z)) if z > 0 else log(1 + exp(z))


def _add(a: float, b: float) -> float:
    return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))


def surrounding_lines(df: DataFrame, doc_id: str, text: str, title: str) -> DataFrame:
    """Every line that is not main body: ``doc_id, line_no``."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work():
        model = PageModel()

        def f(b):
            for i, t, title in zip(b["_id"], b["_text"], b["_title"]):
                for no, p in enumerate(model.marginals(t, title)):
                    if p < 0.5:
                        yield i, no
        return f

    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(title).alias("_title")).where(F.col("_text").isNotNull())
    return map_rows(rows, f"{doc_id} {kind}, line_no int", work)


def main_body(df: DataFrame, doc_id: str, text: str, title: str) -> DataFrame:
    """``doc_id, main_body``: the lines of the main body in their order (null text gives null)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work():
        model = PageModel()

        def f(b):
            for i, t, title in zip(b["_id"], b["_text"], b["_title"]):
                yield i, None if t is None else "\n".join(x for x, p in zip(t.split("\n"), model.marginals(t, title)) if p >= 0.5)
        return f

    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(title).alias("_title"))
    return map_rows(rows, f"{doc_id} {kind}, main_body string", work)


def html_lines(html: str) -> tuple[list[str], list[int]]:
    """Lines of an HTML page and, of each, the number of the document node its block hangs on.

    A line is the text of a block element, or loose text between blocks.  The lines of elements without blocks in them
    hang on their common parent, so the items of a list or the paragraphs of an article are one block.  The cells of a
    table's row are one line; scripts and styles have none."""
    lines: list[str] = []
    nodes: list[int] = []
    buf: list[str] = []

    def flush(node: int) -> None:
        if text := " ".join("".join(buf).split()):
            lines.append(text)
            nodes.append(node)
        buf.clear()

    number = 0
    todo: list[tuple] = [(parse_html(html), [0, 0, True])]  # element or text, and its block: number, parent's number, has blocks
    while todo:
        n, block = todo.pop()
        if n is None:
            flush(block[0] if block[2] else block[1])
        elif isinstance(n, str):
            buf.append(n)
        elif n.tag in ("script", "style"):
            continue
        elif n.tag == "br":
            flush(block[0])
        elif n.tag in ("td", "th"):
            if "".join(buf).strip():
                buf.append(" | ")
            todo += [(c, block) for c in reversed(n.children)]
        elif n.tag in BLOCKS:
            flush(block[0])
            block[2] = True
            number += 1
            inner = [number, block[0], False]
            todo.append((None, inner))
            todo += [(c, inner) for c in reversed(n.children)]
        else:
            todo += [(c, block) for c in reversed(n.children)]
    flush(0)
    return lines, nodes


def html_main_body(df: DataFrame, doc_id: str, html: str, title: str) -> DataFrame:
    """``doc_id, main_body``: the main body of HTML pages, by the same model over the document's own nodes (null html
    gives null)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work():
        model = PageModel()

        def f(b):
            for i, t, head in zip(b["_id"], b["_text"], b["_title"]):
                if t is None:
                    yield i, None
                    continue
                lines, nodes = html_lines(t)
                yield i, "\n".join(x for x, p in zip(lines, model.marginals("\n".join(lines), head, nodes)) if p >= 0.5)
        return f

    rows = df.select(F.col(doc_id).alias("_id"), F.col(html).alias("_text"), F.col(title).alias("_title"))
    return map_rows(rows, f"{doc_id} {kind}, main_body string", work)
