"""Fields of an HTML page by the standard parser: one struct-returning Arrow function."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_BEFORE = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "li": {"li"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Elements whose text stands on lines of its own.
BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "section", "article", "table", "ul", "ol", "dt", "dd"}
#: Kinds and class words of nodes that hold no content.
NOISE_TAGS = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
NOISE_CLASSES = re.compile(r"\b(?:menu|nav|footer|header|sidebar|breadcrumb|share|sns|gnb|lnb)\b", re.I)
# Where the content of a board's article and of a static page stands, in the order of trial; what leaves a
# static page's content; where a title stands if the page names none; labels that end an author's name.
BOARD_CONTENT = [".board_view .cont", ".board_view .content", ".board-view .cont", ".board-view .content", ".view_cont", ".view-content", "#contents", "#content", ".content", "main", ".fr-view"]
STATIC_CONTENT = ["main", "#contents", "#content", ".contents", ".content", ".sub-content", ".cont", "#board_skin"]
STATIC_NOISE = ["header", "footer", "nav", "aside", "script", "style", ".breadcrumb", ".quick", ".quickMenu", ".pagination", ".sns", ".share"]
_STATIC_NOISE = frozenset(STATIC_NOISE)
TITLES = ["h2", "h3", ".title", ".sub-title", ".page-title", ".contents-title"]
AUTHOR_ENDS = "조회수|작성일|첨부파일|목록|이전글|다음글"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        # An explicit stack: pages may be nested deeper than Python's recursion allows.
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self, skip: set[str] = frozenset(("script", "style"))) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip:
                if n.tag in BLOCKS:
                    out.append("\n")
                    todo.append("\n")
                todo.extend(reversed(n.children))
        lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip() for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    def classes(self) -> str:
        return (self.attrs.get("class") or "") + " " + (self.attrs.get("id") or "")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = _ENDS_BEFORE.get(tag)
        if ends and self.at.tag in ends:  # an end tag left out
            self.at = self.at.parent
            if tag == "tr" and self.at.tag == "tr":
                self.at = self.at.parent
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def find_title(root: Node, hint: str | None = None) -> str:
    if hint and hint.strip():
        return hint.strip()
    kinds = _by_kind(root)
    for n in kinds.get("title", ()):
        if n.text().strip():
            return n.text().strip()
    return next((t for sel in (*TITLES, "h1") if (n := select(root, sel, kinds)) and (t := " ".join(n.text().split()))), "")


def is_kind(n: Node, simple: str) -> bool:
    """Does a node meet ``tag``, ``.class`` or ``#id``?"""
    if simple.startswith("."):
        return simple[1:] in n.classes().split()
    return n.attrs.get("id") == simple[1:] if simple.startswith("#") else n.tag == simple


def _by_kind(root: Node) -> dict[str, list[Node]]:
    """Nodes of a page in document order by tag, ``.class`` and ``#id``, kept with its root."""
    out: dict[str, list[Node]] = {}
    for n in root.walk():
        out.setdefault(n.tag, []).append(n)
        if n.attrs:
            for c in dict.fromkeys(n.classes().split()):
                out.setdefault("." + c, []).append(n)
            if n.attrs.get("id"):
                out.setdefault("#" + n.attrs["id"], []).append(n)
    return out


def select(root: Node, selector: str, kinds: dict[str, list[Node]] | None = None) -> Node | None:
    """First node in document order that meets a selector of one kind, or of an ancestor's and its own."""
    *above, own = selector.split()
    for n in (kinds if kinds is not None else _by_kind(root)).get(own, ()):
        p, wanted = n.parent, list(above)
        while p is not None and wanted:
            if is_kind(p, wanted[-1]):
                wanted.pop()
            p = p.parent
        if not wanted:
            return n
    return None


def find_content(root: Node, selectors: list[str] = BOARD_CONTENT) -> Node:
    """The first node that a selector finds, in their order; else the div with the longest text, of equal ones the first."""
    kinds = _by_kind(root)
    for sel in selectors:
        if (n := select(root, sel, kinds)) is not None:
            return n
    divs = [n for n in root.walk() if n.tag == "div"]
    return max(divs, key=lambda n: len(n.text())) if divs else root


def without_noise(n: Node) -> Node:
    n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in NOISE_TAGS or NOISE_CLASSES.search(c.classes()) or c.tag in _STATIC_NOISE or c.attrs and any("." + x in _STATIC_NOISE for x in c.classes().split()))]
    for c in n.children:
        if isinstance(c, Node):
            without_noise(c)
    return n


def tables(node: Node) -> str:
    out = []
    for i, t in enumerate((n for n in node.walk() if n.tag == "table"), 1):
        rows = []
        for r in (n for n in t.walk() if n.tag == "tr"):
            cells = [" ".join(c.text().split()) for c in r.walk() if c.tag in ("td", "th")]
            if any(cells):
                rows.append(" | ".join(c for c in cells if c))
        if rows:
            out.append(f"[TABLE {i}]\n" + "\n".join(rows))
    return "\n\n".join(out)


def fields(html: str | None, url: str | None, hint: str | None = None, static: bool = False) -> dict:
    """Fields of a page; ``static``: not a board's article."""
    root = parse(html or "")
    node = find_content(root, STATIC_CONTENT if static else BOARD_CONTENT)
    text = root.text()
    date = re.search(r"(?:작성일|등록일|Date)\s*[:：]?\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2})", text) or re.search(r"(\d{4}-\d{2}-\d{2})", text)
    views = re.search(r"(?:조회수?|Views)\s*[:：]?\s*([\d,]+)", text)
    author = re.search(r"(?m)^\s*(?:작성자|글쓴이|부서|Author)\s*[:：]?\s*([^\n|]{1,40})", text)
    who = re.split(rf"\s*(?:{AUTHOR_ENDS})\s*", author.group(1))[0].strip(" :") if author else ""
    links, images, files = set(), set(), []
    for n in node.walk():
        if n.tag == "a" and (h := n.attrs.get("href")):
            if not re.match(r"\s*(?:javascript|mailto|tel):", h, re.I):
                absolute = urljoin(url or "", h.strip()).split("#")[0]
                links.add(absolute)
                label = " ".join(n.text().split())
                if re.search(r"download|file|\.(?:pdf|hwpx?|docx?|xlsx?|pptx?|zip)$", absolute.lower()) or re.search("첨부|다운로드", label):
                    files.append({"name": label or absolute.rsplit("/", 1)[-1], "url": absolute})
        elif n.tag == "img" and (s := n.attrs.get("src")):
            images.add(urljoin(url or "", s.strip()))
    seen, unique = set(), []
    for i, f in enumerate(files, 1):  # numbered before repeats leave
        if (f["name"], f["url"]) not in seen:
            seen.add((f["name"], f["url"]))
            unique.append({"index": i, **f})
    table = tables(node)
    return {"title": find_title(root, hint), "content": without_noise(node).text(), "table_text": table, "published_at": date.group(1) if date else None,
            "views": int(views.group(1).replace(",", "")) if views else None, "author": who or None,
            "links": sorted(links), "images": sorted(images), "attachments": unique}


_S, _A = StringType(), ArrayType(StringType())
SCHEMA = StructType([
    StructField("title", _S), StructField("content", _S), StructField("table_text", _S), StructField("published_at", _S), StructField("views", IntegerType()),
    StructField("author", _S), StructField("links", _A), StructField("images", _A),
    StructField("attachments", ArrayType(StructType([StructField("index", IntegerType()), StructField("name", _S), StructField("url", _S)])))])


@F.pandas_udf(SCHEMA)
def page_fields(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fields(h, u) for h, u in zip(html, url)], columns=["title", "content", "table_text", "published_at", "views", "author", "links", "images", "attachments"])


def list_rows(html: str, base: str) -> list[dict]:
    """Rows of a board's list page: those with a link to an article; the last of equal articles at the first place."""
    root, out = parse(html or ""), {}
    rows = [n for n in root.walk() if n.tag == "tr"]
    for r in rows:
        a = next((n for n in r.walk() if n.tag == "a" and n.attrs.get("href")), None)
        m = a and re.search(r"articleNo=(\d+)", a.attrs["href"])
        if m:
            d = re.search(r"\d{4}[-.]\d{2}[-.]\d{2}", r.text())
            out[m.group(1)] = {"article_no": m.group(1), "title": " ".join(a.text().split()), "url": urljoin(base, a.attrs["href"]),
                               "date": d.group().replace(".", "-") if d else None, "row_text": " ".join(r.text().split())}
    return list(out.values())
