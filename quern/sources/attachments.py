"""Attachment parsers: bytes to text, one result row a file.

Zip-and-XML formats are read with the standard library.  Formats whose readers
are absent here (pdf, hwp, images) keep the result contract: a null text and a
note.  A broken file never ends the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip

KINDS = {"pdf": "pdf", "hwpx": "hwpx", "hwp": "hwp", "xlsx": "ooxml", "pptx": "ooxml", "docx": "ooxml", "jpg": "image", "jpeg": "image", "png": "image"}


def parser_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))
    out = F.lit("unsupported")
    for e, kind in KINDS.items():
        out = F.when(ext == e, kind).otherwise(out)
    return out


def _texts(xml: bytes, tags: set[str] | None = None) -> list[str]:
    root = ElementTree.fromstring(xml)
    return [t for e in root.iter() if (tags is None or e.tag.rsplit("}", 1)[-1] in tags) and (t := (e.text or "").strip())]


def read_hwpx(data: bytes) -> tuple[str, list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".xml")]
        chosen = [n for n in names if re.search("contents|section|content", n, re.I)] or names
        parts, used = [], []
        for n in sorted(chosen):
            try:
                t = "\n".join(_texts(z.read(n)))
            except (ElementTree.ParseError, zipfile.BadZipFile, KeyError):
                continue
            if t:
                parts.append(t)
                used.append(n)
    return "\n\n".join(parts), used


def read_ooxml(data: bytes, ext: str) -> tuple[str, list[str]]:
    want = {"xlsx": r"xl/worksheets/sheet\d+\.xml$", "pptx": r"ppt/slides/slide\d+\.xml$", "docx": r"word/(?:document|header\d*)\.xml$"}[ext]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if ext == "xlsx" and "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.rsplit("}", 1)[-1] == "t") for si in root if si.tag.rsplit("}", 1)[-1] == "si"]
        parts, used = [], []
        number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
        for n in sorted((n for n in z.namelist() if re.match(want, n)), key=lambda n: (number(n), n)):
            try:
                root = ElementTree.fromstring(z.read(n))
            except ElementTree.ParseError:
                continue
            out = []
            if ext == "xlsx":
                for c in (e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "c"):
                    v = next((e.text for e in c.iter() if e.tag.rsplit("}", 1)[-1] in ("v", "t") and e.text), None)
                    if v is not None:
                        out.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
            else:
                out = [t for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "t" and (t := (e.text or "").strip())]
            if out:
                parts.append("\n".join(out))
                used.append(n)
    return "\n\n".join(parts), used


def parse_file(name: str, data: bytes | None) -> tuple[str, str | None, int | None, str | None, list[str]]:
    """parser_type, text, pages, note, members read."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    kind = KINDS.get(ext, "unsupported")
    try:
        if kind == "hwpx":
            text, used = read_hwpx(data or b"")
        elif kind == "ooxml":
            text, used = read_ooxml(data or b"", ext)
        else:
            return kind, None, None, "unsupported file type" if kind == "unsupported" else f"no reader for {kind} here", []
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as x:
        return kind, None, None, f"{type(x).__name__}: {x}"[:200], []
    return kind, text or None, len(used) or None, None if text else "no text found", used


def parse_files(files: DataFrame) -> DataFrame:
    """``source_type, doc_id, file_name, parser_type, extracted_text, page_count, note, members``."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)}
            res = [parse_file(n, d) for n, d in zip(cols["file_name"], cols["content"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["source_type"], pa.string()), pa.array(cols["doc_id"], pa.string()), pa.array(cols["file_name"], pa.string()), *(pa.array([r[i] for r in res], t) for i, t in
                 enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))))],
                names=["source_type", "doc_id", "file_name", "parser_type", "extracted_text", "page_count", "note", "members"])

    return files.select("source_type", "doc_id", "file_name", "content").mapInArrow(
        run, "source_type string, doc_id string, file_name string, parser_type string, extracted_text string, page_count int, note string, members array<string>")


# ---- text read from pages: predicates and line cleaners

NOISE_LINE = r"^\s*(?:https?://\S*|www\.\S+|\d{4}[-./]\d{1,2}[-./]\d{1,2}\.?|(?:오전|오후)?\s*\d{1,2}:\d{2}(?::\d{2})?|-?\s*\d+\s*(?:/|of)?\s*\d*\s*-?|page \d+.*)\s*$"


def is_noise(c: Column, least: int = 20) -> Column:
    """Fewer than ``least`` signs are left once addresses, dates, times and page marks are away."""
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://\S+|www\.\S+|\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}:\d{2}|(?i)page \d+|\s+", "")
    return F.length(rest) < least


def clean_lines(c: Column) -> Column:
    """Blanks squeezed, noise lines emptied, three or more line breaks become two."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: strip(F.regexp_replace(x, "[ \\t]+", " ")))
    kept = F.transform(lines, lambda x: F.when(F.lower(x).rlike(NOISE_LINE), "").otherwise(x))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\\n{3,}", "\n\n"))


def merge_texts(items: Column, label: str) -> Column:
    """``[label: name]`` over each non-empty text of array<struct<name, text>>, joined by an empty line; null if none."""
    full = F.filter(items, lambda x: strip(F.coalesce(x["text"], F.lit(""))) != "")
    return F.nullif(F.array_join(F.transform(full, lambda x: F.concat(F.lit(f"[{label}: "), F.coalesce(x["name"], F.lit("")), F.lit("]\n"), strip(x["text"]))), "\n\n"), F.lit(""))
