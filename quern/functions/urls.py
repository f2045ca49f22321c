"""Functions over addresses."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ATTACHMENT_EXTENSIONS = ("pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "jpg", "jpeg", "png")


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parameter(c: Column, name: str) -> Column:
    """Value of a query parameter, null if it is not there."""
    return F.nullif(F.regexp_extract(c, f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def extension(c: Column) -> Column:
    last = F.regexp_extract(path_of(c), "([^/]*)$", 1)
    return F.lower(F.nullif(F.regexp_extract(last, "\\.([^.]+)$", 1), F.lit("")))


def canonical(c: Column) -> Column:
    """Without blanks at the ends and without fragment."""
    return F.regexp_replace(F.btrim(c), "#.*$", "")


def classify(c: Column) -> Column:
    """attachment, board_detail, board_list or static_page, in this order of rules."""
    mode = F.lower(F.coalesce(parameter(c, "mode"), F.lit("")))
    return (F.when(extension(c).isin(*ATTACHMENT_EXTENSIONS) | mode.isin("download"), "attachment")
            .when((mode == "view") | parameter(c, "articleNo").isNotNull(), "board_detail")
            .when((mode == "list") | c.contains("/board/"), "board_list").otherwise("static_page"))


def article_number(c: Column) -> Column:
    """Query parameter, else the last number of the path."""
    return F.coalesce(parameter(c, "articleNo"), F.nullif(F.regexp_extract(path_of(c), "/(\\d+)/?$", 1), F.lit("")))


def source_type(c: Column, rules: list[tuple[str, str]], default: str = "webpage") -> Column:
    """First rule whose part stands in the address."""
    out = F.lit(default)
    for part, kind in reversed(rules):
        out = F.when(F.contains(F.lower(c), F.lit(part)), kind).otherwise(out)
    return out


def document_id(kind: Column, article: Column, prefix: str = "doc") -> Column:
    return F.concat_ws("_", F.lit(prefix), kind, F.coalesce(F.nullif(article, F.lit("")), F.lit("unknown")))


def static_id(url: Column) -> Column:
    return F.concat(F.lit("static_"), F.substring(F.sha1(url), 1, 16))


def navigates(c: Column) -> Column:
    return ~F.coalesce(F.lower(c).rlike("^\\s*(javascript|mailto|tel):"), F.lit(True))


def looks_like_attachment(href: Column, label: Column) -> Column:
    h = F.lower(F.coalesce(href, F.lit("")))
    return (h.contains("download") | h.contains("file") | h.rlike("\\.(" + "|".join(ATTACHMENT_EXTENSIONS) + ")$")
            | F.coalesce(label, F.lit("")).rlike("첨부|다운로드"))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href)], dtype="object")
