"""Text functions, Column to Column unless a name says otherwise. Null in, null out, if nothing else is said."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

WORD = "[가-힣A-Za-z0-9]+"
# Fixed value: particles the search tokenizer takes off, in the order of trial.
PARTICLES = "(은|는|이|가|을|를|에|의|로|으로|에서|부터|까지|도)$"
BLANKS = "[ \\t\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000]"


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits without lone letters, one trailing particle taken off; repeats stay."""
    # Three passes over the whole text; a function per token would leave generated code.
    sign = "[가-힣A-Za-z0-9]"
    lone = F.regexp_replace(F.lower(c), f"(?<!{sign})[가-힣A-Za-z](?!{sign})", "")
    return words(F.regexp_replace(lone, PARTICLES.removesuffix("$") + f"(?!{sign})", ""))


_RUN, _PARTICLE = re.compile("[가-힣a-z0-9]+"), re.compile(PARTICLES)


class SearchTokens:
    """``search_tokens`` of a Python string, for passes that need more than the tokens; recent words are remembered."""

    def __init__(self, remembered: int = 200_000):
        self.known: dict[str, str] = {}
        self.size = remembered

    def __call__(self, s: str) -> list[str]:
        known, out = self.known, []
        for w in _RUN.findall(s.lower()):
            t = known.get(w)
            if t is None:
                if len(known) >= self.size:
                    known.clear()
                t = known[w] = "" if len(w) == 1 and not w.isdigit() else _PARTICLE.sub("", w)
            if t:
                out.append(t)
        return out


def keyword_tokens(c: Column) -> Column:
    """As ``search_tokens`` in the given letter case; a particle leaves only a word of two or more signs."""
    return F.filter(F.transform(words(c), lambda t: F.when(F.length(t) > 1, F.regexp_replace(t, PARTICLES, "")).otherwise(t)), lambda t: t != "")


def distinct_tokens(c: Column) -> Column:
    """Distinct lower-case runs in order of first appearance."""
    return F.array_distinct(words(F.lower(c)))


def long_tokens(c: Column) -> Column:
    """Runs of two or more signs."""
    return words(c, "[가-힣A-Za-z0-9]{2,}")


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once: inside a lambda an outer expression would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\s\\u00A0\\u3000]+|[\\s\\u00A0\\u3000]+$", "")


def one_line(c: Column) -> Column:
    """Blanks of any kind and line breaks as one space."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\u00A0\\u3000]+", " "))


def squeeze(c: Column) -> Column:
    """One space for runs of blanks, no blank at line ends, at most one empty line in a row."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n"), BLANKS + "+", " ")
    return strip(F.regexp_replace(F.regexp_replace(x, " ?\\n ?", "\n"), "\\n{3,}", "\n\n"))


def clean_text(c: Column, noise: list[str] = (), table: Column | None = None, min_line: int = 2) -> Column:
    """``squeeze``, then lines that match a noise pattern or are shorter than ``min_line`` leave; table text follows."""
    lines = F.split(squeeze(c), "\n", -1)
    kept = F.filter(lines, lambda x: (x == "") | ((F.length(x) >= min_line) & ~(x.rlike("|".join(f"(?:{p})" for p in noise)) if noise else F.lit(False))))
    body = squeeze(F.array_join(kept, "\n"))
    if table is None:
        return body
    t = squeeze(table)
    return F.when(t == "", body).when(body == "", t).otherwise(F.concat_ws("\n\n", body, t))


def clean_title(c: Column, suffixes: str = "[^|\\-–]*(대학교|University|Portal)[^|\\-–]*") -> Column:
    """Site names behind a bar or dash leave the title."""
    return strip(F.regexp_replace(one_line(c), f"\\s*[|\\-–]\\s*{suffixes}$", ""))


def strip_values(text: Column, *values: Column) -> Column:
    """Take literal values (any letter case) out of a text."""
    for v in values:
        quoted = F.concat(F.lit("(?i)\\Q"), v, F.lit("\\E"))
        text = F.when(v.isNull() | (v == ""), text).otherwise(F.regexp_replace(text, quoted, ""))
    return squeeze(text)


def clean_person(c: Column, labels: str = "등록일|작성일|조회|첨부") -> Column:
    """A name up to the next label, without blanks and colons at its ends; null if nothing is left."""
    return F.nullif(F.btrim(F.split(one_line(c), labels)[0], F.lit(" :")), F.lit(""))


def fingerprint_text(parts: dict[str, Column]) -> Column:
    """Tagged non-empty parts joined by an empty line."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(strip(c), F.lit("")) != "", F.concat(F.lit(f"[{tag}]\n"), strip(c))) for tag, c in parts.items()])


def fingerprint(parts: dict[str, Column]) -> Column:
    return F.sha1(fingerprint_text(parts))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\\n\\s*\\n", -1), strip), lambda p: p != "")


def fixed_split(c: Column, size: int = 900, overlap: int = 100) -> Column:
    """Pieces of ``size`` signs, each starting ``size - overlap`` after the one before; the last ends the text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(c) - size) / step), F.lit(0)).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, size))).otherwise(F.array().cast("array<string>"))


_SPACE = " \t\n\x0b\x0c\r\u00a0\u3000"
_EMPTY_LINE = re.compile(r"\n\s*\n", re.ASCII)


def packed_pieces(text: str | None, size: int = 900, overlap: int = 100) -> list[str]:
    """Pieces of ``greedy_pack`` for one text, in one pass."""
    out, buf, n = [], [], 0
    for p in (p for x in _EMPTY_LINE.split(text or "") if (p := x.strip(_SPACE))):
        if buf and (len(p) > size or n + 2 + len(p) > size):
            out.append("\n\n".join(buf))
            buf, n = [], 0
        if len(p) > size:
            step = size - overlap
            out += [p[i:i + size] for i in range(0, max(len(p) - overlap, 1), step)]
        else:
            n += len(p) + (2 if buf else 0)
            buf.append(p)
    return [*out, "\n\n".join(buf)] if buf else out


def greedy_pack(c: Column, size: int = 900, overlap: int = 100) -> Column:
    """Paragraphs packed in order up to ``size`` signs with an empty line between them; a longer paragraph closes
    the open piece and is cut by ``fixed_split``.  Packed pieces do not overlap."""
    @F.pandas_udf(ArrayType(StringType()))
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([packed_pieces(t, size, overlap) for t in texts], dtype="object")

    return pack(c)


def sentences(c: Column, cut: int = 240, least: int = 20) -> Column:
    """After . ! ? 。 or the ending 다 before a blank; each cut at ``cut`` signs, shorter ones than ``least`` leave."""
    parts = F.split(F.coalesce(c, F.lit("")), "(?<=[.!?。])\\s+|(?<=다)\\s+|\\n+", -1)
    return F.filter(F.transform(parts, lambda s: F.substring(strip(s), 1, cut)), lambda s: F.length(s) >= least)


# A line that begins so labels a context and says nothing.
LABELS = ["[문서", "[TITLE]", "[BODY]", "[ATTACHMENT]", "제목:", "출처:", "게시일:", "내용:"]


def content_lines(c: Column) -> Column:
    """Lines of a context that say something: not empty, no label, not the word ``body`` alone."""
    def label(x):
        out = (x == "") | (x == "body")
        for p in LABELS:
            out = out | F.startswith(x, F.lit(p))
        return out

    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), strip), lambda x: ~label(x))


def context_sentences(c: Column, cut: int = 240, least: int = 20) -> Column:
    """Sentences of a context's content lines, which run on over line ends; shorter ones than ``least`` leave, dashes
    and blanks come off the ends, each is cut at ``cut`` signs."""
    parts = F.split(one_line(F.array_join(content_lines(c), " ")), "(?<=[.!?。])\\s+|(?<=다)\\s+", -1)
    return F.transform(F.filter(parts, lambda s: F.length(strip(s)) >= least), lambda s: F.substring(F.btrim(s, F.lit(" -")), 1, cut))


def section(c: Column, name: str) -> Column:
    """Text between a bracketed header and the next one."""
    return strip(F.regexp_extract(c, rf"(?s)\[{name}\]\s*(.*?)(?=\n\[[^\]\n]+\]|$)", 1))


def utterance(c: Column) -> Column:
    """Lower case, single spaces, no closing marks."""
    return F.regexp_replace(F.lower(one_line(c)), "[?!.~]+$", "")


def squeezed_form(c: Column, swaps: tuple[str, str] = ("@013457$", "aoieasts"), keep_blanks: bool = False) -> Column:
    """Form for word-list tests: look-alike signs swapped, marks and blanks away (or as blanks), long repeats cut to two."""
    x = F.translate(F.lower(F.coalesce(c, F.lit(""))), *swaps)
    x = F.regexp_replace(x, "[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]+", " " if keep_blanks else "")
    return strip(F.regexp_replace(x, "(.)\\1{2,}", "$1$1"))


def preview(c: Column, size: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(mark))).otherwise(c)


def safe_filename(c: Column) -> Column:
    return F.when(one_line(c) == "", F.lit("file")).otherwise(strip(F.regexp_replace(one_line(c), '[\\\\/:*?"<>|\\x00-\\x1f]+', "_")))


def disposition_filename(c: Column) -> Column:
    """File name of a Content-Disposition value, in its extended or quoted form."""
    extended = F.regexp_extract(c, "(?i)filename\\*=(?:UTF-8'[^']*')([^;]+)", 1)
    plain = F.regexp_extract(c, '(?i)filename="?([^";]+)"?', 1)
    return F.when(extended != "", F.try_url_decode(strip(extended))).when(plain != "", strip(plain))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x), na_action="ignore")


def _indel_similarity(a: str, b: str) -> float:
    """2 x longest common subsequence over the sum of lengths, as a percentage."""
    if not a and not b:
        return 100.0
    # Bit-parallel longest common subsequence.
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def partial_similarity(a: str, b: str) -> float:
    """Best ``_indel_similarity`` of the shorter text with a window of the longer one (0 to 100)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    windows = {b[max(0, i):i + n] for i in range(1 - n, len(b))}
    return max(_indel_similarity(a, w) for w in windows if w)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(partial_similarity(x, y), 6) for x, y in zip(a, b)], dtype="float64")


def normalise_query(c: Column, replacements: list[tuple[str, str]] = ()) -> Column:
    """Widths and blanks normalised, signs beyond letters, digits and ``- / ? . :`` away, literal replacements in
    order, repeated marks single."""
    x = one_line(nfkc(F.coalesce(c, F.lit(""))))
    x = one_line(F.regexp_replace(x, "[^0-9A-Za-z가-힣\\s\\-/?.:]", ""))
    for a, b in replacements:
        x = F.replace(x, F.lit(a), F.lit(b))
    return one_line(F.regexp_replace(x, "([?.:])\\1+", "$1"))
