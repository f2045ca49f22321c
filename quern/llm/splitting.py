"""Cutting oversized texts at natural boundaries.

The text is taken apart into units (paragraphs, lines, sentences).  Between
neighbouring units a lexical cohesion score is computed from sliding blocks of
words; its valleys mark topic boundaries.  From each start the deepest valley
inside the size window is the cut; a longer break (paragraph over line over
sentence over blank) decides between equal depths.  Only where the window has
no break at all is a word cut.  Every piece but the first repeats the
``overlap`` characters before its start, so pieces without their overlap
concatenate to the text again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import PARTICLES
from quern.llm.arrow import map_rows

LIMIT, OVERLAP = 900, 100
#: Units (sentences, lines) in each of the two blocks compared at a gap; a cut is sought in the last part of a window.
BLOCK_UNITS, WINDOW_START = 3, 0.5
_GAP = re.compile(r"\n[ \t]*\n\s*|\n|(?<=[.!?。…])[ \t　]+|(?<=다\.)(?=\S)")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"\w{2,}")
#: A Korean word is compared without its particle, so one noun is one word.
_PARTICLE = re.compile(PARTICLES)


def _gaps(text: str) -> list[tuple[int, int]]:
    """Cut positions (end of the break) with their rank: 3 paragraph, 2 line, 1 sentence."""
    out = []
    for m in _GAP.finditer(text):
        b = m.group()
        out.append((m.end(), 3 if b.count("\n") > 1 else 2 if "\n" in b else 1))
    return [(p, r) for p, r in out if 0 < p < len(text)]


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(b) < len(a):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def boundary_depths(text: str, gaps: list[tuple[int, int]]) -> list[float]:
    """Depth of the cohesion valley at each gap: fall from the peaks on both sides."""
    edges = [0, *(p for p, _ in gaps), len(text)]
    units = [Counter(_PARTICLE.sub("", w) if "가" <= w[-1] <= "힣" and len(w) > 2 else w for w in _WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])]
    n = len(gaps)
    sims, left, right = [], Counter(), Counter()
    for u in units[1:1 + BLOCK_UNITS]:
        right.update(u)
    for g in range(n):
        left.update(units[g])
        if g >= BLOCK_UNITS:
            left -= units[g - BLOCK_UNITS]
        if g:
            right -= units[g]
            if g + BLOCK_UNITS < len(units):
                right.update(units[g + BLOCK_UNITS])
        sims.append(_cosine(left, right))
    depths = [0.0] * n
    rise_left: list[float] = []
    for i, s in enumerate(sims):  # how far the similarity fell from the last peak on the left
        if i and s <= sims[i - 1]:
            rise_left.append(max(rise_left[-1] + sims[i - 1] - s, 0.0))
        else:
            rise_left.append(0.0)
    rise = 0.0
    for i in range(n - 1, -1, -1):
        rise = rise + sims[i + 1] - sims[i] if i + 1 < n and sims[i] <= sims[i + 1] else 0.0
        depths[i] = rise_left[i] + rise
    return depths


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces ``(start, body_start, end)`` of a text: each at most ``limit`` long, body parts tile the text.

    A text within the limit is one piece; an empty text has none.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, 0, n)]
    gaps = _gaps(text)
    depths = boundary_depths(text, gaps)
    at = [p for p, _ in gaps]
    out, body = [], 0
    while body < n:
        start = max(0, body - overlap)
        room = start + limit
        if room >= n:
            out.append((start, body, n))
            break
        low = body + max(1, int((room - body) * WINDOW_START))
        i, j = bisect_left(at, low), bisect_right(at, room)
        if i == j:
            i = bisect_right(at, body)
        if i < j:
            cut = at[max(range(i, j), key=lambda g: (round(depths[g], 6), gaps[g][1], at[g]))]
        else:
            cut = next((m.end() for m in reversed(list(_BLANK.finditer(text, low, room))) if m.end() <= room), room)
        out.append((start, body, cut))
        body = cut
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters: ``rec_id, piece_no, start_pos, body_pos, end_pos, piece``.

    Null, empty and short texts are no oversized items and give no row.  Texts are read whole; each is split inside
    its row, so nothing is exchanged.
    """
    kind = df.schema[key].dataType.simpleString()

    def work():
        def f(b):
            for k, t in zip(b["_key"], b["_text"]):
                for no, (start, body, end) in enumerate(split_text(t, limit, overlap)):
                    yield k, no, start, body, end, t[start:end]
        return f

    long_ones = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > limit)
    return map_rows(long_ones, f"rec_id {kind}, piece_no int, start_pos int, body_pos int, end_pos int, piece string", work)
