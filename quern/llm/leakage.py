"""Evaluation passages inside training texts.

Passages and texts are reduced to letters and digits of their one form in lower
case.  Shared character q-grams are counted in overlapping diagonal bands; by
the q-gram lemma a region that holds a run of ``run`` characters with at most
``edits`` edits keeps at least ``run + 1 - q - q * edits`` of them.  Bands that
reach the bound are verified by banded alignment.

The passages are the fixed side.  Their index is shared with all tasks, in
blocks of at most ``block_chars`` passage characters; more passages mean more
passes over the texts, never a larger index.  Null texts and null passages
match nothing; passages shorter than ``run`` cannot be given away.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_rows
from quern.llm.visual_form import letters_and_digits

RUN, Q = 60, 12
BLOCK_CHARS = 8_000_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def gram_hashes(s: str, q: int) -> np.ndarray:
    """64-bit hash of every q-gram, by position."""
    codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        h = h * _BASE + codes[j:j + n]
    return (h ^ (h >> np.uint64(31))) * _MIX


class PassageIndex:
    """q-gram index of reduced passages: sorted hashes with item and position, 16 bytes a character, behind a bitmap.
    A hash that meets by chance adds to a count and is refused by the alignment."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, q: int = Q, edits: int = 0):
        self.run, self.q, self.edits = run, q, edits
        self.bound = run + 1 - q - q * edits
        if self.bound < 1:
            raise ValueError("the edit budget leaves no q-gram in common: take a smaller q or fewer edits")
        self.items = [(i, s) for i, p in items if len(s := letters_and_digits(p)) >= run]
        each = [gram_hashes(s, q) for _, s in self.items]
        hashes = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(each), dtype=np.int32), [len(h) for h in each])[order] if each else np.zeros(0, dtype=np.int32)
        self.place = (np.concatenate([np.arange(len(h), dtype=np.int32) for h in each]) if each else np.zeros(0, dtype=np.int32))[order]
        bits = max(10, int(len(hashes)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[(self.hashes >> self.shift).astype(np.int64)] = True

    def found(self, text: str) -> list[int]:
        """Item ids whose passage has a run inside ``text`` (in order of id)."""
        t = letters_and_digits(text)
        if len(t) < self.run - self.edits or not len(self.hashes):
            return []
        h = gram_hashes(t, self.q)
        at = np.nonzero(self.bitmap[(h >> self.shift).astype(np.int64)])[0]
        if not len(at):
            return []
        low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        some = high > low
        if int(some.sum()) < self.bound:
            return []
        width = self.edits + 1
        bands: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, a, z in zip(at[some].tolist(), low[some].tolist(), high[some].tolist()):
            for no, p in zip(self.item[a:z].tolist(), self.place[a:z].tolist()):
                b = (i - p) // width
                bands[no, b].append(i)  # bands of two widths overlap by one, so no region is cut in two
                if self.edits:
                    bands[no, b - 1].append(i)
        out = set()
        for (no, b), hits in bands.items():
            if len(hits) < self.bound or self.items[no][0] in out:
                continue
            hits.sort()
            # The lemma holds inside one window of the run's length (and its edits).
            span, k = self.run + self.edits - self.q, self.bound - 1
            regions = [(hits[j], hits[j + k]) for j in range(len(hits) - k) if hits[j + k] - hits[j] <= span]
            if regions and self._verified(t, self.items[no][1], b * width, regions):
                out.add(self.items[no][0])
        return sorted(out)

    def _verified(self, t: str, s: str, diagonal: int, regions: list[tuple[int, int]]) -> bool:
        if self.edits == 0:
            # One diagonal: the alignment is a run of equal characters.
            for a, z in regions:
                i = a
                while i and i - diagonal > 0 and t[i - 1] == s[i - 1 - diagonal]:
                    i -= 1
                j = a
                while j < len(t) and j - diagonal < len(s) and t[j] == s[j - diagonal]:
                    j += 1
                if j - i >= self.run:
                    return True
            return False
        low, high = min(a for a, _ in regions), max(z for _, z in regions) + self.q
        return banded_run(t[max(0, low - self.run):high + self.run], s, diagonal - max(0, low - self.run), 2 * self.edits + 2, self.run, self.edits)


def banded_run(t: str, s: str, diagonal: int, half: int, run: int, edits: int) -> bool:
    """Does some stretch of at least ``run`` characters of ``s`` align inside the band with at most ``edits`` edits?

    State per cell and edit count: characters of ``s`` covered so far by the best alignment ending there."""
    prev: dict[int, list[int]] = {}
    for i in range(len(t) + 1):
        row: dict[int, list[int]] = {}
        for p in range(max(0, i - diagonal - half), min(len(s), i - diagonal + half) + 1):
            best = [0] + [-1] * edits
            up, diag, left = prev.get(p), prev.get(p - 1), row.get(p - 1)
            for e in range(edits + 1):
                if diag is not None and i and p:
                    if t[i - 1] == s[p - 1]:
                        if diag[e] >= 0:
                            best[e] = max(best[e], diag[e] + 1)
                    elif e and diag[e - 1] > 0:
                        best[e] = max(best[e], diag[e - 1] + 1)
                if e and up is not None and up[e - 1] > 0:
                    best[e] = max(best[e], up[e - 1])
                if e and left is not None and left[e - 1] > 0:
                    best[e] = max(best[e], left[e - 1] + 1)
                if best[e] >= run:
                    return True
            row[p] = best
        prev = row
    return False


_BUILT: dict[str, PassageIndex] = {}


def _built(name: str, shared, run: int, q: int, edits: int) -> PassageIndex:
    """The index of a block, built once in each worker process however many tasks it runs."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = PassageIndex(shared.value, run, q, edits)
    return _BUILT[name]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, run: int = RUN,
                 q: int = Q, edits: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id``: texts that hold at least ``run`` consecutive letters and digits of a passage."""
    spark = docs.sparkSession
    sized = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("p")).where("item_id is not null and p is not null")
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = f"{doc_id} {kind}, item_id {item_kind}"

    def scan(block):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def work():
            index = _built(name, shared, run, q, edits)

            def f(b):
                for i, t in zip(b["_id"], b["_text"]):
                    for item in index.found(t):
                        yield i, item
            return f
        return map_rows(texts, schema, work)

    out, block, chars = None, [], 0
    for r in sized.orderBy("item_id").toLocalIterator():
        if block and chars + len(r["p"]) > block_chars:
            one = scan(block)
            out = one if out is None else out.unionByName(one)
            block, chars = [], 0
        block.append((r["item_id"], r["p"]))
        chars += len(r["p"])
    one = scan(block)
    return one if out is None else out.unionByName(one)
