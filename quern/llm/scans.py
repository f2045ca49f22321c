"""Noise in text read from scanned pages.

Running headers are found by fuzzy repetition of lines at page edges - within
a record and over all records.  Page numbers are lines of the form of one that
carry marks of their own, stand at a page's edge or continue the record's
sequence of numbers.  What remains is running text.  A word is misread if the corpus vocabulary does not know it but
knows, much more often, one that differs by confusable shapes only; a hyphen
at a line end is inside a broken word unless the vocabulary knows the hyphened
compound and not the joined word.

The vocabulary comes from born-digital text of the same corpus.  Tokens of the
scans that stand in a bounded list of the most frequent words are known at
once; all others are looked up by joins, so no vocabulary has to fit a task.
A word that the rule for misread ones would change is never in the list, so its
length changes speed, not verdicts.  Known headers are shared with the tasks up
to a checked number and joined beyond it.
Null and empty texts have no lines.  A record that neither looks wrapped like
a scanned page nor shows another sign of one (``PageReader.is_scan``) is not
one; ``always_scanned`` takes a field as scanned.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_rows, map_task
from quern.session import written

#: Words known at once in every task (the rest is joined).
KNOWN_WORDS = 50_000
#: A line heads pages, whatever the number of records, if it stands above this many different lines and at page tops
#: more often than lines do by chance (binomial tail below the level, corrected for all lines tested).
HEADER_RECORDS, HEADER_LEVEL = 3, 0.05
#: Known headers are shared up to this number, else joined.
SHARED_HEADERS = 50_000
#: The right word is this often in the vocabulary at least, and this many times as often as the doubtful one.
MIN_RIGHT, RATIO = 3, 100
MARKS = "-­¬‐‑"

_DIGIT_RUN = re.compile(r"\d+")
_EDGE = re.compile(r"^[^\w%]+|[^\w%]+$")
_NUMBER_LIKE = re.compile(r"[0-9OolISBis]+")
_AS_DIGIT = str.maketrans("OoIliSsB", "00111558")
_NUMBER = "[0-9OolIS]{1,4}"
_PAGE_NUMBER = re.compile(rf"^[\W_]*(?:(?i:p(?:age)?\.?)|쪽|면)?\s*({_NUMBER})(?:\s*(?:/|(?i:of)|중)\s*{_NUMBER})?\s*(?:쪽|면|페이지)?[\W_]*$")
_BARE_NUMBER = re.compile(_NUMBER)
_MISREAD_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:[0-9OolI]*[0-9][OolI]+[0-9][0-9OolI]*(?![A-Za-z0-9])|(?:[0-9]+[OolI]+|[OolI]+[0-9]+)(?=[년월일시명]))")
_HEADER_NUMBER = re.compile(r"^\s*[0-9OolIS]{1,4}\s{2,}|\s{2,}[0-9OolIS]{1,4}\s*$")
_ENDS = re.compile(r"[.?!:;)\]]$")
_ROW = re.compile(r"^\s*(?:[-*•※■□]|\d+[).]|[가-하]\.)\s| \| | / ")

# Vowels and finals of one class are confused by shape.
_VOWELS = [0, 4, 0, 4, 0, 4, 0, 4, 1, 2, 2, 2, 1, 1, 3, 3, 3, 1, 1, 0, 0]
_FINALS = {21: 16}
_INITIALS = {15: 0, 16: 3}


def shape(token: str) -> str:
    """A token as the vocabulary counts it: bare of marks at its ends, lower case, digit runs as one sign."""
    return _DIGIT_RUN.sub("9", _EDGE.sub("", token)).lower()


def number_shape(token: str) -> str:
    """Shape after letters that look like digits are read as digits wherever a run has only such signs."""
    return _DIGIT_RUN.sub("9", _NUMBER_LIKE.sub(lambda m: m.group().translate(_AS_DIGIT), _EDGE.sub("", token))).lower()


def code_shape(token: str) -> str:
    """As ``number_shape`` for codes: only letters after the first digit-like sign following capitals change."""
    bare = _EDGE.sub("", token)
    m = re.match(r"^([A-Z]{2,}?)([0-9OolIS]{2,}.*)$", bare)
    return _DIGIT_RUN.sub("9", m.group(1) + _NUMBER_LIKE.sub(lambda x: x.group().translate(_AS_DIGIT), m.group(2))).lower() if m else ""


def _look_table() -> dict[int, str]:
    t = {ord(a): b for a, b in zip("01l58fc", "oiisbte")}
    for cp in range(11172):
        i, v, f = cp // 588, cp % 588 // 28, cp % 28
        t[0xAC00 + cp] = chr(0xE000 + (_INITIALS.get(i, i) * 5 + _VOWELS[v]) * 28 + _FINALS.get(f, f))
    return t


_LOOK = _look_table()


def look_key(token: str) -> str:
    """Equal for words that differ by confusable shapes only."""
    return _EDGE.sub("", token).lower().replace("rn", "m").replace("vv", "w").translate(_LOOK)


def header_key(line: str) -> str:
    return look_key(" ".join(_HEADER_NUMBER.sub("", line).split()))


def is_page_number(line: str) -> bool:
    """Has a line the form of a page number?  It needs a digit; letters beside it may be misread ones."""
    s = line.strip("\x0c \t")
    return bool(s) and not s.endswith(".") and any(c in "0123456789" for c in s) and bool(_PAGE_NUMBER.match(s))


def page_numbers(lines: list[str]) -> set[int]:
    """Lines that number a page: of the form, and with marks of its own, or alone at a page's edge, or one step from
    the number before or after it in the record.  Any other bare number is text or a table's cell."""
    at = [i for i, x in enumerate(lines) if is_page_number(x)]
    if not at:
        return set()
    filled = [i for i, x in enumerate(lines) if x.strip("\x0c \t")]
    place = {i: n for n, i in enumerate(filled)}
    value = {i: int(_PAGE_NUMBER.match(lines[i].strip("\x0c \t")).group(1).translate(_AS_DIGIT)) for i in at}
    out = set()
    for n, i in enumerate(at):
        s, k = lines[i].strip("\x0c \t"), place[i]
        after, before = lines[i + 1:filled[k + 1] + 1] if k + 1 < len(filled) else ["\x0c"], lines[filled[k - 1] + 1:i + 1] if k else ["\x0c"]
        edge = any("\x0c" in x for x in before) or any("\x0c" in x for x in after)
        chained = n and value[i] - value[at[n - 1]] == 1 or n + 1 < len(at) and value[at[n + 1]] - value[i] == 1
        if not _BARE_NUMBER.fullmatch(s) or edge or chained:
            out.add(i)
    return out


def looks_scanned(lines: list[str]) -> bool:
    """Text wrapped to one width, sentences running over the line ends."""
    body = [x.strip("\x0c ") for x in lines if x.strip("\x0c ")]
    body = [x for x in body if not is_page_number(x)]
    if len(body) < 2:
        return False
    width = max(len(x) for x in body)
    if width > 110:
        return False
    wrapped = other = 0
    for a, b in zip(body, body[1:]):
        if _ROW.search(a) or _ENDS.search(a) and len(a) < 0.75 * width:
            other += bool(_ROW.search(a))
        elif len(a) + 1 + len(b.split(" ")[0]) > width and len(a) >= 0.6 * width:
            wrapped += not _ENDS.search(a) or ". " in a
        else:
            other += 1
    inside = sum(1 for x in body if re.search(r"[다요]\. \S|[a-z]\. [A-Z]", x))
    return wrapped >= 1 and wrapped > other and (inside > 0 or wrapped >= 2)


def page_tops(lines: list[str], numbers: set[int] | None = None) -> list[int]:
    """First lines of pages: of the record, after a form feed, around a page number."""
    out, new = [], True
    numbers = page_numbers(lines) if numbers is None else numbers
    for i, x in enumerate(lines):
        s = x.strip("\x0c \t")
        if "\x0c" in x:
            new = True
        if not s:
            continue
        if i in numbers:
            new = True
        elif new:
            out.append(i)
            new = False
    return out


def _variants(key: str) -> set[str]:
    """A key and what it is without one of its signs: keys up to one edit apart have one of these in common."""
    return {key, *(key[:i] + key[i + 1:] for i in range(len(key)))}


class PageReader:
    """Splits a record into headers, page numbers and running text.

    Headers are compared up to one edit by their variants with one sign left out, so a line is met with few of them."""

    def __init__(self, headers: set[str], remembered: int = 100_000):
        self.headers, self.size, self.seen = headers, remembered, {}
        self.variants: dict[str, list[str]] = {}
        for h in headers:
            if len(h) > 6:
                for v in _variants(h):
                    self.variants.setdefault(v, []).append(h)

    def roles(self, lines: list[str], title: str | None = None) -> list[str]:
        """``running_header``, ``page_number``, ``text`` or empty for each line.  A page may also be headed by the
        beginning of the record's own title."""
        named = look_key(" ".join(title.split())) if title else ""
        numbers = page_numbers(lines)
        out = ["" if not x.strip("\x0c \t") else "page_number" if i in numbers else "text" for i, x in enumerate(lines)]
        tops = set(page_tops(lines, numbers))
        own = Counter(header_key(lines[i]) for i in tops)
        for i, x in enumerate(lines):
            if out[i] == "text" and len(x) < 60:
                k = header_key(x)
                numbered = bool(_HEADER_NUMBER.search(x))
                if k and (k in self.headers or self._near(k) or (own.get(k, 0) >= 2 and i in tops and not _ENDS.search(x.strip()))):
                    if i in tops or numbered or k in self.headers or self._near(k):
                        out[i] = "running_header"
                elif len(k) >= 6 and i in tops and (named.startswith(k) or sum(x != y for x, y in zip(named, k)) <= 1 and len(named) >= len(k)):
                    out[i] = "running_header"
        return out

    def is_scan(self, lines: list[str]) -> bool:
        """Wrapped like a page, or another sign of one: a page number with signs or words around it, a misread number,
        a soft or odd hyphen at a line end, a known header at a page's top.  A bare number may be a table's cell."""
        if looks_scanned(lines):
            return True
        for x in lines:
            s = x.strip("\x0c \t")
            if is_page_number(x) and not _BARE_NUMBER.fullmatch(s) or _MISREAD_NUMBER.search(x) or len(s) > 1 and s[-1] in MARKS[1:] and s[-2].isalnum():
                return True
        return any(len(lines[i]) < 60 and (k := header_key(lines[i])) and (k in self.headers or self._near(k)) for i in page_tops(lines))

    def _near(self, key: str) -> bool:
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) >= self.size:
                self.seen.clear()
            near = {h for v in _variants(key) for h in self.variants.get(v, ())}
            got = self.seen[key] = any(abs(len(h) - len(key)) <= 1 and _one_edit(h, key) for h in near)
        return got


def _one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def vocabulary(texts: DataFrame) -> DataFrame:
    """``w, key, n`` over one column of born-digital text (all rows)."""
    def work(batches, flush=300_000):
        counts: Counter = Counter()
        words: Counter = Counter()
        for b in batches:
            for t in next(iter(b.values())):
                if t:
                    words.update(t.split())
            if len(words) >= flush:
                for w, n in words.items():
                    counts[shape(w)] += n
                words.clear()
                if len(counts) >= flush:
                    yield from ((w, look_key(w), n) for w, n in counts.items() if w)
                    counts.clear()
        for w, n in words.items():
            counts[shape(w)] += n
        yield from ((w, look_key(w), n) for w, n in counts.items() if w)

    return (map_task(texts, "w string, key string, n long", work).groupBy("w", "key").agg(F.sum("n").alias("n")))


def header_lexicon(scans: DataFrame) -> DataFrame:
    """``k``: keys of lines that head pages, of records that are wrapped like a page.

    A line of text stands at a page's top by chance as often as lines do; copies of one record show the same line above
    the same next line.  So a header stands above at least ``HEADER_RECORDS`` different lines, or in as many records
    where it is no wrapped text, and at tops significantly
    more often than the share of lines that are tops.  The rule does not depend on how many other headers there are."""
    def work(batches, flush=300_000):
        counts: dict[str, list] = {}
        n_lines = n_tops = 0
        for b in batches:
            for rec, text, always in zip(b["rec_id"], b["_text"], b["_always"]):
                lines = text.split("\n")
                if not always and not looks_scanned(lines):
                    continue
                tops, filled = set(page_tops(lines)), [i for i, x in enumerate(lines) if x.strip("\x0c \t")]
                width = max((len(lines[i]) for i in filled), default=0)
                for n, i in enumerate(filled):
                    x = lines[i]
                    n_lines += 1
                    n_tops += i in tops
                    if len(x) >= 60 or _ENDS.search(x.strip()) or len(k := header_key(x)) <= 3:
                        continue
                    got = counts.setdefault(k, [0, 0, set()])
                    got[0] += 1
                    if i in tops:
                        got[1] += 1
                        if len(got[2]) < 2 * HEADER_RECORDS:  # as many different ones as can matter, of each task
                            below = lines[filled[n + 1]] if n + 1 < len(filled) else ""
                            # A line that ends though the next word had room is no wrapped text, so copies count too.
                            own = f"\0{rec}" if below.split() and len(x) + 1 + len(below.split()[0]) <= width else below
                            got[2].add(xxhash.xxh3_64_intdigest(own) >> 1)
            if len(counts) >= flush:
                yield from ((k, a, t, list(s)) for k, (a, t, s) in counts.items())
                counts = {}
        yield "", n_lines, n_tops, []
        yield from ((k, a, t, list(s)) for k, (a, t, s) in counts.items())

    parts = map_task(scans.select("rec_id", "_text", "_always"), "k string, n long, tops long, below array<bigint>", work)
    counted = written(parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("tops").alias("tops"), F.size(F.array_distinct(F.flatten(F.collect_list("below")))).alias("below")), "heads")
    base = counted.agg(F.max(F.when(F.col("k") == "", F.col("tops") / F.greatest("n", F.lit(1)))).alias("p"), F.count(F.lit(1)).alias("tests")).first()
    share, tests = min(max(base["p"] or 0.0, 0.01), 0.5), base["tests"]
    # Chernoff bound of the binomial tail, in logarithms.
    q = F.col("tops") / F.col("n")
    tail = -F.col("n") * (q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0))
    return counted.where((F.col("k") != "") & (F.col("below") >= HEADER_RECORDS) & (q > share) & (tail <= math.log(HEADER_LEVEL / max(tests, 1)))).select("k")


def _with_headers(rows: DataFrame, headers: DataFrame) -> tuple[DataFrame, set[str] | None]:
    """Rows with ``_heads``, the known headers among their lines up to one edit, or the whole set where it is small enough
    to share.  A reader finds the same headers either way."""
    headers = written(headers, "headers")
    if headers.count() <= SHARED_HEADERS:
        return rows.withColumn("_heads", F.lit(None).cast("array<string>")), {r["k"] for r in headers.collect()}

    def of_record():
        def f(b):
            for field, rec, text in zip(b["field"], b["rec_id"], b["_text"]):
                # Every line a reader compares with headers, wherever it stands: a header found in a shared set is found here.
                for k in {header_key(x) for x in text.split("\n") if len(x) < 60} - {""}:
                    yield field, rec, k
        return f

    def variants():
        def f(b):
            for k, line in zip(b["k"], b["line"]):
                for v in _variants(k):
                    yield line, xxhash.xxh3_64_intdigest(v) >> 1
        return f

    # Each different line is asked for once.  Hashes that meet by chance give a record one header more, which the reader refuses.
    of = F.xxhash64("k")
    lines = map_rows(rows.select("field", "rec_id", "_text"), "field string, rec_id long, k string", of_record).withColumn("line", of)
    asked = map_rows(lines.select("k", "line").distinct(), "line long, v long", variants)
    known = map_rows(headers.withColumn("line", of), "line long, v long", variants).withColumnRenamed("line", "head")
    near = asked.join(known, "v").select("line", "head").distinct().join(headers.select("k", of.alias("head")), "head")
    each = (lines.select("field", "rec_id", "line").join(near, "line").groupBy(F.col("field").alias("_field"), F.col("rec_id").alias("_rec"))
            .agg(F.collect_set("k").alias("_heads")))
    return rows.join(each, F.col("field").eqNullSafe(F.col("_field")) & F.col("rec_id").eqNullSafe(F.col("_rec")), "left").drop("_field", "_rec"), None


def _findings(scans: DataFrame, known: set[str], headers: set[str] | None) -> DataFrame:
    """Settled lines (``noise``) and tokens to look up (``role``: word, or joined/compound of a line end)."""
    sc = scans.sparkSession.sparkContext
    shared_known, shared_headers = sc.broadcast(known), sc.broadcast(headers)

    def work():
        reader, known = PageReader(shared_headers.value or set()), shared_known.value

        def f(b):
            nonlocal reader
            for field, rec, text, always, title, own in zip(b["field"], b["rec_id"], b["_text"], b["_always"], b["_title"], b["_heads"]):
                lines = text.split("\n")
                if shared_headers.value is None:
                    reader = PageReader(set(own or ()))
                if not always and not reader.is_scan(lines):
                    continue
                roles = reader.roles(lines, title)
                body = [i for i, r in enumerate(roles) if r == "text"]
                for i, r in enumerate(roles):
                    if r in ("running_header", "page_number"):
                        yield field, rec, i, r, None, None, None, 0
                carried = ""
                for at, i in enumerate(body):
                    tokens = lines[i].strip("\x0c").split()
                    nxt = lines[body[at + 1]].strip("\x0c").split() if at + 1 < len(body) else []
                    end = ""
                    if tokens and nxt and len(tokens[-1]) > 1 and tokens[-1][-1] in MARKS and tokens[-1][-2].isalpha() and nxt[0][0].isalpha():
                        end = tokens[-1]
                    elif tokens and nxt and len(tokens[-1]) > 1 and tokens[-1][-1] in MARKS[1:] and tokens[-1][-2].isalnum() and nxt[0][0].isalnum():
                        end = tokens[-1]
                    if carried:
                        tokens = tokens[1:]  # the rest of a broken word belongs to the line before
                    if end and tokens:
                        tokens = tokens[:-1]
                    for t in tokens:
                        s = shape(t)
                        if s and s not in known and any(c.isalnum() for c in t):
                            yield field, rec, i, None, t, "word", None, 0
                    if end:
                        whole = (carried[:-1] if carried and len(lines[i].split()) == 1 else "") + end[:-1] + nxt[0]
                        if end[-1] == "-":
                            yield field, rec, i, None, end[:-1] + "-" + nxt[0], "compound", whole, len(end) - 1
                        else:
                            yield field, rec, i, "broken_word", None, None, None, 0
                        if shape(whole) not in known:
                            yield field, rec, i, None, whole, "joined", str(body[at + 1]), len(end) - 1
                    carried = end
        return f

    return map_rows(scans, "field string, rec_id long, line_no int, noise string, token string, role string, other string, cut int", work)


def _verdicts(types: DataFrame, vocab: DataFrame) -> DataFrame:
    """``token, n, right``: frequency of a token's own shape, and the right word if it is a misread one."""
    def keys():
        def f(b):
            for t in b["token"]:
                s, n, c = shape(t), number_shape(t), code_shape(t)
                # Words around numbers are compared with their digits as one sign, others with digits as letters.
                # Where there is no other reading a key is given that no word has, and not null: nulls would all meet in one task.
                none = "\0" + s
                yield t, s, n if n != s else none, c if c and c != s else none, look_key(t), look_key(n) if "9" in n and not n.isascii() else none
        return f

    typed = map_rows(types, "token string, s string, num string, code string, key string, key2 string", keys)
    words = vocab.select(F.col("w").alias("s"), F.col("n"))
    best = (vocab.where("key is not null").groupBy("key").agg(F.max(F.struct(F.col("n"), F.col("w"))).alias("b"))
            .select("key", F.col("b.n").alias("bn"), F.col("b.w").alias("bw")))
    near = best.select(F.col("key").alias("key2"), F.col("bn").alias("bn2"), F.col("bw").alias("bw2"))
    out = (typed.join(words, "s", "left").join(words.select(F.col("s").alias("num"), F.col("n").alias("nn")), "num", "left")
           .join(words.select(F.col("s").alias("code"), F.col("n").alias("cn")), "code", "left").join(best, "key", "left").join(near, "key2", "left"))
    own = F.coalesce("n", F.lit(0))
    enough = lambda c: (F.coalesce(c, F.lit(0)) >= F.greatest(F.lit(MIN_RIGHT), own * RATIO))
    right = (F.when(enough("nn"), F.col("num")).when(enough("cn"), F.col("code"))
             .when(enough("bn2") & (F.col("bw2") != F.col("s")), F.col("bw2"))
             .when(enough("bn") & (F.col("bw") != F.col("s")), F.col("bw")))
    return out.select("token", own.alias("n"), right.alias("right"))


def scan_noise(scans: list[tuple[str, DataFrame, str, str, str | None, bool]], clean: list[tuple[DataFrame, str]]) -> DataFrame:
    """``field, rec_id, line_no, noise``.

    ``scans``: (field, table, key, text, title or None, always scanned); ``clean``: (table, column) of born-digital text.
    """
    return _noise_with_words(scans, clean)[0].select("field", "rec_id", "line_no", "noise").distinct()


def _rows(scans) -> DataFrame:
    rows = None
    for field, df, key, text, title, always in scans:
        one = df.select(F.lit(field).alias("field"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("_text"),
                        (F.col(title) if title else F.lit(None).cast("string")).alias("_title"), F.lit(always).alias("_always")).where("_text != ''")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _noise_with_words(scans, clean) -> tuple[DataFrame, DataFrame, set[str] | None]:
    """Noise with the words it stands in, the rows read, and the known headers if they are shared."""
    texts = None
    for df, column in clean:
        one = df.select(F.col(column).alias("t")).where("t != ''")
        texts = one if texts is None else texts.unionByName(one)
    vocab = written(vocabulary(texts), "vocabulary")
    # The floor of the known list is found by counts of counts, so the driver receives at most KNOWN_WORDS words.
    floor, seen = 1, 0
    bins = vocab.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).count().collect()
    for r in sorted(bins, key=lambda r: -r["b"]):
        seen += r["count"]
        if seen > KNOWN_WORDS:
            break
        floor = r["b"]
    often = vocab.where((F.floor(F.log2("n") * 8) >= floor) & (F.col("n") >= MIN_RIGHT)).select(F.col("w").alias("token"))
    known = {r["token"] for r in _verdicts(often, vocab).where("right is null").select("token").collect()} if seen else set()
    rows = _rows(scans)
    rows, headers = _with_headers(rows, header_lexicon(rows))
    found = written(_findings(rows, known, headers), "scan-lines")
    asked = found.where("token is not null").select("token").union(found.where("role = 'compound'").select(F.col("other")))
    verdict = written(_verdicts(asked.distinct(), vocab), "verdicts")
    settled = found.where("noise is not null").select("field", "rec_id", "line_no", "noise", "token", F.lit(None).cast("string").alias("right"))
    words = found.where("role in ('word', 'joined')").join(verdict, "token").where("right is not null")
    # A misread sign of a broken word belongs to the line it stands in.
    where = _first_difference()
    words = map_rows(words.select("field", "rec_id", "line_no", "token", "right", "role", "other", "cut"),
                     "field string, rec_id long, line_no int, noise string, token string, right string", where)
    compound = (found.where("role = 'compound'").join(verdict.select("token", F.col("n").alias("as_compound")), "token")
                .join(verdict.select(F.col("token").alias("other"), F.col("n").alias("as_joined"), F.col("right").alias("joined_right")), "other", "left")
                .where((F.coalesce("as_compound", F.lit(0)) == 0) | (F.coalesce("as_joined", F.lit(0)) > F.col("as_compound")))
                .select("field", "rec_id", "line_no", F.lit("broken_word").alias("noise"), "token", F.lit(None).cast("string").alias("right")))
    return settled.unionByName(words).unionByName(compound), rows, headers


def _first_difference():
    def work():
        def f(b):
            for field, rec, no, t, right, role, other, cut in zip(b["field"], b["rec_id"], b["line_no"], b["token"], b["right"], b["role"], b["other"], b["cut"]):
                if role == "word":
                    yield field, rec, no, "misread", t, right
                    continue
                bare = t.lower()
                if len(bare.strip(".,;:()[]!?\"'")) == len(right):
                    start = len(bare) - len(bare.lstrip("([\"'"))
                    spots = [start + i for i, (x, y) in enumerate(zip(bare[start:], right)) if x != y]
                else:
                    spots = [next((i for i, (x, y) in enumerate(zip(bare, right)) if x != y), 0)]
                for line in {no if s < cut else int(other) for s in spots}:
                    yield field, rec, line, "misread", t, right
        return f
    return work


def repaired(scans: list[tuple[str, DataFrame, str, str, str | None, bool]], clean: list[tuple[DataFrame, str]]) -> DataFrame:
    """``field, rec_id, text``: paragraphs without headers and page numbers, broken words joined, misread words set right.
    Records that are no scans come back as they are."""
    noise, rows, headers = _noise_with_words(scans, clean)
    per = noise.groupBy("field", "rec_id").agg(F.collect_list(F.struct("line_no", "noise", "token", "right")).alias("marks"))
    shared_headers = rows.sparkSession.sparkContext.broadcast(headers)

    def work():
        reader = PageReader(shared_headers.value or set())

        def f(b):
            nonlocal reader
            for field, rec, text, always, marks, own in zip(b["field"], b["rec_id"], b["_text"], b["_always"], b["marks"], b["_heads"]):
                lines = text.split("\n")
                if shared_headers.value is None:
                    reader = PageReader(set(own or ()))
                yield field, rec, join_lines(lines, marks or []) if always or reader.is_scan(lines) else text
        return f

    return map_rows(rows.join(per, ["field", "rec_id"], "left"), "field string, rec_id long, text string", work)


def join_lines(lines: list[str], marks: list[dict]) -> str:
    gone = {m["line_no"] for m in marks if m["noise"] in ("running_header", "page_number")}
    broken = {m["line_no"] for m in marks if m["noise"] == "broken_word"}
    right = {m["token"]: m["right"] for m in marks if m["noise"] == "misread" and m["right"]}
    out, para, glue, page_end = [], "", False, False
    for i, x in enumerate(lines):
        if i in gone:
            page_end = True
            continue
        s = x.strip("\x0c \t")
        if not s:
            # A blank line ends a paragraph unless it only surrounds a page's end.
            if para and not page_end and not glue:
                out.append(para)
                para = ""
            continue
        page_end = False
        para = para + s if glue else f"{para} {s}" if para else s
        glue = i in broken
        if glue:
            para = para[:-1]
    if para:
        out.append(para)
    text = "\n\n".join(out)
    for wrong, good in sorted(right.items(), key=lambda x: -len(x[0])):
        bare = _EDGE.sub("", wrong)
        if bare:
            text = re.sub(rf"(?<!\w){re.escape(bare)}(?!\w)", lambda m: restore(bare, good), text)
    return text


def restore(wrong: str, right: str) -> str:
    """The right word in the letter case of the wrong one; for numbers the digits are read back one by one."""
    if "9" in right and not right.isascii() and number_shape(wrong) != right:
        # A word around a number: its letters come from the right word, its digits stay.
        numbers = iter(re.findall(r"\d+", wrong))
        return re.sub("9", lambda m: next(numbers, m.group()), right)
    if "9" in right:
        return _NUMBER_LIKE.sub(lambda m: m.group().translate(_AS_DIGIT) if any(c.isdigit() for c in m.group()) or number_shape(wrong) == right else m.group(), wrong)
    return right[:1].upper() + right[1:] if wrong[:1].isupper() else right
