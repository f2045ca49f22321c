"""One stored form for text that looks the same.

``visual_key`` is the table part: width of a character, kind of blank, unseen
characters, the script a letter comes from and the storage of accents and
syllables are removed; letters, case, accents, digits, marks and line breaks
stay.  ``SpellingTrie`` is the vocabulary part: a trie over canonical spellings
walked by an automaton whose look-alike substitutions and unseen insertions
cost nothing.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts drawn like a Latin letter.
LOOKALIKES = {
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ӏ": "l", "ѵ": "v", "ү": "y",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "Օ": "O", "Ս": "U",
    "ց": "g", "ԍ": "g",
    # Latin letters of other alphabets with the same drawing
    "ı": "ı", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x",
    "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L",
    "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
}

# Blanks beside the space-separator class (line breaks are not among them).
_BLANKS = "\t\u2800\u3164\uffa0"
# Unseen characters besides the format class.
_UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b"


def _table() -> dict[int, str]:
    """Character table, built by rule over the basic plane."""
    t: dict[int, str] = {}
    for cp in range(0x80, 0x10000):
        if 0xAC00 <= cp <= 0xD7A3 or 0x4E00 <= cp <= 0x9FFF or 0xD800 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            t[cp] = ""
        elif cat == "Zs":
            t[cp] = " "
        else:
            kind = unicodedata.decomposition(ch).split(" ")[0]
            if kind in ("<wide>", "<narrow>", "<font>"):
                t[cp] = unicodedata.normalize("NFKC", ch) if not 0xFFA1 <= cp <= 0xFFDC else chr(int(unicodedata.decomposition(ch).split(" ")[1], 16))
    # Letters of mathematical alphabets, and ligatures drawn as their letters.
    t |= {cp: unicodedata.normalize("NFKC", chr(cp)) for cp in (*range(0x1D400, 0x1D800), *range(0xFB00, 0xFB07)) if unicodedata.decomposition(chr(cp))}
    t |= {ord(c): " " for c in _BLANKS}
    t |= {ord(c): "" for c in _UNSEEN}
    t |= {ord(a): b for a, b in LOOKALIKES.items()}
    return t


TABLE = _table()


def _fold(s: str) -> str:
    """Accents come off before the table and go back on after it, so a look-alike below an accent is seen too."""
    nfd = unicodedata.normalize("NFD", s.translate(TABLE)).translate(TABLE)
    return unicodedata.normalize("NFC", nfd)


def _irregular_class() -> str:
    """Characters that call for work on the words they stand in, as ranges of a character class."""
    bad = [cp for cp in range(0x80, 0x10000)
           if not 0xD800 <= cp <= 0xF8FF and not 0xAC00 <= cp <= 0xD7A3
           and (cp in TABLE or unicodedata.combining(chr(cp)) or 0x1100 <= cp <= 0x11FF or _fold(chr(cp)) != chr(cp))]
    # Letters of scripts with look-alikes: a word with one of them has its spelling chosen by vocabulary.
    bad = sorted({*bad, 0x09, *range(0x370, 0x590), *range(0x1F00, 0x2000)})
    out, start, last = [], None, None
    for cp in [*bad, None]:
        if start is not None and cp != last + 1:
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = None
        if start is None:
            start = cp
        last = cp
    return "[" + "".join(out) + "]"


#: A text without these characters is stored in its final form already.
IRREGULAR = re.compile(_irregular_class()[:-1] + "\U0001d400-\U0001d7ff]")


# Letters of each look-alike script by the Latin letter they look like (of several, the first in the table).
_SCRIPTS = {script: {v: k for k, v in reversed(LOOKALIKES.items()) if unicodedata.name(k).split(" ")[0] == script} for script in ("GREEK", "CYRILLIC", "ARMENIAN")}
_LETTERS = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+")
_FOREIGN = re.compile("[\u0370-\u058f\u1f00-\u1fff]")


def own_script(s: str) -> str:
    """Table form with every run of letters that must be of a foreign script wholly in that script.

    A run with a letter no Latin letter looks like, and with none that is Latin alone, is a word of that script: the
    table's Latin letters in it go back to the script's own.  It is decided by the table form, so strings that look
    the same still come out equal, and by the run alone, so no word list is asked."""
    return _LETTERS.sub(_restored, s) if _FOREIGN.search(s) else s


def _restored(m: re.Match) -> str:
    nfd = unicodedata.normalize("NFD", m.group())
    letters = [c for c in nfd if not unicodedata.combining(c)]
    scripts = {_script(c) for c in letters if not c.isascii()}
    back = _SCRIPTS.get(scripts.pop()) if len(scripts) == 1 else None
    if back is None or any(c.isascii() and c not in back for c in letters):
        return m.group()
    return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in nfd))


def visual_key(s: str | None) -> str | None:
    """The table form of a text: equal for texts that look the same; null stays null."""
    if s is None:
        return None
    return _fold(s) if IRREGULAR.search(s) else s


_NOT_ALNUM = re.compile(r"[\W_]+")


def letters_and_digits(s: str) -> str:
    """Letters and digits of the table form in lower case."""
    return _NOT_ALNUM.sub("", visual_key(s)).lower()


# ---------------------------------------------------------------- vocabulary

from collections import Counter  # noqa: E402

import xxhash  # noqa: E402
from pyspark.sql import Column, DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quern.llm.arrow import map_rows, map_task  # noqa: E402

#: Canonical spellings kept in the trie. Spellings beyond it are normalised by table and ``own_script``, which decide
#: alike for all members of a class, so the bound never changes which strings come out equal; a word of a foreign
#: script comes out in that script with or without the list.
VOCABULARY = 20_000
_WORD = re.compile(r"[^\W\d_][^\s]*")
_LETTER = re.compile(r"[^\W\d_]")


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


def canonical_spelling(word: str) -> bool:
    """May ``word`` stand in the finished text?  Either in the table form, or wholly in one foreign script
    with at least one letter that no Latin letter looks like (so that it is no disguise)."""
    if not IRREGULAR.search(word):
        return True
    if unicodedata.normalize("NFC", word) != word:
        return False
    letters = [c for c in word if c.isalpha()]
    if not letters or any(TABLE.get(ord(c)) in ("", " ") for c in word):
        return False
    scripts = {_script(c) for c in letters}
    return len(scripts) == 1 and scripts <= {"GREEK", "CYRILLIC", "ARMENIAN"} and any(ord(c) not in TABLE for c in letters)


class SpellingTrie:
    """Trie over canonical spellings, walked by a weighted edit automaton.

    Edges are labelled by what the eye sees.  Reading a character costs nothing if an edge of the same look leaves
    the node, or if the character is unseen; any other edit costs 1.  ``walk`` returns the cheapest spelling within
    ``budget`` (0: visually identical), ties by frequency, then by code points.
    """

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for look in self.looks(w):
                node = node.setdefault(look, {})
            old = node.get("")
            if old is None or (-n, w) < (-old[1], old[0]):
                node[""] = (w, n)

    @staticmethod
    def looks(word: str) -> str:
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", word.translate(TABLE)).translate(TABLE))

    def walk(self, token: str, budget: int = 0) -> str | None:
        if budget == 0:
            node = self.root
            for ch in unicodedata.normalize("NFD", token):
                look = TABLE.get(ord(ch), ch)  # an unseen character reads as nothing: the automaton stays
                for x in unicodedata.normalize("NFD", look):
                    node = node.get(x)
                    if node is None:
                        return None
            return node[""][0] if "" in node else None
        looks = self.looks(token)
        best: tuple | None = None
        states = {(id(self.root), 0): (self.root, 0, 0)}  # node, read, cost
        todo = list(states.values())
        seen: dict[tuple[int, int], int] = {}
        while todo:
            node, i, cost = todo.pop()
            if seen.get((id(node), i), budget + 1) <= cost:
                continue
            seen[id(node), i] = cost
            if i == len(looks) and "" in node:
                w, n = node[""]
                if best is None or (cost, -n, w) < best:
                    best = (cost, -n, w)
            for x, child in node.items():
                if x == "":
                    continue
                if i < len(looks) and looks[i] == x:
                    todo.append((child, i + 1, cost))
                if cost < budget:
                    todo.append((child, i, cost + 1))
                    if i < len(looks) and looks[i] != x:
                        todo.append((child, i + 1, cost + 1))
            if i < len(looks) and cost < budget:
                todo.append((node, i + 1, cost + 1))
        return best[2] if best else None


def spelling_vocabulary(columns: list[DataFrame], size: int = VOCABULARY) -> dict[str, int]:
    """The ``size`` most frequent canonical spellings (whole classes of equal frequency, so at most as many) over all rows of
    one-column tables.
    Counts leave each task summed; the driver receives at most ``size`` rows."""
    def work(batches, flush=200_000):
        counts, fit = Counter(), {}
        for b in batches:
            for text in next(iter(b.values())):
                if text:
                    counts.update(text.split())
            if len(counts) >= flush:
                yield from ((w, n) for w, n in counts.items() if not w.isdigit() and _LETTER.search(w) and len(w) <= 40 and canonical_spelling(w))
                counts.clear()
        yield from ((w, n) for w, n in counts.items() if _LETTER.search(w) and len(w) <= 40 and canonical_spelling(w))

    texts = None
    for df in columns:
        one = df.select(F.col(df.columns[0]).alias("t"))
        texts = one if texts is None else texts.unionByName(one)
    from quern.session import written
    counted = written(map_task(texts, "w string, n long", work).groupBy("w").agg(F.sum("n").alias("n")), "spellings")
    # The floor of the list is found by counts of counts, so the driver receives at most ``size`` rows in all.
    bins = counted.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("b")).count().collect()
    floor, seen = None, 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        seen += r["count"]
        if seen > size:
            break
        floor = r["b"]
    if floor is None:
        return {}
    return {r["w"]: r["n"] for r in counted.where(F.floor(F.log2("n") * 16) >= floor).collect()}


class Normaliser:
    """Text to its one form: words with irregular characters by trie, else by table and script."""

    def __init__(self, words: dict[str, int], remembered: int = 100_000):
        self.trie, self.size, self.known = SpellingTrie(words), remembered, {}

    def word(self, token: str) -> str:
        out = self.known.get(token)
        if out is None:
            if len(self.known) >= self.size:
                self.known.clear()
            out = self.known[token] = self.trie.walk(token) or own_script(_fold(token))
        return out

    def __call__(self, text: str) -> str:
        if not IRREGULAR.search(text):
            return text
        # Words end at what a reader sees as a blank or a line break; blanks are put in their one form.
        parts = _BREAKS.split(text)
        for i in range(0, len(parts), 2):
            if parts[i] and IRREGULAR.search(parts[i]):
                parts[i] = self.word(parts[i])
        for i in range(1, len(parts), 2):
            parts[i] = parts[i].translate(TABLE)
        return "".join(parts)


_BREAKS = re.compile("([" + "".join(f"\\u{cp:04x}" for cp in sorted({0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029} | {k for k, v in TABLE.items() if v == " "})) + "]+)")


def normalised(df: DataFrame, key: str, text: str, words: dict[str, int]) -> DataFrame:
    """``key, text_hash, form_hash, form``: every non-null text in its one form (regular texts pass unchanged)."""
    kind = df.schema[key].dataType.simpleString()
    return _map_forms(df, key, text, words, f"{key} {kind}, text_hash binary, form_hash binary, form string", True)


def _map_forms(df, key, text, words, schema, with_form):
    shared = df.sparkSession.sparkContext.broadcast(words)  # at most VOCABULARY words

    def work():
        norm = Normaliser(shared.value)
        digest = xxhash.xxh3_128_digest

        def f(b):
            for k, t in zip(b["_key"], b["_text"]):
                form = norm(t)
                h = digest(t)
                g = h if form == t else digest(form)
                yield (k, h, g, form) if with_form else (k, h, g)
        return f

    return map_rows(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()), schema, work)


def look_alike_pairs(fields: list[tuple[str, DataFrame, str, str]], size: int = VOCABULARY) -> DataFrame:
    """Pairs of records of one field whose texts differ yet look the same: ``field, id_a, id_b``, id_a < id_b.

    ``fields``: (field name, table, key column, text column).  Null texts look like nothing.  Classes of one and the
    same text give no pair and leave before the join; empty texts equal each other and only each other.
    """
    few = _mixed_forms(fields, size)
    a = few.select("field", "form_hash", F.col("id").alias("id_a"), F.col("text_hash").alias("ta"))
    b = few.select("field", "form_hash", F.col("id").alias("id_b"), F.col("text_hash").alias("tb"))
    return (a.join(b, ["field", "form_hash"]).where("id_a < id_b and ta != tb").select("field", "id_a", "id_b"))


def _mixed_forms(fields, size: int) -> DataFrame:
    """``field, id, text_hash, form_hash`` of the classes with more than one text."""
    words = spelling_vocabulary([df.select(text) for _, df, _, text in fields], size)
    forms = None
    for name, df, key, text in fields:
        one = _map_forms(df, key, text, words, "id long, text_hash binary, form_hash binary", False).withColumn("field", F.lit(name))
        forms = one if forms is None else forms.unionByName(one)
    from quern.session import written
    forms = written(forms, "forms")
    mixed = (forms.groupBy("field", "form_hash").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
             .where("a != b").select("field", "form_hash"))
    return forms.join(mixed, ["field", "form_hash"], "left_semi")


def look_alike_classes(fields: list[tuple[str, DataFrame, str, str]], size: int = VOCABULARY) -> DataFrame:
    """The same as classes, without writing pairs out: ``field, id, class_id, text_id, n_links`` for every record with
    a look-alike.  ``class_id`` is the least id of the class, ``text_id`` the least id with the very same text and
    ``n_links`` the number of its look-alikes; records of one class with different ``text_id`` are the pairs.
    Counts are summed per text before classes meet, so a hot class is no larger than its number of spellings."""
    from quern.session import written
    few = written(_mixed_forms(fields, size), "mixed")
    texts = few.groupBy("field", "form_hash", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("text_id"))
    classes = texts.groupBy("field", "form_hash").agg(F.sum("n").alias("n_class"), F.min("text_id").alias("class_id"))
    return (few.join(texts, ["field", "form_hash", "text_hash"]).join(classes, ["field", "form_hash"])
            .select("field", "id", "class_id", "text_id", (F.col("n_class") - F.col("n")).alias("n_links")))
