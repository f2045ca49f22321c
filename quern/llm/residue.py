"""Template residue, filler, error pages and demands to switch scripts on.

The lines of a record's own text (of a page: what the page model keeps) are
filed in a fixed-depth prefix tree - number of words, first three words, last
word - after digits, trace ids and slots are masked.  Lines of one leaf merge
into a template; each template is classified once - by a log-linear model over
its words and letter triples, one with a slot by whether it writes about slots
- and the verdict goes back to all its lines.
Running text is filed sentence by sentence, so a message written as one long
line is judged like a short one, and a slot left in an ordinary record is found
by itself.

Lines of a page that the page model is not sure to be surroundings come along
as weak ones, which count only if they turn out to be residue: a page may hold
nothing but its message.

A record is named if an unresolved slot was left in it, or if at least half
of its own letters belong to message or filler templates.  Null and empty texts are
no records with residue.  Repeats of one sentence count as one.
"""

from __future__ import annotations

import json
import re
from functools import cache
from math import exp
from pathlib import Path

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_rows, map_task
from quern.llm.page_model import PageModel
from quern.llm.visual_form import visual_key
from quern.session import written

MODEL = Path(__file__).with_name("models") / "residue_model.json"
#: Slots of the usual template languages and of hand-made forms.
SLOT = re.compile(r"\{\{[^{}\n]{1,60}\}\}|[$#]\{[^{}\n]{1,60}\}|<%[^%\n]{1,60}%>|@@\w[\w.]*@@|%[A-Za-z_][\w.]*%|__[A-Za-z][A-Za-z_.]*?__|\[\[[^\[\]\n]{1,60}\]\]"
                  r"|\{[A-Za-z_][\w.]*\}|〈[^〉\n]{1,40}(?:입력|기재|선택)〉|\[[^\[\]\n]{1,40}여기에[^\[\]\n]{1,20}\]|<[A-Za-z_]+ here>|\[(?:insert|your|enter) [^\[\]\n]{1,40}\]|\bO{3,}\b|○{2,}|\bX{3,}\b")
#: Every slot has one of these signs.
_SLOT_SIGN = re.compile(r"[{<$#%@_\[〈○]|OOO|XXX")
_TRACE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b")
_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=다\.)")
_KEYS = re.compile(r"^(?:[ㄱ-ㅎㅏ-ㅣ]+|(?:asdf|qwer|zxcv|hjkl)+\w*|(.{1,5}?)\1{2,}.{0,3}|\.{3,}|가나다라\w*|(\w)\2+)$")
#: Words of a sentence that writes about slots instead of having one left in.
MENTION = re.compile("자리표시자|견본|서식의|예시로|치환|바꾸는 법|적는 자리|placeholder|template|mail merge|syntax|such as <slot>")
_LETTER = re.compile(r"[^\W\d_]")
#: English text has these in every sentence of some length; made-up filler has none.
_FUNCTION_WORDS = frozenset("the a an of and or to in on at for from by with is are was were be been as it its that this these those not no you your we our will may can must should has have had if when than then there after before".split())
_ASCII_WORD = re.compile(r"[A-Za-z]+")
RUNNING_WORDS, WEAK = 14, 0.001
_PLAIN_EDGE = re.compile(r"^[\s\-·※■□▲▼▶>|*•›«»]+|[\s|›]+$")


def units(line: str) -> list[tuple[str, int, bool]]:
    """Units of a line to be filed: masked text, letters it stands for, has a slot.  A line of running text gives its
    sentences; what holds no letter comes back under an empty mask."""
    s = _BLANK.sub(" ", _PLAIN_EDGE.sub("", visual_key(line)))
    if not s:
        return []
    if not _LETTER.search(s):
        return [("", len(s), False)] if not _KEYS.match(s) else [(mask(s), len(s), False)]
    if s.count(" ") < RUNNING_WORDS:
        parts = [p for p in _SENTENCE.split(s) if p]
        if len(parts) > 1 and len(set(parts)) == 1:
            return [(mask(parts[0]) + " <again>", len(s), bool(SLOT.search(s)))]
        masked, slot = _masked(s)
        return [(masked, len(s), slot)]
    out, rest = [], 0
    parts = [p for p in _SENTENCE.split(s) if p]
    if len(parts) > 1 and len(set(parts)) == 1:
        return [(mask(parts[0]) + " <again>", len(s), bool(SLOT.search(s)))]
    for p in parts:
        if _LETTER.search(p):
            masked, slot = _masked(p)
            out.append((masked, len(p), slot))
        else:
            rest += len(p)
    return [*out, ("", rest, False)] if rest else out


def made_up(s: str) -> bool:
    """A sentence of at least six small Latin words without one function word."""
    if not s[:1].isascii():
        return False
    w = [x.strip(",;:") for x in s.strip(" .!?").split(" ")]
    return (len(w) >= 6 and not any(x.lower() in _FUNCTION_WORDS for x in w) and all(x.isascii() and x.isalpha() for x in w)
            and sum(x.islower() for x in w) >= 0.7 * len(w))


def mask(s: str) -> str:
    return _masked(s)[0]


def _masked(s: str) -> tuple[str, bool]:
    """Masked text, and whether it has a slot."""
    if made_up(s):
        return "<made-up> words", False
    slots = 0
    if _SLOT_SIGN.search(s):
        s, slots = SLOT.subn("<slot>", s)
    if _DIGITS.search(s):
        s = _DIGITS.sub("9", _TRACE.sub("<id>", s))
    return s.lower(), bool(slots)


def leaf(masked: str) -> bytes:
    """Path in the prefix tree."""
    w = masked.split(" ")
    path = [str(len(w)), *w[:3], w[-1]]
    if "<slot>" in masked:
        path.append("mention" if MENTION.search(masked) else "slot")
    return xxhash.xxh3_128_digest("\x1f".join(path))


def merge(a: list[str], b: list[str]) -> list[str]:
    """A word that differs becomes open; a slot stays one."""
    return [x if x == y else "<slot>" if "<slot>" in x or "<slot>" in y else "<*>" for x, y in zip(a, b)]


def word_features(word: str) -> list[str]:
    """Features of one word; they do not depend on where it stands, so a word's share of a score is computed once."""
    if word.startswith("<"):
        return ["w:" + word]
    x = "^" + word.strip(".,!?:;()") + "$"
    f = ["w:" + word, *("t:" + x[i:i + 3] for i in range(len(x) - 2))]
    return [*f, "keys"] if len(word) > 2 and _KEYS.match(word) else f


def frame_features(template: str, words: list[str]) -> list[str]:
    """Features of the whole: length, slots, ends and word pairs."""
    f = ["bias", "n:" + str(min(len(words), RUNNING_WORDS + 1)), "slots:" + str(min(template.count("<slot>"), 3)), "first:" + words[0], "last:" + words[-1]]
    f += ["p:" + a + " " + b for a, b in zip(words, words[1:])]
    return [*f, "stop"] if template.endswith(".") else f


def template_features(template: str) -> list[str]:
    words = template.split(" ")
    return frame_features(template, words) + [x for w in dict.fromkeys(words) for x in word_features(w)]


@cache
def load_model() -> dict[str, float]:
    return json.loads(MODEL.read_text(encoding="utf-8"))


class Scorer:
    """Probability that a template is a message or filler; a slot counts by whether its sentence writes about slots."""

    def __init__(self, weights: dict[str, float] | None = None, remembered: int = 200_000):
        self.weights, self.size, self.known = load_model() if weights is None else weights, remembered, {}

    def __call__(self, template: str) -> float:
        if "<slot>" in template:
            return 0.0 if MENTION.search(template) else 1.0
        w, known, words = self.weights, self.known, template.split(" ")
        z = sum(w.get(x, 0.0) for x in frame_features(template, words))
        for word in dict.fromkeys(words):
            share = known.get(word)
            if share is None:
                if len(known) >= self.size:
                    known.clear()
                share = known[word] = sum(w.get(x, 0.0) for x in word_features(word))
            z += share
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def score(template: str, weights: dict[str, float] | None = None) -> float:
    return Scorer(weights)(template)


def _page_lines(model: PageModel, text: str, title: str | None) -> list[tuple[str, bool]]:
    """Own lines of a page; lines the page model is not quite sure to be surroundings come along as weak ones, which
    count only if they turn out to be residue."""
    lines, titles, _ = model.layout(text, title)
    return [(x, q < 0.5) for x, t, q in zip(lines, titles, model.marginals(text, title)) if not t and q >= WEAK and x.strip()]


def filed_units(df: DataFrame, key: str, text: str, title: str | None) -> DataFrame:
    """Units of every record: ``rec_id, leaf, template, letters, slot``; what holds no letter is summed under a null leaf.
    With ``title`` the text is a collected page and only its main body is read."""
    kind = df.schema[key].dataType.simpleString()

    def work():
        model = PageModel() if title else None

        def f(b):
            for k, t, head in zip(b["_key"], b["_text"], b["_title"]):
                rest = 0
                for line, weak in (_page_lines(model, t, head) if model else [(x, False) for x in t.split("\n")]):
                    for masked, n, slot in units(line):
                        if masked:
                            yield k, leaf(masked), masked, n, slot, weak
                        elif not weak:
                            rest += n
                if rest:
                    yield k, None, None, rest, False, False
        return f

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), (F.col(title) if title else F.lit(None).cast("string")).alias("_title"))
    return map_rows(rows.where("_text != ''"), f"rec_id {kind}, leaf binary, template string, letters int, slot boolean, weak boolean", work)


def judged_templates(filed: DataFrame) -> DataFrame:
    """One verdict per leaf: ``leaf, template, n, residue`` (probability of message, filler or left-in slot)."""
    def mine(batches, flush=200_000):
        tree: dict[bytes, list] = {}
        for b in batches:
            for lf, masked in zip(b["leaf"], b["template"]):
                got = tree.get(lf)
                if got is None:
                    tree[lf] = [masked.split(" "), 1, masked]
                else:
                    got[0] = merge(got[0], masked.split(" "))
                    got[1] += 1
                    if masked < got[2]:
                        got[2] = masked
            if len(tree) >= flush:
                yield from ((lf, " ".join(t), n, x) for lf, (t, n, x) in tree.items())
                tree = {}
        yield from ((lf, " ".join(t), n, x) for lf, (t, n, x) in tree.items())

    def judge():
        score = Scorer()

        def f(b):
            for lf, templates, n, example in zip(b["leaf"], b["templates"], b["n"], b["example"]):
                t = templates[0].split(" ")
                for other in templates[1:]:
                    t = merge(t, other.split(" "))
                # A template of open words alone says little: its least line has to agree.
                yield lf, " ".join(t), n, min(score(" ".join(t)), score(example))
        return f

    # Each task mines its own tree; a leaf then has at most one partial template per task (and flush).
    partial = map_task(filed.where("leaf is not null").select("leaf", "template"), "leaf binary, template string, n long, example string", mine)
    merged = partial.groupBy("leaf").agg(F.collect_set("template").alias("templates"), F.sum("n").alias("n"), F.min("example").alias("example"))
    return map_rows(merged, "leaf binary, template string, n long, residue double", judge)


def residue_records(fields: list[tuple[str, DataFrame, str, str, str | None]], share: float = 0.5) -> DataFrame:
    """``field, rec_id`` of records that hold no real content.  ``fields``: (name, table, key, text, title or None)."""
    filed = None
    for name, df, key, text, title in fields:
        one = filed_units(df, key, text, title).withColumn("field", F.lit(name)).withColumn("rec_id", F.col("rec_id").cast("long"))
        filed = one if filed is None else filed.unionByName(one)
    filed = written(filed, "filed")
    verdicts = judged_templates(filed).select("leaf", (F.col("residue") >= 0.5).alias("bad")).where("bad")
    columns = ["field", "rec_id", "letters", "slot", "weak"]
    # Units without a leaf pass by the join: they would all meet in one task.
    judged = (filed.where("leaf is not null").select("leaf", *columns).join(verdicts, "leaf", "left").select(*columns, F.coalesce("bad", F.lit(False)).alias("bad"))
              .unionByName(filed.where("leaf is null").select(*columns, F.lit(False).alias("bad"))))
    return (judged.groupBy("field", "rec_id")
            .agg(F.sum(F.when(F.col("bad"), F.col("letters")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad") | ~F.col("weak"), F.col("letters")).otherwise(0)).alias("n"),
                 F.max(F.col("bad") & F.col("slot")).alias("slot"))
            .where(F.col("slot") | ((F.col("b") > 0) & (F.col("b") >= F.lit(share) * F.col("n"))))
            .select("field", "rec_id"))
