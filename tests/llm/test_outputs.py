"""The cleaned outputs a user takes away, against what the found rows and the source texts say of them."""

import textwrap
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from quern.llm import packing, personal, scans, visual_form
from quern.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def column(table, key, text):
    t = pq.read_table(DATA / f"{table}.parquet", columns=[key, text]).to_pylist()
    return {r[key]: r[text] for r in t}


def run(spark, name):
    return QUERIES[name](spark, str(DATA)).collect()


@needs_data
def test_pieces_tile_their_texts(spark):
    texts = {"attachment_text": column("documents", "doc_id", "attachment_text"), "content": column("chunks", "id", "content")}
    pieces = defaultdict(list)
    for r in run(spark, "p4_pieces"):
        pieces[r.field, r.rec_id].append(r)
    assert set(pieces) == {(f, i) for f, t in texts.items() for i, x in t.items() if x and len(x) > 900}
    for (field, i), rows in pieces.items():
        text, rows = texts[field][i], sorted(rows, key=lambda r: r.piece_no)
        assert "".join(text[r.body_pos:r.end_pos] for r in rows) == text
        assert all(len(r.piece) <= 900 and r.piece == text[r.start_pos:r.end_pos] for r in rows)
        assert all(r.body_pos - r.start_pos == min(100, r.body_pos) for r in rows[1:])


@needs_data
def test_redaction_changes_nothing_else(spark):
    text, spans = column("documents", "doc_id", "text"), defaultdict(list)
    for r in run(spark, "p10_found"):
        spans[r.doc_id].append((r.start_pos, r.end_pos, r.pii_type))
    for r in run(spark, "p10_redacted"):
        want, at = "", 0
        for a, b, kind in sorted(spans[r.doc_id]):
            want += text[r.doc_id][at:a] + personal.PLACEHOLDERS[kind]
            at = b
        assert r.text == want + text[r.doc_id][at:]


@needs_data
def test_body_is_what_is_not_around_it(spark):
    raw, gone = column("documents", "doc_id", "raw_text"), defaultdict(set)
    for r in run(spark, "p5_found"):
        gone[r.doc_id].add(r.line_no)
    assert {r.doc_id: r.main_body for r in run(spark, "p5_body")} == {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in raw.items()}


@needs_data
def test_one_form_for_what_looks_the_same(spark):
    texts = {"raw_text": column("documents", "doc_id", "raw_text"), "content": column("chunks", "id", "content")}
    forms = {(r.field, r.rec_id): r.form for r in run(spark, "p2_normalised")}
    assert set(forms) == {(f, i) for f, t in texts.items() for i, x in t.items() if x is not None}
    looks, same = defaultdict(list), defaultdict(set)
    for (f, i), form in forms.items():
        key = visual_form.visual_key(texts[f][i])
        looks[f, key].append(i)
        same[f, key].add(form)
        assert visual_form.visual_key(form) == key
    assert all(len(x) == 1 for x in same.values())
    want = {(f, a, b) for (f, _), ids in looks.items() for a, b in combinations(sorted(ids), 2) if texts[f][a] != texts[f][b]}
    assert {tuple(r) for r in run(spark, "p2_found")} == want
    links = defaultdict(int)
    for f, a, b in want:
        links[f, a] += 1
        links[f, b] += 1
    assert {(r.field, r.id): r.n_links for r in run(spark, "p2_classes")} == links


@needs_data
def test_every_token_is_in_one_container(spark):
    encode = packing._encoding(packing.TOKENIZER).encode_ordinary
    want = {i: n for i, t in column("documents", "doc_id", "text").items() if t and (n := len(encode(t)))}
    room, got, places = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in run(spark, "p8_containers"):
        room[r.container] += r.n_tokens
        got[r.rec_id] += r.n_tokens
        places[r.rec_id].append((r.first_token, r.n_tokens))
    assert got == want and max(room.values()) <= packing.CAPACITY
    for i, p in places.items():  # a text within the capacity is whole, a longer one is cut without gap
        p.sort()
        assert len(p) == 1 if want[i] < packing.CAPACITY else all(a + n == b for (a, n), (b, _) in zip(p, p[1:]))


def test_a_planted_scan_comes_out_as_it_went_in(spark):
    """Paragraphs are wrapped, hyphened, headed, numbered and misread; what comes out are the paragraphs."""
    para = ["The laboratory opens after the safety training and returns the insurance copy to every incoming student who completed the reading marathon.",
            "Seats for the account migration are limited, so graduate assistants are placed first and the exchange office keeps a note for them."]
    clean = spark.createDataFrame([(" ".join(para),)] * 120, "t string")

    def page(no, text, wrong, right):
        first = lambda lines, i: len(lines[i + 1].split(" ")[0])
        lines, k = next((x, k) for w in range(48, 36, -1) for x in [textwrap.wrap(text.replace(right, wrong, 1), w)] for k in range(len(x) - 2) if first(x, k) > 5)
        word, rest = lines[k + 1].split(" ", 1)
        lines[k], lines[k + 1] = f"{lines[k]} {word[:2]}\u00ad", f"{word[2:]} {rest}"
        return ["Student Handbook", *lines, f"- {no} -"]

    rows = [(i, "\n".join(page(2 * i, para[0], "1aboratory", "laboratory") + [""] + page(2 * i + 1, para[1], "migrat1on", "migration"))) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {r.rec_id: r.text for r in scans.repaired([("s", df, "id", "s", None, True)], [(clean, "t")]).collect()}
    assert set(got) == {i for i, _ in rows} and all(" ".join(t.split()) == " ".join(para) for t in got.values()), next(iter(got.values()))
