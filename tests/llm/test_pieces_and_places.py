import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import leakage as lk
from quern.llm import packing as pk
from quern.llm import personal as ps
from quern.llm import splitting as sp
from quern.llm.visual_form import letters_and_digits


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n다"), max_size=400), st.integers(10, 60), st.integers(0, 4))
def test_split_tiles_the_text(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in pieces) == text
    assert all(0 < e - s <= limit for s, _, e in pieces)
    assert all(s == max(0, b - overlap) for s, b, _ in pieces[1:])


def test_split_cuts_at_boundaries():
    a, b = "사과 나무 열매 수확. " * 30, "기차 역 철도 승객. " * 30
    pieces = sp.split_text(a + "\n\n" + b, 600, 50)
    assert any(e == len(a) + 2 for _, _, e in pieces)  # the topic changes at the empty line
    assert sp.split_text("x" * 2000)[0] == (0, 0, 900)


def test_words_are_compared_whole():
    """Words that begin alike are not one word; a noun with and without its particle is."""
    gaps = lambda t: sp._gaps(t)
    same = "contract contest control. " * 3 + "continent contrast concert. " * 3
    depth = sp.boundary_depths(same, gaps(same))
    assert max(range(len(depth)), key=depth.__getitem__) == 2
    noun = "도서관은 열람실을 엽니다. " * 3 + "도서관의 열람실에서 엽니다. " * 3
    assert max(sp.boundary_depths(noun, gaps(noun))) < 0.01


def test_split_operator(spark):
    df = spark.createDataFrame([(1, "가나다 " * 300, 0), (2, None, 0), (3, "", 0), (4, "x" * 900, 0), (5, "y" * 901, 0), (5, "y" * 901, 0)], "id long, t string, piece int")
    got = sp.split_oversized(df, "id", "t").collect()
    assert {r.rec_id for r in got} == {1, 5} and all(len(r.piece) <= 900 for r in got)
    assert sp.split_oversized(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        sp.split_text("x", 10, 6)


def test_leakage_exact(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefg하나둘셋") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(40)), "x") for i in range(8)] + [(90, None, "x"), (91, "short", "x"), (92, "", "x")]
    docs = []
    for d in range(60):
        p = items[rnd.randrange(8)][1]
        a = rnd.randrange(len(p) - 40)
        docs.append((d, word() + " " + p[a:a + rnd.randint(50, 110)].upper().replace(" ", rnd.choice([" ", ", ", "​"])) + " " + word(), 1))
    docs += [(100, None, 1), (101, "", 1), (102, items[0][1] * 200, 1), (102, items[0][1] * 200, 1)]
    want = set()
    for d, t, _ in docs:
        for i, p, _ in items:
            s, x = letters_and_digits(p or ""), letters_and_digits(t or "")
            if any(s[k:k + 60] in x for k in range(len(s) - 59)):
                want.add((d, i))
    dd = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    ii = spark.createDataFrame(items, "item_id long, passage string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in lk.leaked_items(dd, "doc_id", "text", ii, "item_id", "passage").collect()}
    assert got == want and len(want) > 20
    blocks = {(r.doc_id, r.item_id) for r in lk.leaked_items(dd, "doc_id", "text", ii, "item_id", "passage", block_chars=300).collect()}
    assert blocks == want
    assert lk.leaked_items(dd, "doc_id", "text", ii.limit(0), "item_id", "passage").count() == 0
    assert lk.leaked_items(dd.limit(0), "doc_id", "text", ii, "item_id", "passage").count() == 0


def test_leakage_with_edits():
    s = "thequickbrownfoxjumpsoverthelazydogwhilethesunrisesabovethequiethills"
    index = lk.PassageIndex([(1, s)], run=60, q=8, edits=2)
    assert index.found("xx" + s[:20] + "Q" + s[21:40] + s[41:] + "yy") == [1]  # one replaced, one dropped
    assert index.found(s[:30] + "zzzzzzzzzz" + s[30:]) == []
    with pytest.raises(ValueError):
        lk.PassageIndex([], run=20, q=12, edits=1)


def test_index_is_small_and_refuses_chance():
    """16 bytes a character behind a bitmap; a hash that meets by chance is refused by the alignment."""
    rnd = random.Random(4)
    items = [(i, "".join(rnd.choice("abcdefghij가나다라") for _ in range(2_000))) for i in range(50)]
    index = lk.PassageIndex(items)
    assert index.hashes.nbytes + index.item.nbytes + index.place.nbytes <= 16 * 50 * 2_000 and index.bitmap.nbytes <= 16 * 50 * 2_000
    assert all(index.found("x" * 30 + s[700:760] + "y" * 30) == [i] for i, s in items) and index.found(items[0][1][700:759]) == []
    index.hashes[:] = index.hashes[0]  # every gram meets every other
    index.bitmap[:] = True
    assert index.found("z" * 500) == [] and lk.PassageIndex([]).found("a" * 100) == []


def test_edits_over_tables(spark):
    s = "thequickbrownfoxjumpsoverthelazydogwhilethesunrisesabovethequiethillsandvalleys"
    items = spark.createDataFrame([(7, s)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, s[:30] + "Q" + s[31:]), (2, s), (3, s[:30] + "zz9zz9zz9" + s[30:])], "doc_id long, text string")
    run = lambda e: sorted(r.doc_id for r in lk.leaked_items(docs, "doc_id", "text", items, "item_id", "passage", edits=e).collect())
    assert run(0) == [2] and run(2) == [1, 2]


def test_best_fit_and_bound():
    for seed in range(30):
        rnd = random.Random(seed)
        cap = rnd.choice([10, 64, 100])
        sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(0, 60))), reverse=True)
        place, room = pk.best_fit(sizes, cap)
        load = [0] * len(room)
        for s, c in zip(sizes, place):
            load[c] += s
        assert all(x + r == cap for x, r in zip(load, room))
        assert -(-sum(sizes) // cap) <= pk.lower_bound(sizes, cap) <= len(room) or not sizes
    assert pk.lower_bound([6, 6, 6], 10) == 3 and pk.lower_bound([4, 4, 4, 4], 10) == 2 and pk.lower_bound([4, 3, 3], 10) == 1


def test_containers_hold_everything_once(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 5, 40, 90, 100, 101, 250, rnd.randint(1, 100)])) for i in range(900)] + [(None, 7)]
    df = spark.createDataFrame(rows, "rec_id long, n_tokens long")
    out = pk._packed(df, 100, partition_items=200).collect()
    load, per = {}, {}
    for r in out:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        per[r.rec_id] = per.get(r.rec_id, 0) + r.n_tokens
        assert r.first_token == r.piece_no * 100
    assert max(load.values()) <= 100 and per == dict(rows)
    whole = {i for i, n in rows if n <= 100}
    assert all(sum(1 for r in out if r.rec_id == i) == 1 for i in list(whole)[:50])
    assert len(load) <= 1.03 * sum(n for _, n in rows) / 100 + 1
    assert pk._packed(df.limit(0), 100).count() == 0


def test_best_round_stands_and_the_whole_is_certified(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randint(20, 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "rec_id long, n_tokens long")
    made = {k: pk.report(pk._packed(df, 100, partition_items=60, rounds=k), 100).first() for k in (1, 2, 3)}
    # More rounds are never worse, and no packing is below the bound.
    assert made[3].containers <= made[2].containers <= made[1].containers
    assert all(r.bound <= r.containers and r.gap == r.containers - r.bound and r.tokens == sum(n for _, n in rows) and r.fullest <= 100 for r in made.values())
    assert made[1].bound == made[3].bound == pk.lower_bound([n for _, n in rows], 100)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, t string")
    got = {r.rec_id: r.n_tokens for r in pk.token_sizes(df, "id", "t").collect()}
    assert set(got) == {1, 4} and got[1] >= 2 and got[4] > 1


CASES = [
    ("담당: 탁 라 채 (taritk26@stu.nurisol.example)", [("name", "탁 라 채"), ("email", "taritk26@stu.nurisol.example")]),
    ("답변은 miro.s[at]nurisol[dot]example 주소로", [("email", "miro.s[at]nurisol[dot]example")]),
    ("Reply-to: palri.nsu89 at garam dot test", [("email", "palri.nsu89 at garam dot test")]),
    ("자료 원본은 palin-lib골뱅이mail.haesol.example에서", [("email", "palin-lib골뱅이mail.haesol.example")]),
    ("문의처 （０３１）０７２７－６３６９", [("phone", "（０３１）０７２７－６３６９")]),
    ("번호(031) 060-0889)가 결번", [("phone", "031) 060-0889")]),
    ("전화+82-10-1405-6113 또는", [("phone", "+82-10-1405-6113")]),
    ("전화 공일공 일이삼사 오육칠팔 입니다", [("phone", "공일공 일이삼사 오육칠팔")]),
    ("본인 확인을 위해 490419 - 3968629 번호", [("id_number", "490419 - 3968629")]),
    ("ID on file: M00386927", [("id_number", "M00386927")]),
    ("주민번호 90-39-407158-99, 이름 하 재 하, 주소 라온시 미르구 가온동 26-51", [("id_number", "90-39-407158-99"), ("name", "하 재 하"), ("address", "라온시 미르구 가온동 26-51")]),
    ("제 새 주소는 온새미도 다솜군 너울읍 한울로 71 70층입니다.", [("address", "온새미도 다솜군 너울읍 한울로 71 70층")]),
    ("Send the parcel to 67 Tolven St., Unit 3, Haesol City, attention CALDEL ASTRARRE.", [("address", "67 Tolven St., Unit 3, Haesol City"), ("name", "CALDEL ASTRARRE")]),
    ("Mentor Quimber, Jondova answered quickly.", [("name", "Quimber, Jondova")]),
    ("어제 남한비님께서 남기신", [("name", "남한비")]),
    ("행사 물품 번호 GEN1495-109과 문서 120-110-120은 보건진료소 보관입니다.", []),
    ("새빛로 쪽 학생회관 소극장 앞에 11:20까지 모여 주십시오.", []),
    ("@누리솔 알림을 켜면 2026-04-15 소식을 17:50에 받습니다.", []),
    ("저는 신입생입니다. 담당자 확인을 거쳐 동의서의 유효 기간은 12일입니다.", []),
    ("the desk closes at 9:15 p.m. and opens at noon", []),
    ("Contact John Smith today", [("name", "John Smith")]),
    ("Maria Garcia lives here and Alice Johnson will come", [("name", "Maria Garcia"), ("name", "Alice Johnson")]),
    ("+33 1 23 45 67 89 or +49 30 901820.", [("phone", "+33 1 23 45 67 89"), ("phone", "+49 30 901820")]),
    ("연락 +82 10 0255 9446 69주차에는", [("phone", "+82 10 0255 9446")]),
    ("SSN 123-45-6789 is on file, room 123-45-6789x", [("id_number", "123-45-6789")]),
    ("call five five five one two three four five six seven now", [("phone", "five five five one two three four five six seven")]),
    ("Dear Course Catalog, From: Seoul Station", []),
    ("The tutor United Nations said 2+3 is 4+12345678", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_personal(text, want):
    assert [(k, text[a:b]) for k, a, b in ps.find(text)] == sorted(want, key=lambda w: text.index(w[1]))


def test_personal_offsets_survive_disguise():
    plain, cover = "연락 010-1234-5678 끝", "연​락 ０１０­-１２３４-5678​ 끝"
    assert ps.redact(plain) == "연락 [PHONE] 끝"
    assert ps.redact(cover) == "연​락 [PHONE]​ 끝"
    import unicodedata
    nfd = "담당: " + unicodedata.normalize("NFD", "남한비") + " (x)"
    assert ps.redact(nfd) == "담당: [NAME] (x)"


def test_personal_operator(spark):
    df = spark.createDataFrame([(1, "문의 010-1234-5678", 5), (2, None, 5), (3, "", 5), (4, "가" * 100_000 + " 010-1234-5678", 5), (4, "010-1234-5678", 5)], "doc_id long, text string, start_pos int")
    got = sorted((r.doc_id, r.start_pos) for r in ps.personal_spans(df, "doc_id", "text").collect())
    assert got == [(1, 3), (4, 0), (4, 100_001)]
    assert {r.text for r in ps.redacted(df, "doc_id", "text").where("doc_id < 3").collect()} == {"문의 [PHONE]", None}
    assert ps.personal_spans(df.limit(0), "doc_id", "text").count() == 0
