from quern.llm import page_model as pm
from quern.llm import residue as rs
from quern.llm import scans as sc

PAGE = "\n".join(["본문으로 건너뛰기", "학교안내", "입학정보", "Home > 장학 > 등록금 납부", "등록금 납부 안내 (제2026-1호)", "등록일 2026.01.02 | 조회 17",
                  "등록금 납부 기간은 3월 2일부터 8일까지이며, 기간이 지나면 추가 비용이 발생할 수 있습니다.", "- 장소: 본관 통합민원실(9:00 집합)", "이 글이 도움이 되었나요? 의견 남기기",
                  "관련 글 목록", "장학금 신청 안내 (제2025-12345호)", "Copyright Nurisol University. All rights reserved."])


def test_page_body(spark):
    rows = [(1, PAGE, "등록금 납부 안내 (제2026-1호)", 0, "x"), (2, None, "t", 0, "x"), (3, "", "t", 0, "x"), (4, "\n\n", None, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, raw_text string, title string, `_id` int, `_text` string")
    gone = {(r.doc_id, r.line_no) for r in pm.surrounding_lines(df, "doc_id", "raw_text", "title").collect()}
    assert gone == {(1, i) for i in (0, 1, 2, 3, 5, 8, 9, 10, 11)}
    body = {r.doc_id: r.main_body for r in pm.main_body(df, "doc_id", "raw_text", "title").collect()}
    assert body[1].split("\n")[0].startswith("등록금 납부 안내") and body[2] is None and body[3] == ""
    assert pm.surrounding_lines(df.limit(0), "doc_id", "raw_text", "title").count() == 0


HTML = ("<html><body><ul id=menu><li>학교안내<li>입학정보</ul><div>Home &gt; 장학 &gt; 등록금 납부</div><div class=view><h2>등록금 납부 안내 (제2026-1호)</h2><p>등록일 2026.01.02 | 조회 17"
        "<div><p>등록금 납부 기간은 3월 2일부터 8일까지이며, 기간이 <b>지나면</b> 추가 비용이 발생할 수 있습니다.<table><tr><td>장소<td>본관 통합민원실</table></div></div>"
        "<script>var x = 1;</script><div><h4>관련 글 목록</h4><ul><li>장학금 신청 안내 (제2025-12345호)<li>휴학 신청 안내 (제2024-77호)</ul></div><p>Copyright Nurisol University. All rights reserved.")


def test_page_body_of_html(spark):
    lines, nodes = pm.html_lines(HTML)
    assert lines[:2] == ["학교안내", "입학정보"] and nodes[0] == nodes[1] != nodes[2] and "장소 | 본관 통합민원실" in lines and not any("var x" in x for x in lines)
    assert pm.html_lines("") == ([], []) and pm.html_lines("a<br>b<div>c</div>d")[0] == ["a", "b", "c", "d"]
    assert len(pm.html_lines("<div>" * 3000 + "x")[0]) == 1
    df = spark.createDataFrame([(1, HTML, "등록금 납부 안내 (제2026-1호)"), (2, None, None), (3, "", None)], "doc_id long, html string, title string")
    got = {r.doc_id: r.main_body for r in pm.html_main_body(df, "doc_id", "html", "title").collect()}
    assert got[1].split("\n") == ["등록금 납부 안내 (제2026-1호)", "등록금 납부 기간은 3월 2일부터 8일까지이며, 기간이 지나면 추가 비용이 발생할 수 있습니다.", "장소 | 본관 통합민원실"]
    assert got[2] is None and got[3] == ""


def test_messages_agree_with_enumeration():
    """Sum-product on a small tree gives the marginals of a full enumeration."""
    import itertools
    from math import exp, isclose
    model = pm.PageModel()
    text, title = "로그인\n사이트맵\n안내 말씀 드립니다.\n- 장소: 본관", None
    lines, titles, regions = model.layout(text, title)
    ev = [model.evidence(x, t, r) for x, t, r in zip(lines, titles, regions)]
    blocks = []
    for i, (_, kind) in enumerate(ev):
        if blocks and ev[blocks[-1][-1]][1] == kind:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    total, on = 0.0, [0.0] * len(lines)
    for r in (0, 1):
        for bs in itertools.product((0, 1), repeat=len(blocks)):
            for ls in itertools.product((0, 1), repeat=len(lines)):
                w = model.region[regions[0]][r]
                for b, members in zip(bs, blocks):
                    w += model.block.get(ev[members[0]][1], model.block["short"])[r][b]
                    for i in members:
                        z = ev[i][0]
                        w += model.line[b][ls[i]] + (-pm._softplus(-z) if ls[i] else -pm._softplus(z))
                w = exp(w)
                total += w
                for i, x in enumerate(ls):
                    on[i] += w * x
    assert all(isclose(p, o / total, abs_tol=1e-9) for p, o in zip(model.marginals(text, title), on))


def test_residue(spark):
    rows = [(1, "오류 코드: 404\n요청하신 페이지를 찾을 수 없습니다."), (2, "{{title}}\n{{name}}님, {{dept}}에서 접수합니다."), (3, "응용 실습에서는 {{name}} 같은 자리표시자를 실제 값으로 바꾸는 법을 3주차에 배웁니다."),
            (4, "장학금 신청 기간은 3월 2일까지입니다.\n문의: ${office}"), (5, "휴학 신청 중 404 오류 화면이 뜨면 학생 포털 주소를 다시 입력하고, 3분 뒤에도 같으면 학사지원팀에 알려 주십시오."),
            (6, None), (7, ""), (8, "Lorem ipsum limen vendit pristo maquen consel."), (9, "Please bring the form to the desk before noon.")]
    rows += [(10, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, t string, leaf string, letters int")
    got = {r.rec_id for r in rs.residue_records([("t", df, "id", "t", None)]).collect()}
    assert got == {1, 2, 4, 8, 10}
    assert rs.residue_records([("t", df.limit(0), "id", "t", None)]).count() == 0


def test_long_messages_and_standard_ones(spark):
    """Messages written as one long line, and pages that hold little or much beside them."""
    bad = ["We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "Just a moment... Checking your browser before accessing the site.", "Under construction",
           "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."]
    good = ["The library moves to the new hall in spring, so the reading room is closed for two weeks and loans are extended. Ask the desk for help.",
            "If the portal shows an error such as 404, reload the page and write to the office, which will look into it within two working days."]
    df = spark.createDataFrame(list(enumerate(bad + good)), "id long, t string")
    assert sorted(r.rec_id for r in rs.residue_records([("t", df, "id", "t", None)]).collect()) == list(range(len(bad)))


def test_residue_of_a_page(spark):
    page = "본문으로 건너뛰기\n학교안내\n등록금 안내 (제2026-1호)\n스크립트를 지원하지 않는 환경입니다. 설정을 확인해 주세요.\nCopyright Nurisol University. All rights reserved."
    df = spark.createDataFrame([(1, page, "등록금 안내 (제2026-1호)"), (2, PAGE, "등록금 납부 안내 (제2026-1호)"), (3, None, None)], "id long, t string, title string")
    assert [r.rec_id for r in rs.residue_records([("raw_text", df, "id", "t", "title")]).collect()] == [1]


def test_scan_shapes():
    assert sc.look_key("생활괸") == sc.look_key("생활관") and sc.look_key("cornpleted") == sc.look_key("completed") and sc.look_key("1ab0rat0ry") == sc.look_key("laboratory")
    assert sc.number_shape("2O26-O8-l8에") == "9-9-9에" and sc.code_shape("ENGl9S6") == "eng9"
    for x in ("[36]", "- 16 -", "8", "p. 12", "Page 3 of 9", "5 / 8", "- l6 -"):
        assert sc.is_page_number(x), x
    for x in ("2026.", "Page turner", "23.(월)까지 학생회관", ""):
        assert not sc.is_page_number(x), x


def test_page_numbers_need_a_digit_and_a_place():
    for x in ("Soil", "loss", "oil", "solo", "OS", "Is", "- lS -"):
        assert not sc.is_page_number(x), x
    page = ["The year was", "2024", "and rooms", "350", "were free."]
    assert sc.page_numbers(page) == set()
    assert sc.page_numbers([*page, "12"]) == {5} and sc.page_numbers(["7", *page]) == {0} and sc.page_numbers(["text", "- 9 -", "text"]) == {1}
    assert sc.page_numbers(["a b", "31", "c d", "32", "e f", "350", "g h"]) == {1, 3}  # in sequence
    assert sc.page_numbers(["a b", "31", "\x0cc d", "350", "g h"]) == {1} and sc.page_numbers([]) == set()


def test_headers_of_a_small_series_in_a_large_corpus(spark):
    """A booklet's header is found whatever else there is; the first line of copies of one text is not one."""
    import random
    rnd = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: [" ".join(rnd.choice(words) for _ in range(7)) for _ in range(n)]
    rows = [(i, "\n".join(text(12))) for i in range(300)] + [(1000 + i, "\n".join(["Handbook of the tiny series", *text(11)])) for i in range(6)]
    copy = "\n".join(text(12))
    rows += [(2000 + i, copy) for i in range(60)]
    df = spark.createDataFrame(rows, "rec_id long, _text string").selectExpr("*", "true as _always")
    assert {r.k for r in sc.header_lexicon(df).collect()} == {sc.header_key("Handbook of the tiny series")}


def test_joined_headers_and_word_list_change_nothing(spark, monkeypatch):
    clean = spark.createDataFrame([("장학금 신청서를 학생회관 사무실에 제출하면 됩니다. 2026년 3월 18일까지 접수합니다.",)] * 300, "t string")
    rows = [(i, f"생활관 안내 책자\n{i}번 장학금 신청서를 힉생회괸 사무실에 제출하-\n면 됩니다. 2O26년 3월 l8일까지 접수합니다.\n- {i} -") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "id long, s string")
    run = lambda: sorted(tuple(r) for r in sc.scan_noise([("s", df, "id", "s", None, True)], [(clean, "t")]).collect())
    want = run()
    assert len(want) == 8 * 5
    monkeypatch.setattr(sc, "SHARED_HEADERS", 0)
    assert run() == want
    monkeypatch.setattr(sc, "KNOWN_WORDS", 0)
    assert run() == want


def test_joined_headers_are_found_wherever_they_stand(spark, monkeypatch):
    """At a page's foot, within it, numbered, one sign off, and in records without an id, as with shared headers."""
    clean = spark.createDataFrame([("장학금 신청서를 학생회관 사무실에 제출하면 됩니다.",)] * 6, "t string")
    rows = [(i, "\n".join(["생활관 안내 책자", *(f"{i}번 학생은 {j}번 신청서를 냅니다." for j in range(9))])) for i in range(20, 32)]
    rows += [(9, "장학금 신청서를 제출하면 됩니다.\n생활관 안내 책자"), (10, "신청서를 냅니다.\n12   생활관 안내 책지\n신청서를 냅니다."),
             (None, "신청서를 냅니다.\n생활관 안내\n생활관안내 책자"), (11, "신청서를 냅니다.\n생활관 안내 규정"), (12, ""), (13, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    args = [("s", df, "id", "s", None, True)], [(clean, "t")]
    run = lambda: (sorted(map(tuple, sc.scan_noise(*args).collect()), key=str), sorted(map(tuple, sc.repaired(*args).collect()), key=str))
    want = run()
    assert {r[1:3] for r in want[0] if r[3] == "running_header"} == {*((i, 0) for i in range(20, 32)), (9, 1), (10, 1), (None, 2)}
    monkeypatch.setattr(sc, "SHARED_HEADERS", 0)
    assert run() == want


def test_wrapped_or_not():
    import textwrap
    text = "Seats for the credit transfer are limited to forty, so graduate assistants are placed first. Bring the budget sheet to the desk. The office will contact you soon."
    assert sc.looks_scanned(textwrap.wrap(text, 45))
    assert not sc.looks_scanned([s + "." for s in text.split(". ")]) and not sc.looks_scanned(["one line"]) and not sc.looks_scanned([])


def test_scans(spark):
    clean = ["장학금 신청서를 학생회관 사무실에 제출하면 됩니다. 강의실 배정 결과는 학생 포털에서 확인할 수 있습니다. 2026년 3월 18일까지 접수합니다. part-time tutoring round"] * 6
    scan = "생활관 안내 책자\n장학금 신청서를 힉생회괸 사무실에 제출하-\n면 됩니다. 강의실 배정 결과는 학생 포털에서\n확인할 수 있습니다. 2O26년 3월 l8일까지 접수\n- 7 -\n생활괸 안내 책자\n합니다. 장학금 신청서를 학생회관 사무실에 제출\n하면 됩니다.\n- 8 -"
    texts = spark.createDataFrame([(t,) for t in clean], "t string")
    rows = [(1, scan, None), (2, None, None), (3, "", None), (4, "- 접수: 3월 2일\n비고\n45\n합계", None), (5, scan, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, s string, title string, field string")
    both = [("s", df.where("id != 4"), "id", "s", "title", True), ("s", df.where("id = 4"), "id", "s", "title", False)]
    found = sc.scan_noise(both, [(texts, "t")])
    got = {(r.rec_id, r.line_no, r.noise) for r in found.collect()}
    want = {(0, "running_header"), (1, "misread"), (1, "broken_word"), (3, "misread"), (4, "page_number"), (5, "running_header"), (8, "page_number")}
    assert {(n, k) for i, n, k in got if i == 1} == want and {(n, k) for i, n, k in got if i == 5} == want
    assert not any(i in (2, 3, 4) for i, *_ in got)
    fixed = {r.rec_id: r.text for r in sc.repaired(both, [(texts, "t")]).collect()}
    assert "학생회관 사무실에 제출하면 됩니다." in fixed[1] and "2026년 3월 18일까지 접수 합니다." in fixed[1] and "책자" not in fixed[1]
    assert fixed[4] == rows[3][1]
    assert sc.scan_noise([("s", df.limit(0), "id", "s", "title", True)], [(texts.limit(0), "t")]).count() == 0
