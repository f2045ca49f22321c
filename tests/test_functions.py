from datetime import date, datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import html, scalars, text, urls
from quern.operators import chunking, understand


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


def test_search_tokens(spark):
    assert one(spark, "수강정정 기간은 Library에서 A 5 CAMPUS", text.search_tokens) == ["수강정정", "기간", "library", "5", "campus"]
    assert one(spark, "", text.search_tokens) == []
    assert one(spark, None, text.search_tokens) is None


def test_fixed_split(spark):
    for n, pieces in ((0, 0), (1, 1), (900, 1), (901, 2), (1700, 2), (1701, 3)):
        got = one(spark, "x" * n, text.fixed_split)
        assert len(got) == pieces and all(len(p) <= 900 for p in got)


def test_greedy_pack(spark):
    t = "\n\n".join(["a" * 400, "b" * 400, "c" * 200, "d" * 1000, "e" * 10])
    got = one(spark, t, text.greedy_pack)
    assert [len(p) for p in got] == [802, 200, 900, 200, 10]
    assert one(spark, None, text.greedy_pack) == []


def test_repeated_lines(spark):
    t = "\n".join(["repeated line"] * 4 + ["three times!"] * 3 + ["12345678"] * 5)
    assert one(spark, t, chunking.drop_repeated_lines) == "\n".join(["three times!"] * 3 + ["12345678"] * 5)


def test_sections(spark):
    got = one(spark, "front\n[ATTACHMENT: a.pdf]\nx\ny\n[ATTACHMENT: b.hwp]\n", chunking.attachment_sections)
    assert [(s.title, s.text) for s in got] == [("", "front"), ("a.pdf", "x\ny")]


def test_forms(spark):
    assert one(spark, "  Hello   WORLD?!", text.utterance) == "hello world"
    assert one(spark, "b@@@@d w0rd!", text.squeezed_form) == "baadword"
    assert one(spark, "report.final.PDF", lambda c: urls.extension(F.concat(F.lit("https://h/a/"), c))) == "pdf"
    assert one(spark, 'attachment; filename="a b.pdf"', text.disposition_filename) == "a b.pdf"
    assert one(spark, "attachment; filename*=UTF-8''%EA%B0%80.hwp", text.disposition_filename) == "가.hwp"
    assert one(spark, "ＡＢＣ 몇시??", lambda c: text.normalise_query(c, [("몇시", "몇 시")])) == "ABC 몇 시?"
    assert one(spark, "a" * 10, lambda c: text.preview(c, 4)) == "aaaa..."


def test_dates(spark):
    for raw, want in (("2026-04-10T01:02", date(2026, 4, 10)), ("2026.04.10", date(2026, 4, 10)), ("2026/4/1", date(2026, 4, 1)), ("junk", None), ("", None), ("2026-13-40", None), (None, None)):
        assert one(spark, raw, scalars.parse_date) == want
    assert one(spark, date(2030, 1, 1), lambda c: scalars.recency(c, F.lit("2026-01-01").cast("date")), "date") == 0.4
    assert one(spark, datetime(2026, 1, 1, 20), lambda c: scalars.kst_stamp(c), "timestamp_ntz") == "2026-01-02T05:00:00+09:00"


def test_urls(spark):
    for u, kind in (("https://h/a.pdf", "attachment"), ("https://h/b.do?mode=view&articleNo=7", "board_detail"), ("https://h/b.do?mode=list", "board_list"), ("https://h/x", "static_page")):
        assert one(spark, u, urls.classify) == kind
    assert one(spark, " https://h/x#top ", urls.canonical) == "https://h/x"
    got = spark.createDataFrame([("https://h/a/b", "../c"), ("https://h/", None)], "b string, h string").select(urls.resolve("b", "h").alias("r")).collect()
    assert [r.r for r in got] == ["https://h/c", None]


def test_html():
    f = html.fields("<title>T</title><div>short</div><div>the longest one here</div>", "https://h/")
    assert f["title"] == "T" and f["content"] == "the longest one here"
    assert html.fields(None, None)["links"] == []
    rows = html.list_rows("<table><tr><td><a href='v?articleNo=3'>A</a><td>2024.01.02</tr><tr><td><a href='v?articleNo=3'>B</a></tr><tr><td>no link</tr></table>", "https://h/b/")
    assert [(r["article_no"], r["title"], r["date"]) for r in rows] == [("3", "B", None)]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert "x" in html.parse(deep).text()


def test_partial_similarity():
    assert text.partial_similarity("abc", "xxabcxx") == 100.0
    assert text.partial_similarity("", "") == 100.0 and text.partial_similarity("", "a") == 0.0
    assert text.partial_similarity("abcd", "abxd") == 75.0


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_indel_is_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 100.0 if not a and not b else 200.0 * table[-1][-1] / (len(a) + len(b))
    assert abs(text._indel_similarity(a, b) - want) < 1e-9


def test_understanding(spark):
    df = spark.createDataFrame([("도서관 언제 신청",), ("",), (None,)], "question string")
    got = understand.understand(df, "question", synonyms={"도서관": ["열람실"]}, terms=["도서관", "신청"], stopwords=["언제"], groups={"category": {"도서관": ["열람석"]}},
                                expansions={"언제": ["기간"]}, hints={"도서관": ["library"]}).collect()
    assert got[0].normalized_query == "도서관 언제 신청 열람실"
    assert got[0].keywords == ["도서관", "신청", "열람실"] and got[0].category == "도서관"
    assert got[0].filters["document_category"] == ["library"] and got[0].rewritten_queries[-1].endswith("기간")
    assert got[1].keywords == [] and got[2].category is None


def test_intents(spark):
    df = spark.createDataFrame([("등록금 얼마",), ("안녕!!",), ("st0pid 바보",), ("",)], "q string")
    rude = understand.abusive(F.col("q"), ["바보"], [])
    got = [r.i for r in df.select(understand.intent(F.col("q"), abuse=rude, domain=["등록금"], question=["얼마"], time=["오늘"], patterns=["[0-9]+월"]).alias("i")).collect()]
    assert got == ["INFO", "GENERAL", "PROFANITY", "GENERAL"]


def test_html_selectors_and_meta():
    page = ("<div id=x><main>m</main></div><div class='board_view big'><p><div class='info cont'>body<table><tr><td>a<td>b<tr><td><table><tr><td>inner</table></table>"
            "<img src=p.png><img src='/p.png'><a href='f.pdf'>첨부 one</a><a href='f.pdf'>첨부 one</a><a href='g.hwp'>two</a></div></div><p>작성자<p>홍길동 조회수 1,234<p>작성일: 2026-01-02<p>2020-01-01")
    f = html.fields(page, "https://h/b/")
    assert f["content"].startswith("body") and (f["published_at"], f["views"], f["author"]) == ("2026-01-02", 1234, "홍길동")
    assert f["images"] == ["https://h/b/p.png", "https://h/p.png"] and [(a["index"], a["url"][-5:]) for a in f["attachments"]] == [(1, "f.pdf"), (3, "g.hwp")]
    assert "a | b" in f["table_text"] and html.fields(page, "https://h/", static=True)["content"] == "m"
    root = html.parse("<h3>three</h3><div class='sub-title'>s</div><nav><p class=cont>no</p></nav>")
    assert html.find_title(root) == "three" and html.select(root, "nav .cont").text() == "no" and html.select(root, ".cont nav") is None
    assert html.without_noise(html.parse("<div>a<div class='quickMenu'>q</div><aside>z</aside>b</div>")).text().replace("\n", "") == "ab"


def test_long_lexicons_match_alike(spark):
    from quern.operators import understand as u
    terms = ["ab", "abc", "bc", "가나", "나다", "가나다"] + [f"zz{i}" for i in range(80)]
    rows = [("xabcx ab",), ("가나다 abc",), ("",), (None,), ("zz7 zz70 bc",)]
    got = [r.t or [] for r in spark.createDataFrame(rows, "s string").select(u.lexicon_hits(F.col("s"), terms).alias("t")).collect()]
    want = [sorted((t for t in terms if s and t in s), key=lambda t: (s.index(t) + len(t), -len(t), t)) for s, in rows]
    assert got == want
