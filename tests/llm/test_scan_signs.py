import pytest

from quern.llm import scans as sc

HEADER = "누리솔대학교 수업 편람"
SHORT = "휴학 신청은 학생 포털에서 접수합니다."


@pytest.mark.parametrize("text", [f"{HEADER}\n{SHORT}", f"10   {HEADER}\n{SHORT}", f"{SHORT}\n32 / 35", f"{SHORT}\n- 35 -", f"{SHORT}\n[21]", f"{SHORT}\np. 24",
                                  f"2O24. 2. 14.까지\n{SHORT}", f"l8일까지\n{SHORT}", "신청서를 제출하­\n면 됩니다.", f"{'a' * 120}\n{SHORT}\n- 7 -"])
def test_other_signs_of_a_scan(text):
    lines = text.split("\n")
    assert not sc.looks_scanned(lines) and sc.PageReader({sc.header_key(HEADER)}).is_scan(lines)


@pytest.mark.parametrize("text", [SHORT, f"{SHORT}\n35", "비고\n45\n합계", "ENG1950 | LIB1339", "SO2 5l IRB", f"{SHORT}\n{HEADER}", "- 접수: 3월 2일\n비고\n45", ""])
def test_no_sign_of_a_scan(text):
    assert not sc.PageReader({sc.header_key(HEADER)}).is_scan(text.split("\n"))


def test_short_scans_are_read(spark):
    clean = spark.createDataFrame([("휴학 신청은 학생 포털에서 접수합니다. 2026년 3월 18일까지",)] * 6, "t string")
    rows = [(i, f"{HEADER}\n{SHORT}\n{SHORT}") for i in range(4)] + [(7, f"{HEADER}\n{SHORT}\n5 / 8"), (8, f"{SHORT}\n35")]
    df = spark.createDataFrame(rows, "id long, s string")
    scans = [("a", df.where("id < 4"), "id", "s", None, True), ("b", df.where("id > 4"), "id", "s", None, False)]
    got = {(r.rec_id, r.line_no, r.noise) for r in sc.scan_noise(scans, [(clean, "t")]).where("field = 'b'").collect()}
    assert got == {(7, 0, "running_header"), (7, 2, "page_number")}
    fixed = {r.rec_id: r.text for r in sc.repaired(scans, [(clean, "t")]).where("field = 'b'").collect()}
    assert fixed == {7: SHORT, 8: rows[-1][1]}
