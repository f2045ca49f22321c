import io
import json
import zipfile

from pyspark.sql import functions as F

from quern.sources import attachments, files, sinks
from quern.streaming import jobs


def _zip(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return b.getvalue()


def test_chunk_files(spark, tmp_path):
    d = tmp_path / "notice"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([{"chunk_id": "c1", "title": "t"}, 3, {"chunk_id": "c2", "department": None}]), "utf-8")
    (d / "b.json").write_text(json.dumps({"chunk_id": "c3", "chunk_index": 2}), "utf-8")
    (d / "c.json").write_text("[]", "utf-8")
    (d / "d.json").write_text("{broken", "utf-8")
    got = {r.chunk_id: r for r in files.json_records(spark, str(tmp_path)).collect() if r.chunk_id}
    assert sorted(got) == ["c1", "c2", "c3"] and got["c1"].content == "" and got["c2"].department is None and got["c3"].chunk_index == 2


def test_parsers(spark, tmp_path):
    d = tmp_path / "notice" / "d1"
    d.mkdir(parents=True)
    (d / "a.docx").write_bytes(_zip(word__document="", **{"word/document.xml": "<w:d xmlns:w='u'><w:t>하나</w:t><w:t>둘</w:t></w:d>"}))
    (d / "b.xlsx").write_bytes(_zip(**{"xl/sharedStrings.xml": "<s><si><t>가</t></si></s>", "xl/worksheets/sheet1.xml": "<w><c t='s'><v>0</v></c><c><v>7</v></c></w>"}))
    (d / "c.hwpx").write_bytes(_zip(**{"Contents/section0.xml": "<a><b>본문</b></a>", "other.xml": "<x>no</x>", "Contents/section1.xml": "<broken"}))
    (d / "d.docx").write_bytes(b"no zip")
    (d / "e.pdf").write_bytes(b"%PDF")
    (d / "f.exe").write_bytes(b"MZ")
    got = {r.file_name: r for r in attachments.parse_files(files.attachment_files(spark, str(tmp_path))).collect()}
    assert got["a.docx"].extracted_text == "하나\n둘" and got["b.xlsx"].extracted_text == "가\n7" and got["c.hwpx"].extracted_text == "본문"
    assert got["d.docx"].extracted_text is None and got["d.docx"].note.startswith("BadZipFile")
    assert got["e.pdf"].note and got["f.exe"].parser_type == "unsupported"


def test_fetch_keeps_failures(spark):
    s = files.seeds(spark, [("n", "https://h/list", "notice", "board")])
    req = files.page_requests(s, 2)
    assert [r.request_url for r in req.orderBy("page_no").collect()][1].endswith("article.offset=10")

    def get(u):
        if u.endswith("=10"):
            raise OSError("down")
        return "<html>"

    got = files.fetch(req, "request_url", get).orderBy("page_no").collect()
    assert got[0].body == "<html>" and got[1].body is None and "down" in got[1].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, source_type string")
    sinks.write_partitions(df, str(tmp_path / "t"))
    sinks.write_partitions(df.where("id = 2").withColumn("id", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]
    sinks.append_log(df, str(tmp_path / "log"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_upsert_stream(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "table")
    schema = "k int, v string, at int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "a2", 2)], schema).write.mode("append").parquet(str(src))
    run = lambda: jobs.upsert_stream(jobs.file_stream(spark, str(src), schema), table, ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "b2", 3), (3, "c", 3)], schema).write.mode("append").parquet(str(src))
    run()
    assert {r.k: r.v for r in jobs.read_latest(spark, table).collect()} == {1: "a2", 2: "b2", 3: "c"}


def test_lines(spark):
    df = spark.createDataFrame([("본문 줄입니다\nhttps://x.y\n- 3 -\n\n\n\n끝   줄",)], "t string")
    assert df.select(attachments.clean_lines(F.col("t")).alias("r")).first().r == "본문 줄입니다\n\n끝 줄"
