"""Cleaning, fingerprints, chunking, addresses and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalars, text, urls
from quern.functions.html import page_fields
from quern.operators import chunking
from quern.plans.tables import table
from quern.sources import attachments

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_B = r"[ \t\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_STRIP = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{3000}}]+|[\s\x{{00A0}}\x{{3000}}]+$', '', 'g')"
_STRIP = _STRIP.replace("{{", "{").replace("}}", "}")


def _strip(x):
    return _STRIP.replace("{0}", x)


def _squeeze(x):
    a = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g'), '{_B}+', ' ', 'g')"
    return _strip(f"regexp_replace(regexp_replace({a}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


#: Fixed noise patterns of the cleaning query.
NOISE = ["^주메뉴", "바로가기 선택$", "^Copyright", "^조회 \\d+$"]


@query(f"""WITH s AS (SELECT doc_id, {_squeeze('raw_text')} AS b, {_squeeze('table_text')} AS t FROM documents),
k AS (SELECT doc_id, t, {_squeeze("array_to_string(list_filter(string_split(b, chr(10)), lambda x: x = '' OR (length(x) >= 2 AND NOT regexp_matches(x, '(?:^주메뉴)|(?:바로가기 선택$)|(?:^Copyright)|(?:^조회 [0-9]+$)'))), chr(10))")} AS b FROM s)
SELECT doc_id, CASE WHEN t = '' THEN b WHEN b = '' THEN t ELSE b || chr(10) || chr(10) || t END AS clean FROM k""")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean_text(F.col("raw_text"), NOISE, F.col("table_text")).alias("clean"))


_LINE = r"regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{3000}]+', ' ', 'g')"


@query(f"SELECT doc_id, {_strip(_LINE)} AS line, {_squeeze('text')} AS squeezed FROM documents")
def whitespace_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.one_line(F.col("text")).alias("line"), text.squeeze(F.col("text")).alias("squeezed"))


def _tagged(tag, col):
    s = _strip(f"coalesce({col}, '')")
    return f"CASE WHEN {s} <> '' THEN '[{tag}]' || chr(10) || {s} END"


@query(f"SELECT doc_id, sha1(coalesce(concat_ws(chr(10) || chr(10), {_tagged('BODY', 'text')}, {_tagged('TABLE', 'table_text')}, {_tagged('ATTACHMENT', 'attachment_text')}, {_tagged('IMAGE', 'image_text')}), '')) AS fingerprint FROM documents")
def content_hash(spark, sf_dir):
    parts = {"BODY": F.col("text"), "TABLE": F.col("table_text"), "ATTACHMENT": F.col("attachment_text"), "IMAGE": F.col("image_text")}
    return _docs(spark, sf_dir).select("doc_id", text.fingerprint(parts).alias("fingerprint"))


@query("""SELECT doc_id, i::INTEGER AS piece_no, substring(attachment_text, (i * 800 + 1)::BIGINT, 900) AS piece
FROM (SELECT doc_id, attachment_text, unnest(generate_series(0, greatest(ceil((length(attachment_text) - 900) / 800.0), 0)::BIGINT)) AS i FROM documents WHERE length(attachment_text) > 0)""")
def chunk_fixed_split(spark, sf_dir):
    d = _docs(spark, sf_dir).where(F.length("attachment_text") > 0)
    return d.select("doc_id", F.posexplode(text.fixed_split(F.col("attachment_text"))).alias("piece_no", "piece"))


@query()
def chunk_greedy_pack(spark, sf_dir):
    return chunking.chunk_documents(_docs(spark, sf_dir), "doc_id", "title", "text", "table_text", "attachment_text", "image_text")


@query(f"""SELECT doc_id, i::INTEGER AS paragraph_no, p AS paragraph FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS p FROM
 (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM documents))""")
def paragraph_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("paragraph_no", "paragraph"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(attachment_text, chr(10)) AS ls FROM documents WHERE attachment_text IS NOT NULL)),
k AS (SELECT *, {_strip('line')} AS key, count(*) OVER (PARTITION BY doc_id, {_strip('line')}) AS n FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (length(key) >= 8 AND NOT regexp_matches(key, '^[0-9]+$') AND n > 3)), '') AS kept FROM k GROUP BY doc_id""")
def repeated_lines_in_document(spark, sf_dir):
    d = _docs(spark, sf_dir).where("attachment_text is not null")
    return d.select("doc_id", chunking.drop_repeated_lines(F.col("attachment_text")).alias("kept"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(attachment_text, chr(10)) AS ls FROM documents WHERE attachment_text <> '')),
k AS (SELECT *, regexp_full_match(line, '\\[ATTACHMENT: .*\\]') AS head, sum(regexp_full_match(line, '\\[ATTACHMENT: .*\\]')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
g AS (SELECT doc_id, sec, coalesce(max(CASE WHEN head THEN regexp_extract(line, '^\\[ATTACHMENT: (.*)\\]$', 1) END), '') AS title, {_strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '')")} AS text FROM k GROUP BY doc_id, sec)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INTEGER AS section_no, title, text FROM g WHERE text <> ''""")
def attachment_sections(spark, sf_dir):
    s = chunking.attachment_sections(F.col("attachment_text"))
    return _docs(spark, sf_dir).where("attachment_text != ''").select("doc_id", F.posexplode(s).alias("section_no", "s")).select("doc_id", "section_no", "s.title", "s.text")


@query(f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。])\\s+', '\\1' || chr(1), 'g'), '다\\s+', '다' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS ps FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(ps, lambda x: substring({_strip('x')}, 1, 240)), lambda x: length(x) >= 20) AS ps FROM p)
SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INTEGER AS sentence_no, unnest(ps) AS sentence FROM k""")
def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence_no", "sentence"))


_PATH = "regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_EXT = f"lower(nullif(regexp_extract(regexp_extract({_PATH}, '([^/]*)$', 1), '\\.([^.]+)$', 1), ''))"
_MODE = "lower(coalesce(nullif(regexp_extract(source_url, '[?&]mode=([^&#]*)', 1), ''), ''))"
_ART = "nullif(regexp_extract(source_url, '[?&]articleNo=([^&#]*)', 1), '')"
_LIST = ", ".join(f"'{e}'" for e in urls.ATTACHMENT_EXTENSIONS)


@query(f"""SELECT doc_id, CASE WHEN coalesce({_EXT} IN ({_LIST}), false) OR {_MODE} = 'download' THEN 'attachment' WHEN {_MODE} = 'view' OR {_ART} IS NOT NULL THEN 'board_detail'
  WHEN {_MODE} = 'list' OR contains(source_url, '/board/') THEN 'board_list' ELSE 'static_page' END AS kind,
  lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_replace(trim(source_url), '#.*$', '') AS canonical,
  coalesce({_ART}, nullif(regexp_extract({_PATH}, '/([0-9]+)/?$', 1), '')) AS article_no, 'static_' || substring(sha1(source_url), 1, 16) AS static_id,
  'doc_' || source_type || '_' || coalesce(coalesce({_ART}, nullif(regexp_extract({_PATH}, '/([0-9]+)/?$', 1), '')), 'unknown') AS board_id
FROM documents WHERE source_url IS NOT NULL""")
def url_fields(spark, sf_dir):
    u = F.col("source_url")
    return _docs(spark, sf_dir).where(u.isNotNull()).select(
        "doc_id", urls.classify(u).alias("kind"), urls.host_of(u).alias("host"), urls.canonical(u).alias("canonical"), urls.article_number(u).alias("article_no"),
        urls.static_id(u).alias("static_id"), urls.document_id(F.col("source_type"), urls.article_number(u)).alias("board_id"))


def _escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("""WITH f AS (SELECT doc_id, list({'n': asset_index, 'id': id, 'name': '첨부 ' || file_name, 'url': file_url} ORDER BY asset_index, id) FILTER (WHERE asset_type = 'attachment' AND file_url IS NOT NULL) AS files,
  list_sort(list_distinct(list(file_url) FILTER (WHERE asset_type = 'image' AND file_url IS NOT NULL))) AS images FROM document_assets GROUP BY doc_id),
u AS (SELECT doc_id, images, list_filter(list_transform(files, lambda x, i: {'i': i, 'name': x.name, 'url': x.url}), lambda x: list_position(list_transform(files, lambda y: y.name || ' ' || y.url), x.name || ' ' || x.url) = x.i) AS files FROM f)
SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(title, '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n'), chr(10)) AS title, n_chars::INTEGER AS views, coalesce(strftime(published_at, '%Y-%m-%d'), nullif(regexp_extract(title || chr(10) || coalesce(text, ''), '\\d{4}-\\d{2}-\\d{2}', 0), '')) AS published, department AS author,
 1 + coalesce(len(list_distinct(list_transform(files, lambda x: x.url))), 0) AS links, coalesce(array_to_string(images, ' '), '') AS images,
 coalesce(array_to_string(list_transform(files, lambda x: x.i || ' ' || x.name || ' ' || x.url), chr(10)), '') AS attachments, '[TABLE 1]' || chr(10) || source || ' | ' || source_type AS table_text
FROM documents LEFT JOIN u USING (doc_id)""")
def page_extract(spark, sf_dir):
    """Fields of pages written from documents and their assets, with late and missing end tags, scripts, links that lead
    nowhere and repeated files: what was put in must come out."""
    a = table(spark, sf_dir, "document_assets").where("file_url is not null")
    link = F.concat(F.lit("<li><a href='"), "file_url", F.lit("#top'>첨부  <b>"), _escape(F.col("file_name")), F.lit("</b></a>"))
    item = F.struct("asset_index", "id", F.when(F.col("asset_type") == "image", F.concat(F.lit("<img alt=x src='"), "file_url", F.lit("'>"))).otherwise(link).alias("h"))
    a = a.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["h"]), "\n").alias("assets"))
    d = _docs(spark, sf_dir).join(a, "doc_id", "left")
    part = lambda before, c, after: F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    html = F.concat(F.lit("<html><head><script>var a='<div class=content>';</script><title>"), _escape(F.col("title")), F.lit("</title><body><nav><a href='/menu'>menu</a></nav><div class='content'>"),
                    part("<p>작성자: ", _escape(F.col("department")), "</p>"), part("<p>작성일: ", F.date_format("published_at", "yyyy-MM-dd"), "<p>"), part("조회수 ", F.format_number("n_chars", 0), "</p>"),
                    F.lit("<table><tr><td>"), F.col("source"), F.lit("<td>"), F.col("source_type"), F.lit("</table><ul>"), F.coalesce("assets", F.lit("")), F.lit("</ul><a href='/d/"), F.col("doc_id").cast("string"),
                    F.lit("'>x</a><a href='javascript:void(0)'>y</a><a href='mailto:a@b'>z</a><div>"), _escape(F.coalesce("text", F.lit(""))), F.lit("</div></div>"))
    url = F.concat(F.lit("https://host.example/p/"), F.col("doc_id").cast("string"))
    f = d.select("doc_id", page_fields(html, url).alias("f"))
    files = F.transform("f.attachments", lambda x: F.concat_ws(" ", x["index"].cast("string"), x["name"], x["url"]))
    return f.select("doc_id", "f.title", "f.views", F.col("f.published_at").alias("published"), "f.author", F.size("f.links").cast("long").alias("links"), F.array_join("f.images", " ").alias("images"),
                    F.array_join(files, "\n").alias("attachments"), "f.table_text")


@query("""SELECT doc_id, string_agg('[ATTACHMENT: ' || coalesce(file_name, '') || ']' || chr(10) || regexp_replace(extracted_text, '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g'), chr(10) || chr(10) ORDER BY asset_index, id) AS merged
FROM document_assets WHERE asset_type = 'attachment' AND regexp_replace(coalesce(extracted_text, ''), '^[\\s\\x{00A0}\\x{3000}]+|[\\s\\x{00A0}\\x{3000}]+$', '', 'g') <> '' GROUP BY doc_id""")
def merge_attachment_texts(spark, sf_dir):
    a = table(spark, sf_dir, "document_assets").where("asset_type = 'attachment'")
    items = F.transform(F.array_sort(F.collect_list(F.struct("asset_index", "id", F.col("file_name").alias("name"), F.col("extracted_text").alias("text")))), lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text")))
    return a.groupBy("doc_id").agg(attachments.merge_texts(items, "ATTACHMENT").alias("merged")).where("merged is not null")


@query("""SELECT id, CASE lower(regexp_extract(coalesce(file_name, ''), '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'hwpx' THEN 'hwpx' WHEN 'hwp' THEN 'hwp' WHEN 'xlsx' THEN 'ooxml' WHEN 'pptx' THEN 'ooxml'
 WHEN 'docx' THEN 'ooxml' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'png' THEN 'image' ELSE 'unsupported' END AS parser FROM document_assets""")
def attachment_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "document_assets").select("id", attachments.parser_type(F.coalesce("file_name", F.lit(""))).alias("parser"))


@query()
def clean_scan_lines(spark, sf_dir):
    d = _docs(spark, sf_dir).where("image_text != ''")
    return d.select("doc_id", attachments.clean_lines(F.col("image_text")).alias("clean"), attachments.is_noise(F.col("image_text")).alias("noise"))


@query("""SELECT doc_id, published_at + INTERVAL 9 HOURS AS kst, strftime(published_at + INTERVAL 9 HOURS, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS stamp,
 round(coalesce(0.4 * exp(-greatest(date_diff('day', published_at::DATE, DATE '2026-07-01'), 0) / 365.0), 0), 6) AS recency,
 date_diff('millisecond', published_at, collected_at) AS elapsed_ms FROM documents""")
def date_fields(spark, sf_dir):
    p = F.col("published_at")
    return _docs(spark, sf_dir).select(
        "doc_id", scalars.to_kst(p).alias("kst"), scalars.kst_stamp(p).alias("stamp"), F.round(scalars.recency(F.to_date(p), F.lit("2026-07-01").cast("date")), 6).alias("recency"),
        scalars.elapsed_ms(p, F.col("collected_at")).alias("elapsed_ms"))


@query("""SELECT doc_id, CAST(d AS VARCHAR) AS found FROM (SELECT doc_id, try_cast(replace(replace(regexp_extract(title, '\\d{4}[-./]\\d{1,2}[-./]\\d{1,2}', 0), '.', '-'), '/', '-') AS DATE) AS d,
 regexp_extract(title, '\\d{4}([-./])\\d{1,2}[-./]\\d{1,2}', 1) AS s FROM documents) WHERE d IS NOT NULL""")
def date_parse(spark, sf_dir):
    t = F.regexp_extract("title", "\\d{4}[-./]\\d{1,2}[-./]\\d{1,2}", 0)
    return _docs(spark, sf_dir).select("doc_id", scalars.parse_date(t).cast("string").alias("found")).where("found is not null")


@query("""SELECT doc_id, coalesce(nullif(department, ''), nullif(source, ''), 'none') AS unit, CASE lang WHEN 'ko' THEN 'Korean' WHEN 'en' THEN 'English' ELSE 'other' END AS language,
 CASE WHEN length(title) > 20 THEN substring(title, 1, 20) || '...' ELSE title END AS short_title FROM documents""")
def conditional_fields(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", scalars.first_filled(F.col("department"), F.col("source"), F.lit("none")).alias("unit"), scalars.lookup({"ko": "Korean", "en": "English"}, F.col("lang"), "other").alias("language"),
        text.preview(F.col("title"), 20).alias("short_title"))


@query()
def metadata_merge(spark, sf_dir):
    """Document metadata below row values, the last wins."""
    m = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    row = F.create_map(F.lit("source_type"), F.col("source_type"), F.lit("version"), F.col("version").cast("string"))
    return _docs(spark, sf_dir).select("doc_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(scalars.merge_maps(m, row))))).alias("merged"))


_TITLED = r"regexp_replace(title || ' | Nurisol University', '[\s\x{00A0}\x{3000}]+', ' ', 'g')"


@query(f"""SELECT doc_id, {_strip(f"regexp_replace({_strip(_TITLED)}, '\\s*[|\\-–]\\s*[^|\\-–]*(대학교|University|Portal)[^|\\-–]*$', '')")} AS title,
 md5({_squeeze("regexp_replace(text, '(?i)' || regexp_escape(title), '', 'g')")}) AS body_md5, nullif(trim(string_split(department, '조회')[1], ' :'), '') AS person, {_strip('coalesce(lang, source)')} AS part,
 array_to_string(regexp_extract_all(title, '[가-힣A-Za-z0-9]{{2,}}'), ' ') AS tokens FROM documents""")
def text_forms(spark, sf_dir):
    """Titles without the site's name, texts without their title, names before labels, a bracketed section, longer tokens."""
    d = _docs(spark, sf_dir)
    section = F.concat(F.lit("[ONE]\n"), F.coalesce("lang", "source"), F.lit("\n\n[TWO]\n"), "source")
    return d.select("doc_id", text.clean_title(F.concat("title", F.lit(" | Nurisol University"))).alias("title"), F.md5(text.strip_values(F.col("text"), F.col("title"))).alias("body_md5"),
                    text.clean_person(F.concat("department", F.lit(" : 조회 3"))).alias("person"), text.section(section, "ONE").alias("part"), F.array_join(text.long_tokens(F.col("title")), " ").alias("tokens"))


_KIND = "CASE WHEN contains(lower(source_url), 'notice') THEN 'notice' WHEN contains(lower(source_url), 'scholar') THEN 'scholarship' ELSE 'webpage' END"


@query(f"""SELECT doc_id, {_KIND} AS kind, regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*', 0) || '/files/' || doc_id || '.pdf' AS attachment, source_url IS NOT NULL AS navigates,
 strptime(nullif(trim(coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), ' ')), ''), '%Y-%m-%d %H:%M:%S') AS published FROM documents WHERE source_url IS NOT NULL""")
def address_forms(spark, sf_dir):
    """Kind by ordered parts of the address, links resolved against their page, empty dates as null."""
    u = F.col("source_url")
    stamp = scalars.empty_to_timestamp(F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
    return _docs(spark, sf_dir).where(u.isNotNull()).select(
        "doc_id", urls.source_type(u, [("notice", "notice"), ("scholar", "scholarship")]).alias("kind"), urls.resolve(u, F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("attachment"),
        urls.navigates(u).alias("navigates"), stamp.cast("timestamp_ntz").alias("published"))
