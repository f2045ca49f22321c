"""Question understanding, logs, events (batch and stream), star-schema regression queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import understand as u
from quern.operators.merge import latest
from quern.plans.tables import table
from quern.session import shared_folder
from quern.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


# Dictionaries of these queries (parameters of the operators).
DOMAIN = ["수강정정", "장학", "생활관", "도서관", "휴학", "졸업", "증명서", "무선망", "교환학생", "학점교류", "상담", "대관"]
QUESTION = ["언제", "어디", "얼마", "몇", "누구", "when", "where", "how", "who"]
TIME = ["오늘", "내일", "이번", "마감", "주차", "today", "deadline"]
SYNONYMS = {"도서관": ["열람실", "상호대차"], "증명서": ["무인발급"], "무선망": ["Wi-Fi"], "대관": ["시설 예약"]}
STOP = ["알려", "주세요", "언제", "어디", "the", "what", "and", "from"]
GROUPS = {"category": {"도서관": ["열람석", "상호대차"], "생활관": ["야간 외출", "중간 퇴사"], "장학": ["성적우수"], "학점교류": ["교환학생"]}, "target": {"신입생": ["예비과정"], "조교": ["담당 조교"], "통학생": ["순환버스"]},
          "time_scope": {"계절학기": ["여름 계절학기", "겨울 계절학기"], "집중학기": ["봄 집중학기"]}}
EXPANSIONS = {"언제": ["시작", "접수"], "어디": ["위치", "건물"], "서류": ["제출"]}
HINTS = {"도서관": ["library"], "생활관": ["dormitory"], "장학": ["scholarship"], "학점교류": ["international", "academic_notice"]}
EXACT = {"greeting": ["안녕", "안녕하세요", "hello", "hi"], "thanks": ["고마워", "감사합니다", "thanks"]}
ROOTS = {"greeting": ["안녕", "반가"], "thanks": ["고마", "감사"], "help": ["도와", "도움", "help"]}
RUDE = ["멍청", "바보", "stupid", "idiot"]


def _likes(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_U = "regexp_replace(lower(trim(regexp_replace(coalesce(question, ''), '[\\s\\x{00A0}\\x{3000}]+', ' ', 'g'))), '[?!.~]+$', '')"
_SQ = "regexp_replace(translate(lower(coalesce(question, '')), '@013457$', 'aoieasts'), '[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]+', '', 'g')"


@query(f"""SELECT id, CASE WHEN {_likes(_SQ, RUDE)} THEN 'PROFANITY' WHEN {_U} = '' THEN 'GENERAL' WHEN {_likes(_U, DOMAIN)} OR ({_likes(_U, QUESTION)} AND ({_likes(_U, TIME)} OR regexp_matches({_U}, '[0-9]+월'))) THEN 'INFO' ELSE 'GENERAL' END AS intent,
 {_likes(_SQ, RUDE)} AS rude FROM query_logs""")
def intent_classify(spark, sf_dir):
    q = F.col("question")
    rude = u.abusive(q, RUDE, [])
    return table(spark, sf_dir, "query_logs").select("id", u.intent(q, abuse=rude, domain=DOMAIN, question=QUESTION, time=TIME, patterns=["[0-9]+월"]).alias("intent"), rude.alias("rude"))


@query(f"""SELECT id, CASE WHEN {_U} IN ('안녕', '안녕하세요', 'hello', 'hi') THEN 'greeting' WHEN {_U} IN ('고마워', '감사합니다', 'thanks') THEN 'thanks' WHEN {_likes(_U, ROOTS['greeting'])} THEN 'greeting'
 WHEN {_likes(_U, ROOTS['thanks'])} THEN 'thanks' WHEN {_likes(_U, ROOTS['help'])} THEN 'help' ELSE 'unknown' END AS kind FROM query_logs""")
def general_intent(spark, sf_dir):
    return table(spark, sf_dir, "query_logs").select("id", u.general_intent(F.col("question"), EXACT, ROOTS).alias("kind"))


@query()
def nearest_intent(spark, sf_dir):
    near = u.nearest_intent([("library", "도서관 열람실 예약"), ("dorm", "생활관 입사 신청"), ("scholarship", "장학금 신청 기간")])
    return table(spark, sf_dir, "query_logs").select("id", near(F.col("question")).alias("intent"))


@query()
def understand_questions(spark, sf_dir):
    q = table(spark, sf_dir, "query_logs").select("id", "question")
    out = u.understand(q, "question", replacements=[("몇시", "몇 시"), ("어딨", "어디 있")], synonyms=SYNONYMS, terms=DOMAIN, stopwords=STOP, groups=GROUPS, expansions=EXPANSIONS, hints=HINTS)
    return out.select("id", "normalized_query", "keywords", F.to_json("entities").alias("entities"), F.to_json("filters").alias("filters"), "category", "rewritten_queries")


PATTERNS, SOFT, CONTEXTS = ["바.?보", "st[u*]pid"], ["멍하", "답답"], ["정말", "you"]


@query(f"""WITH n AS (SELECT id, lower(coalesce(question, '')) AS raw, {_SQ} AS sq, regexp_replace(translate(lower(coalesce(question, '')), '@013457$', 'aoieasts'), '[^0-9a-z가-힣ㄱ-ㅎㅏ-ㅣ]+', ' ', 'g') AS sp FROM query_logs)
SELECT id, ({_likes('sq', RUDE)} OR regexp_matches(raw, '바.?보|st[u*]pid') OR regexp_matches(sp, '바.?보|st[u*]pid') OR regexp_matches(sq, '바.?보|st[u*]pid')
 OR (({_likes('sq', SOFT)}) AND regexp_matches(raw, '정말|you'))) AS rude FROM n""")
def abuse_check(spark, sf_dir):
    """Words, patterns on three forms, and soft words within their contexts."""
    return table(spark, sf_dir, "query_logs").select("id", u.abusive(F.col("question"), RUDE, PATTERNS, SOFT, CONTEXTS).alias("rude"))


LABELS = {"time": [("[0-9]{1,2}월", "month"), ("[0-9]{4}[-.]", "year")]}


@query("""SELECT id, CASE WHEN contains(question, '이번') OR contains(question, 'now') THEN 'now,' ELSE '' END || CASE WHEN regexp_matches(question, '[0-9]{1,2}월') THEN 'month,' ELSE '' END || CASE WHEN regexp_matches(question, '[0-9]{4}[-.]') THEN 'year,' ELSE '' END AS times,
 CASE WHEN contains(question, '도서관') OR contains(question, '열람석') OR contains(question, 'library') THEN 'library' END AS place FROM query_logs WHERE question IS NOT NULL""")
def entity_labels(spark, sf_dir):
    """Entities by name, word and pattern; filters in their known order."""
    none = F.array().cast("array<string>")
    e = u.entities(F.col("question"), none, {"time": {"now": ["이번"]}, "place": {"library": ["도서관", "열람석"]}, "person": {"student": ["학생"]}}, LABELS)
    q = table(spark, sf_dir, "query_logs").where("question is not null").select("id", u.filters(e, {}, ["place", "time"]).alias("f"))
    times = F.coalesce(F.array_join(F.transform(F.element_at("f", "time"), lambda x: F.concat(x, F.lit(","))), ""), F.lit(""))
    return q.select("id", times.alias("times"), F.get(F.element_at("f", "place"), F.lit(0)).alias("place"))


_TERMS = " UNION ALL ".join(f"SELECT id, '{t}' AS term, position('{t}' IN question) + {len(t)} AS e, -{len(t)} AS l FROM query_logs WHERE contains(question, '{t}')" for t in DOMAIN)


@query(f"SELECT id, term, (row_number() OVER (PARTITION BY id ORDER BY e, l, term) - 1)::INTEGER AS pos FROM ({_TERMS})")
def lexicon_hits(spark, sf_dir):
    return table(spark, sf_dir, "query_logs").select("id", F.posexplode(u.lexicon_hits(F.col("question"), DOMAIN)).alias("pos", "term"))


_ONE = "(SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC NULLS LAST, id DESC) AS n FROM query_logs)"


@query(f"SELECT request_id, id, user_id, intent_type FROM {_ONE} WHERE n = 1")
def query_log_latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "query_logs"), ["request_id"], [F.desc_nulls_last("loaded_at"), F.desc("id")]).select("request_id", "id", "user_id", "intent_type")


@query(f"SELECT CAST((created_at + INTERVAL 9 HOURS)::DATE AS VARCHAR) AS day, coalesce(intent_type, 'none') AS intent, count(*) AS n, count(DISTINCT user_id) AS users FROM {_ONE} WHERE n = 1 GROUP BY ALL")
def intent_by_day(spark, sf_dir):
    one = latest(table(spark, sf_dir, "query_logs"), ["request_id"], [F.desc_nulls_last("loaded_at"), F.desc("id")])
    return (one.groupBy(F.to_date(F.col("created_at") + F.expr("INTERVAL 9 HOURS")).cast("string").alias("day"), F.coalesce("intent_type", F.lit("none")).alias("intent"))
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")))


@query(f"""SELECT q.request_id, q.user_id, e.user_id AS event_user, e.n_events, e.total FROM
 (SELECT request_id, user_id, CASE WHEN regexp_full_match(user_id, 'u_[0-9]{{1,18}}') THEN try_cast(substring(user_id, 3) AS BIGINT) END AS number FROM {_ONE} WHERE n = 1) q
 FULL JOIN (SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY user_id) e ON e.user_id = q.number""")
def log_star(spark, sf_dir):
    """Every query of the log beside the events of its user, and the users with events alone: ``u_00042`` of the log is
    user 42 of the events; other names (as of kiosks) and null have none."""
    one = latest(table(spark, sf_dir, "query_logs"), ["request_id"], [F.desc_nulls_last("loaded_at"), F.desc("id")]).select("request_id", "user_id")
    one = one.withColumn("number", F.when(F.col("user_id").rlike("^u_[0-9]{1,18}$"), F.substring("user_id", 3, 18)).try_cast("long"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("event_user")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return one.join(e, F.col("number") == F.col("event_user"), "full").select("request_id", "user_id", "event_user", "n_events", "total")


@query("""SELECT event_id, user_id, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 SECONDS, false) AS overlapping FROM events""")
def user_overlap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(F.col("ts") < F.lag("ts").over(w) + F.expr("INTERVAL 60 SECONDS"), F.lit(False)).alias("overlapping"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE value > 50) AS large, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def response_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"))


_WINDOWS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_WINDOWS)
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def _run(stream, mode="append"):
    """Runs a finite stream to its end into files of the shared folder; returns what it wrote."""
    spark, where = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(f"{where}/out")


@query(f"SELECT * FROM ({_WINDOWS}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)")
def stream_event_windows(spark, sf_dir):
    """Counts from a stream run to its end: a window is written once the watermark, two hours behind the latest event,
    has passed it; later windows stay open."""
    schema = table(spark, sf_dir, "events").schema
    s = jobs.file_stream(spark, f"{sf_dir}/", schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(jobs.window_counts(s, "ts", "event_type", "value"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return (e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
            .select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS n FROM events),
r AS (SELECT event_id, user_id, n, true AS ok, ts + INTERVAL 60 SECONDS AS free FROM o WHERE n = 1
 UNION ALL SELECT o.event_id, o.user_id, o.n, o.ts >= r.free, CASE WHEN o.ts >= r.free THEN o.ts + INTERVAL 60 SECONDS ELSE r.free END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id::VARCHAR AS request_id, user_id::VARCHAR AS user_id, ok AS accepted FROM r""")
def stream_in_flight(spark, sf_dir):
    """Each event as a request of 60 seconds: refused while an accepted one of its user is under way."""
    schema = table(spark, sf_dir, "events").schema
    s = jobs.file_stream(spark, f"{sf_dir}/", schema, "events.parquet")
    req = s.select(F.col("event_id").cast("string").alias("request_id"), F.col("user_id").cast("string").alias("user"), F.col("ts").alias("started"), F.lit(60.0).alias("seconds"))
    return _run(jobs.in_flight(req, "user", "started", "seconds"))


# ---- star schema


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
                                                          F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def orders_by_region(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT p_brand, s_nationkey, sum(l_quantity) AS qty, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def parts_by_supplier(spark, sf_dir):
    li, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    return li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).groupBy("p_brand", "s_nationkey").agg(F.sum("l_quantity").alias("qty"), F.countDistinct("l_orderkey").alias("orders"))

