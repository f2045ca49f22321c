"""Ranked retrieval: inverted index with BM25, full-text with substring bonus, filters and their relaxation."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import SearchTokens, search_tokens
from quern.session import exists, shared_folder, spread

K1, B, TOP_K, MIN_TEXT_SCORE = 1.5, 0.75, 10, 0.5
#: Query terms are broadcast up to this many rows, else joined by exchange.
BROADCAST_TERMS = 200_000


class Index:
    """Inverted index of a table: postings (id, length, token, tf), token frequencies (token, df) and corpus statistics.

    The texts move once, by document, into the buckets the postings are kept in; counting a document's tokens and
    summing its score over a query's tokens then need no further exchange, and only the best rows of a task leave it.
    With ``version`` (as of ``session.table_version``) the index is stored once in the shared folder and found again by
    later queries and sessions; another version is another index.  Null and empty texts are no documents.
    ``analyse`` (text to list of words, with a name in ``analyser``) adds the words of a morphological analyser to the
    tokens; each token then counts once a document, in the index and in its length."""

    def __init__(self, docs: DataFrame, key: str, text: Column, version: str | None = None, buckets: int | None = None, analyse=None, analyser: str = ""):
        self.analyse = analyse
        self.spark = docs.sparkSession
        self.buckets = buckets or max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.kind = docs.schema[key].dataType.simpleString()
        name = hashlib.sha1(repr((version or uuid.uuid4().hex, key, str(text), self.kind, self.buckets, analyser)).encode()).hexdigest()
        self.folder = f"{shared_folder(self.spark)}/index-{name}"
        if not (version and exists(self.spark, f"{self.folder}/done/_SUCCESS")):
            self._build(docs.select(F.col(key).alias("id"), text.alias("t")))
        done = self.spark.read.schema("build string, n_docs long, avg_length double").parquet(f"{self.folder}/done").first()
        self.n_docs, self.avg_length, build = done["n_docs"], done["avg_length"], done["build"]
        self._register(build)
        self.postings = self.spark.table(f"postings_{build}")
        self.frequencies = self.spark.read.schema("token string, df long").parquet(f"{self.folder}/frequencies-{build}")
        self.stats = self.spark.createDataFrame([(self.n_docs, self.avg_length)], "n_docs long, avg_length double")

    def _register(self, build: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS postings_{build} (id {self.kind}, length INT, token STRING, tf BIGINT) USING parquet "
                       f"CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/postings-{build}'")

    def _build(self, texts: DataFrame) -> None:
        build = uuid.uuid4().hex  # two builds at a time do not meet; the last one to end is the one that is read
        postings = texts.where("t is not null").repartition(self.buckets, "id").mapInArrow(lambda b, a=self.analyse: _postings(b, a), f"id {self.kind}, length int, token string, tf long")
        self._register(build)
        postings.write.insertInto(f"postings_{build}")
        postings = self.spark.table(f"postings_{build}")
        postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{self.folder}/frequencies-{build}")
        lengths = postings.groupBy("id").agg(F.max("length").alias("length"))
        lengths.agg(F.lit(build).alias("build"), F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length")).write.mode("overwrite").parquet(f"{self.folder}/done")


def _postings(batches, analyse=None):
    """Tokens of each document counted where the document is."""
    import pyarrow as pa

    tokens = SearchTokens()
    for b in batches:
        for at in range(0, b.num_rows, 500):  # a long text's postings leave before many others join them
            part = b.slice(at, 500)
            take, lengths, words, counts = [], [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                found = tokens(t)
                if analyse:
                    found = list(dict.fromkeys([*found, *(w for w in analyse(t.lower()) if len(w) > 1)]))
                each = Counter(found)
                take += [i] * len(each)
                lengths += [len(found)] * len(each)
                words += each.keys()
                counts += each.values()
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take, type=pa.int32())), pa.array(lengths, type=pa.int32()), pa.array(words, type=pa.string()),
                                              pa.array(counts, type=pa.int64())], names=["id", "length", "token", "tf"])


def query_terms(queries: DataFrame, key: str, *texts: Column) -> DataFrame:
    """Distinct search tokens of each query over its texts: ``query_id, token``."""
    tokens = F.array_distinct(F.flatten(F.array(*[F.coalesce(search_tokens(t), F.array().cast("array<string>")) for t in texts])))
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens).alias("token"))


def bm25(index: Index, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, matched``: BM25 over the whole corpus's statistics; ``allowed`` (id [, query_id])
    restricts the rows, not the statistics."""
    # Weighted terms are the query terms the corpus knows: their number is checked on the small side, before any join.
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    idf = F.log(1 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = index.frequencies.join(F.broadcast(terms) if few else terms, "token").select("query_id", "token", idf.alias("idf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(index.avg_length, 1.0)))
    hits = index.postings
    if allowed is not None and "query_id" not in allowed.columns:
        hits = hits.join(allowed, "id", "left_semi")
    out = hits.join(F.broadcast(weighted) if few else weighted, "token").groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    if allowed is not None and "query_id" in allowed.columns:
        out = out.join(allowed, ["query_id", "id"], "left_semi")
    return out.where("score > 0")


def best(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Rows of each query that can be among its first ``k``: those scored as high as the k-th, all of a tie.  Tasks
    cut to them before anything is exchanged, and before titles and texts are joined."""
    return scored.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc("score")))).where(F.col("_r") <= k).drop("_r")


def top_k(scored: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """First ``k`` rows of each query with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def weak_term(c: Column, stopwords: list[str]) -> Column:
    return c.isin(*stopwords) | (c.rlike("^[A-Za-z]+$") & (F.length(c) < 3))


#: Cells of the score matrix (texts by queries) a task holds at a time.
SCORE_CELLS = 2_000_000


def full_text(docs: DataFrame, key: str, text: Column, terms: DataFrame, step: float = 0.1, bonus: float = 0.2, k: int | None = None, block: int = 50_000) -> DataFrame:
    """``query_id, id, score``: 0.1 for every matched position (an OR query by cover density) and 0.2 for every term
    that stands in the text as a substring.

    One pass over the texts finds both, the substrings by an automaton over all terms; no text is paired with a query
    it does not match.  With ``k`` a task returns of each query only its rows scored as high as the k-th.  The terms
    are shared in blocks of whole queries of about ``block`` rows (more terms, more passes)."""
    spark = docs.sparkSession
    kind, query_kind = docs.schema[key].dataType.simpleString(), terms.schema["query_id"].dataType.simpleString()
    base = spread(docs.select(F.col(key).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("t")))
    schema = f"query_id {query_kind}, id {kind}, score double"

    def scan(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)
        return base.mapInArrow(lambda batches: _score_texts(batches, shared.value, step, bonus, k), schema)

    out, rows = None, []
    for r in terms.where("token != ''").select("query_id", "token").orderBy("query_id", "token").toLocalIterator():
        if len(rows) >= block and rows[-1][0] != r["query_id"]:
            out = scan(rows) if out is None else out.unionByName(scan(rows))
            rows = []
        rows.append((r["query_id"], r["token"]))
    if rows:
        out = scan(rows) if out is None else out.unionByName(scan(rows))
    return out if out is not None else spark.createDataFrame([], schema)


def _score_texts(batches, rows: list[tuple], step: float, bonus: float, k: int | None):
    """Scores of a task's texts for a block of (query, token) rows; of each query the k best with their ties."""
    import ahocorasick
    import numpy as np
    import pyarrow as pa

    names = list(dict.fromkeys(q for q, _ in rows))
    number = {q: i for i, q in enumerate(names)}
    asked: dict[str, list[int]] = {}
    for q, t in rows:
        asked.setdefault(t, []).append(number[q])
    queries = {t: np.array(v) for t, v in asked.items()}
    automaton = ahocorasick.Automaton()
    for t in queries:
        automaton.add_word(t, t)
    automaton.make_automaton()
    word = re.compile("[가-힣a-z0-9]+")
    chunk = max(k or 1, SCORE_CELLS // max(len(names), 1), 1)
    best_scores, best_ids, schema = np.zeros((0, len(names))), [], None

    def rows_of(scores, ids):
        at, q = np.nonzero(scores)
        return pa.RecordBatch.from_arrays([pa.array([names[j] for j in q.tolist()], type=schema[0]), pa.array([ids[i] for i in at.tolist()], type=schema[1]),
                                           pa.array(np.round(scores[at, q], 6))], names=["query_id", "id", "score"])

    def cut(scores, ids):
        """Zero what is below the k-th score of its query; rows without any score leave."""
        if len(ids) > k:
            scores[scores < np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]] = 0.0
        keep = scores.any(axis=1)
        return scores[keep], [i for i, x in zip(ids, keep.tolist()) if x]

    for b in batches:
        schema = (pa.array([rows[0][0]]).type, b.schema.field(0).type)
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for at in range(0, len(ids), chunk):
            part = texts[at:at + chunk]
            scores = np.zeros((len(part), len(names)))
            for line, t in zip(scores, part):
                inside = {w for _, w in automaton.iter(t)}
                if not inside:
                    continue
                counts = Counter(w for w in word.findall(t) if w in inside)
                for w in inside:
                    line[queries[w]] += bonus + step * counts.get(w, 0)
            scores = np.round(scores, 6)
            if k is None:
                yield rows_of(scores, ids[at:at + chunk])
            else:
                best_scores, best_ids = cut(np.concatenate([best_scores, scores]), best_ids + ids[at:at + chunk])
    if best_ids:
        yield rows_of(best_scores, best_ids)


def value_filter(actual: Column, expected: Column, exact: bool) -> Column:
    """Does a row's value meet a list of expected ones?  An empty or null list does not filter; a null value meets
    none.  Not exact: blanks and letter case aside, an expected value may also be a part of it."""
    none = expected.isNull() | (F.size(expected) == 0)
    if exact:
        return none | F.coalesce(F.array_contains(expected, actual), F.lit(False))
    a = F.lower(F.btrim(actual))
    return none | F.coalesce(F.exists(F.filter(expected, lambda e: F.btrim(e) != ""), lambda e: F.contains(a, F.lower(F.btrim(e)))), F.lit(False))


def relax(strict: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Strict results; queries without any fall back to the unfiltered ones, flagged ``filters_relaxed``."""
    answered = strict.select("query_id").distinct()
    return (strict.withColumn("filters_relaxed", F.lit(False))
            .unionByName(unfiltered.join(answered, "query_id", "left_anti").withColumn("filters_relaxed", F.lit(True))))


def fallback_triggers(query: Column, keywords: Column, filters: Column) -> Column:
    words, limits = F.coalesce(F.size(keywords), F.lit(0)) > 0, F.coalesce(F.size(filters), F.lit(0)) > 0
    return F.filter(F.array(F.when(F.btrim(F.coalesce(query, F.lit(""))) == "", F.lit("empty_query")),
                            F.when(~words & ~limits, F.lit("insufficient_search_terms")),
                            F.when(limits & ~words, F.lit("filter_only_query"))), lambda x: x.isNotNull())
