"""Nearest vectors by cosine: exact by blocks of queries, approximate by cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(column: pa.Array, width: int | None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 1))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_top_k(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 2_000, skip_self: bool = True) -> DataFrame:
    """``query_id, id, similarity, rank``: the ``k`` nearest rows of every query over all rows.

    Queries are shared in blocks; each task keeps the best ``k`` of its rows for each query of the block (one matrix
    product a batch), so what is exchanged is at most k rows a query and task.  Ties: smaller id.  Null or empty
    vectors are near nothing."""
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    rows = corpus.where(F.size(vector) > 0).select(key, vector)
    out, ids, vectors = None, [], []

    def scan(ids, vectors):
        shared = spark.sparkContext.broadcast((list(ids), _unit(np.asarray(vectors, dtype=np.float64))))

        def run(batches):
            qids, q = shared.value
            qid = np.asarray(qids)
            best_s = np.full((len(qids), 0), -np.inf)
            best_i = np.zeros((len(qids), 0), dtype=qid.dtype)
            for b in batches:
                m = _unit(_matrix(b.column(1), q.shape[1]))
                i = b.column(0).to_numpy(zero_copy_only=False)
                s = np.round(q @ m.T, 6)
                if skip_self:
                    s[qid[:, None] == i[None, :]] = -np.inf
                s, i2 = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(i, (len(qids), len(i)))], axis=1)
                order = np.lexsort((i2, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i2, order, 1)
            keep = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, keep.sum(axis=1))), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["query_id", "id", "similarity"])

        return rows.mapInArrow(run, f"query_id {kind}, id {kind}, similarity double")

    for r in queries.where(F.size(vector) > 0).select(key, vector).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == block:
            out = scan(ids, vectors) if out is None else out.unionByName(scan(ids, vectors))
            ids, vectors = [], []
    if ids or out is None:
        last = scan(ids, vectors) if ids else rows.select(F.col(key).alias("query_id"), F.col(key).alias("id"), F.lit(0.0).alias("similarity")).where("false")
        out = last if out is None else out.unionByName(last)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows the cell centres are fitted on (in order of a hash of the key); every row is indexed.
FIT_ROWS = 20_000
#: Rows of a cell, and queries that visit it, that meet in one task; larger cells are dealt out by a hash of the key.
GROUP_ROWS, GROUP_QUERIES = 50_000, 5_000


class CellIndex:
    """Cells around centres fitted on a bounded sample; every row is filed under its nearest centre.

    Without ``cells`` there are as many as the root of the number of rows, up to a twentieth of the sample."""

    def __init__(self, corpus: DataFrame, key: str, vector: str, cells: int | None = None, rounds: int = 12, recall: float = 0.9):
        self.key, self.vector = key, vector
        full = corpus.where(F.size(vector) > 0)
        sample = full.orderBy(F.xxhash64(key)).limit(FIT_ROWS).select(vector).collect()
        m = _unit(np.asarray([r[0] for r in sample], dtype=np.float64)) if sample else np.zeros((1, 1))
        if cells is None:
            cells = max(16, min(int(full.count() ** 0.5), FIT_ROWS // 20))
        rng = np.random.default_rng(1)
        c = m[rng.permutation(len(m))[:cells]]
        for _ in range(rounds):
            near = np.argmax(m @ c.T, axis=1)
            c = _unit(np.stack([m[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
        self.centres = c
        self.probes = self._probes_for(m, recall)
        self.rows = self._filed(corpus, 1)

    def _probes_for(self, m: np.ndarray, recall: float, k: int = 10, asked: int = 200) -> int:
        """Fewest cells to visit for this recall among the sample (with some reserve): for each asked row, the places
        its nearest rows' cells take in its own order of cells."""
        n = min(asked, len(m))
        if len(m) < 2:
            return len(self.centres)
        s = m[:n] @ m.T
        s[np.arange(n), np.arange(n)] = -np.inf
        near = np.argsort(-s, axis=1)[:, :k]
        home = np.argmax(m @ self.centres.T, axis=1)
        place = np.argsort(np.argsort(-(m[:n] @ self.centres.T), axis=1), axis=1)
        taken = np.take_along_axis(place, home[near], axis=1).ravel()
        return int(min(len(self.centres), np.quantile(taken, min(1.0, recall + 0.03)) + 2))

    def _filed(self, df: DataFrame, probes: int) -> DataFrame:
        c, kind = self.centres, df.schema[self.key].dataType.simpleString()

        def run(batches):
            for b in batches:
                near = np.argsort(-(_unit(_matrix(b.column(1), c.shape[1])) @ c.T), axis=1, kind="stable")[:, :probes]
                for j in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near[:, j].astype("int32"))], names=["id", "v", "cell"])

        return df.where(F.size(self.vector) > 0).select(F.col(self.key).alias("id"), F.col(self.vector).cast("array<float>").alias("v")).mapInArrow(run, f"id {kind}, v array<float>, cell int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """Nearest rows within the ``probes`` cells nearest to each query (default: as many as the sample needs for the
        recall asked for).  Rows and queries of a cell meet in groups of bounded size and are compared by matrix
        product; a group returns the best ``k`` of each query, so no pair is written out."""
        kind = queries.schema[self.key].dataType.simpleString()
        q = self._filed(queries, probes or self.probes).withColumnRenamed("id", "query_id")
        sizes = self.rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("row_parts"))
        sizes = sizes.join(q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("query_parts")), "cell")  # cells that somebody visits
        sizes = F.broadcast(sizes)  # one row a cell
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
        rows = self.rows.join(sizes, "cell").select("cell", part("id", "row_parts").alias("r"), every("query_parts").alias("s"), "id", "v")
        asked = q.join(sizes, "cell").select("cell", part("query_id", "query_parts").alias("s"), every("row_parts").alias("r"), "query_id", "v")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"query_id": [], "id": [], "similarity": []}
            if left.num_rows and right.num_rows:
                ids, qid = left["id"].to_numpy(), right["query_id"].to_numpy()
                m, asks = (_unit(_matrix(t["v"].combine_chunks(), None)) for t in (left, right))
                step = max(1, 4_000_000 // len(ids))
                for at in range(0, len(qid), step):
                    s = np.round(asks[at:at + step] @ m.T, 6)
                    s[qid[at:at + step, None] == ids[None, :]] = -np.inf
                    if s.shape[1] > 4 * k:  # only what reaches the k-th is put in order
                        s[s < np.partition(s, -k, axis=1)[:, [-k]]] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    best = np.take_along_axis(s, order, 1)
                    keep = np.isfinite(best)
                    out["query_id"].append(np.repeat(qid[at:at + step], keep.sum(axis=1)))
                    out["id"].append(ids[order[keep]])
                    out["similarity"].append(best[keep])
            kinds = {"query_id": right["query_id"].type, "id": left["id"].type, "similarity": pa.float64()}
            return pa.table({n: pa.array(np.concatenate(v) if v else [], type=kinds[n]) for n, v in out.items()})

        s = rows.groupBy("cell", "r", "s").cogroup(asked.groupBy("cell", "r", "s")).applyInArrow(meet, f"query_id {kind}, id {kind}, similarity double")
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
