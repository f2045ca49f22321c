"""Filling containers of fixed token capacity.

Items are hashed into partitions of bounded size; each partition packs its own
by best-fit decreasing and certifies the count of its containers with the
largest of a family of dual-feasible-function bounds.  A partition that meets
its bound is settled (no packing of its items is better), and so is every full
container.  The rest - the items of partitions with a gap - exchange places
under another hash and are packed again, for a bounded number of rounds.  After
each round the containers used if it were the last are counted; the best round's
packing stands.  A bound over the sizes of all items certifies the whole.

A text longer than the capacity is cut into full containers and a remainder,
which is packed like any item; no other text is cut.  Null and empty texts
have no tokens and need no room.
"""

from __future__ import annotations

import base64
from functools import cache
from math import ceil
from pathlib import Path

import numpy as np
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import map_rows, map_task
from quern.session import written

CAPACITY = 2_048
#: Items of a partition (about); with their sizes they fit a task many times over.
PARTITION_ITEMS = 50_000
ROUNDS = 3
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Word pattern that belongs to the byte-pair vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(path: str):
    import tiktoken

    if not Path(path).exists():  # on a machine without it, the copy that came with the job
        path = SparkFiles.get(Path(path).name)
    with Path(path).open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``rec_id, n_tokens`` of every text with at least one token (marks of special tokens are ordinary text).  The
    vocabulary file at ``tokenizer`` goes with the job to machines that lack it."""
    if Path(tokenizer).exists():
        df.sparkSession.sparkContext.addFile(tokenizer)
    kind = df.schema[key].dataType.simpleString()

    def work():
        encode = _encoding(tokenizer).encode_ordinary

        def f(b):
            for k, t in zip(b["_key"], b["_text"]):
                yield k, len(encode(t))
        return f

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text != ''")
    return map_rows(rows, f"rec_id {kind}, n_tokens long", work)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item (sizes in falling order) and the room left in each container.

    Containers are filed by the room left; a bit mask of the rooms in use gives the tightest one that fits."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, place, room = 0, [], []
    for s in sizes:
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            c = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            c, r = len(room), capacity
            room.append(capacity)
        left = r - s
        place.append(c)
        room[c] = left
        if left:
            by_room[left].append(c)
            mask |= 1 << left
    return place, room


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: the largest bound of two families of dual feasible functions."""
    return bound_of_counts(np.bincount(np.asarray(sizes, dtype=np.int64), minlength=capacity + 1), capacity) if sizes else 0


def bound_of_counts(h: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of so many items of each size."""
    h = h.astype(np.int64)
    if not h.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    count, weight = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * x)])
    # Items above capacity - k count as full, items below k as nothing, the others as they are.
    k = np.arange(0, capacity // 2 + 1)
    full = count[-1] - count[capacity - k + 1]
    middle = weight[capacity - k + 1] - weight[k]
    best = int(np.max(full + -(-middle // capacity)))
    # Rounding of (k + 1) x / capacity to k-ths.
    used = np.nonzero(h)[0]
    for k in range(1, 101):
        whole = (k + 1) * used % capacity == 0
        # Sum in units of 1 / (capacity * k), exact integers.
        value = np.where(whole, used * k, ((k + 1) * used // capacity) * capacity)
        best = max(best, int(-(-int((value * h[used]).sum()) // (capacity * k))))
    return best


def _round(items: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    kind = items.schema["rec_id"].dataType.simpleString()

    def work(batches):
        rows = []
        for b in batches:
            rows += zip(b["n"], b["rec_id"], b["piece_no"])
        if not rows:
            return
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1], r[2]))
        sizes = [r[0] for r in rows]
        place, room = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        settled = len(room) == bound
        part, opened = TaskContext.get().partitionId(), set()
        for (n, rec, piece), c in zip(rows, place):
            yield rec, piece, n, f"{number}-{part}-{c}", settled or room[c] == 0, c not in opened
            opened.add(c)

    spread = items.repartition(parts, F.xxhash64("rec_id", "piece_no", F.lit(number)))
    return map_task(spread, f"rec_id {kind}, piece_no int, n int, container string, settled boolean, opens boolean", work)


def packed(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
           partition_items: int = PARTITION_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``container, rec_id, piece_no, first_token, n_tokens``: every token of every text in exactly one container."""
    return _packed(token_sizes(df, key, text, tokenizer), capacity, partition_items, rounds)


def _packed(sizes: DataFrame, capacity: int, partition_items: int = PARTITION_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    sizes = written(sizes, "sizes")
    full = (sizes.where(F.col("n_tokens") >= capacity)
            .select("rec_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n_tokens div {capacity} as int) - 1"))).alias("piece_no")))
    out = full.select(F.concat_ws("-", F.lit("full"), "rec_id", "piece_no").alias("container"), "rec_id", "piece_no",
                      F.lit(capacity).cast("int").alias("n"))
    items = sizes.select("rec_id", F.expr(f"cast(n_tokens div {capacity} as int)").alias("piece_no"),
                         F.expr(f"cast(n_tokens % {capacity} as int)").alias("n")).where("n > 0")
    count = items.count()
    rounds_done, totals, before = [], [], 0
    for number in range(rounds):
        parts = max(1, ceil(count / partition_items))
        done = written(_round(items, number, parts, capacity), "packed")
        now = done.agg(F.count_if(F.col("opens") & F.col("settled")).alias("settled"), F.count_if(F.col("opens") & ~F.col("settled")).alias("open"), F.count_if(~F.col("settled")).alias("left")).first()
        rounds_done.append(done)
        totals.append(before + now["settled"] + now["open"])
        before, count = before + now["settled"], now["left"]
        if not count or parts == 1:  # one partition alone has nobody to exchange with
            break
        items = done.where(~F.col("settled")).select("rec_id", "piece_no", "n")
    stands = totals.index(min(totals))
    for number, done in enumerate(rounds_done[:stands + 1]):
        out = out.unionByName((done if number == stands else done.where("settled")).select("container", "rec_id", "piece_no", "n"))
    return out.select("container", "rec_id", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("first_token"), F.col("n").alias("n_tokens"))


def report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the number any packing of these items needs at least (``bound``), their difference
    (``gap``), tokens and the share of room used.  The sizes reach the driver as counts, one a size."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in containers.groupBy("n_tokens").count().collect():
        counts[r["n_tokens"]] += r["count"]
    full = int(counts[capacity])
    counts[capacity] = 0
    bound = F.lit(full + bound_of_counts(counts, capacity))
    per = containers.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), bound.alias("bound"), (F.count(F.lit(1)) - bound).alias("gap"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
                   F.round(F.sum("t") / (F.count(F.lit(1)) * capacity), 6).alias("fill"))
