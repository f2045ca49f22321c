"""Queries over whole tables against a brute-force run."""

import re
from pathlib import Path

import pyarrow.dataset as ds
import pytest

from quern.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def rows(name, *columns):
    return ds.dataset(DATA / f"{name}.parquet").to_table(columns=list(columns)).to_pylist()


def test_title_overlap(spark):
    tokens = lambda t: None if t is None else set(re.findall("[가-힣A-Za-z0-9]+", t.lower()))
    asked = [(r["item_id"], tokens(r["question"]), r["source_type"]) for r in rows("eval_items", "item_id", "question", "source_type")]
    want = {(i, r["doc_id"]): (s == r["source_type"], len(q & tokens(r["title"])))
            for r in rows("documents", "doc_id", "title", "source_type") for i, q, s in asked if q and r["title"] and q & tokens(r["title"])}
    got = registry.queries()["title_overlap"](spark, str(DATA)).collect()
    assert len(got) == len(want) and {(r.item_id, r.doc_id): (r.same_source, r.shared) for r in got} == want


def test_log_star(spark):
    last = {}
    for r in rows("query_logs", "id", "request_id", "user_id", "loaded_at"):
        key = (r["loaded_at"] is not None, r["loaded_at"], r["id"])
        if r["request_id"] not in last or key > last[r["request_id"]][0]:
            last[r["request_id"]] = (key, r["user_id"])
    events = {}
    for r in rows("events", "user_id", "value"):
        n, total = events.get(r["user_id"], (0, 0.0))
        events[r["user_id"]] = (n + 1, total + (r["value"] or 0))
    number = lambda u: int(u[2:]) if u and re.fullmatch("u_[0-9]+", u) else None
    want = [(q, u, number(u) if number(u) in events else None, events.get(number(u), (None,))[0]) for q, (_, u) in last.items()]
    asked = {number(u) for _, u in last.values()}
    want += [(None, None, u, n) for u, (n, _) in events.items() if u not in asked]
    got = registry.queries()["log_star"](spark, str(DATA)).collect()
    order = lambda x: tuple(map(str, x))
    assert sorted(((r.request_id, r.user_id, r.event_user, r.n_events) for r in got), key=order) == sorted(want, key=order)
    assert all(abs(r.total - events[r.event_user][1]) < 1e-3 for r in got if r.event_user is not None)
    assert {r.event_user for r in got} - {None} == set(events)


def test_link_bfs(spark):
    orders, edges = {}, {}
    for r in rows("lineitem", "l_orderkey", "l_linenumber", "l_partkey"):
        orders.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_partkey"]))
    for lines in orders.values():
        parts = [p for _, p in sorted(lines)]
        for a, b in zip(parts, parts[1:]):
            edges.setdefault(a, set()).add(b)
    parts = rows("part", "p_partkey", "p_size")
    largest = max(r["p_size"] for r in parts)
    want = {r["p_partkey"]: 0 for r in parts if r["p_size"] == largest}
    for depth in (1, 2):
        for p in {b for a, d in want.items() if d == depth - 1 for b in edges.get(a, ())} - set(want):
            want[p] = depth
    got = {int(r.url.rsplit("/", 1)[1]): r.depth for r in registry.queries()["link_bfs"](spark, str(DATA)).collect()}
    assert got == want
