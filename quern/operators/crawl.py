"""Link graph: breadth-first reach with bounds, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import canonical, host_of
from quern.session import written


def reach(edges: DataFrame, seeds: DataFrame, depth: int, hosts: list[str] | None = None, pages: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """``url, depth``: least number of steps from a seed along ``edges`` (src, dst), up to ``depth``.

    ``pages`` is the budget of a crawl: at most so many pages are entered, in order of depth and then of address.
    ``failed`` (url) names pages that cannot be read: each is visited once, counts as seen, leads nowhere and is not
    in the result.  Addresses are canonical; other hosts than ``hosts`` are not entered.  Each round joins the frontier with the
    edges, drops what was seen and is written, so the plan does not grow with the rounds."""
    e = edges.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst")).where("src is not null and dst is not null").distinct()
    if hosts is not None:
        e = e.where(host_of(F.col("dst")).isin(*hosts))
    bad = failed.select(canonical(F.col("url")).alias("url")).distinct() if failed is not None else None
    first = seeds.select(canonical(F.col("url")).alias("url")).where("url is not null").distinct().withColumn("depth", F.lit(0))
    seen = frontier = written(_entered(first, bad, pages), "frontier")
    left = None if pages is None else pages - seen.count()
    for step in range(1, depth + 1):
        new = (e.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
               .join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step)))
        if left is not None and left <= 0:
            break
        frontier = written(_entered(new, bad, left), "frontier")
        n = frontier.count()
        if not n:
            break
        left = None if left is None else left - n
        seen = seen.unionByName(frontier)
    return seen


def _entered(new: DataFrame, bad: DataFrame | None, budget: int | None) -> DataFrame:
    out = new if bad is None else new.join(bad, "url", "left_anti")
    return out if budget is None else out.orderBy("url").limit(max(budget, 0))
