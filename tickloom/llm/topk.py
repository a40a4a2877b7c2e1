"""Exact top-k search by no-random-access aggregation over sorted lists.

Queries and candidates are dealt out to blocks; every pair of blocks is one
task's work. In a block each component is a sorted list. A query reads the
list of a component from its high end where its own component is positive and
from its low end where it is negative, a stretch at a time and all lists at
the same depth. What has been read gives every candidate a lower bound (unread
components at the list's worst value) and an upper bound (unread components at
the value the list has come to). Reading stops once all but a few candidates
cannot reach the k-th lower bound; those few get their final integer scores.
The best of each block meet in a window per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch

K, SCALE = 5, 256
#: Vectors of a block of candidates and of queries.
CANDIDATES, QUERIES = 8192, 2048
#: Depths at which bounds are compared, as parts of a list; at the last one bounds are scores.
DEPTHS = (0.125, 0.25, 0.5, 0.75, 0.9, 1.0)
#: Candidates that may be left when reading stops.
FEW = 64

PAIR_SCHEMA = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, no component null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _bounds(order: np.ndarray, depth: int, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper values of all components, for reading from the high ends (first half) and the low ends (second)."""
    n = len(items)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    from_high, from_low = rank >= n - depth, rank < depth
    lists = np.take_along_axis(items, order, axis=0)
    high, low = lists[n - depth], lists[depth - 1]
    worst = np.concatenate((np.where(from_high, items, lists[0]), np.where(from_low, items, lists[-1])), axis=1)
    best = np.concatenate((np.where(from_high, items, high), np.where(from_low, items, low)), axis=1)
    return worst, best


def nearest(
    queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int, read: dict[int, float] | None = None,
) -> list[tuple[int, int, int]]:
    """(query id, item id, score): for each query its k best items of a block, and ties with the last; never the query's own id.

    ``read`` is told which part of every list each query has read.
    """
    n = len(items)
    values = items.astype(np.float64)
    order = np.argsort(items, axis=0, kind="stable")
    signed = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1).astype(np.float64)
    # float sums of whole numbers below 2^53 are exact; beyond, bounds give way by their rounding
    slack = np.abs(signed).sum(axis=1) * (np.abs(values).max(initial=0.0)) * 2.0**-50
    slack[slack < 0.5] = 0.0
    out: list[tuple[int, int, int]] = []
    todo = np.arange(len(queries))
    for part in DEPTHS:
        depth = max(1, int(np.ceil(part * n)))
        worst, best = _bounds(order, depth, values)
        later = []
        for at in range(0, len(todo), 256):
            some = todo[at: at + 256]
            own = query_ids[some][:, None] == item_ids[None, :]
            lower = np.where(own, -np.inf, signed[some] @ worst.T)
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
            upper = lower if depth == n else signed[some] @ best.T
            alive = (upper >= (kth - 2 * slack[some])[:, None]) & ~own
            ready = (alive.sum(axis=1) <= FEW + k) | (depth == n)
            later.append(some[~ready])
            if read is not None:
                read |= dict.fromkeys(query_ids[some[ready]].tolist(), depth / n)
            q, item = np.nonzero(alive & ready[:, None])
            scores = np.einsum("ij,ij->i", queries[some[q]], items[item])
            out += zip(query_ids[some[q]].tolist(), item_ids[item].tolist(), scores.tolist(), strict=True)
        todo = np.concatenate(later) if later else todo[:0]
        if not len(todo):
            break
    return out


def _best(pairs: list[tuple[int, int, int]], k: int) -> pd.DataFrame:
    found = pd.DataFrame(pairs, columns=["query_id", "vec_id", "score"]).astype("int64")
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found[found.groupby("query_id").cumcount() < k]


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return _best([], k)
        # of equal vectors only the k + 1 smallest ids can be among the best k of another row
        items = items.sort_values("vec_id")
        items = items[items.groupby(items["q"].map(lambda q: q.tobytes())).cumcount() <= k]
        matrices = [np.stack(df["q"].to_list()).astype(np.int64) for df in (queries, items)]
        return _best(nearest(matrices[0], queries["vec_id"].to_numpy(), matrices[1], items["vec_id"].to_numpy(), k), k)

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k highest integer inner products of each query among ``vectors`` (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows with another vec_id. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller vec_id; all candidates where there are fewer.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id. Rows repeated exactly count once. Vectors of
    different lengths have no score. Scores must fit a long.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    whole = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), whole_numbers(F.col("embedding")).alias("q")
    ).where(F.size("q") > 0).withColumn("dims", F.size("q")).distinct()
    whole = scratch.keep(whole, "whole")
    asked = whole.where(F.col("vec_id") % every == 0)
    sizes = whole.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    item_blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(sizes, (candidates, queries), strict=True))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "q"), F.lit(count)).cast("int")

    def every_block(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = asked.select("vec_id", "q", "dims", block(query_blocks).alias("qb"), every_block(item_blocks).alias("ib"))
    right = whole.select("vec_id", "q", "dims", every_block(query_blocks).alias("qb"), block(item_blocks).alias("ib"))
    by = ["dims", "qb", "ib"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_search(k), PAIR_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
