"""Exact top-k inner-product search by branch and bound over columns.

Candidates and queries meet in a grid of cells: groups of candidates times groups of
queries, each of bounded size.  In a cell candidates lie column by column.  A query's scores grow by
blocks of dimensions; after each block, what the remaining dimensions can still add is
bounded by the product of the remaining lengths of query and candidate.  Candidates whose
bound is below the k-th best lower bound are dropped and the columns compacted.  Scores
are integers and exact; the bounds only decide what is dropped.  Each cell hands on its
best k per query, of which the best k overall are ranked.

Edge cases: vectors that are null or empty or hold null or non-finite components take no
part, nor do rows without id, nor vectors whose components are not finite once scaled.  Pairs whose scores
may leave what 64-bit floats hold exactly are computed in integers of any size; a score beyond a long counts as
the nearest long.  Vectors of different length never meet.  Ties go to the smaller id.
Repeated rows are candidates each; rows with the query's id are its own and never its
candidates, and of several query rows with one id the smallest vector asks.  Empty tables
give an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 8
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the ``k`` best candidates (by score, then smaller id).

    ``columns``: dimensions x candidates, integers in 64-bit floats in which all sums are exact.
    """
    n = len(ids)
    alive = np.arange(n)
    partial = np.zeros(n, columns.dtype)
    left = columns
    # Dimensions in which the query weighs most come first, so bounds close early.
    order = np.argsort(-np.abs(query), kind="stable")
    rest_query = np.sqrt(np.maximum(0.0, np.cumsum((query[order].astype(float) ** 2)[::-1])[::-1]))
    rest = np.einsum("ij,ij->j", columns.astype(float, copy=False), columns.astype(float, copy=False))
    for at in range(0, len(order), DIMENSIONS):
        dims = order[at:at + DIMENSIONS]
        block = left[dims] if len(alive) == n else left[np.ix_(dims, alive)]
        partial = partial + query[dims] @ block
        end = at + len(dims)
        if end == len(order):
            break
        rest = np.maximum(0.0, rest - np.einsum("ij,ij->j", block.astype(float, copy=False), block.astype(float, copy=False)))
        if len(alive) > 4 * k:
            slack = rest_query[end] * np.sqrt(rest) * (1 + 1e-9) + 1
            low = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
            keep = partial + slack >= low
            if keep.mean() < 0.7:
                alive, partial, rest = alive[keep], partial[keep], rest[keep]
    best = np.lexsort((ids[alive], -partial))[:k]
    return alive[best], partial[best]


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _large(vectors: np.ndarray, size: int) -> np.ndarray:
    """Which vectors may have products with others that 64-bit floats don't hold exactly."""
    return size * np.abs(vectors).max(axis=1) ** 2 >= 1 << 53


def _search_large(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """As :func:`search`, in integers of any size, for the few pairs that need them."""
    whole = [int(x) for x in query.tolist()]
    sums = (sum(a * int(b) for a, b in zip(whole, v, strict=True)) for v in vectors.tolist())
    scores = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in sums]
    best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return np.array(best, np.int64), [scores[i] for i in best]


def _cell(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    found: list[tuple[int, int, int]] = []
    sizes = candidates["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(candidates) else np.zeros(0, int)
    asked = queries["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(queries) else np.zeros(0, int)
    for size in np.intersect1d(sizes, asked):
        mine, theirs = candidates.filter(pa.array(sizes == size)), queries.filter(pa.array(asked == size))
        c, q = _matrix(mine["v"], size), _matrix(theirs["v"], size)
        ids, large = mine["vec_id"].to_numpy(), _large(c, size)
        columns = np.ascontiguousarray(c[~large].T)
        for query_id, vector, wide in zip(theirs["vec_id"].to_numpy(), q, _large(q, size), strict=True):
            # Rows of the query's own id are among the candidates; ask for as many more.
            own = int((ids == query_id).sum())
            exact = np.ones(len(ids), bool) if wide else large
            pairs: list[tuple[int, int]] = []
            if not wide and len(ids[~large]):
                at, scores = search(vector, columns, ids[~large], k + own)
                pairs += zip(ids[~large][at].tolist(), scores.astype(np.int64).tolist(), strict=True)
            if exact.any():
                at, scores = _search_large(vector, c[exact], ids[exact], k + own)
                pairs += zip(ids[exact][at].tolist(), scores, strict=True)
            pairs = sorted((p for p in pairs if p[0] != query_id), key=lambda p: (-p[1], p[0]))[:k]
            found += [(int(query_id), vec_id, score) for vec_id, score in pairs]
    if not found:
        return _OUT.empty_table()
    return pa.table(list(zip(*found, strict=True)), schema=_OUT)


def _floor(x: Column) -> Column:
    """The floor as a double; from 2^53 on doubles are whole numbers, and a long would not hold them all."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024,
          group_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``every``, its best ``k``.

    Needs ``vec_id`` and ``embedding``.  Candidates are copied once per group of queries and
    queries once per group of candidates, whatever the tables' sizes; nothing is broadcast.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter(
        "vec_id is not null and size(e) > 0"
    ).select("vec_id", F.transform("e", lambda x: _floor(x * F.lit(float(scale)))).alias("v")).filter(
        F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    queries = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = usable.agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))).alias("q")).first()
    groups, parts = max(1, -(-counts["n"] // group_rows)), max(1, -(-counts["q"] // query_rows))
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    left = usable.withColumn("candidates", F.pmod(place, F.lit(groups))).withColumn(
        "queries", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("queries", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn(
        "candidates", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = left.groupBy("candidates", "queries").cogroup(right.groupBy("candidates", "queries")).applyInArrow(
        lambda a, b: _cell(a, b, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
