"""Nearest neighbours by inner product: a block matrix join with int8 tiles and exact top lists.

Vectors are rounded to int8 with a scale of their own. A tile multiplies a block of queries with a block of
candidates in integers; the norms of what rounding lost bound the error of each product, so candidates that cannot
reach the list of a query are dropped for certain. The rest are computed again from the original numbers and merged
into the query's list, which grows stricter from tile to tile. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blendwise.session import durable

TILE_NUMBERS = 1 << 19
STRIP = 256


def usable(vector: Column) -> Column:
    """Neither NULL nor empty nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scale, norm of the rounded vector, norm of the error, per row."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near * near).sum(1)), np.sqrt(((x - near) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class TopLists:
    """The k best of each query, as a heap whose root is the one to beat."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]

    def bar(self) -> np.ndarray:
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def offer(self, query: int, score: float, vec: int) -> None:
        heap, entry = self.heaps[query], (score, -vec)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def rows(self) -> list[tuple[int, int, float]]:
        return [(int(q), -v, s) for q, heap in zip(self.ids, self.heaps) for s, v in heap]


def _tile(tops: TopLists, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Merge a block of candidates into the lists of a block of queries."""
    cq, cs, cn, ce = quantised(vectors)
    exact = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
    wide = cq.T.astype(exact)
    bars = tops.bar()
    for at in range(0, len(queries), STRIP):
        part = queries[at : at + STRIP]
        qq, qs, qn, qe = quantised(part)
        near = (qq.astype(exact) @ wide).astype(np.float64) * (qs[:, None] * cs)
        # |<x,y> - <x',y'>| <= |x - x'| |y| + |x'| |y - y'|, with room for rounding in double precision.
        error = qe[:, None] * (cn + ce) + qn[:, None] * ce
        error += 1e-12 * (qn + qe)[:, None] * (cn + ce)
        other = tops.ids[at : at + STRIP, None] != ids
        low = np.where(other, near - error, -np.inf)
        bar = bars[at : at + STRIP]
        if low.shape[1] >= tops.k:
            bar = np.maximum(bar, np.partition(low, -tops.k, axis=1)[:, -tops.k])
        row, col = np.nonzero(other & (near + error >= bar[:, None]))
        for begin in range(0, len(row), 65536):
            r, c = row[begin : begin + 65536], col[begin : begin + 65536]
            scores = products(part[r], vectors[c])
            for query, score, vec in zip(r, scores, ids[c]):
                tops.offer(at + int(query), float(score), int(vec))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all other rows.

    Ties go to the smaller id. Vectors that are NULL, empty, zero or not finite, and rows without id, take no part.
    Rows repeated under one id count once, with the smallest vector. Only vectors of the same length are compared.
    Queries with fewer than k candidates get all; an empty table gives an empty result. ``is_query`` is an
    expression on the id column. Blocks hold a bounded amount of numbers, whatever the dimension.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.max("q").alias("q"), F.min("v").alias("v")).withColumn("d", F.size("v"))
    rows = durable(rows)
    # One row per dimension.
    sizes = [(r.d, max(64, TILE_NUMBERS // r.d), r.n, r.nq) for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("nq")).collect()]
    sizes = [(d, -(-n // per), -(-(nq or 0) // max(1, per // 4))) for d, per, n, nq in sizes]
    spark = vectors.sparkSession
    grid = spark.createDataFrame(sizes or [(0, 0, 0)], "d int, nc int, nq int")

    def pack(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        flat = np.array(block["v"].tolist(), np.float64)
        return pd.DataFrame({"d": [key[0]], "b": [key[1]], "ids": [block["id"].to_numpy(np.int64).tobytes()], "vs": [flat.tobytes()]})

    dealt = rows.join(F.broadcast(grid), "d").where("nq > 0")
    hashed = F.xxhash64("id")
    blocks = dealt.select("d", F.pmod(hashed, "nc").alias("b"), "id", "v")
    asked = dealt.where("q").select("d", F.pmod(hashed, "nq").alias("b"), "id", "v")
    shape = "d int, b long, ids binary, vs binary"
    blocks, asked = (durable(x.groupBy("d", "b").applyInPandas(pack, shape)) for x in (blocks, asked))
    # Each block once for each block of the other side: the tiles, met by equality.
    left = asked.join(F.broadcast(grid), "d").select("d", F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc").cast("long") - 1)).alias("cb"), F.col("ids").alias("qi"), F.col("vs").alias("qv"))
    right = blocks.join(F.broadcast(grid), "d").select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq").cast("long") - 1)).alias("qb"), F.col("b").alias("cb"), F.col("ids").alias("ci"), F.col("vs").alias("cv"))
    tiles = left.join(right, ["d", "qb", "cb"]).sortWithinPartitions("d", "qb", "cb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, queries, place = None, None, None

        def result() -> pa.RecordBatch:
            found = tops.rows()
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for d, qb, qi, qv, ci, cv in zip(*(batch.column(i) for i in range(6))):
                width = d.as_py()
                if place != (width, qb.as_py()):
                    if tops:
                        yield result()
                    place = (width, qb.as_py())
                    tops = TopLists(np.frombuffer(qi.as_buffer(), np.int64), k)
                    queries = np.frombuffer(qv.as_buffer(), np.float64).reshape(-1, width)
                _tile(tops, queries, np.frombuffer(ci.as_buffer(), np.int64), np.frombuffer(cv.as_buffer(), np.float64).reshape(-1, width))
        if tops:
            yield result()

    lists = tiles.select("d", "qb", "qi", "qv", "ci", "cv").mapInArrow(work, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
