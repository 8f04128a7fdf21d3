"""Nearest neighbours by cosine: a block matrix join with int8 product tiles.

Queries and candidates are dealt by a hash of their id to blocks of bounded size, and each block of queries meets each
block of candidates in one task: a tile. Vectors are scaled to length 1 and quantised to int8 with a scale per row; the
tile's products of codes are exact integers, and the norms of the rows' quantisation errors bound how far a product can
be from the true cosine. Of a tile, a pair survives if its upper bound is not below the query's k-th best lower bound;
survivors are computed again in double precision from the original vectors, and heaps keep each query's k best, in the
tile and then over tiles. No pair that belongs to the result is lost: recall is 1.

Results: vectors that are null, zero or hold null or non-finite components take no part; only vectors of equal length
are compared; rows that repeat a vec_id count once, with the least vector; null ids take no part; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 5
QUERY_STEP = 50
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: Candidates multiplied at once in a tile.
STRIP = 1024
#: float32 sums of products of int8 codes are exact up to so many dimensions.
EXACT = 1024
PART = "query_id long, vec_id long, score double"


class Block:
    """Vectors of one length, scaled and quantised."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        unit = self.x / np.abs(self.x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        back = self.codes * self.scale[:, None]
        self.error = np.sqrt(((unit - back) ** 2).sum(axis=1))
        self.length = np.sqrt((back**2).sum(axis=1))

    def products(self, other: Block, rows: slice) -> np.ndarray:
        """codes of self times codes of some of other's rows, as exact integers in doubles."""
        a, b = self.codes.astype(np.float32), other.codes[rows].astype(np.float32)
        total = np.zeros((len(a), len(b)))
        for d in range(0, a.shape[1], EXACT):
            total += a[:, d : d + EXACT] @ b[:, d : d + EXACT].T
        return total

    def bounds(self, other: Block, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Approximate cosines, and how far from them the true ones may be."""
        near = self.products(other, rows) * self.scale[:, None] * other.scale[rows]
        return near, self.error[:, None] + np.outer(self.length, other.error[rows]) + 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; sums go from the first component to the last, so that a pair's result does not
    depend on where or with what it is computed."""
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    with np.errstate(all="ignore"):
        square = total(a * a) * total(b * b)
        out = total(a * b) / np.sqrt(square)
    if (odd := ~((square > 1e-200) & (square < 1e200))).any():  # squares that vanish or overflow
        a, b = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (a, b))
        out[odd] = total(a * b) / np.sqrt(total(a * a) * total(b * b))
    return out


def search(queries: Block, candidates: Block, k: int) -> Iterator[tuple[int, int, float]]:
    """(query id, candidate id, cosine) of each query's k nearest candidates, ties to the smaller id."""
    n, heaps = len(queries.ids), [[] for _ in queries.ids]
    floor = np.full((n, k), -np.inf)  # the k best lower bounds so far
    for at in range(0, len(candidates.ids), STRIP):
        rows = slice(at, at + STRIP)
        near, slack = queries.bounds(candidates, rows)
        own = queries.ids[:, None] == candidates.ids[rows]
        low = np.where(own, -np.inf, near - slack)
        both = np.concatenate([floor, low], axis=1)
        floor = -np.partition(-both, k - 1, axis=1)[:, :k]
        keep = (near + slack >= floor.min(axis=1)[:, None]) & ~own
        hit = np.argwhere(keep)
        for some in np.array_split(hit, max(1, -(-len(hit) // STRIP))):
            exact = cosines(queries.x[some[:, 0]], candidates.x[at + some[:, 1]])
            for i, score, v in zip(some[:, 0].tolist(), exact.tolist(), candidates.ids[at + some[:, 1]].tolist()):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -v))
                elif (score, -v) > heap[0]:
                    heapq.heapreplace(heap, (score, -v))
    for i, heap in enumerate(heaps):
        for score, neg in heap:
            yield int(queries.ids[i]), -neg, score


def _blocks(pdf: pd.DataFrame) -> dict[int, Block]:
    """By length of vector; of rows that repeat an id the least vector."""
    if not len(pdf):
        return {}
    sizes = pdf["vec"].map(len)
    if pdf["vec_id"].duplicated().any():
        pdf = pdf.assign(_v=pdf["vec"].map(tuple)).sort_values(["vec_id", "_v"], kind="stable").drop_duplicates("vec_id")
        sizes = pdf["vec"].map(len)
    return {int(d): Block(g["vec_id"].to_numpy(np.int64), np.stack(g["vec"].to_list())) for d, g in pdf.groupby(sizes, sort=True)}


def _tile(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        q, c = _blocks(queries), _blocks(candidates)
        found = [x for d in q if d in c for x in search(q[d], c[d], k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def _merge(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for pdf in batches:
            for q, v, s in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        rows = [(q, r, -v, s) for q, heap in heaps.items() for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})

    return run


# Vectors are shuffled as they are stored; blocks turn them into doubles.
def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """vectors: vec_id, embedding. Queries are the rows whose id is divisible by `step`. Returns query_id, rank, vec_id, score."""
    kind = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).filter(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    )
    is_query = F.col("vec_id") % step == 0
    n, n_q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    g, h = max(1, -(-n // candidate_block)), max(1, -(-n_q // query_block))
    all_of = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    block = lambda size: F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int")
    queries = rows.filter(is_query).select("vec_id", "vec", block(h).alias("q"), all_of(g).alias("c"))
    candidates = rows.select("vec_id", "vec", all_of(h).alias("q"), block(g).alias("c"))
    tiles = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInPandas(_tile(k), PART)
    return tiles.repartition("query_id").mapInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")
