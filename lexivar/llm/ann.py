"""Approximate nearest neighbours by collision-counting hashing.

Each vector, at unit length, is projected on m random lines; per line a block of vectors keeps one sorted array. A query
opens on every line a window centred on its own projection. Windows grow by the factor GROWTH (virtual rehashing: no table
is built anew), only what a window newly covers is counted, and a vector that falls into the windows of at
least ALPHA * m lines is verified by its exact cosine on the original vectors in double precision. A query ends when,
at the distance of its k-th best so far, a vector would exceed the collision threshold with Z standard
deviations to spare, or when the windows cover everything; then nothing nearer is likely to be left.

Blocks hold a bounded number of vectors, dealt by a hash of the id; every query block meets every vector block once. The first block is searched before
the others, and its k-th best is where the search of the others starts from: the rule to end is then that of the whole table, not of a block. Equal vectors are
projected and verified once a block, and stand for their k + 1 least ids.

How many vectors are verified depends on the data: ALPHA and the lines are set so that of vectors without any structure (Gaussian, 64 numbers) most are not,
though their nearest neighbours are hardly nearer than the rest.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Vectors meet only those of
their own length. Ties go to the smaller id. Repeated ids are kept as rows, but never answer a query of the same id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, table

LINES = 128
ALPHA = 0.75
GROWTH = 1.2
START = 0.29
Z = 2.2
BLOCK = 16_384
QUERY_BLOCK = 32_768


def _normal_within(x: np.ndarray | float) -> float:
    from math import erf

    return erf(x / 2**0.5)


class Block:
    """Sorted projections of a block's distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first].astype(np.float64)
        by = np.argsort(group, kind="stable")
        at = np.r_[0, np.cumsum(np.bincount(group))]
        self.ids = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(at[:-1], at[1:])]
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.lines = np.random.default_rng(7).standard_normal((vectors.shape[1], LINES))
        projected = (self.vectors / self.norms[:, None]) @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32).copy()
        # All lines in one sorted array, each shifted clear of the one before, so that one search serves them all.
        self.shift = 4 * np.abs(projected).max(initial=1.0) * np.arange(LINES) + 1e3 * np.arange(LINES)
        self.flat = (np.take_along_axis(projected, self.order.T, 0) + self.shift).T.ravel()
        self.flat_order = self.order.ravel()
        self.verified = 0

    def search(self, own_id: int, query: np.ndarray, k: int, least: float = -2.0) -> list[tuple[float, int]]:
        """(-score, id) of the k best found; `least` is a score that k others are known to reach."""
        n, q = len(self.vectors), query.astype(np.float64)
        norm = np.sqrt((q**2).sum())
        at = (q / norm) @ self.lines
        counts, tried = np.zeros(n, np.int32), np.zeros(n, bool)
        centre, first = at + self.shift, n * np.arange(LINES)
        lo = np.clip(np.searchsorted(self.flat, centre), first, first + n)
        hi, half, need, best = lo.copy(), START, int(np.ceil(ALPHA * LINES)), []
        while True:
            to_lo = np.maximum(np.searchsorted(self.flat, centre - half, "left"), first)
            to_hi = np.minimum(np.searchsorted(self.flat, centre + half, "right"), first + n)
            new = [self.flat_order[i:j] for i, j in zip(np.r_[to_lo, hi], np.r_[lo, to_hi])]
            counts += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            lo, hi = to_lo, to_hi
            fresh = np.flatnonzero((counts >= need) & ~tried)
            if len(fresh):
                tried[fresh] = True
                cos = self.vectors[fresh] @ q / (self.norms[fresh] * norm)
                best += [(-float(cos[i]), int(v)) for i in np.argsort(-cos, kind="stable")[: k + 1] for v in self.ids[fresh[i]] if v != own_id]
                best = sorted(best)[:k]
                self.verified += len(fresh)
            if tried.all():
                return best
            reached = max(least, -best[-1][0] if len(best) == k else -2.0)
            if reached >= -1:
                apart = np.sqrt(max(0.0, 2 - 2 * reached))
                p = _normal_within(half / apart) if apart > 1e-9 else 1.0
                if p * LINES - Z * np.sqrt(LINES * p * (1 - p)) >= need:
                    return best
            half *= GROWTH


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest found for each row where is_query(id column) holds."""
    v = F.col("v")
    plain = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(plain)
    rows = rows.withColumn("dim", F.size("v")).withColumn("query", is_query(F.col("id")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).first()
    blocks, asked = -(-max(total["n"], 1) // block), -(-max(total["q"], 1) // query_block)
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    left = rows.select("dim", place(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("c"), "id", "v")
    right = rows.where("query").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), place(asked, 2).cast("int").alias("c"), "id", "v")
    kind = np.float64 if "double" in dict(rows.dtypes)["v"] else np.float32

    def flat(t: pa.Table, dim: int) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if x.num_rows and y.num_rows:
            dim = x.column("dim")[0].as_py()
            index = Block(x.column("id").to_numpy(), flat(x, dim), k)
            for qid, q, least in zip(y.column("id").to_numpy(), flat(y, dim), y.column("least").to_numpy()):
                out += [(int(qid), i, -s) for s, i in index.search(int(qid), q, k, least)]
        ids, found, score = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])

    def found(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(*[F.col(c).alias(f"{c}_") for c in y.columns]).toDF(*y.columns)  # both sides stem from the same rows; new names for the columns of one
        return x.groupBy("dim", "b", "c").cogroup(y.groupBy("dim", "b", "c")).applyInArrow(search, "query_id long, id long, score double")

    scratch = Scratch(vectors.sparkSession, "nearest")
    # A hair below, as the same cosine may be summed up in another order elsewhere.
    near = scratch.save(found(left.where("b = 0"), right.where("b = 0").withColumn("least", F.lit(-2.0))), "first")
    if blocks > 1:
        best = near.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        twice = rows.where("query").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
        best = best.where(F.size("s") >= k).join(twice, "id", "left_anti").select("id", (F.element_at("s", k) - 1e-9).alias("known"))
        asks = right.where("b > 0").join(best, "id", "left").withColumn("least", F.coalesce("known", F.lit(-2.0))).drop("known")
        near = near.unionByName(found(left.where("b > 0"), asks))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda x: x % 50 == 0)
