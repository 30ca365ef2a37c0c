"""Exact top-k search by pivot-table elimination.

Vectors become integers, floor(SCALE * x).  For every vector its distances to
many pivots are stored beside it.  By the triangle inequality the largest
difference between a query's and a candidate's distance to a pivot is a lower
bound of their distance, and with their norms an upper bound of their inner
product.  A query takes its candidates in the order of that bound: the highest
first, which gives it a k-th best score, then all whose bound reaches that score,
several queries at once.  No other vector can be among the best, so it stops there.

Queries and vectors are dealt into blocks; each pair of blocks is searched on its
own and gives k rows per query, and the best k of those are the answer.  Block
sizes are fixed, their number grows with the data.  Pivots are a fixed number of
vectors, drawn by the smallest id digests; they decide how much is skipped,
never what is found.

Defined results: vectors that are NULL, empty, or hold a NULL or non-finite
component, and rows with a NULL id, take no part; vectors of different lengths
never meet; scores that tie go to the smaller id; rows that repeat an id are
candidates of their own for other queries and, as the query's own id, none;
repeated queries are answered once; fewer candidates than k give all of them; an
empty table gives no rows; other columns are ignored.  Scores are exact as long
as they fit into 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.session import materialize

SCALE = 64
PIVOTS = 32
QUERY_BLOCK = 2_048
VECTOR_BLOCK = 8_192
QUERY_STEP = 128
STEP = 256


def integer_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (array<double> of whole numbers) of the rows that take part."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(vec_id).cast("long").alias("id"), values.alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(fine)
            .select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
            .withColumn("dim", F.size("v")))


def pivot_vectors(vectors: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per vector length, ``count`` vectors at most; one pass and a bounded answer per length."""
    per_dim = vectors.select("dim", F.struct(F.md5(F.col("id").cast("string")).alias("h"), "v").alias("p"))
    # A bounded list per task and length: min_by keeps one vector per slot of the digest.
    slot = F.pmod(F.conv(F.substring("p.h", 1, 8), 16, 10).cast("long"), F.lit(count))
    found = per_dim.groupBy("dim", slot.alias("slot")).agg(F.min_by("p.v", "p.h").alias("v")).collect()
    out: dict[int, list] = {}
    for row in sorted(found, key=lambda r: (r["dim"], r["slot"])):
        out.setdefault(row["dim"], []).append(row["v"])
    return {dim: np.array(v, np.float64) for dim, v in out.items()}


def with_pivot_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``far``, the distances to the pivots of the vector's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            far: list = [None] * batch.num_rows
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                x = np.array([batch.column(1)[int(i)].as_py() for i in at], np.float64)
                for i, row in zip(at, _distances(x, pivots[dim])):
                    far[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(far, pa.list_(pa.float64()))], names=["id", "v", "dim", "far"])

    return vectors.select("id", "v", "dim").mapInArrow(run, "id long, v array<double>, dim int, far array<double>")


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of one block of vectors for each of its queries, by elimination."""
    order = np.argsort(vectors["id"].to_numpy(), kind="stable")  # equal scores then stand in the order of ids
    x, x_far = np.stack(vectors["v"])[order], np.stack(vectors["far"])[order]
    x_ids = vectors["id"].to_numpy()[order]
    q, q_far = np.stack(queries["v"]), np.stack(queries["far"])
    q_ids = queries["id"].to_numpy()
    x_norm, q_norm = (x**2).sum(1), (q**2).sum(1)
    slack = 32 * np.finfo(np.float64).eps * (q_norm.max() + x_norm.max())  # of the bounds' rounding
    # Distances are compared in 32 bits.  A pivot that lies far out is inexact there and tells least: it is left out.
    unsure = 8 * np.finfo(np.float32).eps * np.maximum(x_far.max(0), q_far.max(0))
    use = np.flatnonzero((unsure <= 4 * np.median(unsure)) & (unsure < 1e30))
    x_far, q_far = x_far[:, use].astype(np.float32), q_far[:, use].astype(np.float32)
    off = np.float32(unsure[use].max(initial=0.0))
    out = []
    for start in range(0, len(q), QUERY_STEP):
        part = slice(start, start + QUERY_STEP)
        nearest = np.full((len(q[part]), len(x)), off)  # lower bounds of the distances, once ``off`` is taken from them
        for p in range(x_far.shape[1]):
            np.maximum(nearest, np.abs(x_far[:, p] - q_far[part, p, None]), out=nearest)
        bounds = (q_norm[part, None] + x_norm - np.square(nearest - off, dtype=np.float64)) / 2.0 + slack
        bounds[q_ids[part, None] == x_ids] = -np.inf
        out += _best_of(q[part], q_ids[part], x, x_ids, bounds, k)
    query, vec, score = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score.astype(np.int64)})


def _best_of(q, q_ids, x, x_ids, bounds, k: int) -> list[tuple]:
    """Candidates in the order of their bounds: first those with the highest ones, then all that can still count.

    A bound below the k-th score found among the first ends the search for good;
    one that equals it may still tie with a smaller id.
    """
    first = min(len(x), max(STEP, k))
    lowest = np.empty(len(q))
    for i in range(len(q)):
        now = np.argpartition(-bounds[i], first - 1)[:first]
        scores = np.where(bounds[i, now] > -np.inf, x[now] @ q[i], -np.inf)
        lowest[i] = np.partition(scores, first - k)[first - k] if first >= k else -np.inf
    open_ = (bounds >= lowest[:, None]) & (bounds > -np.inf)
    columns = np.flatnonzero(open_.any(0))  # a vector that no query can use any more is not evaluated
    scores = np.where(open_[:, columns], q @ x[columns].T, -np.inf)
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(scores[i] >= max(lowest[i], np.finfo(np.float64).min))
        near = near[np.argsort(-scores[i, near], kind="stable")][:k]
        out.append((np.full(len(near), q_ids[i]), x_ids[columns[near]], scores[i, near]))
    return out


def _blocks(df: DataFrame, size: int, number: str, *spread: str) -> tuple[DataFrame, int]:
    """Numbers rows by a digest of their id, and of ``spread`` where ids repeat, into blocks of about ``size`` rows.

    The digest depends on stored values alone, so a task that runs again numbers its rows as before.
    """
    count = max(1, -(-df.count() // size))
    return df.withColumn(number, F.pmod(F.xxhash64("id", *spread), F.lit(count))), count


def top_k(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on ``id``."""
    plain = materialize(integer_vectors(df, vec_id, vector), "vectors")
    pivots = pivot_vectors(plain)
    index = materialize(with_pivot_distances(plain, pivots).withColumn("row", F.monotonically_increasing_id()), "pivot-table")
    queries, query_blocks = _blocks(index.where(is_query).dropDuplicates(["id"]), QUERY_BLOCK, "query_block")
    vectors, vector_blocks = _blocks(index, VECTOR_BLOCK, "vector_block", "row")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("vector_block", every(vector_blocks))
    right = vectors.withColumn("query_block", every(query_blocks))
    keys = ["dim", "query_block", "vector_block"]

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return search_block(q, x, k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
