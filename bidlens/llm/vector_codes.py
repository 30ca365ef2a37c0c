"""Vector code compression: codebooks per part, trained with Drake and Hamerly's adaptive bounds.

Vectors become integers, floor(SCALE * x), cut into equal parts, each with a
codebook of its own.  A round assigns every part to its nearest entry and moves
each entry to the floored mean of its parts.  Beside a vector its state is stored:
per part the assigned entry, the ``b`` entries that were closest after it with
lower bounds of their distances in order, and one outer bound for all others.  When
entries move, bounds shrink by as much.  The distance to the assigned entry is
recomputed as an integer; a part is settled if every bound lies above it.  If only
stored entries are in doubt, those are compared as integers, otherwise all are.
So rounding of bounds costs comparisons, never an assignment.  ``b`` adapts per part
position: to the rank up to which bounds were reached, and one more where the outer
bound was reached often.

A round is one pass over the table of vectors and states.  Its tasks also write
the change of every entry's count and sum, PARTS * ENTRIES rows a task, so entries
move without a second pass.  A round's table is removed once the next is stored.

Defined results: vectors that are NULL or hold NULL or non-finite components take
no part; nor do those of another length than the vector with the smallest id whose
length is a multiple of PARTS, those of length 0, and those whose distances could
exceed 63 bits (components beyond sqrt(2**61 / length) / SCALE).  NULL ids come
last; rows that repeat an id are rows of their own, ordered by their components;
with fewer vectors than ENTRIES the codebooks are as small; ties go to the lower
entry; NULL labels are one group, whose sum is NULL if it exceeds a long; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import drop_table
from bidlens.operators.prefix import join_null_safe
from bidlens.session import materialize, new_table_path

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
FEWEST, MOST, FIRST = 2, 8, 4  # entries kept per part: limits, and in the first round
REACHED, OUTER = 1_000, 8  # a rank counts if one part in REACHED reaches it; the outer bound if one in OUTER does
NO_ENTRY = 255


def integer_vectors(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, v (array of long) of the rows that can take part."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.sqrt(F.lit(2.0**61) / F.size("v")) - 1))
    return (df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), scaled.alias("v"))
            .where("v IS NOT NULL AND size(v) > 0").where(fits)
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x)).alias("v")))


def _first(vectors: DataFrame, count: int) -> list[list[int]]:
    return [list(r.v) for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(count).select("v").collect()]


def squared(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, w) parts to (k, w) or (n, k, w) entries."""
    gap = v[:, None, :] - entries
    return np.einsum("nkw,nkw->nk", gap, gap)


def lower(distance2: np.ndarray) -> np.ndarray:
    """Distances as 32-bit numbers that are not above the exact ones."""
    root = np.sqrt(distance2.astype(np.float64)) * (1 - 1e-12)
    return np.nextafter(root.astype(np.float32), np.float32(-np.inf))


class PartState:
    """State of one part position for the rows of a batch."""

    def __init__(self, entry: np.ndarray, near: np.ndarray, bound: np.ndarray, outer: np.ndarray):
        self.entry, self.near, self.bound, self.outer = entry, near, bound, outer

    @staticmethod
    def width(b: int) -> int:
        return 5 + 5 * b

    @classmethod
    def read(cls, raw: np.ndarray, b: int) -> PartState:
        """From (n, width) bytes."""
        floats = np.ascontiguousarray(raw[:, 1 + b:]).view(np.float32)
        return cls(raw[:, 0].astype(np.int64), raw[:, 1:1 + b].astype(np.int64), floats[:, :b].copy(), floats[:, b].copy())

    def written(self) -> np.ndarray:
        floats = np.concatenate([self.bound, self.outer[:, None]], 1).astype(np.float32)
        return np.concatenate([self.entry[:, None].astype(np.uint8), self.near.astype(np.uint8), floats.view(np.uint8)], 1)

    def resized(self, b: int) -> PartState:
        """With ``b`` stored entries: those too many go under the outer bound, missing ones are empty places."""
        have = self.near.shape[1]
        if b < have:
            self.outer = np.minimum(self.outer, self.bound[:, b:].min(1))
            self.near, self.bound = self.near[:, :b], self.bound[:, :b]
        elif b > have:
            more = (len(self.near), b - have)
            self.near = np.concatenate([self.near, np.full(more, NO_ENTRY, np.int64)], 1)
            self.bound = np.concatenate([self.bound, np.full(more, np.inf, np.float32)], 1)
        return self


def compare_all(v: np.ndarray, book: np.ndarray, b: int) -> tuple[PartState, np.ndarray]:
    """State and squared distance from comparisons with every entry."""
    d2 = squared(v, book)
    order = np.argsort(d2, 1, kind="stable")  # equal distances by the lower entry
    ranked = np.take_along_axis(d2, order, 1)
    bounds = lower(ranked)
    stored = min(b, d2.shape[1] - 1)
    outer = bounds[:, stored + 1] if d2.shape[1] > stored + 1 else np.full(len(v), np.inf, np.float32)
    state = PartState(order[:, 0], order[:, 1:stored + 1], bounds[:, 1:stored + 1], outer)
    return state.resized(b), ranked[:, 0]


def move(v: np.ndarray, book: np.ndarray, moved: np.ndarray, state: PartState, b: int) -> tuple[PartState, np.ndarray, np.ndarray]:
    """State and squared distance after entries moved by ``moved``; how many rows reached each rank, at last the outer bound."""
    have = state.near.shape[1]
    steps = np.append(moved, np.zeros(NO_ENTRY + 1 - len(moved)))
    bound = np.nextafter((state.bound - steps[state.near]).astype(np.float32), np.float32(-np.inf))
    order = np.argsort(bound, 1, kind="stable")
    state.near, state.bound = np.take_along_axis(state.near, order, 1), np.take_along_axis(bound, order, 1)
    state.outer = np.nextafter((state.outer - moved.max()).astype(np.float32), np.float32(-np.inf))
    own = book[state.entry]
    best = np.einsum("nw,nw->n", v - own, v - own)
    limit = np.sqrt(best.astype(np.float64)) * (1 + 1e-12)
    open_ = state.outer <= limit
    reached = (state.bound <= limit[:, None]).sum(1)
    counts = np.append(np.bincount(reached[~open_], minlength=MOST + 1), open_.sum())

    some = np.flatnonzero(~open_ & (reached > 0))
    if len(some):
        ids = np.concatenate([state.entry[some, None], state.near[some]], 1)
        known = ids != NO_ENTRY
        d2 = np.where(known, squared(v[some], book[np.where(known, ids, 0)]), np.iinfo(np.int64).max)
        order = np.lexsort((ids, d2), axis=1)
        ids, d2 = np.take_along_axis(ids, order, 1), np.take_along_axis(d2, order, 1)
        state.entry[some], best[some] = ids[:, 0], d2[:, 0]
        state.near[some] = ids[:, 1:]
        state.bound[some] = np.where(ids[:, 1:] == NO_ENTRY, np.float32(np.inf), lower(d2[:, 1:]))
    state = state.resized(b)
    every = np.flatnonzero(open_)
    if len(every):
        fresh, best[every] = compare_all(v[every], book, b)
        state.entry[every], state.near[every] = fresh.entry, fresh.near
        state.bound[every], state.outer[every] = fresh.bound, fresh.outer
    return state, best, counts


def next_sizes(sizes: Sequence[int], counts: np.ndarray) -> list[int]:
    """Per part position how many entries to keep, from (part, rank) counts of the last round."""
    out = []
    for b, seen in zip(sizes, counts):
        reached = np.flatnonzero(seen[:-1] * REACHED > seen.sum())
        want = int(reached.max()) if len(reached) else 0
        out.append(min(MOST, max(FEWEST, b + 1 if seen[-1] * OUTER > seen.sum() else want)))
    return out


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), parts, -1)


def assign(vectors: DataFrame, books: np.ndarray, moved: np.ndarray | None, sizes: Sequence[int] | None,
           new_sizes: Sequence[int], last: bool) -> DataFrame:
    """One round over (vec_id, label, v, state).

    Rows of kind 0 are vectors: with their new state, or at last with code and
    error.  Kind 1: change of an entry's count ``n`` and ``sums``.  Kind 2: rows ``n``
    that reached rank ``entry`` of a part.
    """
    parts, k, w = books.shape
    label = next(f for f in vectors.schema if f.name == "label")
    names = ["vec_id", "label", "v", "state", "kind", "code", "error", "part", "entry", "n", "sums"]
    schema = vectors.limit(0).select("vec_id", "label", "v", F.lit(b"").alias("state"), F.lit(0).alias("kind"), F.lit("").alias("code"), *[
        F.lit(0).cast("long").alias(c) for c in ("error", "part", "entry", "n")], F.col("v").alias("sums")).schema
    for field in schema:
        field.nullable = True
    old_widths = [PartState.width(b) for b in sizes] if sizes else None
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        reached = np.zeros((parts, MOST + 2), np.int64)
        label_type = None
        for batch in batches:
            label_type, rows = batch.schema.field(1).type, batch.num_rows
            if not rows:
                continue
            v = _matrix(batch.column(2), parts)
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(rows, -1) if sizes else None
            codes, error, states, at = np.empty((rows, parts), np.uint8), np.zeros(rows, np.int64), [], 0
            for p in range(parts):
                part = np.ascontiguousarray(v[:, p])
                if raw is None:
                    before, (state, best) = None, compare_all(part, books[p], new_sizes[p])
                else:
                    state = PartState.read(raw[:, at:at + old_widths[p]], sizes[p])
                    at += old_widths[p]
                    before = state.entry.copy()
                    state, best, counts = move(part, books[p], moved[p], state, new_sizes[p])
                    reached[p] += counts
                codes[:, p] = state.entry
                error += best
                states.append(state)
                gone = np.arange(rows) if before is None else np.flatnonzero(before != state.entry)
                np.add.at(n[p], state.entry[gone], 1)
                np.add.at(sums[p], state.entry[gone], part[gone])
                if before is not None:
                    np.subtract.at(n[p], before[gone], 1)
                    np.subtract.at(sums[p], before[gone], part[gone])
            nothing = lambda t: pa.nulls(rows, t)
            if last:
                extra = [nothing(longs), nothing(pa.binary()), pa.array(np.zeros(rows, np.int32)),
                         pa.array([c.tobytes().hex() for c in codes]), pa.array(error)]
            else:
                packed = np.concatenate([s.written() for s in states], 1)
                extra = [batch.column(2), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(np.zeros(rows, np.int32)),
                         nothing(pa.string()), nothing(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *extra, *[nothing(pa.int64())] * 3, nothing(longs)], names=names)
        if label_type is None or last:
            return
        found = [(1, p, e, int(n[p, e]), sums[p, e].tolist()) for p in range(parts) for e in range(k) if n[p, e] or sums[p, e].any()]
        found += [(2, p, rank, int(reached[p, rank]), None) for p in range(parts) for rank in range(MOST + 2) if reached[p, rank]]
        if found:
            kind, part, entry, count, total = zip(*found)
            m = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, label_type), pa.nulls(m, longs), pa.nulls(m, pa.binary()), pa.array(kind, pa.int32()),
                 pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.array(part, pa.int64()), pa.array(entry, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(total, longs)], names=names)

    assert label is not None
    return vectors.select("vec_id", "label", "v", "state").mapInArrow(run, schema)


def _changes(stored: DataFrame, parts: int, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of counts and sums, and counts per rank: bounded by the codebooks' size."""
    n, sums, reached = np.zeros((parts, k), object), np.zeros((parts, k, w), object), np.zeros((parts, MOST + 2), np.int64)
    rows = stored.where("kind > 0").groupBy("kind", "part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(w)]).alias("sums"))
    for r in rows.collect():
        if r["kind"] == 1:
            n[r["part"], r["entry"]], sums[r["part"], r["entry"]] = r["n"], r["sums"]
        else:
            reached[r["part"], r["entry"]] = r["n"]
    return n, sums, reached


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[list[int]]] | None:
    """Codes (vec_id, label, code, error), the final codebooks and ``b`` per round; None without vectors.

    ``vectors``: (vec_id, label, v); they are stored by the caller.
    """
    spark = vectors.sparkSession
    fitting = vectors.where(F.size("v") % parts == 0)
    seed = _first(fitting, 1)
    if not seed:
        return None
    rows = fitting.where(F.size("v") == len(seed[0]))
    books = np.array(_first(rows, entries), np.int64).reshape(-1, parts, len(seed[0]) // parts).transpose(1, 0, 2).copy()
    k, w = books.shape[1:]
    n, sums = np.zeros((parts, k), object), np.zeros((parts, k, w), object)
    now, moved, sizes, new_sizes, history, path = rows.withColumn("state", F.lit(None).cast("binary")), None, None, [FIRST] * parts, [], None
    for _ in range(rounds):
        stored = new_table_path(spark, "vector-states")
        assign(now, books, moved, sizes, new_sizes, last=False).write.partitionBy("kind").option("compression", "zstd").parquet(stored)
        if path:
            drop_table(spark, path)
        path, table = stored, spark.read.parquet(stored)
        dn, dsums, reached = _changes(table, parts, k, w)
        n, sums = n + dn, sums + dsums
        after = books.copy()
        for p, e in zip(*np.nonzero(n)):
            after[p, e] = [int(s) // int(n[p, e]) for s in sums[p, e]]
        gap = (after - books).astype(np.float64)
        moved = np.sqrt((gap**2).sum(2)) * (1 + 1e-12)
        books, now, history = after, table.where("kind = 0"), [*history, list(new_sizes)]
        sizes, new_sizes = new_sizes, next_sizes(new_sizes, reached) if reached.any() else new_sizes
    coded = materialize(assign(now, books, moved, sizes, new_sizes, last=True).select("vec_id", "label", "code", "error"), "vector-codes")
    if path:
        drop_table(spark, path)
    return coded, books, history


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in books.reshape(-1)).encode()).hexdigest()


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    spark = df.sparkSession
    trained = train(materialize(integer_vectors(df, vec_id, vector, label), "vectors"))
    if trained is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded, books, _ = trained
    totals = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return join_null_safe(coded, totals, ["label"]).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
