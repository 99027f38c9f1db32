"""Nearest vectors by collision counting over sorted single projections.

Vectors are brought to unit length, so the largest cosine is the smallest distance. Every block of vectors keeps one sorted
array per random projection. A query opens a window around its own projection in each of them and counts how often
it meets a vector; windows grow with the search radius (virtual rehashing: the same arrays serve all radii), and only
what a larger window adds is counted. A vector at the radius or nearer falls into a window with probability ``p`` at
least, so it is met ``meetings(p)`` times or more except with probability ``MISS``: vectors met that often are verified on
their coordinates. The search ends when the radius has reached the ``k``-th distance found.

Queries are asked in blocks of bounded size against all vectors; a sample of the vectors gives each query a first bound on its
``k``-th distance, so that most blocks return nothing. The sample never decides a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise
from twinsight.llm.text import only

#: Projections, half width of a window as a multiple of the radius, probability to miss a true neighbour.
PROJECTIONS, HALF_WIDTH, MISS = 64, 1.0, 0.001
#: The first radius and its growth; unit vectors are at most 2 apart.
FIRST_RADIUS, GROWTH = 0.25, 2.0
#: Bytes of query vectors that are broadcast at a time, and of vectors in one set of sorted arrays.
QUERY_BYTES, BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 16 << 20, 8192
#: Queries whose counters a task holds at a time.
QUERY_SLICE = 256
#: One vector in so many gives the first bound.
SAMPLE = 64
#: Stands for a null id, and sorts after all others.
NO_ID = (1 << 63) - 1


def meetings(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """The largest count that a vector at the radius stays below with probability ``miss`` at most."""
    from math import comb, erf, sqrt

    p, below = erf(half_width / sqrt(2)), 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def usable(vector: Column) -> Column:
    """Not null, of one component at least, all of them finite and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, asked: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``df`` that ``asked`` selects, the ``k`` rows of largest cosine found.

    ``asked`` is a condition on ``vec_id``. Candidates are all rows with another id; ties go to the smaller one. The score is
    the cosine of the given vectors in double precision. Vectors that are null, empty or zero, or hold a null or a component that
    is not finite, take no part. Vectors are compared only with those of as many components. Rows that repeat an id
    are candidates of their own; of queries that repeat an id the least vector is asked. Rows without an id are
    candidates that come last among ties, and never queries. An empty table gives an empty one. Other columns are not looked at.
    """
    rows = only(df, vec_id=vec_id, vector=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")))
    queries = rows.filter(asked & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = materialise(queries)
    size = queries.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0
    blocks = max(-(-size // QUERY_BYTES), 1)
    vectors = rows.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "vector")
    found = []
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        held = [(r["vec_id"], r["vector"]) for r in part.collect()]  # about QUERY_BYTES
        found.append(materialise(_search(vectors, held, k)) if blocks > 1 else _search(vectors, held, k))
    everything = reduce(DataFrame.unionByName, found)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = everything.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def _search(vectors: DataFrame, held: list, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of what each task of ``vectors`` found for the queries, at most ``k`` a query."""
    by_width: dict[int, list] = {}
    for query, vector in sorted(held, key=lambda q: q[0]):
        by_width.setdefault(len(vector), []).append((query, vector))
    asked = {
        width: (np.array([q for q, _ in some], "int64"), np.array([v for _, v in some], "float64"))
        for width, some in by_width.items()
    }
    context = vectors.sparkSession.sparkContext
    if not asked:
        return vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sample = vectors.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(SAMPLE)) == 0)
    first = sample.mapInArrow(_task(context.broadcast((asked, {})), k), RESULT)
    last = first.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("best"))
    bounds = {r["query_id"]: r["best"][-1] for r in last.collect() if len(r["best"]) == k}  # one number a query of the block
    return vectors.mapInArrow(_task(context.broadcast((asked, bounds)), k), RESULT)


RESULT = "query_id long, vec_id long, score double"


def _task(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bounds = shared.value
        finders = {width: _Finder(ids, vectors, bounds, k) for width, (ids, vectors) in asked.items()}
        for batch in batches:
            lists = batch.column("vector")
            widths = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            ids = batch.column("vec_id").to_numpy()
            for width in set(widths.tolist()) & set(finders):
                chosen = np.flatnonzero(widths == width)
                finders[width].add(ids[chosen], flat[starts[chosen][:, None] + np.arange(width)])
        for finder in finders.values():
            yield from finder.found()

    return search


class _Finder:
    """The queries of one width, and the best each of them has met in this task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: dict[int, float], k: int):
        self.ids, self.k, self.least = ids, k, meetings()
        self.scaled, self.units = _units(vectors)
        width = vectors.shape[1]
        self.lines = np.random.default_rng(width).standard_normal((PROJECTIONS, width))
        self.at = self.units @ self.lines.T
        self.scores, self.found_ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NO_ID)
        #: Scores below this cannot be among the k best; the small allowance is for rounding.
        self.bar = np.array([bounds.get(q, -np.inf) for q in ids.tolist()]) - 1e-9
        self.rows = int(max(min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)), 1))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), self.rows):
            self.held.append((ids[at : at + self.rows], vectors[at : at + self.rows]))
            self.n_held += len(self.held[-1][0])
            if self.n_held >= self.rows:
                self.flush()

    def flush(self) -> None:
        if self.n_held:
            ids, vectors = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.n_held = [], 0
            block = _Block(ids, vectors, self.lines)
            for at in range(0, len(self.ids), QUERY_SLICE):
                self.ask(block, np.arange(at, min(at + QUERY_SLICE, len(self.ids))))

    def ask(self, block: _Block, queries: np.ndarray) -> None:
        counts = np.zeros((len(queries), len(block.ids)), "int16")
        low = high = None
        met: list[list] = [[] for _ in queries]
        done = np.zeros(len(queries))  # radius searched so far
        active = np.arange(len(queries))
        radius = FIRST_RADIUS
        while len(active):
            limit = np.sqrt(np.maximum(2 - 2 * self.bar[queries[active]], 0))  # infinite without k scores yet
            done[active] = reach = np.minimum(np.minimum(radius, limit), 2.0)
            left, right = block.windows(self.at[queries[active]], HALF_WIDTH * reach + 1e-12)
            if low is None:
                low, high = left.copy(), left.copy()
            for row, i in enumerate(active):
                fresh = block.between(left[row], low[i], high[i], right[row])
                counts[i] += np.bincount(fresh, minlength=len(block.ids)).astype("int16")
                often = np.flatnonzero(counts[i] >= self.least)
                if len(often):
                    counts[i, often] = -PROJECTIONS - 1  # verified: never again
                    self.verify(block, queries[i], often, met[i])
            low[active], high[active] = left, right
            for i in active[(done[active] >= 2.0) & np.isinf(self.bar[queries[active]])]:  # fewer than k found: all are
                self.verify(block, queries[i], np.flatnonzero(counts[i] >= 0), met[i])
            limit = np.sqrt(np.maximum(2 - 2 * self.bar[queries[active]], 0))
            active = active[(done[active] < limit) & (done[active] < 2.0)]
            radius *= GROWTH
        for i, query in enumerate(queries):
            self.keep(block, query, met[i])

    def verify(self, block: _Block, query: int, often: np.ndarray, met: list) -> None:
        often = often[block.ids[often] != self.ids[query]]
        scores = block.units[often] @ self.units[query]
        near = scores >= self.bar[query]
        met.append((often[near], scores[near]))
        seen = np.concatenate([*(s for _, s in met), self.scores[query]])
        if len(seen) >= self.k:
            self.bar[query] = max(self.bar[query], np.partition(seen, -self.k)[-self.k] - 1e-9)

    def keep(self, block: _Block, query: int, met: list) -> None:
        rows = np.concatenate([r for r, s in met for r in [r[s >= self.bar[query]]]]) if met else []
        if len(rows):
            exact = _cosine(block.scaled[rows], self.scaled[query])
            scores, ids = np.concatenate([self.scores[query], exact]), np.concatenate([self.found_ids[query], block.ids[rows]])
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores[query], self.found_ids[query] = scores[best], ids[best]

    def found(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        row, column = np.nonzero(self.scores > -np.inf)
        columns = [self.ids[row], self.found_ids[row, column], self.scores[row, column]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


class _Block:
    """Vectors with their sorted array per projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray):
        self.ids = ids
        self.scaled, self.units = _units(vectors)
        at = np.ascontiguousarray((self.units @ lines.T).T)
        self.order = np.argsort(at, axis=1).astype("int32")
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last position of each query's window, per projection."""
        left = [np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, centres.T, strict=True)]
        right = [np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centres.T, strict=True)]
        return np.array(left).T, np.array(right).T

    def between(self, left, low, high, right) -> np.ndarray:
        """Rows that the windows ``left:right`` hold beyond ``low:high``, once for each projection."""
        spans = zip(self.order, left.tolist(), low.tolist(), high.tolist(), right.tolist(), strict=True)
        return np.concatenate([x for o, a, b, c, d in spans for x in (o[a:b], o[c:d])])


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by a power of two, which is exact and keeps squares in range, and at length 1."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled, scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed row by row in one order, so equal vectors have equal scores."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))
