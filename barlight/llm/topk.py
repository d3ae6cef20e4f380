"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors lie in blocks of a document range (ordered by the signs of their dimensions, so that a block's vectors are alike). A block knows the maximum and
minimum of each term. For a query, the sum over its terms of weight times maximum (or minimum, for a negative weight) bounds every score in the block.
Blocks are visited in the order of that bound and scored through their forward indexes, until the bound falls below the k-th score so far.

Queries are dealt into chunks and tiles of blocks into lanes; a task holds the queries of one chunk and reads the tiles of one lane, so every tile is sent
once for each chunk and every query once for each lane. Alike queries visit blocks together. A common set of vectors is scored first, so every task starts
with a k-th score to beat, which rises as it reads. A task returns at most k rows for each of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from barlight.session import durable

BLOCK = 32
"""Vectors under one bound."""
STEP = 64
"""Blocks that are scored at once."""
TILE = 4096
"""Vectors that travel together."""
RANGE = 16
"""Tiles of a document range."""
BATCH = 256
"""Queries that visit blocks together."""
CHUNK = 131_072
"""Queries that a task holds at most, fewer if they are long."""
CHUNK_VALUES = 1 << 24
WORK = 2_000_000_000
"""Scores of a task, as long as that takes no more than COPIES of the vectors or LANES rows of the queries."""
COPIES, LANES = 4, 16
SEEDS = 16384
SEED_VALUES = 1 << 20
SIGN_BITS = 62
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
TYPES = {1: "i1", 2: "<i2", 4: "<i4", 8: "<f8"}


def width(limit: np.ndarray) -> np.ndarray:
    """Bytes of the narrowest type that holds whole numbers up to *limit*."""
    return np.select([limit < 1 << (8 * w - 1) for w in (1, 2, 4)], [1, 2, 4], 8)


def cells(x: np.ndarray) -> np.ndarray:
    """The signs of the leading dimensions as a number: neighbours in its order are alike."""
    signs = x[:, :SIGN_BITS] > 0
    return signs.astype(np.int64) @ (1 << np.arange(SIGN_BITS - 1, SIGN_BITS - 1 - signs.shape[1], -1, dtype=np.int64))


def matrix(vs: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(vs, TYPES[len(vs) // (n * dims)] if n * dims else "<f8").reshape(n, dims)


def narrow(x: np.ndarray) -> bytes:
    return x.astype(TYPES[int(width(np.abs(x).max(initial=0)))]).tobytes()


def in_order(ids: np.ndarray, x: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The vectors *x*, what belongs to them alongside, so that alike ones are neighbours."""
    order = np.argsort(cells(x), kind="stable")
    return ids[order], x[order], *(o[order] for o in others)


def quantised(vectors: DataFrame, dims: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, cell, v) of the vectors that take part; v holds floor(scale * x), padded to *dims*, in the narrowest of the TYPES."""
    rows = max(1, CHUNK_VALUES // 16 // max(dims, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(start, rows) for start in range(0, whole.num_rows, rows)):
                lists = batch.column("vector")
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.floor(scale * lists.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False))
                row = np.repeat(np.arange(len(lengths)), lengths)
                full = np.zeros((len(lengths), dims))
                full[row, np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x
                taken = np.array(pc.and_(lists.is_valid(), batch.column("vec_id").is_valid()).to_pylist(), bool)
                taken[row[~np.isfinite(x)]] = False
                ids, full = batch.column("vec_id").filter(pa.array(taken)), full[taken]
                widths = width(np.abs(full).max(axis=1, initial=0))
                widths[(np.signbit(full) & (full == 0)).any(axis=1)] = 8  # minus zero keeps its sign, which decides between query rows of one id
                values = np.empty(len(full), object)
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    data, step = full[at].astype(TYPES[int(w)]).tobytes(), dims * int(w)
                    values[at] = [data[i * step : (i + 1) * step] for i in range(len(at))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cells(full), pa.int64()), pa.array(values, pa.binary())], ["vec_id", "cell", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(run, "vec_id long, cell long, v binary")


def as_doubles(rows: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v) of *rows*, v as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [matrix(v, 1, dims).astype("<f8").tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(values, pa.binary())], ["vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary")


def bundles(rows: DataFrame, size: int, dims: int, keep: list[str]) -> DataFrame:
    """Rows of each partition, as they come, in bundles of at most *size*: (ids, vs), and the columns *keep*, which change between bundles only."""
    schema = ", ".join([*(f"{c} int" for c in keep), "ids binary", "vs binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, ids, values = None, [], []

        def bundle() -> pa.RecordBatch:
            columns = [pa.array([m], pa.int32()) for m in marks] + [pa.array([np.array(ids, "<i8").tobytes()]), pa.array([narrow(stacked(values, dims))])]
            return pa.RecordBatch.from_arrays(columns, [*keep, "ids", "vs"])

        for batch in batches:
            table = [batch.column(c).to_pylist() for c in (*keep, "vec_id", "v")]
            for *mark, key, value in zip(*table):
                if ids and (mark != marks or len(ids) == size):
                    yield bundle()
                    ids, values = [], []
                marks = mark
                ids.append(key)
                values.append(value)
        if ids:
            yield bundle()

    return rows.select(*keep, "vec_id", "v").mapInArrow(run, schema)


def stacked(values: list[bytes], dims: int) -> np.ndarray:
    """The vectors *values*, each in a type of its own, as one matrix."""
    if len({len(v) for v in values}) == 1:
        return matrix(b"".join(values), len(values), dims)
    return np.stack([matrix(v, 1, dims)[0].astype(float) for v in values])


def score_type(limit: float) -> str:
    """The quickest type that holds inner products up to *limit* and their partial sums exactly; int64 for very large ones."""
    return "f4" if limit < 2**24 else "f8" if limit < 2**52 else "i8"


class Search:
    """The k best vectors met so far for each of some queries: highest scores, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None, floor_id: np.ndarray | None = None) -> None:
        """*floor* and *floor_id*, where given, are a known k-th score of each query (or NONE) and the id it belongs to."""
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score, self.key = np.full((len(ids), k), NONE), np.full((len(ids), k), LAST)
        self.kth = np.full(len(ids), NONE) if floor is None else floor.copy()
        self.kth_id = np.full(len(ids), LAST) if floor_id is None else floor_id.copy()
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.visited = self.blocks = 0
        self.starts = np.arange(0, len(ids), BATCH)
        self.limit = float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        high, low = (f.reduceat(vectors, self.starts, axis=0).astype(float) for f in (np.maximum, np.minimum))
        self.middle, self.spread = (high + low) / 2, (high - low) / 2

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score the blocks of a tile that may hold one of the k best."""
        limit = self.limit * float(np.abs(vectors).max(initial=0))
        kind = score_type(limit)
        slack = 0 if limit < 2**45 else 1 + limit * 4e-15 * vectors.shape[1]  # rounding must not cut a block off
        starts = np.arange(0, len(ids), BLOCK)
        high, low = (f.reduceat(vectors, starts, axis=0).astype(float) for f in (np.maximum, np.minimum))
        least = np.minimum.reduceat(ids, starts)
        middle, spread = (high + low) / 2, (high - low) / 2
        # no query of a batch scores more in a block than the ranges of their terms allow
        reach = self.middle @ middle.T + np.abs(self.middle) @ spread.T + self.spread @ (np.abs(middle) + spread).T + slack
        kth, kth_id = np.minimum.reduceat(self.kth, self.starts).astype(float), np.maximum.reduceat(self.kth_id, self.starts)
        within = _within(reach, kth, least, kth_id)
        high, low, x = high.astype(_bounds(kind)), low.astype(_bounds(kind)), vectors.astype(kind)
        self.blocks += len(self.ids) * len(starts)
        for batch in np.flatnonzero(within.any(axis=1)):
            rows, blocks = slice(self.starts[batch], self.starts[batch] + BATCH), np.flatnonzero(within[batch])
            queries = self.vectors[rows].astype(high.dtype)
            bound = np.maximum(queries, 0) @ high[blocks].T + np.minimum(queries, 0) @ low[blocks].T
            bound += bound.dtype.type(slack if kind == "i8" else 0)
            self._visit(rows, queries if kind != "i8" else self.vectors[rows].astype(kind), blocks, bound, least[blocks], ids, x)
        if self.held > max(len(self.ids) * self.k // 2, 10_000):
            self.settle()

    def _visit(self, rows: slice, queries: np.ndarray, blocks: np.ndarray, bound: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, order = 0, None
        while order is None or len(order):
            alive = _within(bound, self.kth[rows].astype(bound.dtype), least, self.kth_id[rows])
            if order is None:
                order = np.argsort(-(bound - self.kth[rows].astype(bound.dtype)[:, None]).max(axis=0), kind="stable")
            order = order[alive.any(axis=0)[order]]
            part, order = np.sort(order[:STEP]), order[STEP:]
            if not len(part):
                break
            going = np.flatnonzero(alive[:, part].any(axis=1))
            self.visited += int(alive[:, part].sum())
            at = (blocks[part, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < len(ids)]
            score = (queries if len(going) == len(queries) else queries[going]) @ x[at].T
            hits = score >= self.kth[rows][going].astype(score.dtype)[:, None]
            if np.count_nonzero(hits) > 4 * self.k * len(going) and len(at) > self.k:  # the part alone gives a k-th score to beat
                of_others = np.where(self.ids[rows][going][:, None] == ids[at], NONE, score)
                hits &= of_others >= np.partition(of_others, -self.k, axis=1)[:, -self.k, None]
            row, column = np.divmod(np.flatnonzero(hits), len(at))
            if not len(row):
                continue
            value, key, row = score[row, column].astype(np.int64), ids[at[column]], going[row] + rows.start
            wanted = (key != self.ids[row]) & ((value > self.kth[row]) | (value == self.kth[row]) & (key <= self.kth_id[row]))
            found.append((row[wanted], key[wanted], value[wanted]))
            held += len(found[-1][0])
            if held > len(queries) * self.k:
                self._settle(found)
                found, held = [], 0
        self.pending += found
        self.held += held

    def settle(self) -> None:
        if self.pending:
            self._settle(self.pending)
        self.pending, self.held = [], 0

    def _settle(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        touched = np.unique(np.concatenate([row for row, _, _ in found]))
        score, key = self.score[touched], self.key[touched]
        known = score != NONE
        row, key, score = first([*found, (np.repeat(touched, known.sum(axis=1)), key[known], score[known])], self.k)
        rank = ranks(row)
        self.score[row, rank], self.key[row, rank] = score, key
        full = row[rank == self.k - 1]
        self.kth[full], self.kth_id[full] = self.score[full, -1], self.key[full, -1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the k best of all tiles."""
        self.settle()
        row, rank = np.nonzero(self.score != NONE)
        return row, self.key[row, rank], self.score[row, rank]


def _bounds(kind: str) -> str:
    return "f4" if kind == "f4" else "f8"


def _within(bound: np.ndarray, kth: np.ndarray, least: np.ndarray, kth_id: np.ndarray) -> np.ndarray:
    """Which blocks may hold a row of the k best: a block that can only tie may hold a smaller id."""
    kth = kth[:, None]
    return (bound > kth) | (bound == kth) & (least <= kth_id[:, None])


def ranks(row: np.ndarray) -> np.ndarray:
    """Each entry's place among equal entries of the ascending *row*."""
    if not len(row):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(row)]])))


def first(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: highest scores, ties to smaller ids."""
    row, key, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, -score, row))
    row, key, score = row[order], key[order], score[order]
    kept = ranks(row) < k
    return row[kept], key[kept], score[kept]


def layout(total: int, asked: int, dims: int, k: int) -> tuple[int, int]:
    """(chunks, lanes) for *asked* queries and *total* vectors: tasks of WORK scores while that is cheap to deal, and chunks that a task can hold."""
    tasks = max(1, ceil(asked * total / WORK))
    vector_bytes, query_bytes = total * (dims + 8), max(1, asked) * (dims + 24 * (k + 1))
    lanes = max(1, min(LANES, ceil(sqrt(tasks * vector_bytes / query_bytes)), tasks))
    chunks = min(COPIES, ceil(tasks / lanes))
    return max(1, chunks, ceil(asked / CHUNK), ceil(asked * dims / CHUNK_VALUES)), lanes


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k best partners of each query among all vectors: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by *every*; scores are integer inner products of floor(scale * x); equal scores go to the smaller id. A
    vector that is null or has a null or non-finite component, and one without id, takes no part. Shorter vectors count as padded with zeros. Rows
    that repeat an id are candidates each; a query sees no row of its own id, and one of several query rows with an id is taken (the smallest
    in byte order). An empty table gives an empty one; other columns are ignored. Scores must fit in a long.
    """
    spark = vectors.sparkSession
    dims = max(vectors.agg(F.max(F.size(vector_col))).first()[0] or 0, 0)
    rows = durable(quantised(vectors, dims, id_col, vector_col, scale))
    mine = F.col("vec_id") % every == 0
    total, asked = rows.agg(F.count("*"), F.count(F.when(mine, 1))).first()
    chunks, lanes = layout(total, asked, dims, k)
    seeds = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(k + 1, min(SEEDS, SEED_VALUES // max(dims, 1)))).collect()
    known = (np.array([r["vec_id"] for r in seeds], np.int64), stacked([bytes(r["v"]) for r in seeds], dims)) if seeds else None
    seed = spark.sparkContext.broadcast(in_order(*known) if known else None)

    queries = as_doubles(rows.filter(mine), dims).repartition(max(1, ceil(asked / TILE)), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).sortWithinPartitions("chunk", "vec_id")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, vs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "vs"))):
                search = Search(*in_order(np.frombuffer(ids, "<i8"), matrix(vs, len(ids) // 8, dims)), k)
                for start in range(0, len(seed.value[0]), TILE):
                    search.meet(*(x[start : start + TILE] for x in seed.value))
                search.settle()
                columns = [pa.array([chunk], pa.int32()), *(pa.array([x.tobytes()]) for x in (search.ids, search.vectors, search.kth, search.kth_id))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "vs", "floors", "floor_ids"])

    ready = bundles(dealt, TILE, dims, ["chunk"]).mapInArrow(floors, "chunk int, ids binary, vs binary, floors binary, floor_ids binary")
    ready = ready.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    ranged = rows.repartitionByRange(max(1, ceil(total / (TILE * RANGE))), "cell", "v", "vec_id").sortWithinPartitions("cell", "v", "vec_id")
    place = F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) + {RANGE + 1} * spark_partition_id()")
    tiles = bundles(ranged, TILE, dims, []).withColumn("lane", F.pmod(place, F.lit(lanes)).cast("int"))
    tiles = tiles.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    met = ready.unionByName(tiles, allowMissingColumns=True).withColumn("pair", F.col("chunk") * lanes + F.col("lane")).withColumn("tile", F.col("floors").isNull())
    met = met.repartitionById(chunks * lanes, F.col("pair")).sortWithinPartitions("pair", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, search = None, [], None

        def begin() -> Search | None:
            if not waiting:
                return None
            ids, floor, floor_id = (np.concatenate([np.frombuffer(w[c], "<i8") for w in waiting]) for c in (0, 2, 3))
            parts = [matrix(w[1], len(w[0]) // 8, dims) for w in waiting]
            ids, x, floor, floor_id = in_order(ids, np.concatenate(parts), floor, floor_id)
            return Search(ids, x, k, floor, floor_id)

        def end() -> Iterator[pa.RecordBatch]:
            if search is not None:
                row, key, score = search.result()
                for start in range(0, len(row), 100_000):
                    part = slice(start, start + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(search.ids[row[part]]), pa.array(key[part]), pa.array(score[part])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                pair, tile, ids, vs, floor, floor_ids = (batch.column(c)[at].as_py() for c in ("pair", "tile", "ids", "vs", "floors", "floor_ids"))
                if pair != now:
                    yield from end()
                    now, waiting, search = pair, [], None
                if not tile:
                    waiting.append((ids, vs, floor, floor_ids))
                    continue
                if waiting:
                    search, waiting = begin(), []
                if search is not None:
                    search.meet(np.frombuffer(ids, "<i8"), matrix(vs, len(ids) // 8, dims))
        yield from end()

    best = met.select("pair", "tile", "ids", "vs", "floors", "floor_ids").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
