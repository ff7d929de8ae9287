"""Exact top-k by inner product with a vector-approximation file.

The file holds, for each vector, the cell of every component on a grid that fills its cells evenly. A scan of the cells
bounds every score from below and above; a query's candidates are the vectors whose upper bound reaches its kth best
lower bound. Only their exact vectors are read, in order of their upper bounds, until no open bound can beat the kth
exact score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.common import drop_table, materialize

#: Cells of a component; a cell's number takes one byte.
CELLS = 256
#: Vectors, and numbers in them, that the grid's inner edges are learned from. Any edges give exact results.
GRID_ROWS, GRID_NUMBERS = 4096, 1 << 21
#: Numbers in the queries of one block; the blocks are broadcast one after the other.
BLOCK_NUMBERS = 1 << 21
#: Queries and vectors of one tile, whose bounds are held at once.
TILE_QUERIES, TILE_ROWS = 256, 2048
#: Candidates that a task hands on at once.
FLUSH = 1 << 16
#: Exact vectors read first for a query, as a multiple of k.
FIRST_READ = 4
#: A query's candidates are ranked in so many parts before they meet.
PARTS = 32
#: Vectors whose inner product with themselves is larger are wide: their scores need not fit a long, so they are worked out in
#: whole numbers of any size.
LARGEST_NORM = 2.0**62

def quantize(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double, as whole doubles, so that none is too large; null for a vector that is
    null, empty, or has a null, NaN or infinite one, or one that scale makes infinite."""
    value = F.transform(embedding, lambda x: x.cast("double") * F.lit(float(scale)))
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return F.when(good, F.transform(value, whole))


def _is_wide(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)) > LARGEST_NORM


def _sort_key(score: int) -> tuple[int, str, float]:
    """A score's class (0: it fits a long), the key of one that does not, which sorts as such scores do (digits behind their
    count), and a double close to it."""
    try:
        near = float(score)
    except OverflowError:
        near = np.inf if score > 0 else -np.inf
    if -(1 << 63) <= score < 1 << 63:
        return 0, "", near
    digits = str(abs(score))
    if score > 0:
        return 1, f"{len(digits):06d}{digits}", near
    return -1, f"{999_999 - len(digits):06d}{''.join(str(9 - int(c)) for c in digits)}", near


@F.pandas_udf(StructType([StructField("hi", IntegerType()), StructField("key", StringType()), StructField("near", DoubleType()), StructField("score", LongType())]))
def _wide_score(v: pd.Series, q: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(v, q, strict=True):
        score = sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
        hi, key, near = _sort_key(score)
        out.append((hi, key, near, None if hi else score))
    found = pd.DataFrame(out, columns=["hi", "key", "near", "score"])
    return found.astype({"score": "Int64"})


@dataclass
class Grid:
    """The edges between cells, and the least and greatest integer in each cell, of every component."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest integer of each component of a task's vectors, by length."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for d, _, v in _by_length(batch.column("v")):
            low, high = seen.get(d, (v[0], v[0]))
            seen[d] = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    for d, (low, high) in seen.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d), pa.array(np.arange(d)), pa.array(low), pa.array(high)], names=["d", "j", "low", "high"]
        )


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors as a matrix) for each length of vectors."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[start[rows][:, None] + np.arange(d)]


def learn_grids(rows: DataFrame) -> dict[int, Grid]:
    """A grid for each length of vectors: ends from all vectors, inner edges from a bounded sample's quantiles."""
    spread = rows.mapInArrow(_extent, "d bigint, j bigint, low double, high double").groupBy("d", "j")
    ends = spread.agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    grids = {}
    for d, part in ends.sort_values("j").groupby("d"):
        low, high = part["low"].to_numpy(np.float64), part["high"].to_numpy(np.float64)
        some = rows.filter(F.size("v") == int(d)).orderBy(F.xxhash64("id")).limit(max(1, min(GRID_ROWS, GRID_NUMBERS // int(d))))
        sample = np.array(some.select("v").toPandas()["v"].tolist(), np.float64).reshape(-1, int(d))
        inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="higher").T
        if (high - low).max() < CELLS:  # a cell for each integer
            inner = np.minimum(low[:, None] + np.arange(1, CELLS), high[:, None] + 1)
        inner = np.sort(inner, axis=1)
        first = np.concatenate([low[:, None], inner], axis=1)
        last = np.concatenate([inner - 1, high[:, None]], axis=1)
        grids[int(d)] = Grid(inner, np.maximum(first, low[:, None]), np.minimum(last, high[:, None]))
    return grids


def _to_cells(held):
    """The approximation of each vector: the cells of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [b""] * batch.num_rows
            for d, rows, v in _by_length(batch.column("v")):
                for i, c in zip(rows.tolist(), held.value[d].cells(v), strict=True):
                    cells[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cells, pa.binary())], names=["id", "cells"])

    return run


@dataclass
class QueryBlock:
    """Queries by length, each with its bounds' tables."""

    ids: np.ndarray
    q: np.ndarray
    floor: np.ndarray | None = None
    floor_id: np.ndarray | None = None


def _tiles(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid], queries: dict[int, QueryBlock]):
    """(length, first query, ids, lower bounds, upper bounds) for each tile of queries and vectors.

    A bound is the score of the cells' middles, less or plus what the cells' halves can add and what rounding may.
    """
    for batch in batches:
        all_ids = batch.column("id").to_numpy()
        sizes = np.array([len(x) for x in batch.column("cells").to_pylist()], np.int64)
        for d in np.unique(sizes).tolist():
            if d not in queries:
                continue
            rows, grid, block = np.flatnonzero(sizes == d), grids[d], queries[d]
            middle, half = (grid.low + grid.high) / 2, (grid.high - grid.low) / 2
            largest = float(np.abs(np.concatenate([grid.low, grid.high])).max())
            for at in range(0, len(rows), TILE_ROWS):
                some = rows[at : at + TILE_ROWS]
                cells = np.frombuffer(b"".join(batch.column("cells").take(pa.array(some)).to_pylist()), np.uint8).reshape(-1, d)
                m, h = middle[np.arange(d), cells].T, half[np.arange(d), cells].T
                for first in range(0, len(block.ids), TILE_QUERIES):
                    q = block.q[first : first + TILE_QUERIES]
                    size = np.abs(q)
                    with np.errstate(all="ignore"):  # beyond the doubles, a bound is none
                        width = size @ h + size.sum(axis=1)[:, None] * (largest * (d + 4) * 2.0**-51)
                        centre = q @ m
                        low, high = centre - width, centre + width
                    yield d, first, all_ids[some], np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _floors(held_grids, held, k: int):
    """Each query's k+1 best lower bounds in a task, since the query itself may be one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, QueryBlock] = held.value
        best = {d: (np.full((len(b.ids), k + 1), -np.inf), np.zeros((len(b.ids), k + 1), np.int64)) for d, b in queries.items()}
        for d, first, ids, low, _ in _tiles(batches, held_grids.value, queries):
            values, of = (x[first : first + TILE_QUERIES] for x in best[d])
            if low.shape[1] > k + 1:
                at = np.argpartition(low, low.shape[1] - k - 1, axis=1)[:, low.shape[1] - k - 1 :]
                low, new = np.take_along_axis(low, at, axis=1), ids[at]
            else:
                new = np.broadcast_to(ids, low.shape)
            merged, named = np.concatenate([values, low], axis=1), np.concatenate([of, new], axis=1)
            at = np.argpartition(merged, merged.shape[1] - k - 1, axis=1)[:, merged.shape[1] - k - 1 :]
            values[:], of[:] = np.take_along_axis(merged, at, axis=1), np.take_along_axis(named, at, axis=1)
        for d, (values, of) in best.items():
            keep = values.ravel() > -np.inf
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries[d].ids, k + 1)[keep]), pa.array(of.ravel()[keep]), pa.array(values.ravel()[keep])],
                names=["query_id", "vec_id", "low"],
            )

    return run


def _candidates(held_grids, held):
    """The vectors whose upper bound reaches the query's floor, or equals it where the id can still decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, QueryBlock] = held.value
        found: list[list[np.ndarray]] = [[], [], []]
        for d, first, ids, _, high in _tiles(batches, held_grids.value, queries):
            block = queries[d]
            floor, last = (x[first : first + TILE_QUERIES, None] for x in (block.floor, block.floor_id))
            passing = (high > floor) | ((high == floor) & (ids[None, :] <= last))
            a, b = np.nonzero(passing)
            for x, new in zip(found, (block.ids[first + a], ids[b], high[a, b]), strict=True):
                x.append(new)
            if sum(map(len, found[0])) > FLUSH:
                yield _batch(found)
                found = [[], [], []]
        if found[0]:
            yield _batch(found)

    return run


def _batch(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["query_id", "vec_id", "high"])


def _first_of(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n rows of each query by falling `by`, then id, with their rank. Parts are ranked first, so that a query
    with very many rows is no single task's."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))
    order = (*map(F.desc, by), "vec_id")
    some = rows.withColumn("_p", part).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_p").orderBy(*order)))
    some = some.filter(F.col("rank") <= n).drop("_p", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= n)


def _exact(pairs: DataFrame, rows: DataFrame, queries: DataFrame, wide: bool) -> DataFrame:
    """Reads the exact vectors of (query_id, vec_id) pairs and scores them; queries are of one block, so of bounded size. With
    wide vectors, also hi and key, by which scores beyond a long are ordered; near is a double close to a score."""
    vectors = rows.select(F.col("id").alias("vec_id"), "v")
    of = F.broadcast(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")))
    both = pairs.join(vectors, "vec_id").join(of, "query_id")
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: a.cast("bigint") * b.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    ids = ["query_id", "vec_id"]
    if not wide:
        return both.select(*ids, product.alias("score")).withColumn("near", F.col("score").cast("double"))
    beyond = _is_wide(F.col("v")) | _is_wide(F.col("qv"))
    short = both.filter(~beyond).select(*ids, F.lit(0).alias("hi"), F.lit("").alias("key"), product.alias("score"))
    long = both.filter(beyond).select(*ids, _wide_score("v", "qv").alias("s")).select(*ids, "s.*")
    return short.withColumn("near", F.col("score").cast("double")).unionByName(long)


def _search(file: DataFrame, rows: DataFrame, queries: DataFrame, grids, k: int, wide: bool) -> DataFrame:
    """The k best of each query of one block."""
    by = ["hi", "key", "score"] if wide else ["score"]
    sc = file.sparkSession.sparkContext
    blocks: dict[int, QueryBlock] = {}
    held = queries.toPandas()
    for d, part in held.groupby(held["v"].map(len)):
        blocks[int(d)] = QueryBlock(part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.float64))
    lows = file.mapInArrow(_floors(grids, sc.broadcast(blocks), k), "query_id bigint, vec_id bigint, low double")
    # one row for each query of the block reaches the driver
    floors = _first_of(lows, ["low"], k + 1).filter(F.col("rank") == k + 1).select("query_id", "vec_id", "low").toPandas().set_index("query_id")
    for block in blocks.values():
        block.floor = floors["low"].reindex(block.ids).fillna(-np.inf).to_numpy(np.float64)
        block.floor_id = floors["vec_id"].reindex(block.ids).fillna(0).to_numpy().astype(np.int64)
    found = file.mapInArrow(_candidates(grids, sc.broadcast(blocks)), "query_id bigint, vec_id bigint, high double")
    found = materialize(found.filter("query_id <> vec_id"), "candidates")
    # read by falling upper bound: the first few give the kth exact score, then all whose bound still reaches it
    read = _first_of(found, ["high"], FIRST_READ * k).select("query_id", "vec_id")
    least = F.min(F.col("near") - F.abs("near") * 2.0**-50) if wide else F.min("near")
    kth = _first_of(_exact(read, rows, queries, wide), by, k).groupBy("query_id").agg(F.when(F.count("*") == k, least).alias("least"))
    kth = F.broadcast(kth)  # at most one row a query of the block
    open_ = found.join(kth, "query_id").filter("least is null or isnan(least) or high >= least").select("query_id", "vec_id")
    return _first_of(_exact(open_, rows, queries, wide), by, k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows but itself, by integer inner product.

    Queries are the rows whose id is divisible by query_every. Ties go to the smaller vec_id. Vectors that are null or
    empty, hold a null or non-finite component, or whose id is null, take no part; nor do those that scale makes infinite. Ranks
    go by exact scores of any size; one that does not fit a long is null. Vectors of different lengths are not compared.
    Rows that share an id are one row, of which the vector that sorts first counts. No rows, no result. Other columns
    are not read. Of equal vectors only the k+1 smallest ids can be in any result, so no more of each are scanned.
    Queries are searched in blocks of block_numbers numbers; a block and its floors are what is broadcast.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), quantize(F.col(vector_col), scale).alias("v"))
    rows = rows.filter("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows, "vectors")
    wide = not rows.filter(_is_wide(F.col("v"))).isEmpty()
    grids = spark.sparkContext.broadcast(learn_grids(rows))
    same = Window.partitionBy("v").orderBy("id")
    file = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("id", "v")
    file = materialize(file.mapInArrow(_to_cells(grids), "id bigint, cells binary"), "approximations")
    queries = rows.filter(F.col("id") % query_every == 0)
    numbers = queries.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    blocks = max(1, -(-numbers // block_numbers))
    if blocks == 1:
        return _search(file, rows, queries, grids, k, wide)
    done = []
    for b in range(blocks):
        mine = materialize(queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), "queries")
        done.append(materialize(_search(file, rows, mine, grids, k, wide), "best"))
        drop_table(mine)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
