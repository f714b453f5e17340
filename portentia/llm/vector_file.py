"""Exact top-k inner products by a vector-approximation file.

The file holds, for every row, one byte a component (the cell of its code) and the exact codes. Cells are integer
intervals: up to CELLS a component, equally wide within four standard deviations of its mean and ending at its smallest
and largest code, which one pass over all rows measures. For a query, the cells of a row bound its score from below and
above. Each task scans the cells of its rows block by block, takes the k-th largest lower bound or the k-th score so far,
whichever is more, as the limit, and reads the exact codes only of rows whose upper bound reaches it, largest upper
bound first, until no row left can enter the first k (ties go to the smaller id). The first k of all tasks give the result.

A task keeps k rows a query, whatever the number of copies or ties. Queries come in blocks (see integer_vectors).

Cases: see integer_vectors for unusable vectors, lengths, null and repeated ids; a query never meets its own row but
meets equal ones; with fewer rows than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portentia.llm import integer_vectors as V
from portentia.runtime import stage

CELLS = 256
#: Query vectors that are compared with a block of rows at a time.
QUERY_ROWS = 256
FOUND = "query_uid long, id long, score long"


@dataclass(frozen=True)
class Grid:
    """Cells of the vectors of one length: edges by component, smallest and largest code of every cell, packed width."""

    edges: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    dtype: str

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell numbers, one byte each, of the rows of a matrix of codes."""
        out = np.empty(vectors.shape, dtype=np.uint8)
        for k, edge in enumerate(self.edges):
            out[:, k] = np.searchsorted(edge, vectors[:, k], side="right")
        return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length: rows, and smallest, largest, sum and sum of squares of every component."""
    held: dict[int, list] = {}
    for table in V.gathered(batches):
        column = table.column("codes").combine_chunks()
        for size, at in V.by_length(V.lengths(column)):
            if size:
                m = V.matrix(column.take(pa.array(at)))
                real = m.astype(np.float64)
                new = [len(at), m.min(axis=0), m.max(axis=0), real.sum(axis=0), (real * real).sum(axis=0)]
                old = held.get(size)
                held[size] = new if old is None else [
                    old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), old[3] + new[3], old[4] + new[4]
                ]
    for size, (n, low, high, total, squares) in held.items():
        dims = size // 8
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(dims, dims, dtype=np.int32)), pa.array(np.arange(dims, dtype=np.int32)),
                pa.array(np.full(dims, n, dtype=np.int64)), pa.array(low), pa.array(high), pa.array(total), pa.array(squares),
            ],
            names=["dims", "at", "n", "low", "high", "total", "squares"],
        )


def grids(vectors: DataFrame, cells: int = CELLS) -> dict[int, Grid]:
    """The grid of every vector length; the driver sees five numbers a component, not rows."""
    measured = vectors.select("codes").mapInArrow(
        _measure, "dims int, at int, n long, low long, high long, total double, squares double"
    ).groupBy("dims", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    out: dict[int, list] = {}
    for row in measured.orderBy("dims", "at").collect():
        out.setdefault(row.dims, []).append(row)
    return {dims: _grid(rows, cells) for dims, rows in out.items()}


def _grid(rows: list, cells: int) -> Grid:
    edges, lows, highs = [], np.zeros((len(rows), cells)), np.zeros((len(rows), cells))
    for k, r in enumerate(rows):
        mean = r.total / r.n
        spread = 4 * max(r.squares / r.n - mean * mean, 0.0) ** 0.5
        first, last = max(float(r.low), mean - spread), min(float(r.high), mean + spread)
        steps = [int(x) for x in np.ceil(np.linspace(first, last, cells - 1))]
        edge = np.unique(np.array([min(max(x, r.low + 1), r.high) for x in steps if r.low < r.high], dtype=np.int64))
        edges.append(edge)
        lows[k, : len(edge) + 1] = [r.low, *edge.tolist()]
        highs[k, : len(edge) + 1] = [*(x - 1 for x in edge.tolist()), r.high]
    most = max(max(abs(r.low), abs(r.high)) for r in rows)
    dtype = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return Grid(edges, lows, highs, dtype)


def build(vectors: DataFrame, cells: int = CELLS) -> tuple[DataFrame, dict[int, Grid]]:
    """The approximation file of numbered vectors, written: uid, id, dims, cells, exact; and its grids."""
    made = grids(vectors, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in V.gathered(batches):
            column = table.column("codes").combine_chunks()
            for size, at in V.by_length(V.lengths(column)):
                rows = pa.array(at)
                if size:
                    grid = made[size // 8]
                    m = V.matrix(column.take(rows))
                    near, exact = _packed(grid.cells(m)), _packed(m.astype(grid.dtype))
                else:
                    near = exact = pa.array([b""] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("uid").take(rows).combine_chunks(), table.column("id").take(rows).combine_chunks(),
                        pa.array(np.full(len(at), size // 8, dtype=np.int32)), near, exact,
                    ],
                    names=["uid", "id", "dims", "cells", "exact"],
                )

    file = vectors.select("uid", "id", "codes").mapInArrow(run, "uid long, id long, dims int, cells binary, exact binary")
    return stage(file, "cells"), made


def _packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    step = m.shape[1] * m.itemsize
    offsets = np.arange(len(m) + 1, dtype=np.int64) * step
    data = pa.py_buffer(np.ascontiguousarray(m))
    return pa.Array.from_buffers(pa.large_binary(), len(m), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


class Best:
    """The first k rows of every query so far, by score, then id (missing ids last)."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), V.LEAST)
        self.id = np.full((queries, k), V.MOST)
        self.missing = np.ones((queries, k), dtype=bool)
        self.real = np.zeros((queries, k), dtype=bool)

    def limit(self, at: np.ndarray | slice) -> np.ndarray:
        """The k-th score, -infinity with fewer rows."""
        return np.where(self.real[at, -1], self.score[at, -1].astype(np.float64), -np.inf)

    def behind(self, at: np.ndarray, upper: np.ndarray, missing: np.ndarray, id_: np.ndarray) -> np.ndarray:
        """Can rows with these upper bounds and ids enter the first k no more?"""
        last, score = self.real[at, -1], self.score[at, -1].astype(np.float64)
        later = (missing & ~self.missing[at, -1]) | ((missing == self.missing[at, -1]) & (id_ >= self.id[at, -1]))
        return last & ((upper < score) | ((upper == score) & later))

    def add(self, at: np.ndarray, score: np.ndarray, missing: np.ndarray, id_: np.ndarray, real: np.ndarray) -> None:
        """Merge rows, (len(at), any number), into the queries at distinct positions."""
        k = self.score.shape[1]
        both = [
            np.concatenate([old[at], new], axis=1)
            for old, new in ((self.score, score), (self.missing, missing), (self.id, id_), (self.real, real))
        ]
        order = np.lexsort((both[2], both[1], ~both[0], ~both[3]), axis=-1)[:, :k]
        for old, new in zip((self.score, self.missing, self.id, self.real), both):
            old[at] = np.take_along_axis(new, order, axis=1)


def scan(queries: V.Queries, at: slice, grid: Grid, block: dict[str, np.ndarray], k: int, best: Best) -> None:
    """Let the queries in a slice meet one block of rows of their length."""
    q = queries.vectors[at].astype(np.float64)
    k_rows = np.arange(grid.low.shape[0])
    low, high = grid.low[k_rows, block["cells"]], grid.high[k_rows, block["cells"]]
    middle, half = q @ (low + high).T, np.abs(q) @ (high - low).T  # both twice the value
    scale = np.abs(q) @ np.maximum(np.abs(grid.low), np.abs(grid.high)).max(axis=1)
    slack = np.where(scale < V.EXACT / 8, 0.0, scale * 2.0**-40)[:, None]  # rounding of larger sums
    upper, lower = (middle + half) / 2 + slack, (middle - half) / 2 - slack
    own = np.isin(block["uid"], queries.uid[at])
    if own.any():
        mine = queries.uid[at][:, None] == block["uid"][own][None, :]
        for bounds in (upper, lower):
            bounds[:, own] = np.where(mine, -np.inf, bounds[:, own])
    limit = best.limit(at)
    if upper.shape[1] > k:
        limit = np.maximum(limit, np.partition(lower, -k, axis=1)[:, -k])
    of, row = np.nonzero((upper >= limit[:, None]) & (upper > -np.inf))
    order = np.lexsort((block["id"][row], block["missing"][row], -upper[of, row], of))
    of, row = of[order], row[order]
    edges = np.searchsorted(of, np.arange(len(q) + 1))
    here, stop, base = edges[:-1].copy(), edges[1:], at.start
    active = np.flatnonzero(here < stop)
    while len(active):
        first = row[here[active]]
        go = ~best.behind(active + base, upper[active, first], block["missing"][first], block["id"][first])
        active = active[go]
        if not len(active):
            break
        reads = here[active][:, None] + np.arange(k)
        real = reads < stop[active][:, None]
        rows = row[np.minimum(reads, len(row) - 1)]
        flat = real.ravel()
        score = np.full(flat.shape, V.LEAST)
        exact = block["exact"][rows.ravel()[flat]]
        score[flat] = V.products(queries.vectors[np.repeat(active + base, k)[flat]], exact)
        best.add(active + base, score.reshape(reads.shape), block["missing"][rows] | ~real, np.where(real, block["id"][rows], V.MOST), real)
        here[active] += k
        active = active[here[active] < stop[active]]


def _searcher(made: dict[int, Grid], k: int):
    def kernel(queries: V.Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = queries.vectors.shape[1]
        best = Best(len(queries.uid), k)
        for table in V.gathered(batches):
            table = table.filter(pa.array(np.asarray(table.column("dims")) == dims)).combine_chunks()
            if not table.num_rows:
                continue
            id_, missing = V.id_order(table.column("id").combine_chunks())
            if dims:
                cells, exact, grid = V.matrix(table.column("cells"), "u1"), V.matrix(table.column("exact"), made[dims].dtype), made[dims]
            else:
                cells = exact = np.zeros((len(id_), 0), dtype=np.int64)
                grid = Grid([], np.zeros((0, 1)), np.zeros((0, 1)), "<i2")
            block = {"uid": np.asarray(table.column("uid")), "id": id_, "missing": missing, "cells": cells, "exact": exact}
            for first in range(0, len(queries.uid), QUERY_ROWS):
                scan(queries, slice(first, min(first + QUERY_ROWS, len(queries.uid))), grid, block, k, best)
        if best.real.any():
            ids = pa.array(best.id[best.real], mask=best.missing[best.real])
            uid = np.repeat(queries.uid, best.real.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(uid), ids, pa.array(best.score[best.real])], names=["query_uid", "id", "score"])

    return kernel


def first_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; tasks drop what cannot be among them before the exchange."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of largest inner product with each row for which `is_query` holds."""
    vectors = V.numbered(df, key, vector, scale, is_query=F.coalesce(is_query, F.lit(False)))
    file, made = build(vectors, cells)
    queries = vectors.where("is_query").select("uid", "codes")
    found = V.meet_all(queries, file, _searcher(made, k), FOUND)
    ranked = first_rows(found, ["query_uid"], k)
    names = vectors.where("is_query").select(F.col("uid").alias("query_uid"), F.col("id").alias("query_id"))
    return ranked.join(names, "query_uid").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
