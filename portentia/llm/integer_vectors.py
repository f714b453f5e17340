"""Vectors of integer codes, numbered rows, and query sets that meet all rows block by block.

Component x of a vector is the code floor(scale * x), x as double; codes and inner products saturate at the limits of a
long. Rows whose vector is null or holds a null or non-finite component take no part. Vectors meet vectors of their own
length only; empty ones have inner products of 0. Rows are told apart by a number given when the table is written, so
repeated ids and equal rows stay rows of their own; rows with a null id sort after all others of their score.

A query set may be of any size: it is packed into blocks of at most QUERY_BYTES of vectors, and every block goes to the
executors by itself (the only data broadcast), over one scan of the other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.runtime import run_dir, stage

#: Vectors, as 64-bit integers, of one block of queries.
QUERY_BYTES = 4 << 20
#: Rows that a task handles at a time.
BLOCK_ROWS = 16_384
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Up to this, sums of products are exact as doubles.
EXACT = 1 << 53


def codes(vector: Column, scale: int = 256) -> Column:
    """The integer codes of an array of floating-point numbers."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Is the vector there, with finite components only?"""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def numbered(df: DataFrame, key: str, vector: str, scale: int = 256, **others: Column) -> DataFrame:
    """uid, id, `others` and codes (packed little-endian 64-bit integers) of the usable rows, as a written table."""
    rows = df.where(usable(df[vector])).select(
        df[key].cast("long").alias("id"), *[c.alias(n) for n, c in others.items()], codes(df[vector], scale).alias("codes")
    )
    names = [n for n in rows.columns if n != "codes"]
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.drop("codes").dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("codes")
            offsets = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64) * 8
            data = pa.py_buffer(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")))
            packed = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), data])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], packed.cast(pa.binary())], names=[*names, "codes"])

    table = rows.mapInArrow(pack, f"{fields}, codes binary")
    return stage(table.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def by_length(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of every length that occurs."""
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def matrix(column: pa.Array, dtype: str = "<i8") -> np.ndarray:
    """Packed vectors of equal length as the rows of a matrix."""
    width = len(column[0].as_py()) // np.dtype(dtype).itemsize if len(column) else 0
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), width)


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of every binary value."""
    import pyarrow.compute as pc

    return np.asarray(pc.binary_length(column), dtype=np.int64)


def id_order(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whether they are missing."""
    missing = np.asarray(column.is_null())
    return np.asarray(column.fill_null(MOST), dtype=np.int64), missing


def largest(m: np.ndarray) -> int:
    """Largest absolute value."""
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-by-row inner products of integer matrices, exact, saturating at the limits of a long."""
    if a.shape[1] * largest(a) * largest(b) < EXACT:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    whole = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([min(max(int(x), LEAST), MOST) for x in whole], dtype=np.int64)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """The batches in blocks of about `rows` rows, whatever batch size the session has."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass(frozen=True)
class Queries:
    """One block of queries of one length: row numbers, vectors, and the values of other columns."""

    uid: np.ndarray
    vectors: np.ndarray
    others: dict[str, list]


def packed(queries: DataFrame) -> DataFrame:
    """Queries (uid, codes, ...) as rows (block, payload), each an Arrow stream of vectors of one length."""
    total = queries.agg(F.sum(F.octet_length("codes") + 64)).first()[0] or 0
    dealt = queries.coalesce(int(total // QUERY_BYTES + 1))
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 1 << 16):
            for size, at in by_length(lengths(table.column("codes").combine_chunks())):
                most = max(1, QUERY_BYTES // max(size, 64))
                for first in range(0, len(at), most):
                    block = table.select(names).take(pa.array(at[first : first + most]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, block.schema) as out:
                        out.write_table(block)
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["payload"])

    return stage(dealt.mapInArrow(run, "payload binary").withColumn("block", F.monotonically_increasing_id()), "queries")


def meet_all(queries: DataFrame, rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(Queries, batches of `rows`) for every block of queries, over all rows: the union of its results.

    The driver holds the numbers of the blocks and one block at a time.
    """
    spark = queries.sparkSession
    blocks = packed(queries)
    path = run_dir(spark, "met")
    spark.createDataFrame([], schema).write.parquet(path)
    for (number,) in blocks.select("block").collect():
        payload = bytes(blocks.where(F.col("block") == number).first()["payload"])
        sent = spark.sparkContext.broadcast(payload)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
            others = {n: table.column(n).to_pylist() for n in table.column_names if n not in ("uid", "codes")}
            yield from kernel(Queries(np.asarray(table.column("uid")), matrix(table.column("codes")), others), batches)

        rows.mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path)
