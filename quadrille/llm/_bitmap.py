"""A hash set of fixed size that is built on the executors: a prefilter without false negatives.

`BITS` bits (8 MB) whatever the number of values, so that it may be broadcast; the more values, the fewer rows it
holds back, and none is ever lost by it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _text

BITS = 1 << 26
CHUNKS = 64
_STEP = BITS // 8 // CHUNKS


def _cell(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(38)).astype(np.int64)


def build(values: DataFrame) -> np.ndarray:
    """The set of all 64-bit hashes in the first column, as packed bits."""
    def fill(batches):
        packed = np.zeros(BITS // 8, dtype=np.uint8)
        some = False
        for batch in batches:
            cell = _cell(batch.column(0).to_numpy(zero_copy_only=False))
            some |= bool(len(cell))
            np.bitwise_or.at(packed, cell >> 3, (128 >> (cell & 7)).astype(np.uint8))
        if some:
            packed = packed.reshape(CHUNKS, _STEP)
            full = np.flatnonzero(packed.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[i].tobytes() for i in full], pa.binary())], names=["chunk", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, bits in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(bits, np.uint8)
                held[chunk] = held[chunk] | new if chunk in held else new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((CHUNKS, _STEP), dtype=np.uint8)
    for r in values.mapInArrow(fill, "chunk int, bits binary").repartition("chunk").mapInArrow(merge, "chunk int, bits binary").collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False only for hashes that aren't in the set."""
    cell = _cell(h)
    return (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def sieve(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable]:
    """The rows (doc_id, ...) with one column more, and what makes of their batches those of the rows as they were whose
    doc_id may be in `ids` (or surely isn't): to be called in another mapInArrow, which then needs no second Python worker."""
    shared = rows.sparkSession.sparkContext.broadcast(build(ids.select(F.xxhash64(F.col("doc_id").cast("long")))))

    last = "_" + max(rows.columns, key=len)  # no column's name

    def chosen(batches, inside: bool = True):
        for batch in batches:
            keep = holds(shared.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)) == inside
            yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(keep)) for c in batch.columns[:-1]], schema=pa.schema(list(batch.schema)[:-1]))

    return rows.withColumn(last, F.xxhash64(F.col("doc_id").cast("long"))), chosen


def split(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, ...) whose doc_id may be in `ids`, and those whose doc_id surely isn't.

    The first has all rows that are in, and few others while the set isn't full; put before a join on
    doc_id, it spares the shuffle of rows that the join would drop or leave as they are."""
    marked, chosen = sieve(rows, ids)

    def part(inside: bool):
        def run(batches):
            _text.release()
            yield from chosen(batches, inside)
            _text.release()

        return marked.mapInArrow(run, rows.schema)

    return part(True), part(False)


def likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The first part of `split`."""
    return split(rows, ids)[0]
