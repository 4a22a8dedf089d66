"""Bitmaps of fixed size that tell executors which rows may matter; they err on one side only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits `h mod 2**bits` of a bigint column `h`, as bytes; of fixed size, whatever the input."""
    bit = F.col("h").bitwiseAND((1 << bits) - 1)
    one = F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(31).cast("int"))
    rows = hashes.select(F.shiftright(bit, 5).cast("int").alias("w"), one.alias("b"))
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # no row objects
    out = np.zeros(1 << (bits - 5), "<u4")
    out[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.int32).view(np.uint32)
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def rows_where(df: DataFrame, id_col: str, shared, inside: bool) -> DataFrame:
    """The rows whose bigint id is, or is not, in a broadcast bitmap."""
    at = df.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(shared.value, batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(run, df.schema)
