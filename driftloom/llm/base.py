"""Shared pieces of the operators: tables, queries and bounded bit sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(column.cast("string")) % folds, F.lit(0))


def bit_set(hashed: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bit set of fixed size (2 ** log2_bits) over 64-bit hashes; two bits each. It only lets more through as it fills.

    The cells are ORed by Spark; the driver sees 2 ** log2_bits / 64 numbers at most.
    """
    size = (1 << log2_bits) - 1
    h = F.col(column)
    cells = hashed.select(F.explode(F.array(h.bitwiseAND(size), F.shiftrightunsigned(h, 23).bitwiseAND(size))).alias("cell"))
    rows = (cells.groupBy(F.shiftright("cell", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")))
    bits = np.zeros((1 << log2_bits) // 64, dtype=np.int64)
    found = rows.toArrow()
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


__all__ = ["QUERIES", "ORACLES", "query", "table", "fold", "bit_set", "cut"]
