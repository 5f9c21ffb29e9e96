"""Shared helpers: reading tables, mapping Arrow batches and deterministic label splits."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of an operator takes at most, besides a single longer text.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files dealt to all cores, where it has fewer partitions than there are cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, a null text as an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each slice's ``column`` holds about ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_steps(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, limit: int = STEP_BYTES, column: str = "text") -> DataFrame:
    """``work`` turns a slice into columns of ``schema``; nothing is kept between slices."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in StructType.fromDDL(schema).fields]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, column, limit):
            got = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(got[n], type=arrow.field(n).type) for n in names], schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that is free in this worker's allocators back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent in other C libraries
        if trim:
            trim(0)


def score_column(score: Callable[[list], np.ndarray], as_bytes: bool, limit: int = STEP_BYTES) -> Callable[[Column], Column]:
    """A vectorised function from a text column to a score; the row's other columns stay in the JVM."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pc.fill_null(texts, "")], names=["text"])
        parts = [score((x.column(0).cast(pa.binary()) if as_bytes else x.column(0)).to_pylist()) for x in steps(iter([batch]), "text", limit)]
        release()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x
