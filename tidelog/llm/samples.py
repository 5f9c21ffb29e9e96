"""Bounded samples of labelled texts, and models that one task fits on them.

A sample takes at most a stated number of rows of each class, those with the lowest hash of their id, and of
these as many, in that order, as hold a stated number of characters together; rows whose texts would exceed it are passed
over as a whole, so no text is cut. The model is fitted in a worker, so the texts never come to the driver, and a
lost executor costs one task's repetition; the driver gets the fitted parameters only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import crc_mod, release

#: Characters of all texts of a sample together.
SAMPLE_CHARS = 24_000_000


def labelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, apart: int, per_class: dict[int | None, int], chars: int = SAMPLE_CHARS) -> DataFrame:
    """(label, text) of at most ``per_class`` labelled rows of each class (None: of any) whose crc32 remainder is not ``apart``.
    Rows with a null id or label are not used; an id with several texts or labels counts with each."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    usable = usable.dropna().filter(crc_mod("doc_id", mod) != apart).dropDuplicates(["doc_id", "label"])
    parts = [(usable if y is None else usable.filter(F.col("label") == y)).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id", "label").limit(n) for y, n in per_class.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id", "label"])  # at most the sum of per_class rows
    order = Window.orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sum", F.sum(F.length("text")).over(order)).filter(F.col("sum") <= chars).select("label", "text")


def lowest(texts: Column, df: DataFrame, rows: int, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(label, text) of at most ``rows`` distinct texts, those of lowest hash, within ``chars`` characters; the label is 0.
    The driver sees a hash and a length for each."""
    own = df.select(F.coalesce(texts.cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text", F.lit(17)).alias("hash"), "text")
    kept, sum_ = [], 0
    for r in own.select("hash", F.length("text").alias("n")).distinct().orderBy("hash", "n").limit(rows).collect():
        sum_ += r.n
        if sum_ <= chars:
            kept.append((r.hash,))
    chosen = df.sparkSession.createDataFrame(kept, "hash long")
    return own.join(F.broadcast(chosen), "hash").dropDuplicates(["hash"]).select(F.lit(0).alias("label"), "text")


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], object]) -> object | None:
    """What ``fit`` makes of the texts and labels of a bounded sample, in one task; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []
        texts: list[str] = []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if texts:
            order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))  # whatever order they came in
            model = pickle.dumps(fit([texts[i] for i in order], [labels[i] for i in order]))
            del texts, labels
            release()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()  # a row at most, of the model's size
    return pickle.loads(bytes(got[0].model)) if got else None
