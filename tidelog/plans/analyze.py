"""The conversion report: each topic's messages and its size in several formats."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.names import duration_text, size_text, table_name
from tidelog.sources import recording as R

#: What a topic is written as: name -> (Spark format, compression). The first is the measure of the others.
FORMATS = {"parquet_zstd": ("parquet", "zstd"), "parquet_snappy": ("parquet", "snappy"), "orc_zstd": ("orc", "zstd"), "json_gzip": ("json", "gzip")}


@dataclass
class Analysis:
    """(topic, messages, bytes) and, for each format, its bytes, null where the topic failed."""

    topics: DataFrame
    seconds: dict[str, float]
    errors: dict[tuple[str, str], str]
    input_bytes: int

    def totals(self) -> dict:
        return self.topics.agg(F.sum("messages").alias("messages"), *(F.sum(f).alias(f) for f in FORMATS)).first().asDict()


def _folder_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def analyze(spark: SparkSession, paths: list[str], out: str, clean: bool = False) -> Analysis:
    """Decodes every topic once a format and measures what it takes. A topic that fails in one format
    is removed there and reported; the rest goes on. ``clean`` removes what was written."""
    messages = R.staged(R.recording(spark, *paths))
    kinds: dict[str, list] = {}
    for r in R.topics_of(messages).collect():  # a row a kind of channel
        kinds.setdefault(r.topic, []).append(r)
    sizes = messages.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("data")).alias("bytes"))
    held = {r.topic: [r.messages, r.bytes] for r in sizes.collect()}  # a row a topic
    seconds, errors = dict.fromkeys(FORMATS, 0.0), {}
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for label, (fmt, compression) in FORMATS.items():
        start = time.time()
        for topic, row in sorted(held.items()):
            folder = f"{out.rstrip('/')}/{label}/{table_name(topic)}"
            try:
                R.topic_frame(messages, topic, kinds=kinds[topic]).write.format(fmt).option("compression", compression).mode("overwrite").save(folder)
                row.append(_folder_bytes(spark, folder))
            except Exception as e:  # the report names it
                errors[topic, label] = f"{type(e).__name__}: {e}".split("\n")[0]
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
                row.append(None)
        seconds[label] = time.time() - start
    ddl = "topic string, messages long, bytes long" + "".join(f", {f} long" for f in FORMATS)
    topics = spark.createDataFrame([(t, *row) for t, row in sorted(held.items())], ddl)
    total = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0
    if clean:
        fs.delete(fs_path, True)
    return Analysis(topics, seconds, errors, total)


def ratio_colour(ratio: float) -> str:
    """Green at 0.5, yellow at 1, red from 2, as a 24-bit ANSI sequence."""
    place = min(max((ratio - 0.5) / 0.5 if ratio <= 1 else 1 + (ratio - 1), 0.0), 2.0)
    red, green = int(255 * min(place, 1)), int(255 * min(2 - place, 1))
    return f"\x1b[38;2;{red};{green};0m"


def report(result: Analysis, colour: bool = False) -> str:
    """The report as text."""
    first = next(iter(FORMATS))

    def cell(value: int | None, base: int | None) -> str:
        if value is None:
            return "FAILED"
        if not base:
            return size_text(value)
        text = f"{size_text(value)} ({value / base:.2f}x)"
        return f"{ratio_colour(value / base)}{text}\x1b[0m" if colour else text

    rows = [["topic", "messages", *FORMATS]]
    for r in result.topics.orderBy("topic").collect():  # a row a topic
        rows.append([r.topic, str(r.messages), *(cell(r[f], r[first] if f != first else None) for f in FORMATS)])
    total = result.totals()
    rows.append(["total", str(total["messages"] or 0), *(cell(total[f], result.input_bytes) for f in FORMATS)])
    rows.append(["time", "", *(duration_text(result.seconds[f]) for f in FORMATS)])
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows]
    return "\n".join([f"input: {size_text(result.input_bytes)}", *lines, *(f"FAILED {t} as {f}: {e}" for (t, f), e in sorted(result.errors.items()))])
