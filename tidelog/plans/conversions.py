"""Queries of conversion, export, reports and streams, each compared with SQL on the table it started from."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.protobuf import descriptor_set
from tidelog.operators.export import export_file as write_recording
from tidelog.operators.export import in_order, payloads
from tidelog.sources import recording as R
from tidelog.sources.formats import open_input, write_output
from tidelog.sources.shared import shared_folder
from tidelog.streaming import events as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("_log_time", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _local() -> str:
    return tempfile.mkdtemp(prefix="tidelog-")


def proto_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as Protocol Buffers payloads and back."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines"))
    orders = _table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "lines")
    kind = ("tide.Order", descriptor_set(orders.schema, "tide.Order"), "protobuf")
    coded = R.encode(orders.withColumn("_log_time", F.col("o_orderkey")), *kind)
    out = R.decode(coded.selectExpr("_log_time", "_log_time AS _publish_time", "0L AS _sequence", "0 AS _channel_id", "data"), *kind)
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.explode("lines").alias("l")).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "l.*")


def _topics(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = _events(spark, sf_dir).select("_log_time", "event_id", "user_id", "value", "event_type")
    kinds = sorted(r.event_type for r in events.select("event_type").distinct().collect())  # a row a type
    return {f"/{t}": events.filter(F.col("event_type") == t).drop("event_type") for t in kinds}


def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All topics in the order of an export: time, then the topics' order."""
    ordered = in_order(payloads(_topics(spark, sf_dir))[0])
    return ordered.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.min("_log_time").alias("start"), F.max("_log_time").alias("stop"))


def export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered recording, written and read back, all topics."""
    path = f"{_shared(spark)}.mcap"
    write_recording(_topics(spark, sf_dir), path)
    found = R.topic_frames(R.recording(spark, path))
    return reduce(DataFrame.unionAll, (f.select("_log_time", "event_id", "user_id", "value") for f in found.values()))


def parquet_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics to a folder of Parquet tables, read back as one."""
    folder = _shared(spark)
    write_output(spark, _topics(spark, sf_dir), folder, "parquet")
    source = open_input(spark, folder, "parquet")
    return source.table("click").unionByName(source.table("view")).select("event_id", "user_id", "value")


def two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of one table with different schemas, concatenated."""
    nation, stores = _table(spark, sf_dir, "nation"), [_shared(spark), _shared(spark)]
    write_output(spark, {"n": nation.filter("n_nationkey < 10").select("n_nationkey", "n_name")}, stores[0], "tables")
    write_output(spark, {"n": nation.filter("n_nationkey >= 10")}, stores[1], "tables")
    return open_input(spark, stores, "tables").table("n")


def duckdb_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table to a DuckDB file and back."""
    path = os.path.join(_local(), "t.duckdb")
    write_output(spark, {"supplier": _table(spark, sf_dir, "supplier")}, path, "duckdb")
    return open_input(spark, path).table("supplier")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type, as a stream into Parquet files; windows are written once the watermark is past them, so a far last event, left out again, follows."""
    place, events = _shared(spark), _table(spark, sf_dir, "events")
    events.write.parquet(f"{place}/in/1")
    events.limit(1).withColumn("ts", F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))).write.parquet(f"{place}/in/2")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in").withColumn("at", F.col("ts").cast("timestamp"))
    counts = S.tumbling(stream, "at", "1 hour", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n")])
    S.drain(counts, f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").select(F.expr("unix_seconds(window_start)").alias("hour"), "event_type", "n")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of events without repeats, as a stream into Parquet files."""
    place = _shared(spark)
    S.drain(S.first_seen(_event_stream(spark, sf_dir), "at", "1 day", ["event_id"]).select("event_id", "user_id", "value"), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out")


NS = "epoch_us(ts) * 1000"
_PAIRS = {
    "rec_proto_nested": (proto_nested, "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, l_linenumber, l_quantity, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "rec_export_order": (export_order, f"SELECT '/' || event_type AS topic, count(*) AS messages, min({NS}) AS start, max({NS}) AS stop FROM events GROUP BY event_type"),
    "rec_export_file": (export_file, f"SELECT {NS} AS _log_time, event_id, user_id, value FROM events"),
    "rec_parquet_folder": (parquet_folder, "SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view')"),
    "rec_two_inputs": (two_inputs, "SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 10 THEN n_regionkey END AS n_regionkey FROM nation"),
    "rec_duckdb_file": (duckdb_file, "SELECT * FROM supplier"),
    "stream_windows": (stream_windows, "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_first_seen": (stream_first_seen, "SELECT DISTINCT event_id, user_id, value FROM events"),
}
QUERIES = {k: f for k, (f, _) in _PAIRS.items()}
ORACLES = {k: sql for k, (_, sql) in _PAIRS.items()}
