"""Queries of the recording operators. A table is sent through a codec, container, table or join and
compared with SQL on the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.names import table_name_column
from tidelog.operators import temporal
from tidelog.operators.tables import TableStore
from tidelog.sources import recording as R
from tidelog.sources.shared import shared_folder

EVENT = ("tide/Event", "int64 event_id\nint64 user_id\nfloat64 value\nstring props\nstring event_type")
POINT = ("tide/Fixed", "int64 event_id\nint64 user_id\nfloat64 value")
ORDER = ("tide/Order", "int64 o_orderkey\nint64 o_custkey\nfloat64 o_totalprice\nstring o_orderpriority\ntide/Line[] lines\n" + "=" * 80 + "\nMSG: tide/Line\nint32 l_linenumber\nfloat64 l_quantity\nstring l_returnflag")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("_log_time", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def _recording(spark: SparkSession, sf_dir: str, encoding: str = "ros1") -> DataFrame:
    """Events as recordings, a topic for each event type."""
    events = _events(spark, sf_dir)
    kinds = [r.event_type for r in events.select("event_type").distinct().collect()]  # a row a type
    rows = R.encode(events, *EVENT, encoding, kept=["event_type"]).select(F.concat(F.lit("/events/"), "event_type").alias("topic"), "_log_time", "data")
    return R.pack_files(rows, {f"/events/{k}": (*EVENT, encoding) for k in kinds}, spark.sparkContext.defaultParallelism)


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.envelopes(_recording(spark, sf_dir)).groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.min("_log_time").alias("first"), F.max("_log_time").alias("last"))


def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.envelopes(_recording(spark, sf_dir), ["/events/click"])
    return R.decode(found, *EVENT, "ros1").select("_log_time", "event_id", "user_id", "value", "props")


def cdr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.envelopes(_recording(spark, sf_dir, "cdr"), ["/events/view", "/events/error"])
    return R.decode(found, *EVENT, "cdr").select("_log_time", "event_id", "user_id", "value", "props")


def _round_trip(df: DataFrame, kind: tuple[str, str], encoding: str) -> DataFrame:
    coded = R.encode(df, *kind, encoding)
    return R.decode(coded.selectExpr("_log_time", "_log_time AS _publish_time", "0L AS _sequence", "0 AS _channel_id", "data"), *kind, encoding)


def fixed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(_events(spark, sf_dir), POINT, "ros1").select("_log_time", "event_id", "user_id", "value")


def _nested(encoding: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines"))
        orders = _table(spark, sf_dir, "orders").join(lines, "o_orderkey").withColumn("_log_time", F.col("o_orderkey"))
        out = _round_trip(orders, ORDER, encoding)
        return out.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.explode("lines").alias("l")).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "l.*")

    return run


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "user_id", "_log_time", "event_type", "value")
    out = temporal.asof_join(events.filter("event_type = 'purchase'"), events.filter("event_type = 'click'"), ["user_id"], "_log_time", ["event_id", "value"])
    return out.select("event_id", "user_id", F.col("event_id_right").alias("click_id"), F.col("value_right").alias("click_value"))


def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "user_id", "_log_time", "event_type")
    out = temporal.interval_join(events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'"), ["user_id"], "_log_time", "_log_time", 86_400_000_000_000)
    return out.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.resample(_events(spark, sf_dir), "_log_time", 900_000_000_000, ["event_type"], [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")])


def time_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("_log_time", "event_id", "event_type")
    frames = {t: events.filter(F.col("event_type") == t).select("_log_time", "event_id") for t in ("click", "view")}
    return temporal.merged(frames).select("topic", "_log_time", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


def _store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}")


def evolve_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, orders = _store(spark), _table(spark, sf_dir, "orders")
    store.write("orders", orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").cast("int").alias("c")))
    store.write("orders", orders.filter("o_orderkey % 2 <> 0").select("o_orderkey", F.col("o_custkey").alias("c"), "o_orderpriority"), "append")
    return store.read("orders")


def overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, nation = _store(spark), _table(spark, sf_dir, "nation")
    store.write("n", nation)
    store.write("n", nation.filter("n_regionkey = 1"), "overwrite")
    return store.read("n")


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", table_name_column(F.concat(F.lit("/"), "p_name", F.lit("/a-b."), "p_brand")).alias("name"))


NS = "epoch_us(ts) * 1000"
NESTED = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, l_linenumber, l_quantity, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_PAIRS = {
    "rec_topic_counts": (topic_counts, f"SELECT '/events/' || event_type AS topic, count(*) AS messages, min({NS}) AS first, max({NS}) AS last FROM events GROUP BY event_type"),
    "rec_topic_filter": (topic_filter, f"SELECT {NS} AS _log_time, event_id, user_id, value, props FROM events WHERE event_type = 'click'"),
    "rec_cdr_filter": (cdr_filter, f"SELECT {NS} AS _log_time, event_id, user_id, value, props FROM events WHERE event_type IN ('view', 'error')"),
    "rec_fixed_layout": (fixed_layout, f"SELECT {NS} AS _log_time, event_id, user_id, value FROM events"),
    "rec_packed_nested": (_nested("ros1"), NESTED),
    "rec_cdr_nested": (_nested("cdr"), NESTED),
    "rec_asof_join": (asof, "SELECT p.event_id, p.user_id, c.event_id AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"),
    "rec_interval_join": (interval, "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 DAY"),
    "rec_resample": (resampled, f"SELECT event_type, CAST(({NS}) // 900000000000 * 900000000000 AS BIGINT) AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY ALL"),
    "rec_time_merge": (time_merge, f"SELECT event_type AS topic, {NS} AS _log_time, event_id FROM events WHERE event_type IN ('click', 'view')"),
    "rec_evolve_append": (evolve_append, "SELECT o_orderkey, o_custkey AS c, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"),
    "rec_overwrite": (overwrite, "SELECT * FROM nation WHERE n_regionkey = 1"),
    "rec_table_names": (sanitised, "SELECT p_partkey, regexp_replace(regexp_replace('/' || p_name || '/a-b.' || p_brand, '^/+', ''), '[/.-]', '_', 'g') AS name FROM part"),
}
QUERIES = {k: f for k, (f, _) in _PAIRS.items()}
ORACLES = {k: sql for k, (_, sql) in _PAIRS.items()}
