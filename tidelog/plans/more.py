"""Queries of operators that the other modules leave out: mixed channels, ties, nulls, evolution of folders, metadata, ranges of
times, arrays and times on the wire, functions for SQL, sessions, and the front end's dialect."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.cli import counted
from tidelog.functions.protobuf import descriptor_set
from tidelog.operators import temporal
from tidelog.operators.evolution import can_widen, compare_schemas
from tidelog.operators.export import export_file, log_time
from tidelog.operators.tables import TableStore
from tidelog.plans.analyze import analyze
from tidelog.plans.front import qualify, run_sql
from tidelog.sources import recording as R
from tidelog.sources.formats import open_input, write_output
from tidelog.sources.shared import shared_folder
from tidelog.streaming import events as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("_log_time", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _written(spark: SparkSession, frames: dict[str, DataFrame], encoding: str = "ros1", metadata: dict | None = None) -> str:
    """One ordered recording in the shared folder."""
    path = f"{_folder(spark)}.mcap"
    export_file(frames, path, encoding, metadata=metadata)
    return path


def mixed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic whose channels differ in encoding, order of fields and width; each is decoded by its own schema."""
    events = _events(spark, sf_dir).filter("event_type IN ('click', 'view')")
    kinds = {"click": ("t/A", "int32 event_id\nint64 user_id", "ros1"), "view": ("t/B", "int64 user_id\nint64 event_id\nfloat64 value", "cdr")}
    files = []
    for k, kind in kinds.items():
        rows = events.filter(F.col("event_type") == k).withColumn("event_id", F.col("event_id").cast("int" if k == "click" else "long"))
        files.append(R.pack_files(R.encode(rows, *kind).withColumn("topic", F.lit("/mixed")), {"/mixed": kind}, 2))
    return R.topic_frame(R.envelopes(reduce(DataFrame.unionAll, files)), "/mixed").select("_log_time", "event_id", "user_id", "value")


def all_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic of a recording, decoded from one pass and put together again."""
    events = _events(spark, sf_dir).select("_log_time", "event_id", "user_id", "value", "event_type")
    frames = {f"/{r.event_type}": events.filter(F.col("event_type") == r.event_type).drop("event_type") for r in events.select("event_type").distinct().collect()}  # a row a type
    found = R.topic_frames(R.recording(spark, _written(spark, frames)))
    return reduce(DataFrame.unionAll, (f.select(F.lit(t).alias("topic"), "_log_time", "event_id", "user_id", "value") for t, f in found.items()))


def _packed(spark: SparkSession, sf_dir: str) -> str:
    events = _events(spark, sf_dir).select("_log_time", "event_id", "user_id", "value")
    return _written(spark, {"/events": events})


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of one week, read by ranges of chunks."""
    day = 86_400_000_000_000
    start = 1_704_067_200_000_000_000  # 2024-01-01
    found = R.recording(spark, _packed(spark, sf_dir), since=start + 7 * day, until=start + 14 * day - 1, range_bytes=1 << 20)
    return R.topic_frame(found, "/events").select("_log_time", "event_id", "user_id", "value")


def column_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of a message in the layout that ends with the log time; the others are passed over."""
    return R.topic_frame(R.recording(spark, _packed(spark, sf_dir)), "/events", columns=["user_id", "event_id"], layout="tail").select("user_id", "event_id", "_log_time")


ARRAYS = "time at\nduration span\nbool odd\nfloat64[] prices\nuint16[3] three\nuint8[] raw\nstring[] words\nt/Pair[] pairs\nt/None none\nuint64 big\n" + "=" * 80 + "\nMSG: t/Pair\nint8 n\nstring s\n" + "=" * 80 + "\nMSG: t/None\n"


def _arrays_times(encoding: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Times, bools, arrays of every kind and an empty type, encoded and decoded."""
        lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice")).alias("prices"), F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("byte").alias("n"), F.col("l_returnflag").alias("s")))).alias("pairs"))
        rows = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("o_orderkey").alias("_log_time"), (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400_000_000_000 + F.col("o_orderkey")).alias("at"), (-F.col("o_custkey") * 1_000_000_007).alias("span"), (F.col("o_orderkey") % 2 == 1).alias("odd"),
            "prices", F.array(*((F.col("o_custkey") % m).cast("int") for m in (7, 11, 60000))).alias("three"), F.encode("o_orderpriority", "UTF-8").alias("raw"), F.split("o_orderpriority", "-").alias("words"), "pairs", F.col("o_orderkey").cast("decimal(20,0)").alias("big"),
        )
        kind = ("t/Root", ARRAYS, encoding)
        out = R.decode(R.encode(rows, *kind).selectExpr("_log_time", "_log_time AS _publish_time", "0L AS _sequence", "0 AS _channel_id", "data"), *kind)
        return out.select(F.col("_log_time").alias("o_orderkey"), "at", "span", "odd", F.size("prices").alias("n"), F.element_at("prices", -1).alias("most"), F.array_join(F.col("three").cast("array<string>"), ",").alias("three"), F.decode("raw", "UTF-8").alias("raw"), F.array_join("words", "|").alias("words"), F.expr("array_join(transform(pairs, p -> concat(p.n, p.s)), ',')").alias("pairs"), F.col("big").cast("long").alias("big"))

    return run


def _metadata(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The tables of channels and schemas that a conversion to tables writes beside the topics."""
        nation = _table(spark, sf_dir, "nation").withColumn("_log_time", F.col("n_nationkey").cast("long"))
        frames = {f"/region/{r}": nation.filter(F.col("n_regionkey") == r).select("_log_time", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name") for r in range(5)}
        path, folder = _written(spark, frames, metadata={t: {"unit": t[-1]} for t in frames}), _folder(spark)
        source = open_input(spark, path, "mcap")
        write_output(spark, source.chosen(None) | {n: source.table(n) for n in ("_channels", "_schemas")}, folder, "tables")
        found = open_input(spark, folder, "tables").table(name)
        return found.select("topic", "message_encoding", "metadata") if name == "_channels" else found.select("encoding", F.decode("data", "UTF-8").alias("text")).distinct()

    return run


def proto_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol Buffers messages through a recording."""
    events = _events(spark, sf_dir).select("_log_time", "event_id", "user_id", "value", "props")
    return R.topic_frame(R.recording(spark, _written(spark, {"/events": events}, "protobuf")), "/events").select("_log_time", "event_id", "user_id", "value", "props")


def export_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one time keep their own sequence, topic by topic."""
    events = _events(spark, sf_dir)
    frames = {f"/{t}": events.filter(F.col("event_type") == t).select(F.lit(5).cast("long").alias("_log_time"), (F.col("_log_time") + 1).alias("_publish_time"), F.col("event_id").alias("_sequence"), "user_id") for t in ("click", "error")}
    found = R.recording(spark, _written(spark, frames))
    return found.select("topic", "_log_time", "_publish_time", "_sequence")


def export_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic without own sequences gets running numbers in the order of time."""
    events = _events(spark, sf_dir).filter("event_type = 'error'").select("_log_time", "event_id")
    return R.topic_frame(R.recording(spark, _written(spark, {"/error": events})), "/error").select(F.col("_sequence").alias("n"), "_log_time")


def asof_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys and times equal nothing."""
    events = _events(spark, sf_dir).select("event_id", F.expr("nullif(user_id % 5, 0)").alias("user.k"), F.expr("CASE WHEN event_id % 7 <> 0 THEN event_id END").alias("at"), "event_type")
    out = temporal.asof_join(events.filter("event_type = 'purchase'"), events.filter("event_type = 'click'"), ["user.k"], "at", ["event_id"])
    return out.select("event_id", F.col("event_id_right").alias("click_id"))


def parquet_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends to a folder of Parquet tables that widen a column and add one."""
    folder, orders = _folder(spark), _table(spark, sf_dir, "orders")

    def narrow(rest: int, kind: str) -> Column:
        """Rows whose customer key (or null) the type holds; the others are appended once the column is wide enough."""
        return F.coalesce((F.col("o_orderkey") % 3 == rest) & (F.col("o_custkey").isNull() | F.col("o_custkey").try_cast(kind).isNotNull()), F.lit(False))

    first, second = narrow(0, "int"), narrow(1, "smallint")
    write_output(spark, {"o": orders.filter(first).select("o_orderkey", F.col("o_custkey").cast("int").alias("c"))}, folder, "parquet")
    write_output(spark, {"o": orders.filter(second).select("o_orderkey", F.col("o_custkey").cast("smallint").alias("c"))}, folder, "parquet", "append")
    last = orders.filter(~first & ~second).select("o_orderkey", F.col("o_custkey").cast("long").alias("c"), F.when(F.col("o_orderkey") % 3 == 2, F.col("o_orderstatus")).alias("o_orderstatus"))
    write_output(spark, {"o": last}, folder, "parquet", "append")
    return open_input(spark, folder, "parquet").table("o")


def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each chosen table of a store, those of metadata left out."""
    folder = _folder(spark)
    write_output(spark, {n: _table(spark, sf_dir, n) for n in ("supplier", "nation", "region")} | {"_channels": _table(spark, sf_dir, "region").limit(1)}, folder, "tables")
    return spark.createDataFrame(sorted(counted(open_input(spark, folder, "tables").chosen(None)).items()), "name string, n long")


def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each topic, and of all."""
    events = _events(spark, sf_dir)
    coded = R.encode(events, "t/E", "int64 event_id", "ros1", kept=["event_type"]).withColumnRenamed("event_type", "topic")
    kinds = [r.topic for r in coded.select("topic").distinct().collect()]  # a row a type
    found = R.envelopes(R.pack_files(coded, {k: ("t/E", "int64 event_id", "ros1") for k in kinds}))
    return found.rollup("topic").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("topic").alias("topics"), F.sum(F.length("data")).alias("bytes"))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion report's topics: those whose size is known in every format."""
    frames = {f"/r{r}": _table(spark, sf_dir, "nation").filter(F.col("n_regionkey") == r).select(F.col("n_nationkey").cast("long").alias("_log_time"), "n_name") for r in (1, 2)}
    found = analyze(spark, [_written(spark, frames)], _folder(spark), clean=True).topics
    return found.select("topic", "messages", (F.least("parquet_zstd", "parquet_snappy", "orc_zstd", "json_gzip") > 0).alias("sized"))


def widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which types widen to which, and what two of them merge to."""
    ladder = ["tinyint", "smallint", "int", "bigint", "float", "double", "string"]
    rows = []
    for a in ladder:
        for b in ladder:
            x, y = (T.StructType.fromDDL(f"c {t}") for t in (a, b))
            up, down = can_widen(x["c"].dataType, y["c"].dataType), can_widen(y["c"].dataType, x["c"].dataType)
            rows.append((a, b, up, compare_schemas(x, y).merged["c"].dataType.simpleString() if up or down else None))
    return spark.createDataFrame(rows, "a string, b string, widens boolean, merged string")


def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log times of time stamps as nanoseconds."""
    return log_time(_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("_log_time")))


def wire_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads encoded and decoded by functions that SQL calls."""
    kind = ("t/N", "int64 k\nstring name", "cdr")
    spark.udf.register("tide_encode", R.encoder(*kind))
    spark.udf.register("tide_decode", R.decoder(*kind))
    _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS k", "n_name AS name").createOrReplaceTempView("tide_nation")
    return spark.sql("SELECT d.k, d.name, size FROM (SELECT tide_decode(p) AS d, octet_length(p) AS size FROM (SELECT tide_encode(struct(k, name)) AS p FROM tide_nation))")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of several appends, compacted."""
    store, nation = TableStore(spark, _folder(spark)), _table(spark, sf_dir, "nation")
    store.write("n", nation.filter("n_regionkey = 0").select("n_nationkey"))
    for r in (1, 2, 3):
        store.write("n", nation.filter(F.col("n_regionkey") == r).select("n_nationkey", "n_name"), "append")
    store.compact("n")
    return store.read("n")


STATE_BYTES = 2 << 20  # of the events' files for each partition of the state; a task sorts its partition's rows


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events that are less than a day apart, as a stream into Parquet files; a last far event, left out again, closes them all."""
    schema, place = _table(spark, sf_dir, "events").schema, _folder(spark)
    _table(spark, sf_dir, "events").limit(1).withColumn("ts", F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))).withColumn("user_id", F.lit(-1).cast("long")).write.parquet(f"{place}/in/2")
    _table(spark, sf_dir, "events").coalesce(1).write.parquet(f"{place}/in/1")
    first, last = (spark.read.parquet(f"{place}/in/{i}").inputFiles()[0] for i in (1, 2))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{place}/in").withColumn("at", F.col("ts").cast("timestamp"))
    found = S.sessions(stream.filter("user_id IS NOT NULL"), "at", "1 day", "3650 days", ["user_id"], [F.count(F.lit(1)).alias("n")])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/in/1")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    S.drain(found, f"{place}/out", f"{place}/state", partitions=max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // STATE_BYTES)))
    assert first != last
    return spark.read.parquet(f"{place}/out").filter("user_id >= 0").select("user_id", F.unix_micros("session_start").alias("start"), "n")


def _front(text: str, *tables: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            _table(spark, sf_dir, t).createOrReplaceTempView(t)
        return run_sql(spark, text)

    return run


def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The helper for QUALIFY."""
    return qualify(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)", "__value = 1").select("o_custkey", "o_orderkey")


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches, compared with the exact values within their error. Distinct keys and prices are counted by shuffles of their own. The exact median's ranks lie between the
    approximate quantiles 0.49 and 0.51 (their error is a thousandth of the rows), so of prices outside only the number is kept, and the few inside are ranked."""
    flag = "l_returnflag"
    lines = _table(spark, sf_dir, "lineitem").select(flag, "l_partkey", "l_extendedprice")
    price = F.col("l_extendedprice")
    sketched = lines.groupBy(flag).agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("near_keys"), F.percentile_approx(price, F.array(F.lit(0.5), F.lit(0.49), F.lit(0.51)), 1000).alias("q"), F.max(price).alias("top"), F.count(price).alias("n")
    )
    keys = lines.select(flag, "l_partkey").distinct().groupBy(flag).agg(F.count("l_partkey").alias("keys"))
    limits = sketched.select(F.col(flag).alias("f"), F.col("q")[1].alias("low"), F.col("q")[2].alias("high"), "n")
    inside = F.when(price > F.col("high"), F.lit(float("nan"))).when(price >= F.col("low"), price)  # NaN: above, null: below
    counted = lines.filter(price.isNotNull()).join(F.broadcast(limits), F.col(flag).eqNullSafe(F.col("f"))).groupBy("f", "n", inside.alias("v")).agg(F.count(F.lit(1)).alias("rows"))
    upto = counted.withColumn("upto", F.sum("rows").over(Window.partitionBy("f", "n").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    ranks = [F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)]
    at = [(F.col("upto") - F.col("rows") <= k) & (k < F.col("upto")) for k in ranks]
    medians = upto.groupBy("f").agg(((F.max(F.when(at[0], F.col("v"))) + F.max(F.when(at[1], F.col("v")))) / 2).alias("median"))
    found = sketched.join(keys.withColumnRenamed(flag, "g"), F.col(flag).eqNullSafe(F.col("g"))).join(medians, F.col(flag).eqNullSafe(F.col("f")), "left")
    return found.select(flag, (F.abs(F.col("near_keys") - F.col("keys")) <= 0.1 * F.col("keys")).alias("near_distinct"), (F.abs(F.col("q")[0] - F.col("median")) <= 0.02 * F.col("top")).alias("near_median"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a quarter: rows of the table, each once, and about as many as asked for."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    n = rows.count()
    return rows.sample(0.25, seed=9).agg((F.abs(F.count(F.lit(1)) - 0.25 * n) < 0.02 * n).alias("near"))


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS, INSERT, CREATE VIEW and DROP."""
    name = "tide_" + uuid.uuid4().hex
    _table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    run_sql(spark, f"CREATE TABLE {name} USING parquet LOCATION '{_folder(spark)}' AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    run_sql(spark, f"INSERT INTO {name} SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
    run_sql(spark, f"CREATE OR REPLACE TEMPORARY VIEW {name}_v AS SELECT * FROM {name}")
    out = spark.read.parquet(spark.table(f"{name}_v").inputFiles()[0].rsplit("/", 1)[0])
    run_sql(spark, f"DROP VIEW {name}_v")
    run_sql(spark, f"DROP TABLE {name}")
    return out


NS = "epoch_us(ts) * 1000"
ARRAYS_SQL = """SELECT o_orderkey, CAST(epoch_us(CAST(o_orderdate AS TIMESTAMP)) * 1000 + o_orderkey AS BIGINT) AS at, CAST(-o_custkey * 1000000007 AS BIGINT) AS span, o_orderkey % 2 = 1 AS odd, n, most,
    (o_custkey % 7) || ',' || (o_custkey % 11) || ',' || (o_custkey % 60000) AS three, o_orderpriority AS raw, replace(o_orderpriority, '-', '|') AS words, pairs, o_orderkey AS big
    FROM orders JOIN (SELECT l_orderkey, CAST(count(*) AS INT) AS n, max(l_extendedprice) AS most, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS pairs FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
LADDER = "SELECT unnest(['tinyint', 'smallint', 'int', 'bigint']) AS t, unnest([1, 2, 3, 4]) AS n, 'i' AS f UNION ALL SELECT unnest(['float', 'double']), unnest([1, 2]), 'f' UNION ALL SELECT 'string', 1, 's'"
_PAIRS = {
    "rec_mixed_channels": (mixed_channels, f"SELECT {NS} AS _log_time, event_id, user_id, CASE WHEN event_type = 'view' THEN value END AS value FROM events WHERE event_type IN ('click', 'view')"),
    "rec_all_topics": (all_topics, f"SELECT '/' || event_type AS topic, {NS} AS _log_time, event_id, user_id, value FROM events"),
    "rec_time_range": (time_range, f"SELECT {NS} AS _log_time, event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"),
    "rec_column_pruning": (column_pruning, f"SELECT user_id, event_id, {NS} AS _log_time FROM events"),
    "rec_arrays_times": (_arrays_times("ros1"), ARRAYS_SQL),
    "rec_cdr_arrays_times": (_arrays_times("cdr"), ARRAYS_SQL),
    "rec_channels_table": (_metadata("_channels"), "SELECT '/region/' || r AS topic, 'ros1' AS message_encoding, '{\"unit\": \"' || r || '\"}' AS metadata FROM (SELECT DISTINCT n_regionkey AS r FROM nation)"),
    "rec_schemas_table": (_metadata("_schemas"), "SELECT 'ros1msg' AS encoding, 'int64 n_nationkey' || chr(10) || 'string n_name' AS text"),
    "rec_proto_container": (proto_container, f"SELECT {NS} AS _log_time, event_id, user_id, value, props FROM events"),
    "rec_export_ties": (export_ties, f"SELECT '/' || event_type AS topic, CAST(5 AS BIGINT) AS _log_time, {NS} + 1 AS _publish_time, event_id AS _sequence FROM events WHERE event_type IN ('click', 'error')"),
    "rec_export_running": (export_running, f"SELECT row_number() OVER (ORDER BY ts) - 1 AS n, {NS} AS _log_time FROM events WHERE event_type = 'error'"),
    "rec_asof_nulls": (asof_nulls, "WITH e AS (SELECT event_id, nullif(user_id % 5, 0) AS k, CASE WHEN event_id % 7 <> 0 THEN event_id END AS at, event_type FROM events) SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON p.k = c.k AND p.at >= c.at"),
    "rec_parquet_evolve": (parquet_evolve, "SELECT o_orderkey, o_custkey AS c, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus FROM orders"),
    "rec_table_listing": (table_listing, "SELECT 'supplier' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region"),
    "rec_topic_totals": (topic_totals, "SELECT event_type AS topic, count(*) AS messages, count(DISTINCT event_type) AS topics, count(*) * 8 AS bytes FROM events GROUP BY ROLLUP (event_type)"),
    "rec_analysis": (analysis, "SELECT '/r' || n_regionkey AS topic, count(*) AS messages, true AS sized FROM nation WHERE n_regionkey IN (1, 2) GROUP BY n_regionkey"),
    "rec_widening": (widening, f"WITH l AS ({LADDER}) SELECT a.t AS a, b.t AS b, a.f = b.f AND a.n <= b.n AS widens, CASE WHEN a.f = b.f THEN CASE WHEN a.n <= b.n THEN b.t ELSE a.t END END AS merged FROM l a, l b"),
    "rec_log_time": (log_times, f"SELECT event_id, {NS} AS _log_time FROM events"),
    "rec_wire_functions": (wire_functions, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(4 + 8 + 4 + length(n_name) + 1 AS INT) AS size FROM nation"),
    "rec_compacted": (compacted, "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_name END AS n_name FROM nation WHERE n_regionkey < 4"),
    "stream_sessions": (stream_sessions, "SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY, true) AS fresh FROM events)) GROUP BY user_id, s"),
    "sql_quoted_identifier": (_front('SELECT "n_name", n_nationkey AS "the key" FROM "nation" WHERE "n_name" <> \'CHINA\'', "nation"), 'SELECT "n_name", n_nationkey AS "the key" FROM "nation" WHERE "n_name" <> \'CHINA\''),
    "sql_sort_default_nulls": (_front("SELECT k, row_number() OVER (ORDER BY c, k) AS rn, lag(k) OVER (ORDER BY c DESC, k) AS p FROM (SELECT nullif(n_regionkey, 2) AS c, n_nationkey AS k FROM nation) ORDER BY c LIMIT 20", "nation"), "SELECT k, row_number() OVER (ORDER BY c, k) AS rn, lag(k) OVER (ORDER BY c DESC, k) AS p FROM (SELECT nullif(n_regionkey, 2) AS c, n_nationkey AS k FROM nation) ORDER BY c LIMIT 20"),
    "sql_sort_first_rows": (_front("SELECT c, k FROM (SELECT nullif(n_regionkey, 0) AS c, n_nationkey AS k FROM nation) ORDER BY c, k LIMIT 6", "nation"), "SELECT c, k FROM (SELECT nullif(n_regionkey, 0) AS c, n_nationkey AS k FROM nation) ORDER BY c, k LIMIT 6"),
    "sql_whole_division": (_front("SELECT o_orderkey, o_custkey // 7 AS d, '//' AS s FROM orders", "orders"), "SELECT o_orderkey, o_custkey // 7 AS d, '//' AS s FROM orders"),
    "sql_exclude_columns": (_front("SELECT * EXCLUDE (n_regionkey) FROM nation", "nation"), "SELECT * EXCLUDE (n_regionkey) FROM nation"),
    "sql_pivot_short": (_front("PIVOT events ON event_type USING count(event_id) GROUP BY user_id", "events"), "SELECT * FROM (PIVOT events ON event_type USING count(event_id) GROUP BY user_id)"),
    "sql_qualify_helper": (qualified, "SELECT o_custkey, o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1"),
    "sql_from_first": (_front("FROM nation SELECT n_name WHERE n_regionkey = 3", "nation"), "FROM nation SELECT n_name WHERE n_regionkey = 3"),
    "sql_join_right": (_front("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", "orders", "customer"), "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000"),
    "sql_agg_first_mode": (_front("SELECT n_regionkey, first(n_regionkey) AS f, any_value(n_regionkey) AS a, last(n_regionkey) AS l, mode(n_regionkey) AS m FROM nation GROUP BY n_regionkey", "nation"), "SELECT n_regionkey, first(n_regionkey) AS f, any_value(n_regionkey) AS a, last(n_regionkey) AS l, mode(n_regionkey) AS m FROM nation GROUP BY n_regionkey"),
    "sql_order_by_all": (_front("SELECT n_regionkey, n_name FROM nation ORDER BY ALL LIMIT 7", "nation"), "SELECT n_regionkey, n_name FROM nation ORDER BY ALL LIMIT 7"),
    "sql_union_by_name": (lambda spark, sf: _table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("k")).unionByName(_table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name"), allowMissingColumns=True), "SELECT n_name, n_regionkey AS k FROM nation UNION ALL BY NAME SELECT r_regionkey AS k, r_name FROM region"),
    "sql_agg_approx": (approximate, "SELECT DISTINCT l_returnflag, true AS near_distinct, true AS near_median FROM lineitem"),
    "sql_sample": (sampled, "SELECT true AS near"),
    "sql_ddl": (ddl, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)"),
    "sql_summarize": (_front("SUMMARIZE SELECT n_nationkey, nullif(n_regionkey, 1) AS r FROM nation", "nation"), None),
    "sql_window_groups": (_front("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) > 0 AS p, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS g FROM orders)", "orders"), "SELECT o_orderkey, sum(o_totalprice) OVER w > 0 AS p, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)"),
}
QUERIES = {k: f for k, (f, _) in _PAIRS.items()}
ORACLES = {k: sql for k, (_, sql) in _PAIRS.items() if sql}
