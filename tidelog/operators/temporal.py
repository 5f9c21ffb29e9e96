"""Time-series operators: as-of and interval joins, resampling and time-ordered merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import NameClash


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str], suffix: str = "_right") -> DataFrame:
    """Each left row with ``columns`` of the last right row of its key at or before its time, or nulls. One shuffle
    on the key and a running ``last``: both sides stand in one window, so no pairs are made. A null key or time equals
    nothing, so such left rows get nulls (and pass by the shuffle) and such right rows are not used. Of right rows of one key and time any may be the last. Names may hold any characters;
    one that would stand twice in the result is an error."""
    added = [c + suffix for c in [on, *columns]]
    if clash := set(left.columns) & set(added) | {c for c in added if added.count(c) > 1}:
        raise NameClash(", ".join(sorted(clash)))
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kind = T.StructType([T.StructField(c + suffix, right.schema[c].dataType) for c in [on, *columns]])
    keys = [f"k{i}" for i in range(len(by))]
    own = left.select(*(q(c).alias(k) for c, k in zip(by, keys)), q(on).alias("at"), F.lit(1).alias("side"), F.struct(*(q(c) for c in left.columns)).alias("own"), F.lit(None).cast(kind).alias("other"))
    other = right.select(*(q(c).alias(k) for c, k in zip(by, keys)), q(on).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.struct(*(q(c).alias(c + suffix) for c in [on, *columns])).cast(kind).alias("other"))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, "at"])
    window = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = own.filter(whole).unionByName(other.filter(whole)).withColumn("other", F.last("other", ignorenulls=True).over(window)).filter("side = 1")
    return both.select("own", "other").unionAll(own.filter(f"NOT ({whole})").select("own", "other")).select("own.*", "other.*")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, width: int) -> DataFrame:
    """Pairs of a key with right time in [left time, left time + width); times are whole numbers. Right times fall
    into buckets of that width and a left row meets two of them, so the join is an equi-join with a residual."""
    a = left.withColumn("__bucket", F.explode(F.array(F.floor(F.col(left_on) / width), F.floor(F.col(left_on) / width) + 1)))
    b = right.withColumn("__bucket", F.floor(F.col(right_on) / width))
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*by, "__bucket"]]
    on = (F.col(f"b.{right_on}") >= F.col(f"a.{left_on}")) & (F.col(f"b.{right_on}") < F.col(f"a.{left_on}") + width)
    for k in keys:
        on = on & k
    return a.alias("a").join(b.alias("b"), on).drop("__bucket")


def resample(df: DataFrame, time: str, width: int, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of buckets of ``width``, which start at multiples of it."""
    return df.groupBy(*by, (F.floor(F.col(time) / width) * width).cast("long").alias("bucket")).agg(*aggregates)


def merged(frames: dict[str, DataFrame], time: str = "_log_time") -> DataFrame:
    """(topic, topic_idx, time, payload struct as JSON) of all topics in order of time, the topic given first before others at
    one time: a range-partitioned sort, with no assumption on the inputs' order."""
    parts = [df.select(F.lit(t).alias("topic"), F.lit(i).alias("topic_idx"), F.col(time).alias("_log_time"), F.to_json(F.struct(*[c for c in df.columns if c != time])).alias("payload")) for i, (t, df) in enumerate(frames.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("_log_time", "topic_idx", "payload")
