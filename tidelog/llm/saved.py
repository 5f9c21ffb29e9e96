"""Tables written to the cluster's shared folder, which cut lineage and outlive executors."""

from __future__ import annotations

import gc
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.shared import shared_folder


def trim_native(spark: SparkSession) -> bool:
    """What ``release`` does in a worker, in the driver's JVM, by its diagnostic command; false where that is absent (other
    systems, Java before 17.0.9)."""
    jvm = spark._jvm

    def array(kind: str, *items: object) -> JavaObject:
        out = spark.sparkContext._gateway.new_array(getattr(jvm.java.lang, kind), len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:  # by the interface's method: the server's own class is closed to reflection
        named = jvm.java.lang.Class.forName
        kinds = array("Class", *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array("Object", name, "systemTrimNativeHeap", array("Object"), array("String")))
    except Py4JError:
        return False
    return True


class Scratch:
    """Tables of one run of an operator. ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidelog_path = path
        self.tidy()
        return out

    def tidy(self) -> None:
        """Lets the cluster delete shuffle files of plans that are done: it does so once the driver's JVM has
        collected their handles, which by itself may come late. What is free in the JVM's native allocator goes back to
        the system: else each thread's arena keeps what its largest plan took."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim_native(self.spark)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._tidelog_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
