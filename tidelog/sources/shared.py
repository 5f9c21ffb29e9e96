"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from tidelog.errors import UnsupportedFormat

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets one of this machine; a cluster has
    none that is shared, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise UnsupportedFormat("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidelog-"))
    return folder.rstrip("/")
