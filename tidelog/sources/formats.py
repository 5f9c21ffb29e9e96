"""Inputs and outputs by format: recordings, Parquet folders, managed tables and DuckDB files."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidelog.errors import TableExists, TableNotFound, UnsupportedFormat
from tidelog.functions.names import table_name
from tidelog.operators.evolution import compare_schemas, project
from tidelog.operators.tables import TableStore
from tidelog.sources import recording as R
from tidelog.sources.shared import shared_folder

#: Formats by extension. Those of ABSENT have no reader or writer here.
EXTENSIONS = {".mcap": "mcap", ".parquet": "parquet", ".duckdb": "duckdb", ".db": "duckdb", ".tables": "tables", ".lance": "lance", ".vortex": "vortex"}
ABSENT = {"lance", "vortex"}
#: DuckDB's names of Spark's simple types.
DUCKDB_TYPES = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP"}
MODES = {"error", "overwrite", "append"}
URI = re.compile(r"^[a-z][a-z0-9+.-]*://", re.I)


def is_remote(path: str) -> bool:
    return bool(URI.match(path)) and not path.lower().startswith("file://")


def _names(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder; None for a file or nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) and fs.getFileStatus(p).isDirectory() else None


def detect_input(spark: SparkSession, path: str) -> str:
    """By extension, else by what a folder holds."""
    known = EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if known:
        return known
    names = _names(spark, path) or []
    if any(n.endswith(".tbl") for n in names):
        return "tables"
    for n in sorted(names):
        if EXTENSIONS.get(os.path.splitext(n)[1].lower()):
            return EXTENSIONS[os.path.splitext(n)[1].lower()]
    raise UnsupportedFormat(f"can't tell the format of {path}")


def infer_output(path: str) -> str:
    """By extension; a folder or an address without one is a store of managed tables."""
    return EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "tables")


@dataclass
class Input:
    """Tables by name, each a DataFrame that is read when it is used."""

    frames: dict[str, DataFrame]

    def names(self) -> list[str]:
        return sorted(self.frames)

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise TableNotFound(name)
        return self.frames[name]

    def chosen(self, names: list[str] | None) -> dict[str, DataFrame]:
        """In the order asked for; all but tables of metadata (``_``) if none are."""
        return {n: self.table(n) for n in names} if names is not None else {n: f for n, f in self.frames.items() if not n.startswith("_")}

    def register_views(self) -> list[str]:
        for n, f in self.frames.items():
            f.createOrReplaceTempView(f"`{n}`" if not n.isidentifier() else n)
        return self.names()


def read_duckdb(spark: SparkSession, path: str, batch_rows: int = 65536) -> dict[str, DataFrame]:
    """Tables of a DuckDB file. The library reads files of this machine only, so a table goes through
    the driver, a batch at a time, into a Parquet folder in ``spark.checkpoint.dir``, and is read from there."""
    import tempfile

    import duckdb
    import pyarrow.parquet as pq

    if is_remote(path) or not os.path.exists(path.removeprefix("file://")):
        raise UnsupportedFormat(f"{path}: DuckDB files are read from this machine only")
    folder, out, jvm = f"{shared_folder(spark)}/duckdb-{uuid.uuid4().hex}", {}, spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    with duckdb.connect(path.removeprefix("file://"), read_only=True) as db, tempfile.TemporaryDirectory() as own:
        for (name,) in db.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' ORDER BY 1").fetchall():
            batches = db.sql(f'SELECT * FROM "{name}"').to_arrow_reader(batch_rows)
            with pq.ParquetWriter(f"{own}/part-0.parquet", batches.schema, compression="zstd") as writer:
                for batch in batches:
                    writer.write_batch(batch)
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
            fs.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{own}/part-0.parquet"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/part-0.parquet"))
            out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def open_input(spark: SparkSession, paths: str | list[str], fmt: str | None = None, topics: list[str] | None = None) -> Input:
    """Several paths are concatenated table by table, their schemas merged; each is read in its own format. Recordings
    are read in one pass, and bring the tables ``_channels`` and ``_schemas``."""
    paths = [paths] if isinstance(paths, str) else paths
    formats = [fmt or detect_input(spark, p) for p in paths]
    held: dict[str, list[DataFrame]] = {}
    recordings = [p for p, f in zip(paths, formats) if f == "mcap"]
    if recordings:
        found = R.topic_frames(R.recording(spark, *recordings, topics=topics))
        held |= {t: [f] for t, f in found.items()}
        held |= {n: [f] for n, f in R.metadata(R.read_files(spark, *recordings)).items()}
    for path, kind in zip(paths, formats):
        if kind == "mcap":
            continue
        if kind in ABSENT:
            raise UnsupportedFormat(f"{kind}: no library for it here")
        if kind == "parquet":
            names = _names(spark, path)
            own = [n for n in names or [] if n.endswith(".parquet")]
            found = {n.removesuffix(".parquet"): spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in own} if own and not any(n.startswith("part-") for n in own) else {os.path.basename(path.rstrip("/")).removesuffix(".parquet"): spark.read.parquet(path)}
        elif kind == "duckdb":
            found = read_duckdb(spark, path)
        elif kind == "tables":
            store = TableStore(spark, path)
            found = {n: store.read(n) for n in store.tables()}
        else:
            raise UnsupportedFormat(kind)
        for n, f in found.items():
            held.setdefault(n, []).append(f)

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        merged = compare_schemas(a.schema, b.schema).merged
        return project(a, merged).unionByName(project(b, merged))

    return Input({n: reduce(both, frames) for n, frames in held.items()})


def write_duckdb(frames: dict[str, DataFrame], path: str, mode: str) -> None:
    """Tables of a DuckDB file on this machine; rows pass the driver a partition at a time."""
    import duckdb
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    if is_remote(path):
        raise UnsupportedFormat(f"{path}: DuckDB files are written on this machine only")
    with duckdb.connect(path.removeprefix("file://")) as db:
        there = {n for (n,) in db.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main'").fetchall()}
        if mode == "error" and there & set(frames):
            raise TableExists(sorted(there & set(frames))[0])
        for name, df in frames.items():
            schema = to_arrow_schema(df.schema)
            if mode == "overwrite" or name not in there:
                db.execute(f'DROP TABLE IF EXISTS "{name}"')
                db.execute(create_table_text(name, df.schema))
            columns = ", ".join(f'"{c}"' for c in df.columns)
            for r in df.mapInArrow(_as_streams, "ipc binary").toLocalIterator(prefetchPartitions=True):
                block = pa.ipc.open_stream(bytes(r.ipc)).read_all().cast(schema)  # noqa: F841
                db.execute(f'INSERT INTO "{name}" ({columns}) SELECT {columns} FROM block')


def _as_streams(batches):
    """Each batch as one binary cell, so that the driver gets columns and not rows."""
    import pyarrow as pa

    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])


def create_table_text(name: str, schema) -> str:
    """The DuckDB statement that creates a table of this Spark schema; nested types stay nested."""
    from pyspark.sql import types as T

    def kind(t) -> str:
        if isinstance(t, T.ArrayType):
            return kind(t.elementType) + "[]"
        if isinstance(t, T.StructType):
            return "STRUCT(" + ", ".join(f'"{f.name}" {kind(f.dataType)}' for f in t.fields) + ")"
        if isinstance(t, T.MapType):
            return f"MAP({kind(t.keyType)}, {kind(t.valueType)})"
        if isinstance(t, T.DecimalType):
            return f"DECIMAL({t.precision},{t.scale})"
        return DUCKDB_TYPES[t.simpleString()]

    quoted = name.replace('"', '""')
    return f'CREATE TABLE "{quoted}" (' + ", ".join(f'"{f.name}" {kind(f.dataType)}' for f in schema.fields) + ")"


def _append_parquet(spark: SparkSession, df: DataFrame, target: str) -> None:
    """Appends to a Parquet folder. The schemas are merged first: an impossible merge is an error before anything is written;
    where the folder's own files would not do any more, they are written anew beside it and take its place."""
    old = spark.read.parquet(target)
    change = compare_schemas(old.schema, df.schema)
    if not change.needed:
        project(df, change.merged).write.mode("append").option("compression", "zstd").parquet(target)
        return
    beside = f"{target}.{uuid.uuid4().hex}"
    project(old, change.merged).unionByName(project(df, change.merged)).write.option("compression", "zstd").parquet(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(path(target), path(f"{beside}.old"))
    fs.rename(path(beside), path(target))
    fs.delete(path(f"{beside}.old"), True)


def write_output(spark: SparkSession, frames: dict[str, DataFrame], path: str, fmt: str | None = None, mode: str = "error", encoding: str = "ros1") -> dict[str, str]:
    """Writes all tables (those of metadata are always replaced, and don't go to a recording); every mode holds for every format and table, and in mode error all names are
    checked before anything is written. Returns table name -> the name it was given."""
    if mode not in MODES:
        raise UnsupportedFormat(f"mode {mode}")
    fmt = fmt or infer_output(path)
    if fmt in ABSENT:
        raise UnsupportedFormat(f"{fmt}: no library for it here")
    given = {n: n if fmt == "mcap" else table_name(n) for n in frames}
    if len(set(given.values())) < len(given):
        raise TableExists("two topics have the same table name")
    named = {given[n]: f for n, f in frames.items()}
    meta = {n: f for n, f in named.items() if n in ("_channels", "_schemas")}
    named = {n: f for n, f in named.items() if n not in meta}
    if meta and fmt != "mcap" and mode != "overwrite":
        write_output(spark, named, path, fmt, mode, encoding)
        write_output(spark, meta, path, fmt, "overwrite", encoding)
        return given
    named |= meta if fmt != "mcap" else {}
    if fmt == "mcap":
        from tidelog.operators.export import export

        if is_remote(path):
            raise UnsupportedFormat("one ordered file is written on this machine only; use pack_files")
        local = path.removeprefix("file://")
        if mode != "overwrite" and os.path.exists(local):
            raise TableExists(local)
        with open(local, "wb") as out:
            export(named, out, encoding)
    elif fmt == "parquet":
        there = {n.removesuffix(".parquet") for n in _names(spark, path) or []}
        if mode == "error" and there & set(named):
            raise TableExists(sorted(there & set(named))[0])
        for n, f in named.items():
            target = f"{path.rstrip('/')}/{n}.parquet"
            if mode == "append" and n in there:
                _append_parquet(spark, f, target)
            else:
                f.write.mode(mode).option("compression", "zstd").parquet(target)
    elif fmt == "duckdb":
        write_duckdb(named, path, mode)
    else:
        store = TableStore(spark, path)
        clash = set(store.tables()) & set(named)
        if mode == "error" and clash:
            raise TableExists(sorted(clash)[0])
        for n, f in named.items():
            store.write(n, f, mode)
    return given
