"""Joins with a lookup table whose keys may be held by very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds one in so many of all rows, so there are at most so many hot keys.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of ``table``'s row of their key, or nulls. ``table`` has a row a key, and in ``weight`` how
    many rows hold it. Hot keys, at most ``HOT``, are joined by broadcast where the rows lie, the rest by a
    shuffle, so that no task gets all rows of a hot key. Null keys find nothing."""
    total = table.agg(F.sum(weight).alias("__total"))  # one row
    marked = table.select(key, *columns, F.col(weight).alias("__weight")).crossJoin(F.broadcast(total))
    hot = marked.filter(F.col("__weight") * HOT >= F.col("__total")).select(key, *columns, F.lit(True).alias("__hot"))
    cold = marked.filter(F.col("__weight") * HOT < F.col("__total")).select(key, *columns)
    met = rows.join(F.broadcast(hot), key, "left")
    out = [*rows.columns, *(c for c in columns if c not in rows.columns)]
    rest = met.filter("__hot IS NULL").select(rows.columns).join(cold, key, "left")
    return met.filter("__hot").select(out).unionAll(rest.select(out))
