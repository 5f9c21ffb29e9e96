"""SQL front end: the dialect of the shell's users where Spark's own differs.

Text that Spark would read silently with another meaning is rewritten where there is a form of the same meaning, and
rejected with advice where there is none, before it runs. Double quotes name columns and tables; ascending order puts
nulls last, as descending order does; ``//`` divides whole numbers; ``* EXCLUDE (...)`` leaves columns out; ``PIVOT t ON c USING f`` and ``SUMMARIZE t`` are
answered by DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import SqlRejected
from tidelog.functions.names import cell_text

QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
#: What is rejected, and what to use.
TRAPS = [
    (r"\bASOF\s+(LEFT\s+)?JOIN\b", "Spark takes ASOF for an alias; use operators.temporal.asof_join"),
    (r"\bQUALIFY\b", "use a subquery and WHERE, or plans.front.qualify"),
    (r"\bEXCLUDE\s+(CURRENT\s+ROW|GROUP|TIES|NO\s+OTHERS)\b", "no frame exclusion; take the row's own value off, or join"),
    (r"\bGROUPS\s+(BETWEEN|UNBOUNDED|\d|CURRENT)", "no GROUPS frames; use RANGE over a dense_rank()"),
    (r"^\s*(ATTACH|DETACH|INSTALL|LOAD|COPY)\b", "not available; use sources and sinks"),
]
PIVOT = re.compile(r"^\s*PIVOT\s+(\S+)\s+ON\s+(\S+)\s+USING\s+(.+?)(?:\s+GROUP\s+BY\s+(.+?))?\s*;?\s*$", re.I | re.S)
SUMMARIZE = re.compile(r"^\s*SUMMARIZE\s+(.+?)\s*;?\s*$", re.I | re.S)
ORDER = re.compile(r"\bORDER\s+BY\b", re.I)
#: The words that end a list of ORDER BY.
ENDING = re.compile(r"\b(LIMIT|OFFSET|ROWS|RANGE|UNION|INTERSECT|EXCEPT|MINUS|WINDOW|CLUSTER|DISTRIBUTE|SORT|FETCH)\b|;", re.I)


def _masked(text: str) -> str:
    """``text`` with quoted parts and comments blanked out, place by place."""
    return QUOTED.sub(lambda m: ("'" + " " * (len(m[0]) - 2) + "'") if m[0][0] in "'\"`" else " " * len(m[0]), text)


def _items(bare: str, start: int) -> list[int]:
    """The ends of the items of a list that begins at ``start``: its commas, and where the list itself ends."""
    depth, ends = 0, []
    at = start
    while at < len(bare):
        c = bare[at]
        if c in "([":
            depth += 1
        elif c in ")]":
            if not depth:
                break
            depth -= 1
        elif not depth and c == ",":
            ends.append(at)
        elif not depth and (c == ";" or c.isalpha()) and not (at and (bare[at - 1].isalnum() or bare[at - 1] in "_.")) and ENDING.match(bare, at):
            break
        at += 1
    return [*ends, at]


def nulls_last(text: str) -> str:
    """Items of ORDER BY that name no place of nulls get NULLS LAST; ordered-set aggregates (WITHIN GROUP) keep theirs."""
    bare, added = _masked(text), []
    for m in ORDER.finditer(bare):
        if re.search(r"WITHIN\s+GROUP\s*\(\s*$", bare[: m.start()], re.I):
            continue
        start = m.end()
        for end in _items(bare, m.end()):
            item = bare[start:end]
            if item.strip() and not re.search(r"\bNULLS\s+(FIRST|LAST)\s*$", item, re.I):
                added.append(start + len(item.rstrip()))
            start = end + 1
    for at in reversed(added):
        text = text[:at] + " NULLS LAST" + text[at:]
    return text


def _replaced(text: str, pattern: str, put: str) -> str:
    """Replaces a pattern outside of quotes and comments."""
    for m in reversed([*re.finditer(pattern, _masked(text), re.I)]):
        text = text[: m.start()] + m.expand(put) + text[m.end() :]
    return text


def rewritten(text: str) -> str:
    text = _replaced(text, r"//", " div ")
    text = _replaced(text, r"(?<=\*)\s*EXCLUDE\s*(?=\()", " EXCEPT ")
    text = _replaced(text, r"(?<=\*)\s*EXCLUDE\s+(\w+)", r" EXCEPT (\1)")
    return nulls_last(text)


def _spark_sql(spark: SparkSession, text: str) -> DataFrame:
    """Double quotes name things while the text is parsed."""
    name = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return spark.sql(text)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    bare = _masked(text)
    for pattern, advice in TRAPS:
        if m := re.search(pattern, bare, re.I):
            raise SqlRejected(f"{m[0].strip()}: {advice}")
    if m := SUMMARIZE.match(text):
        return summarize(_spark_sql(spark, rewritten(m[1])) if re.match(r"(SELECT|WITH|FROM)\b", m[1], re.I) else _spark_sql(spark, f"SELECT * FROM {m[1]}"))
    if m := PIVOT.match(text):
        return pivot(_spark_sql(spark, f"SELECT * FROM {m[1]}"), m[2].strip('"`'), m[3], [x.strip().strip('"`') for x in m[4].split(",")] if m[4] else None)
    return _spark_sql(spark, rewritten(text))


def qualify(df: DataFrame, value: str, condition: str) -> DataFrame:
    """Rows for which ``condition`` holds on ``__value``, the window expression ``value``."""
    return df.withColumn("__value", F.expr(value)).filter(condition).drop("__value")


def pivot(df: DataFrame, column: str, aggregate: str, by: list[str] | None = None) -> DataFrame:
    """A column for each value of ``column``, in their order. Without ``by`` the rows are those of all columns that neither are it nor
    are named in the aggregate."""
    named = set(re.findall(r"\w+", aggregate))
    by = [c for c in df.columns if c != column and c not in named] if by is None else by
    return df.groupBy(*(f"`{c}`" for c in by)).pivot(column).agg(F.expr(aggregate))


def summarize(df: DataFrame) -> DataFrame:
    """A row a column: type, least and greatest value, about how many distinct ones, mean, deviation, quartiles, rows and percent of nulls."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        plain = not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
        text = lambda x: x.cast("string")
        none = F.lit(None).cast("string")
        quartiles = F.percentile_approx(c, [0.25, 0.5, 0.75]) if number else None
        parts.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), (text(F.min(c)) if plain else none).alias("min"), (text(F.max(c)) if plain else none).alias("max"),
            (F.approx_count_distinct(c) if plain else F.lit(None).cast("long")).alias("approx_unique"), (F.avg(c).cast("double") if number else F.lit(None).cast("double")).alias("avg"), (F.stddev_samp(c).cast("double") if number else F.lit(None).cast("double")).alias("std"),
            *((text(quartiles[i]) if number else none).alias(n) for i, n in enumerate(("q25", "q50", "q75"))),
            F.count(F.lit(1)).alias("count"), (100 * F.sum(c.isNull().cast("int")) / F.count(F.lit(1))).alias("null_percentage"),
        ))
    return df.agg(F.array(*parts).alias("c")).select(F.inline("c"))


def pages(df: DataFrame, rows_in_page: int = 1000) -> Iterator[str]:
    """All rows as tables of text, a page at a time, and their number behind the last; only a page is held."""
    rows, total = df.toLocalIterator(), 0
    while True:
        page = [[cell_text(v) for v in r] for r in islice(rows, rows_in_page)]
        lines: list[str] = []
        if page or not total:
            widths = [max([len(c), *(len(r[i]) for r in page)]) for i, c in enumerate(df.columns)]
            if not total:
                lines += [" | ".join(c.center(w) for c, w in zip(df.columns, widths)), "-+-".join("-" * w for w in widths)]
            lines += [" | ".join(v.rjust(w) for v, w in zip(r, widths)) for r in page]
        total += len(page)
        last = len(page) < rows_in_page
        yield "\n".join([*lines, *([f"({total} row{'s' * (total != 1)})"] if last else [])])
        if last:
            return


def rendered(df: DataFrame) -> str:
    """All rows as one text."""
    return "\n".join(pages(df))
