"""Chat formatting in budgeted windows, by SQL expressions only.

A turn is written as ``<s>role\\ntext</s>`` and a line break. Control strings inside roles and texts are
escaped reversibly: a backslash becomes ``\\0``, each control string a backslash and its digit, so that
only the template's own marks are left to find.

Windows: the prefix sums of turn tokens (a quarter of the characters, rounded up) choose spans of whole
turns. A window takes turns while the prefix sum beyond its start stays within ``budget`` less what
``history`` and the system turn may take; a longer turn has a span alone. A leading system turn is repeated in each window, then come as many of the turns
before the span as fit in ``history`` tokens, then the span. Repeated turns are masked, and only
assistant texts of the span itself carry loss: each such text once over all windows of a conversation.

A null text or role is an empty one. Turns of one conversation are ordered by ``turn`` (null first), ties by
role and text; repeated rows are repeated turns. Rows with a null conversation id are one conversation.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings that may not stand in a text, and what stands for them.
CONTROL = {"\\": "\\0", "</s>": "\\1", "<s>": "\\2", "[/INST]": "\\3", "[INST]": "\\4", "<</SYS>>": "\\5", "<<SYS>>": "\\6"}
BUDGET, HISTORY = 512, 96


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escaped(expr: str) -> str:
    for plain, mark in CONTROL.items():
        expr = f"replace({expr}, {_literal(plain)}, {_literal(mark)})"
    return expr


def unescaped(expr: str) -> str:
    for plain, mark in reversed(CONTROL.items()):
        expr = f"replace({expr}, {_literal(mark)}, {_literal(plain)})"
    return expr


def windows_table(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a conversation: ``conv_id`` and ``windows``, an array of structs of ``text``, ``repeated``
    (leading turns that are repeated) and ``loss``, an array of (start, size) in code points from 0."""
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    role = f"replace({escaped('x.t.role')}, '\\n', '\\\\7')"
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("t.turn"), F.lit(-(1 << 63))), "t"))).alias("sorted"))
    conv = conv.select("conv_id", F.expr(f"""transform(sorted, x -> struct(x.t.role AS role, concat('<s>', {role}, '\\n') AS head,
        {escaped('x.t.text')} AS body, (char_length(x.t.text) + 3) div 4 AS tokens))""").alias("turns"))
    conv = conv.withColumn("sums", F.expr("aggregate(turns, array(0L), (acc, x) -> array_append(acc, element_at(acc, -1) + x.tokens))"))
    conv = conv.withColumn("lead", F.expr("if(turns[0].role = 'system', 1, 0)"))
    conv = conv.withColumn("room", F.expr(f"greatest(1, {budget} - {history} - lead * turns[0].tokens)"))
    # starts of the windows' spans: turns by 0-based place; sums[k] is the tokens before turn k
    conv = conv.withColumn("starts", F.expr(f"""filter(aggregate(sequence(0, size(turns) - 1), array(0),
        (acc, k) -> if(k > element_at(acc, -1) AND sums[k + 1] - sums[element_at(acc, -1)] > room, array_append(acc, k), acc)), s -> true)"""))
    conv = conv.withColumn("spans", F.expr(f"""transform(starts, (s, i) -> named_struct('s', s, 'e', coalesce(get(starts, i + 1), size(turns)),
        'h', coalesce(array_min(filter(sequence(lead, greatest(s, lead)), k -> sums[s] - sums[k] <= {history})), s), 'sys', if(s > 0, lead, 0)))"""))
    conv = conv.withColumn("spans", F.expr("transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'h', least(greatest(x.h, x.sys), x.s), 'sys', x.sys))"))
    picked = "concat(slice(turns, 1, x.sys), slice(turns, x.h + 1, x.e - x.h))"
    conv = conv.select("conv_id", F.expr(f"transform(spans, x -> named_struct('own', x.sys + x.s - x.h, 'picked', {picked}))").alias("spans"))
    shape = """transform(spans, w -> named_struct('text', concat_ws('', transform(w.picked, t -> concat(t.head, t.body, '</s>\\n'))), 'repeated', w.own,
        'loss', aggregate(transform(w.picked, (t, i) -> struct(i >= w.own AND t.role = 'assistant' AS on, char_length(t.head) AS head, char_length(t.body) AS body)),
            named_struct('at', 0, 'out', cast(array() AS array<struct<start: int, size: int>>)),
            (acc, t) -> named_struct('at', acc.at + t.head + t.body + 5, 'out', if(t.on, array_append(acc.out, named_struct('start', acc.at + t.head, 'size', t.body)), acc.out)),
            acc -> acc.out)))"""
    return conv.select("conv_id", F.expr(shape).alias("windows"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted text of each conversation says: turns of the windows without their repeated
    ones, and the text under the loss masks."""
    cut = "slice(split(w.text, '</s>\\n'), w.repeated + 1, size(split(w.text, '</s>\\n')) - 1 - w.repeated)"
    turns = windows.withColumn("turns", F.expr(f"""transform(flatten(transform(windows, w -> {cut})), p -> named_struct(
        'role', {unescaped("replace(substring_index(substring(p, 4), '\\n', 1), '\\\\7', '\\n')")}, 'text', {unescaped("substring(p, locate('\\n', p) + 1)")}))"""))
    turns = turns.withColumn("loss", F.expr(f"concat_ws('', flatten(transform(windows, w -> transform(w.loss, m -> {unescaped('substring(w.text, m.start + 1, m.size)')}))))"))
    return turns.select(
        "conv_id", F.expr("cast(size(turns) AS bigint)").alias("n_turns"),
        F.expr("sha2(concat_ws('', transform(turns, t -> concat(t.role, '\\n', t.text, '\\n'))), 256)").alias("turns_sha256"),
        F.expr("cast(char_length(loss) AS bigint)").alias("loss_chars"), F.expr("sha2(loss, 256)").alias("loss_sha256"),
        F.expr("cast(aggregate(windows, 0, (acc, w) -> acc + char_length(w.text)) AS bigint)").alias("formatted_chars"), F.expr("size(windows)").alias("n_windows"),
    )
