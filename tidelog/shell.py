"""The interactive loop: SQL over the tables of an input, and commands that begin with a backslash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tidelog.errors import TidelogError
from tidelog.functions.names import size_text
from tidelog.plans.front import pages, run_sql
from tidelog.sources.formats import Input

#: The commands and what they do.
HELP = {"\\dt": "list tables (also \\tables)", "\\dt+": "list tables with rows and size (also \\d+)", "\\d NAME": "columns of a table (also \\describe)", "\\h": "this list (also \\help, \\?)", "\\q": "leave (also \\quit)"}


class Shell:
    def __init__(self, spark: SparkSession, source: Input):
        self.spark, self.source = spark, source
        source.register_views()

    def _listing(self, wide: bool) -> str:
        lines = []
        for n in self.source.names():
            df = self.source.table(n)
            size = sum(self._file_size(f) for f in df.inputFiles()) if wide else 0
            lines.append(f"{n}  {df.count()} rows  {size_text(size)}" if wide else n)
        return "\n".join([*lines, f"({len(lines)} tables)"])

    def _file_size(self, uri: str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()

    def execute(self, line: str) -> str | None:
        """The whole answer to one line; None to leave."""
        parts = list(self.answers(line))
        return None if None in parts else "\n".join(parts)

    def answers(self, line: str) -> Iterator[str | None]:
        """The answer to one line, a page of rows at a time; None to leave."""
        text = line.strip().rstrip(";").strip()
        word, _, rest = text.partition(" ")
        if word in ("\\q", "\\quit"):
            yield None
            return
        if word in ("\\h", "\\help", "\\?"):
            yield "\n".join(f"{c:10} {what}" for c, what in HELP.items())
            return
        try:
            if word in ("\\dt", "\\tables", "\\dt+", "\\d+"):
                yield self._listing(word.endswith("+"))
            elif word in ("\\d", "\\describe"):
                yield "\n".join(f"{f.name}  {f.dataType.simpleString()}" for f in self.source.table(rest.strip()).schema.fields) if rest else self._listing(False)
            elif word.startswith("\\"):
                yield f"unknown command {word}; \\h lists them"
            elif text:
                yield from pages(run_sql(self.spark, text))
        except (TidelogError, PySparkException) as e:
            yield f"{type(e).__name__}: {e}"

    def run(self, read: Callable[[str], str] = input, write: Callable[[str], object] = print) -> None:
        """Until the end of input or a command to leave; an interrupt drops the line; SQL goes on to its ``;``."""
        held: list[str] = []
        while True:
            try:
                line = read("... " if held else "tidelog> ")
            except KeyboardInterrupt:
                held = []
                continue
            except EOFError:
                return
            held.append(line)
            if line.strip() and not line.strip().startswith("\\") and not line.rstrip().endswith(";"):
                continue
            text, held = "\n".join(held), []
            for answer in self.answers(text):
                if answer is None:
                    return
                if answer:
                    write(answer)
