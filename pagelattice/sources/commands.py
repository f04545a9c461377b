"""Files through a command of another package: it reads a file from its input and writes what it makes of it to its output.

So no file is laid down on an executor's disk. Converters to HTML and to other formats are such commands. Starting a command is what small
files cost, so it is started without a shell, pipes or threads: its input and outputs are files in memory that a task keeps. Rows are
spread over all cores first, as a few small files of a table can hold very many of them.

Defined cases: null content isn't sent and has an error; a command that is missing, fails, takes too long or writes nothing gives an error
and null output; repeated files are sent again; an empty table runs nothing; very large files are held in memory one at a time.
"""

from __future__ import annotations

import os
import select
import signal
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gates
from ..session import spread

#: What a converter always warns of.
NOISE = ("undefined ", "defined name/values", "unmatched field end")
LINES = 12
TIMEOUT = 300.0


#: Rows and bytes of output that are sent on together.
ROWS, BYTES = 1000, 1 << 20
_RESULT = [("size", T.LongType(), pa.int64()), ("output", T.BinaryType(), pa.binary()), ("said", T.StringType(), pa.string()), ("error", T.StringType(), pa.string())]


class _Runner:
    """Starts a command again and again."""

    def __init__(self, command: list[str], timeout: float):
        self.command, self.timeout = command, timeout
        self.files = [os.memfd_create(n) for n in ("in", "out", "err")] if hasattr(os, "memfd_create") and hasattr(os, "pidfd_open") else []

    def __call__(self, content: bytes) -> tuple[int, bytes, bytes]:
        """(exit code, output, what was said); FileNotFoundError and TimeoutExpired as subprocess has them."""
        if not self.files:
            done = subprocess.run(self.command, input=content, capture_output=True, timeout=self.timeout)
            return done.returncode, done.stdout, done.stderr
        for f in self.files:
            os.lseek(f, 0, os.SEEK_SET)
            os.ftruncate(f, 0)
        rest = memoryview(content)
        while rest:
            rest = rest[os.write(self.files[0], rest) :]
        os.lseek(self.files[0], 0, os.SEEK_SET)
        pid = os.posix_spawnp(self.command[0], self.command, os.environ, file_actions=[(os.POSIX_SPAWN_DUP2, f, k) for k, f in enumerate(self.files)], setsigdef=[signal.SIGPIPE])
        end = os.pidfd_open(pid)
        try:
            wait = select.poll()
            wait.register(end, select.POLLIN)
            late = not wait.poll(self.timeout * 1000)
            if late:
                os.kill(pid, signal.SIGKILL)
            code = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
        finally:
            os.close(end)
        if late:
            # what the command started may still write
            self.close()
            self.__init__(self.command, self.timeout)
            raise subprocess.TimeoutExpired(self.command, self.timeout)
        return code, self._read(1), self._read(2)

    def _read(self, k: int) -> bytes:
        f, parts, at = self.files[k], [], 0
        while part := os.pread(f, 1 << 30, at):
            parts.append(part)
            at += len(part)
        return b"".join(parts)

    def close(self) -> None:
        for f in self.files:
            os.close(f)


def _results(files: DataFrame, command: list[str], timeout: float) -> DataFrame:
    """(path, size BIGINT: of the content, output, said, error) of files (path, content)."""
    schema = T.StructType([T.StructField("path", T.StringType())] + [T.StructField(n, k) for n, k, _ in _RESULT])

    def one(start: _Runner, content: bytes | None) -> tuple[bytes | None, str | None, str | None]:
        if content is None:
            return None, None, "no content"
        try:
            code, output, said = start(content)
        except FileNotFoundError:
            return None, None, f"no command {command[0]}"
        except subprocess.TimeoutExpired:
            return None, None, f"took more than {timeout:g} seconds"
        said = said.decode("utf-8", "replace")
        if code:
            return None, said, f"exit code {code}"
        return (output, said, None) if output else (None, said, "no output")

    def send(batches):
        start = _Runner(command, timeout)
        try:
            for b in batches:
                first, rows, size = 0, [], 0
                for i in range(b.num_rows):
                    content = b.column(1)[i].as_py()
                    rows.append((None if content is None else len(content), *one(start, content)))
                    size += len(rows[-1][1] or b"") + len(rows[-1][2] or "")
                    if size >= BYTES or len(rows) >= ROWS or i + 1 == b.num_rows:
                        cols = zip(*rows)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *(pa.array(c, k) for c, (_, _, k) in zip(cols, _RESULT))], names=schema.names)
                        first, rows, size = i + 1, [], 0
        finally:
            start.close()

    return spread(files.select("path", "content"), "path").mapInArrow(send, schema)


def run(files: DataFrame, command: list[str], timeout: float = TIMEOUT) -> DataFrame:
    """(path, output BINARY, said STRING: what the command wrote beside it, error STRING) of files (path, content)."""
    return _results(files, command, timeout).drop("size")


def error_lines(said: Column, most: int = LINES) -> Column:
    """The last lines of what a command said, without what it always says."""
    lines = F.filter(F.split(F.coalesce(said, F.lit("")), r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.lower(x).rlike("|".join(NOISE)))
    return F.slice(lines, F.greatest(F.size(lines) - most + 1, F.lit(1)), most)


def html_candidates(files: DataFrame, command: list[str], timeout: float = TIMEOUT) -> DataFrame:
    """(path, html, reason) of files by a converter to HTML: html only if it kept the content, else the reason why it didn't."""
    made = _results(files, command, timeout)
    html = F.decode("output", "UTF-8")
    cells = F.regexp_count(html, F.lit(r"(?i)<t[dh][\s>]"))
    filled = F.regexp_count(html, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(?:\s|&nbsp;|<(?!/?t[dhr])[^>]*>)*[^<\s]"))
    body = F.length(F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:script|style|head)\b.*?</(?:script|style|head)>|<[^>]*>", ""), r"\s", ""))
    lost = gates.html_conversion_verdict(F.col("size"), body, cells, filled, F.coalesce(F.col("said").contains("unmatched field end"), F.lit(False)))
    why = F.when(F.col("error").isNotNull(), F.concat_ws("; ", "error", F.array_join(error_lines(F.col("said")), " "))).otherwise(lost)
    return made.withColumn("reason", why).select("path", F.when(F.col("reason").isNull(), html).alias("html"), F.nullif("reason", F.lit("")).alias("reason"))
