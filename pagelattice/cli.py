"""Command line: python -m pagelattice.cli INPUT --out FOLDER. Exit code 0: all read, 1: some failed, 2: wrong use."""

from __future__ import annotations

import argparse
import sys

from . import config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelattice", description="Documents to structured records")
    p.add_argument("input", nargs="?")
    p.add_argument("--out", default="out")
    p.add_argument("--glob", help="only files with such names")
    p.add_argument("--format", choices=("text", "markdown", "xml"), help="only convert HTML files")
    for flag in ("--slim", "--no-llm", "--no-assess", "--no-fill", "--fill-all", "--unique", "--list-options"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    return p


def convert(spark, source: str, out: str, form: str, glob: str | None) -> int:
    """HTML files as text, Markdown or XML: (path, content) below out."""
    from pyspark.sql import functions as F

    from .sources import files, html

    try:
        found = files.scan(spark, source, suffixes=(".html", ".htm"), glob=glob)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    html.render(html.page_blocks(found.select("path", F.decode("content", "UTF-8").alias("html"))), ["path"], form).write.mode("overwrite").json(out)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_options:
        for k, v in sorted(config.shown(config.resolve()).items()):
            print(f"{k} = {v}")
        return 0
    if not a.input:
        parser().print_usage(sys.stderr)
        return 2
    try:
        own = {config.check(k): v for k, _, v in (s.partition("=") for s in a.set)}
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .api import Batch

    spark = SparkSession.builder.getOrCreate()
    if a.format:
        return convert(spark, a.input, a.out, a.format, a.glob)
    own |= {"fill_all": a.fill_all, "assess_tables": not a.no_assess, "fill_tables": not a.no_fill}
    if a.no_llm:
        own |= {"llm_url": "", "picture_url": "", "llm_adapter": ""}
    try:
        b = Batch(spark, a.input, glob=a.glob, **own)
        b.run()
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    b.save(a.out, a.slim, a.unique)
    b.summary().show(truncate=False)
    return 0 if b.failures.isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
