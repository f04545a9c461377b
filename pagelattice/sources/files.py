"""Files: which there are, and what they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".pdf", ".hwp", ".hwpx")
#: suffix -> DataFrame of files (path, content) to DataFrame (path, content: text, error), a row for each file
_READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_reader(*suffixes: str):
    """Decorator: the reader of files with these suffixes."""

    def add(f):
        _READERS.update({s.lower(): f for s in suffixes})
        return f

    return add


def reader(suffix: str) -> Callable[[DataFrame], DataFrame]:
    if suffix.lower() not in _READERS:
        raise ValueError(f"no reader for {suffix!r}; there are readers for {', '.join(supported())}")
    return _READERS[suffix.lower()]


def supported() -> list[str]:
    return sorted(_READERS)


def scan(spark: SparkSession, sources: str | list[str], recursive: bool = False, suffixes: tuple[str, ...] = SUFFIXES, glob: str | None = None) -> DataFrame:
    """(path, length, content) of the files with known suffixes (and names like the glob), each once. No file: FileNotFoundError.

    Paths are made unique before anything is read, by their sorted absolute names, so contents aren't shuffled for it. A source that lies in
    another that is a folder is left out.
    """
    named = sorted({_absolute(spark, s) for s in ([sources] if isinstance(sources, str) else sources)})
    roots = [s for s in named if not any(s != o and s.startswith(o.rstrip("/") + "/") and (recursive or "/" not in s[len(o.rstrip("/")) + 1 :]) for o in named)]
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(roots).where(suffix(F.col("path")).isin(*suffixes)).select("path", "length", "content")
    if df.select("path").isEmpty():
        raise FileNotFoundError(f"no {', '.join(suffixes)} in {sources}")
    return df


def _absolute(spark: SparkSession, source: str) -> str:
    """The path with its file system, without a slash at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def listed(found: DataFrame) -> DataFrame:
    """(path, length) in the order of paths; contents aren't read."""
    return found.select("path", "length").orderBy("path")


def read(found: DataFrame) -> DataFrame:
    """(path, content, error): each file's text by the reader of its suffix; one that can't be read is tried once more as what its first bytes say it is.

    If that fails as well, the error is the first. A file without a reader has an error; null content is an error of its reader.
    """
    from ..session import cut

    def attempt(files: DataFrame, kind: Column) -> DataFrame:
        some = files.withColumn("__kind", kind)
        out = some.where(~F.col("__kind").isin(*supported()) | F.col("__kind").isNull()).select("path", F.lit(None).cast("string").alias("content"), F.lit("no reader").alias("error"))
        for s in supported():
            out = out.unionByName(reader(s)(some.where(F.col("__kind") == s).select("path", "content")).select("path", "content", "error"))
        return out

    first = cut(attempt(found, suffix(F.col("path"))), "texts")
    bad = first.where("error is not null").select("path")
    other = effective_suffix(F.col("path"), F.col("content"))
    again = found.join(bad, "path", "left_semi").where(F.coalesce(other != suffix(F.col("path")), F.lit(False)))
    second = attempt(again, other).where("error is null").select("path", F.col("content").alias("__again"))
    got = first.join(second, "path", "left")
    return got.select("path", F.coalesce("__again", "content").alias("content"), F.when(F.col("__again").isNull(), F.col("error")).alias("error"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def sniff(content: Column) -> Column:
    """hwp, pdf or hwpx by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "D0CF11E0A1B11AE1", "hwp").when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "hwpx")


def effective_suffix(path: Column, content: Column) -> Column:
    """The suffix that a file's content asks for. An archive isn't taken for hwpx by its first bytes alone."""
    kind = sniff(content)
    return F.when(kind.isin("hwp", "pdf"), F.concat(F.lit("."), kind)).otherwise(suffix(path))


def mismatched(path: Column, content: Column) -> Column:
    return effective_suffix(path, content) != suffix(path)


def hwp_diagnosis(content: Column, header: Column) -> Column:
    """Why a HWP file can't be read, of its bytes and its FileHeader stream (null: none found); null if it can, or if that isn't known."""
    flags = F.conv(F.hex(F.reverse(F.substring(header, 37, 4).cast("string")).cast("binary")), 16, 10).cast("long")
    bit = lambda b: F.coalesce(flags.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(False))
    return (
        F.when(F.coalesce(sniff(content) != "hwp", F.lit(True)), "not a compound file")
        .when(header.isNull(), "no header")
        .when(F.length(header) < 40, "short header")
        .when(~F.substring(header, 1, 17).cast("string").eqNullSafe("HWP Document File"), "bad signature")
        .when(bit(0x02), "encrypted")
        .when(bit(0x04) | bit(0x10), "for distribution only")
    )
