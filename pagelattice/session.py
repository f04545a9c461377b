"""Session helpers: the shared folder of the cluster, tables that cut lineage, and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()

#: Bytes up to which a side is broadcast, as rows times `row_bytes` estimates them.
BROADCAST_BYTES = 48 << 20


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on this machine."""
    base = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, if they wouldn't find it by their path. The driver itself serves the archive."""
    root = str(Path(__file__).resolve().parent.parent)
    sc = spark.sparkContext
    if os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="pagelattice-code-")) / "pagelattice.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in Path(__file__).resolve().parent.rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
    atexit.register(shutil.rmtree, archive.parent, True)


#: Bytes of an Arrow batch on the way to Python: texts are long, and each worker holds several batches.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with batches of BATCH_BYTES from here on unless the application's own configuration sets their size."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return df


#: Tasks for each core of a table that is spread, at least: uneven rows even out, and a task holds less.
TASKS = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """df's rows dealt out over all cores by a key's hash, for work that costs much more a row than sending it, or that makes many rows of one.

    How a table lies in files, row groups and splits doesn't matter then, and partitions that are small before the work aren't merged. There are as many as
    spark.sql.shuffle.partitions says, which grows with the input, and TASKS for each core at least.
    """
    spark = df.sparkSession
    return df.repartition(max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


#: Bytes of a batch that a Python worker turns into its results at a time.
PIECE_BYTES = 1 << 20


def pieces(batches):
    """Arrow batches cut into slices of about PIECE_BYTES, a row at least, so that what a worker makes of one doesn't grow with the batch."""
    for b in batches:
        n = max(1, int(b.num_rows * PIECE_BYTES / max(b.nbytes, 1)))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="pagelattice-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends, the rows survive lost executors. The write's shuffle files go as it ends, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table written by cut(); only once no later job reads it."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def row_bytes(kind: T.DataType) -> int:
    """About how many bytes a value takes in a hashed relation; strings and arrays are taken for short ones of ids and names."""
    if isinstance(kind, T.StructType):
        return 16 + sum(row_bytes(f.dataType) for f in kind)
    return 8 if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else 40


def fits(df: DataFrame) -> bool:
    """Whether a table of ids, numbers and short strings has so few rows, by a count, that it takes no more than BROADCAST_BYTES."""
    limit = BROADCAST_BYTES // row_bytes(df.schema)
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a table that fits; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if fits(df) else df
