"""New files of a folder to page records, as a stream: the stateless operators of the batch, a sink that is written once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import html, office


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, content) of files as they come; a path counts once within an hour."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return s.withWatermark("modificationTime", "1 hour").dropDuplicatesWithinWatermark(["path"]).select("path", "modificationTime", "content")


def html_blocks(stream: DataFrame) -> DataFrame:
    """Blocks of HTML files as they come."""
    return html.page_blocks(stream.select("path", F.decode("content", "UTF-8").alias("html")))


def office_blocks(stream: DataFrame) -> DataFrame:
    return office.read_blocks(stream.select("path", "content"))


def write(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet; with once it ends when nothing is left."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
