"""Lines of text in pictures of pages, by a recogniser: a function from a list of pictures' bytes to a list of their lines, each (text, score, corners).

Defined cases: a null picture isn't sent; a picture for which the recogniser gives None has no lines; lines without corners have a null box; lines
that aren't sure enough, blank ones and noise are left out; repeated pictures give repeated lines; no pictures, no lines.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gates
from ..functions import geometry as G

LEAST = 0.7
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_LINE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("points", T.ArrayType(_POINT))]))
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))

Recogniser = Callable[[list[bytes]], list]


def lines(pictures: DataFrame, recogniser: Recogniser, column: str = "image", scale: float = 1.0, least: float = LEAST, batch: int = 8) -> DataFrame:
    """pictures' other columns with frag_no, text, score and box (in points, of pixels at the scale) for each line."""
    keys = [c for c in pictures.columns if c not in (column, "__lines")]
    schema = T.StructType([pictures.schema[c] for c in keys] + [T.StructField("__lines", _LINE)])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                found = [[{"text": t, "score": s, "points": None if p is None else [{"x": x, "y": y} for x, y in p]} for t, s, p in one or ()] for one in recogniser(part.column(len(keys)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(found, _ARROW)], names=schema.names)

    got = pictures.select(*keys, column).where(F.col(column).isNotNull()).mapInArrow(run, schema)
    e = got.select(*keys, F.posexplode("__lines").alias("frag_no", "__l")).select(*keys, "frag_no", "__l.*").where(gates.ocr_lines_kept(F.col("score"), F.col("text"), least))
    q = G.quad_box(F.col("points"))
    box = F.struct(*(G.from_pixels(q[k], scale).alias(k) for k in "ltrb"))
    return e.select(*keys, "frag_no", "text", "score", F.when(F.size("points") > 0, box).alias("box"))
