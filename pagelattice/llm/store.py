"""Token-ID / binary output: a content-addressed store of token-id chunks.

Each document's ids (little-endian, two bytes where the vocabulary allows, else four) are cut where a rolling hash of the last
32 ids has zero bits at its top, so equal passages are cut alike wherever they stand. A chunk's address is the hash of its bytes.
Every distinct chunk is stored once. A document's recipe lists its chunks' addresses; its manifest is the root of a Merkle tree
over them and their sizes, with a fingerprint of the whole id stream taken from the encoder, before chunks are cut. Verification
hashes every stored chunk again, looks every address of every recipe up in the store, computes every root again, and puts the
fingerprint of the rebuilt stream together from those of the stored chunks: it must be the encoder's, and the sizes must sum to n_tokens.

Texts are encoded once. A task sends a chunk once, to the partition of its address, where equal neighbours in the order of addresses are written once.

Defined cases: null text has null ids, recipe and root and is verified; empty text has an empty recipe and the root of no
chunk; repeated rows have the same recipe and store nothing more; null doc_id is kept; extra columns are left out, whatever their names;
an empty table gives an empty book and store; a very long text is encoded whole, in memory in proportion to it. The book says how many
bytes an id takes.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shared_dir, small_batches
from . import bpe
from . import hashing
from .hashing import give_back, mix

WINDOW = 32
#: Ids of a chunk: at least, at most, and the top bits of the hash that are zero at a cut (so 2**8 more on average).
LEAST, MOST, BITS = 64, 2048, 8
#: Addresses that a task remembers to have sent.
SENT = 500_000
#: White space in a row that the installed library is given at most.
RUN = 100_000
DIGEST = 16


class FastEncoder(bpe.Encoder):
    """An installed library encodes whole texts; those with longer runs of white space than it can take, the encoder of bpe."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(bpe.Vocabulary.load(path))
        self.library = tiktoken.Encoding("store", pat_str=bpe.PATTERN, mergeable_ranks=self.vocab.ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        coded = [self._one(t) if t else np.zeros(0, np.int32) for t in texts]
        return np.concatenate([np.zeros(0, np.int32), *coded]), np.concatenate([[0], np.cumsum([len(ids) for ids in coded])]).astype(np.int64)

    def _one(self, text: str) -> np.ndarray:
        if len(text) > RUN and any(m.end() - m.start() > RUN for m in re.finditer(r"\s+", text)):
            return super().encode([text])[0]
        return np.array(self.library.encode_ordinary(text), np.int32)


_WORKER: dict[str, FastEncoder] = {}


def _encoder(path: str) -> FastEncoder:
    if path not in _WORKER:
        _WORKER[path] = FastEncoder(path)
    return _WORKER[path]


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place, a hash of the last WINDOW ids (fewer at the start)."""
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.uint64) + np.uint64(0xA5A5))
        s = 1
        while s < WINDOW:
            h[s:] = h[s:] + (h[:-s] << np.uint64(s))
            s *= 2
        # the top bits of a sum of shifted hashes depend on all of the window only after mixing
        return mix(h & np.uint64((1 << 64) - 1))


def cuts(off: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each stream off[i]:off[i + 1]; at: the sorted places after which the hash allows a cut."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        ends, start = [], a
        i, j = np.searchsorted(at, [a + LEAST - 1, b])
        for p in at[i:j].tolist():
            while p + 1 - start > MOST:
                start += MOST
                ends.append(start)
            if p + 1 - start >= LEAST:
                start = p + 1
                ends.append(start)
        while b - start > MOST:
            start += MOST
            ends.append(start)
        if b > start:
            ends.append(b)
        out.append(ends)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def fingerprints(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each stream ids[off[i]:off[i + 1]]: the sum of its mixed ids times the powers of an odd base, modulo 2**64; `joined` puts those of its parts together."""
    power, inverse = hashing._powers(len(ids))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)])])
        return ((sums[off[1:]] - sums[off[:-1]]) * inverse[off[:-1]]).view(np.int64)


def joined(parts: list[int], sizes: list[int]) -> int:
    """The fingerprint of a stream by those of its parts and their sizes."""
    out = at = 0
    for h, n in zip(parts, sizes):
        out += h * pow(hashing._P, at, 1 << 64)
        at += n
    out &= (1 << 64) - 1
    return out - (1 << 64) if out >> 63 else out


def merkle(leaves: list[tuple[bytes, int]]) -> bytes:
    """The root over (address, number of ids); leaves and inner nodes are hashed apart, a last odd node goes up as it is."""
    if not leaves:
        return digest(b"\2")
    row = [digest(b"\0" + a + n.to_bytes(8, "little")) for a, n in leaves]
    while len(row) > 1:
        up = [digest(b"\1" + row[i] + row[i + 1]) for i in range(0, len(row) - 1, 2)]
        row = up + row[len(up) * 2 :]
    return row[0]


def _chunks(column: pa.Array, enc: FastEncoder):
    """(first row, texts, ids as bytes, their width, offsets, chunk ends and fingerprint of each text) by slices of the column."""
    width = 2 if len(enc.vocab.bytes_of) <= 1 << 16 else 4
    for i, j in bpe.slices(column):
        texts = column.slice(i, j - i).to_pylist()
        ids, off = enc.encode(texts)
        at = np.flatnonzero(rolling(ids) >> np.uint64(64 - BITS) == 0) if len(ids) else np.zeros(0, np.int64)
        # hashes near a text's start hold ids of the text before; no cut can be there
        yield i, texts, ids.astype("<u2" if width == 2 else "<u4").tobytes(), width, off, cuts(off, at), fingerprints(ids, off).tolist()


RECIPE = [("width", T.IntegerType()), ("n_tokens", T.LongType()), ("n_chunks", T.IntegerType()), ("recipe", T.ArrayType(T.StringType(), False)), ("sizes", T.ArrayType(T.IntegerType(), False)), ("stream", T.LongType()), ("merkle_root", T.StringType())]
_ARROW = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.string()]


def build(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(book, store), written into the shared folder.

    book (doc_id, width: bytes of an id, n_tokens, n_chunks, recipe, sizes, stream: fingerprint, merkle_root): addresses and roots in hexadecimal. store (address BINARY, ids
    BINARY): every distinct chunk once. Texts are encoded once: recipes and chunks go through one shuffle, each to the partition of
    its key, and are written as the two parts of one table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    fields = [T.StructField("kind", T.StringType()), T.StructField("address", T.BinaryType()), T.StructField("ids", T.BinaryType()), docs.schema["doc_id"], *(T.StructField(n, k) for n, k in RECIPE)]
    schema = T.StructType(fields)

    def send(batches):
        enc, sent = _encoder(vocabulary), set()
        for b in batches:
            for first, texts, raw, w, off, ends, marks in _chunks(b.column(1), enc):
                keys, parts, rows = [], [], []
                for k, t in enumerate(texts):
                    if t is None:
                        rows.append((None,) * len(RECIPE))
                        continue
                    edge = [int(off[k]), *ends[k]]
                    leaves = []
                    for x, y in zip(edge, edge[1:]):
                        part = raw[w * x : w * y]
                        key = digest(part)
                        leaves.append((key, y - x))
                        if key not in sent:
                            sent.add(key)
                            keys.append(key)
                            parts.append(part)
                    rows.append((w, int(off[k + 1] - off[k]), len(leaves), [a.hex() for a, _ in leaves], [n for _, n in leaves], marks[k], merkle(leaves).hex()))
                if len(sent) > SENT:
                    sent = set()
                n, m = len(keys), len(rows)
                ids = b.column(0).slice(first, m)
                # a recipe's key only spreads the rows
                keys += [digest((r[-1] or "").encode() + (first + k).to_bytes(8, "little")) for k, r in enumerate(rows)]
                cols = [pa.concat_arrays([pa.nulls(n, kind), pa.array(c, kind)]) for c, kind in zip(zip(*rows), _ARROW)]
                yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n + ["recipe"] * m), pa.array(keys, pa.binary()), pa.array(parts + [None] * m, pa.binary()), pa.concat_arrays([pa.nulls(n, ids.type), ids]), *cols], names=schema.names)
        enc.rest()
        give_back()

    def once(batches):
        before = None
        for b in batches:
            keep = []
            for kind, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keep.append(kind == "recipe" or key != before)
                if kind == "chunk":
                    before = key
            yield b.filter(pa.array(keep, pa.bool_()))

    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    small_batches(docs).mapInArrow(send, schema).repartition("address").sortWithinPartitions("kind", "address").mapInArrow(once, schema).write.partitionBy("kind").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    return table.where("kind = 'recipe'").select("doc_id", *(n for n, _ in RECIPE)), table.where("kind = 'chunk'").select("address", "ids")


def width_of(book: DataFrame) -> int:
    """Bytes of an id in the store of this book; one store has one width."""
    return book.agg(F.max("width")).first()[0] or 2


def check_chunks(store: DataFrame, width: int) -> DataFrame:
    """(address STRING in hexadecimal, size INT: number of ids, sound BOOLEAN: the bytes have this address, mark BIGINT: fingerprint of the ids)."""
    schema = T.StructType([T.StructField("address", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("sound", T.BooleanType()), T.StructField("mark", T.LongType())])

    def run(batches):
        for b in batches:
            keys, parts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = np.array([len(p) // width for p in parts], np.int64)
            ids = np.frombuffer(b"".join(p[: len(p) // width * width] for p in parts), "<u2" if width == 2 else "<u4")
            marks = fingerprints(ids, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k in keys]), pa.array(sizes, pa.int32()), pa.array([digest(p) == k for k, p in zip(keys, parts)], pa.bool_()), pa.array(marks)], names=schema.names)

    return store.select("address", "ids").mapInArrow(run, schema)


def verify(book: DataFrame, store: DataFrame) -> DataFrame:
    """book with verified BOOLEAN: every address of the recipe is in the store once, sound and of its size, the root is that of the recipe, and the rebuilt stream has the encoder's n_tokens and fingerprint."""
    checked = check_chunks(store, width_of(book)).groupBy("address").agg(F.first("size").alias("size"), F.min("sound").alias("sound"), F.first("mark").alias("mark"), F.count("*").alias("n"))
    book = cut(book.withColumn("rid", F.monotonically_increasing_id()), "recipes")
    used = book.select("rid", F.posexplode(F.arrays_zip("recipe", "sizes")).alias("k", "c")).select("rid", "k", F.col("c.recipe").alias("address"), F.col("c.sizes").alias("expected"))
    good = F.coalesce(F.col("sound") & (F.col("n") == 1) & (F.col("size") == F.col("expected")), F.lit(False))
    found = used.join(checked, "address", "left").select("rid", "k", good.alias("good"), "mark")
    whole = found.groupBy("rid").agg(F.min("good").alias("good"), F.transform(F.sort_array(F.collect_list(F.struct("k", "mark"))), lambda x: x["mark"]).alias("marks"))

    @F.pandas_udf(T.BooleanType())
    def same(recipe, sizes, marks, good, n_tokens, stream, expected):
        import pandas as pd

        out = []
        for r, s, m, g, n, x, e in zip(recipe, sizes, marks, good, n_tokens, stream, expected):
            if r is None:
                out.append(e is None)
            elif len(r) and not g:
                out.append(False)
            else:
                s, m = list(map(int, s)), [] if m is None else list(map(int, m))
                out.append(merkle([(bytes.fromhex(a), k) for a, k in zip(r, s)]).hex() == e and str(sum(s)) == n and str(joined(m, s)) == x)
        return pd.Series(out)

    # numbers as strings: a column with nulls would come as floats
    numbers = (F.col(c).cast("string") for c in ("n_tokens", "stream"))
    got = book.join(whole, "rid", "left")
    return got.withColumn("verified", same("recipe", "sizes", "marks", F.coalesce("good", F.lit(False)), *numbers, "merkle_root")).drop("rid", "good", "marks")


def reconstruct(book: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, token_ids ARRAY<INT>) of the recipes; one row for each row of the book that has a recipe."""
    width = width_of(book)
    book = cut(book.withColumn("rid", F.monotonically_increasing_id()), "recipes").where("recipe is not null")
    parts = book.select("rid", F.posexplode("recipe").alias("k", "address")).join(store.select(F.lower(F.hex("address")).alias("address"), "ids"), "address")
    whole = parts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"))
    got = book.select("rid", "doc_id").join(whole, "rid", "left").select("doc_id", F.transform("p", lambda x: x["ids"]).alias("p"))
    schema = T.StructType([book.schema["doc_id"], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            rows = [np.frombuffer(b"".join(p or ()), "<u2" if width == 2 else "<u4").astype(np.int32) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    return got.mapInArrow(run, schema)


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    """Every document's recipe and manifest, verified against the store that the query writes into the shared folder."""
    return verify(*build(spark.read.parquet(f"{sf_dir}/documents.parquet")))
