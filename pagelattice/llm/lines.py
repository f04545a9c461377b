"""Fuzzy line dedup: of the lines that a chain of near copies joins, one occurrence stays.

1. Texts are read twice, for lines with the hashes of their bands, and for the texts of candidates. A line is normalised to its words (runs of ASCII letters and digits or of characters outside ASCII, in
   lower case); it gets a 128-bit hash of them. Lines that are equal when normalised are one from here on, known by the
   hash's first 64 bits.
2. Candidates are found by MinHash: the features of a line are its pairs of neighbouring words, its begin and end counted as words,
   so that one changed word changes two of them. Lines that agree on `ROWS` least hashes of one of the bands meet; of those, the
   ones whose lengths allow the edit similarity and whose SimHashes (of the words) differ in at most `distance` bits are pairs, and lines
   of one meeting that chains of pairs join are a cluster. Rows and bands are the same for every input; the bands are taken `AT_A_TIME`.
   Their records are shuffled as blobs, one for some thousand lines and each bucket of keys, not as rows.
   (The pigeonhole blocks of a SimHash alone can't do it: lines of that edit similarity differ in up to 20 of 64 bits and more.)
3. The edit similarity of all pairs within a cluster is verified on the normalised texts: 1 - Levenshtein distance / length of the longer; but no pair
   that similar ones join already, which changes no group. So clusters, and what is compared of lines that are all alike, grow with the number of lines, not of pairs.
   Lines that chains of clusters join go to one task, or, if they have very many members, to several.
4. Connected components of what is left are the groups; the occurrence of the least (doc_id, text hash, line number) stays.

Defined cases: a line without words (blank, or of signs only) always stays; null text stays null; rows of equal doc_id and text are
one document, each gets the same result; null doc_id sorts first; a text loses the line feeds of its removed lines; extra columns
pass through, columns named like the added ones are replaced; an empty table gives an empty table; very long texts and lines are read whole,
in memory in proportion to the longest.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, drop_cut, fits, maybe_broadcast, small_batches
from . import hashing
from .components import components

#: Bits by which the SimHashes of two lines of that edit similarity differ at most; lines met by chance differ by 32 on average.
DISTANCE = 24
SIMILARITY = 0.85
#: Least hashes of a band, bands, and how many of them are shuffled at a time. Pairs whose features have a Jaccard similarity of 0.4 meet with a probability of 0.94.
ROWS, BANDS, AT_A_TIME = 3, 42, 14
#: Lengths are kept as logarithms, so many steps for a factor of two.
STEPS = 2048
#: Members of the clusters of a component up to which one task takes it whole.
LARGE = 100_000
#: Members of clusters, and characters of lines, from which a task settles the components that it has read so far.
TOGETHER, TOGETHER_CHARS = 200_000, 1 << 23
#: Pairs from which it pays to look at them, and to compare those that lengths and counts leave.
ROUND = 8192
#: Pairs of as many blocks of 64 characters, for each block, from which they are compared at once; fewer ones one by one.
AT_ONCE = 6
#: Lines that a task remembers to have sent.
SENT = 500_000
#: Lines, and features, of which a task hashes the bands at once; bytes of the records of a bucket, about.
PACKED, HASHED, BUCKET_BYTES = 32_768, 1 << 20, 4 << 20
#: Values that are hashed by one function after the other while they are in the processor's cache.
CACHED = 1 << 15
_ODD = hashing.mix(np.arange(1, 513, dtype=np.uint64)) | np.uint64(1)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_SPREAD = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def simhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each run h[first[i]:first[i + 1]] (none is empty): a bit is set if most of the run's hashes have it."""
    count = np.diff(first)
    segs = (count + 254) // 255  # eight counters share a word, each up to 255
    seg_line = np.repeat(np.arange(len(count)), segs)
    seg_first = np.concatenate([[0], np.cumsum(segs)])
    start = first[:-1][seg_line] + 255 * (np.arange(len(seg_line)) - seg_first[seg_line])
    part = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], start, axis=0) if len(h) else np.zeros((0, 8), np.uint64)
    ones = np.add.reduceat(part.view(np.uint8).reshape(-1, 64).astype(np.int32), seg_first[:-1], axis=0) if len(part) else np.zeros((0, 64), np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1).view(np.int64).ravel()


def features(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words, begin and end counted as words, of each run h[first[i]:first[i + 1]] (none is empty), and each run's first."""
    a = np.insert(h, first[:-1], np.uint64(7))
    out = first + np.arange(len(first))
    after = np.append(a[1:], np.uint64(9))
    after[out[1:] - 1] = np.uint64(9)
    with np.errstate(over="ignore"):
        return hashing.mix(a * _MULTIPLIER + after), out


def bands_for(lines: int | None = None) -> tuple[int, int]:
    """(rows of a band, bands), for any number of lines: results mustn't depend on it."""
    return ROWS, BANDS


def band_keys(g: np.ndarray, first: np.ndarray, rows: int, bands: int, start: int = 0) -> np.ndarray:
    """32 bits for each run's bands from `start` on: equal if the run's least hashes by the band's functions are. Runs of about the same length are columns of one table."""
    n = np.diff(first)
    out = np.empty((len(n), bands), np.uint64)
    order = np.argsort(n, kind="stable")
    length, at = n[order], 0
    with np.errstate(over="ignore"):
        while at < len(order):
            width = int(length[at])
            stop = min(int(np.searchsorted(length, max(width + 4, width * 9 // 8), "right")), at + max(1, CACHED // width))
            part, width = order[at:stop], int(length[stop - 1])
            table = g[np.minimum(np.arange(width)[:, None], n[part] - 1) + first[part]]  # the last feature again, below shorter runs
            hashed, least = np.empty_like(table), np.empty((bands * rows, len(part)), np.uint64)
            for i in range(bands * rows):
                np.minimum.reduce(np.multiply(table, _ODD[start * rows + i], out=hashed), axis=0, out=least[i])
            key = np.zeros((bands, len(part)), np.uint64)
            for i in range(rows):
                key = hashing.mix(key * _MULTIPLIER + least[i::rows])
            out[part] = (key >> np.uint64(32)).T
            at = stop
    return out


def line_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each line, the line's text, its number in the text from 0, characters before each word and in all words)."""
    w = hashing.words(data, off)
    feed = np.flatnonzero(data == 10)
    lines = 1 + np.searchsorted(feed, off[1:]) - np.searchsorted(feed, off[:-1])
    start = np.sort(np.concatenate([off[:-1], feed + 1]), kind="stable")
    text = np.repeat(np.arange(len(off) - 1), lines)
    number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    before = np.concatenate([[0], np.cumsum(chars[w._end] - chars[w._start])])
    return w.hashes, np.append(np.searchsorted(w._start, start), len(w.hashes)), text, number, before


def _lines(column: pa.Array):
    """(hashes, first word of each line with words, the row of its text, its number in it, its hash, logarithm of its normalised length) by pieces of the column."""
    data, off = hashing.buffers(column)
    for i, j in hashing.pieces(off):
        h, first, text, number, before = line_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        have = np.flatnonzero(np.diff(first) > 0)
        if not len(have):
            continue
        runs = np.append(first[have], len(h))  # lines without words have no hashes in between
        raw = memoryview(h.view(np.uint8))
        lid = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(runs[:-1].tolist(), runs[1:].tolist())]
        yield h, runs, text[have] + i, number[have], lid, (STEPS * np.log2(np.diff(before[runs]) + np.diff(runs) - 1)).astype(np.int64)


def scan(docs: DataFrame, rows: int = ROWS, bands: int = 0) -> DataFrame:
    """Two kinds of rows, of one reading of the texts. Of each line with words: doc_id, thash, line_no and lid STRUCT<hi, lo>, its hash; thash tells texts of one doc_id apart.
    Of some thousand lines together, if bands are wanted: rids, simhashes, sizes and, for AT_A_TIME bands each, keys0, keys14 ..., the bytes of arrays with a line's values side by side. A task packs a line once."""
    docs = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("thash"), F.lower("text").alias("text"))
    starts = range(0, bands, AT_A_TIME)
    pair = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])
    packs = ["rids", "simhashes", "sizes", *(f"keys{k}" for k in starts)]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("thash", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("lid", pair), *(T.StructField(c, T.BinaryType()) for c in packs)])

    def run(batches):
        kinds, sent, wait = None, set(), []

        def pack():
            nonlocal wait
            ids, sims, sizes, g, n = (np.concatenate(x) for x in zip(*wait))
            wait = []
            keys = band_keys(g, np.append(0, np.cumsum(n)), rows, bands).astype(np.uint32)
            values = [ids, sims, sizes.astype(np.uint16), *(np.ascontiguousarray(keys[:, k : k + AT_A_TIME]) for k in starts)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=schema.names)

        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.struct([("hi", pa.int64()), ("lo", pa.int64())])]
            for h, runs, text, number, lid, size in _lines(b.column(2)):
                row = pa.array(text)
                raw = np.frombuffer(b"".join(lid), ">i8").astype(np.int64).reshape(-1, 2)
                ids = np.ascontiguousarray(raw[:, 0])
                both = pa.StructArray.from_arrays([pa.array(ids), pa.array(np.ascontiguousarray(raw[:, 1]))], names=["hi", "lo"])
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(number, pa.int32()), both, *(pa.nulls(len(ids), pa.binary()) for _ in packs)], names=schema.names)
                if not bands:
                    continue
                new = np.zeros(len(ids), bool)
                for k, x in enumerate(ids.tolist()):
                    if x not in sent:
                        sent.add(x)
                        new[k] = True
                if len(sent) > SENT:
                    sent = set()
                g, at = features(h, runs)
                n = np.diff(at)
                wait.append((ids[new], simhash(h, runs)[new], np.minimum(size, 0xFFFF)[new], g[np.repeat(new, n)], n[new]))
                if sum(len(x[0]) for x in wait) > PACKED or sum(len(x[3]) for x in wait) > HASHED:
                    yield pack()
            del b
        if wait and sum(len(x[0]) for x in wait):
            yield pack()
        del sent, wait
        hashing.give_back()

    return small_batches(docs).mapInArrow(run, schema)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, line_no, lid) of the lines with words."""
    return scan(docs).select("doc_id", "thash", "line_no", "lid")


def rid(lid: Column) -> Column:
    """The first 64 bits of a line's hash as a number."""
    return lid["hi"]


_BUCKET = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("records", T.BinaryType())])


def _by_bucket(records: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with the bytes of its records (rows of 64-bit numbers)."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    records, bucket = np.ascontiguousarray(records[order]), bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    off = np.append(start, len(bucket)) * (8 * records.shape[1])
    held = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(records)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), held], names=_BUCKET.names)


def _buckets(batches, width: int):
    """The records of each bucket, of rows that go by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, records in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and held:
                yield np.concatenate(held)
                held = []
            now = bucket
            held.append(np.frombuffer(records.as_buffer(), np.int64).reshape(-1, width))
    if held:
        yield np.concatenate(held)


def _together(rows: DataFrame) -> DataFrame:
    """Rows of _by_bucket, each bucket in one task and in one run."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def spread(packed: DataFrame, starts: list[int], buckets: int) -> DataFrame:
    """The records (key, rid, simhash) of the packed lines of scan() for the bands of these columns, by buckets of what must agree. key: 7 bits of the band, 32 of what must agree, 16 of the length."""
    packed = packed.where("rids is not null").select("rids", "simhashes", "sizes", *(f"keys{k}" for k in starts))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sims, sizes, *keys = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in enumerate([np.int64, np.int64, np.uint16, *[np.uint32] * len(starts)]))
                for start, key in zip(starts, keys):
                    key = key.reshape(len(ids), -1).astype(np.int64)
                    records = np.empty((*key.shape, 3), np.int64)
                    records[:, :, 0] = key << 16 | np.arange(start, start + key.shape[1]) << 48 | sizes[:, None]
                    records[:, :, 1], records[:, :, 2] = ids[:, None], sims[:, None]
                    yield _by_bucket(records.reshape(-1, 3), (key * buckets >> 32).ravel())
        hashing.give_back()

    return packed.mapInArrow(run, _BUCKET)


def band_rows(docs: DataFrame, rows: int, bands: int, buckets: int = 16) -> DataFrame:
    """The records of so many bands of each line with words, by buckets."""
    return spread(scan(docs, rows, bands), list(range(0, bands, AT_A_TIME)), buckets)


def masks(m: int, distance: int) -> list[int]:
    """The bits of every choice of m - distance of m blocks."""
    edge = [round(64 * i / m) for i in range(m + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(m)]
    return [sum(block[i] for i in c) for c in itertools.combinations(range(m), m - distance)]


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label (each place's group, named by its least place) after the groups of the places x and y were joined pair by pair."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def meet(rows: DataFrame, distance: int, similarity: float, buckets: int) -> DataFrame:
    """The records (cluster, rid), by buckets: of the lines that share a band (band_rows), those that chains of pairs within the Hamming distance and of lengths that allow the similarity join. cluster is a hash of its rids."""
    longer = math.ceil(STEPS * -math.log2(similarity)) + 1

    def within(records):
        """The clusters in the runs of one band's key, which go by length: each row is compared with those k rows on, for k = 1, 2 ... while some is short enough and not of its cluster yet."""
        # most lines share a key with no other
        key = np.sort(records[:, 0] >> 16)
        same = key[1:][key[1:] == key[:-1]]
        if not len(same):
            return np.zeros((0, 2), np.int64)
        key = records[:, 0] >> 16
        low = (1 << max(16, len(key).bit_length())) - 1
        table = np.zeros(low + 1, bool)
        table[same & low] = True  # by their last bits; those that only share these are alone in their run
        records = records[table[key & low]]
        records = records[np.argsort(records[:, 0])]
        key, rid, sim = records[:, 0], np.ascontiguousarray(records[:, 1]), records[:, 2].astype(np.uint64)
        band, size = key >> 16, key & 0xFFFF
        label = np.arange(len(key))
        at, k = np.arange(len(key) - 1), 1
        while True:
            at = at[: np.searchsorted(at, len(key) - k)]
            at = at[(band[at] == band[at + k]) & (size[at + k] - size[at] <= longer)]
            if not len(at):
                break
            new = at[label[at] != label[at + k]]
            near = new[np.bitwise_count(sim[new] ^ sim[new + k]) <= distance]
            if len(near):
                label = unite(label, near, near + k)
            k += 1
        order = np.lexsort((rid, label))
        group, line = label[order], rid[order]
        other = np.append(True, (group[1:] != group[:-1]) | (line[1:] != line[:-1]))
        group, line = group[other], line[other]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        n = np.diff(np.append(start, len(group)))
        with np.errstate(over="ignore"):
            name = np.add.reduceat(hashing.mix(line.view(np.uint64)), start).view(np.int64)
        some = np.repeat(n > 1, n)
        return np.stack([np.repeat(name, n)[some], line[some]], 1)

    def run(batches):
        found, n = [], 0
        for records in _buckets(batches, 3):
            found.append(within(records))
            n += len(found[-1])
            if n > 1 << 18:
                out = np.concatenate(found)
                found, n = [], 0
                yield _by_bucket(out, out[:, 0] % buckets)
        if n:
            out = np.concatenate(found)
            yield _by_bucket(out, out[:, 0] % buckets)
        del found
        hashing.give_back()

    return _together(rows).mapInArrow(run, _BUCKET)


def members_of(found: DataFrame) -> DataFrame:
    """(cluster, rid, first), all BIGINT, of the records of meet(), each once; first: the least rid of the cluster."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("cluster", "rid", "first")])

    def run(batches):
        for records in _buckets(batches, 2):
            records = records[np.lexsort((records[:, 1], records[:, 0]))]
            records = records[np.append(True, (records[1:] != records[:-1]).any(1))]
            start = np.flatnonzero(np.append(True, records[1:, 0] != records[:-1, 0]))
            first = np.repeat(records[start, 1], np.diff(np.append(start, len(records))))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (records[:, 0], records[:, 1], first)], names=schema.names)
        hashing.give_back()

    return _together(found).mapInArrow(run, schema)


def close_pairs(rows: DataFrame, distance: int, similarity: float) -> DataFrame:
    """(a, b) with a < b: all pairs within the clusters, each once."""
    c = members_of(meet(rows, distance, similarity, 16))
    return c.select("cluster", F.col("rid").alias("a")).join(c.select("cluster", F.col("rid").alias("b")), "cluster").where("a < b").select("a", "b").distinct()


def levenshtein(a: str | list[int], b: str | list[int], most: int | None = None) -> int:
    """Edit distance of texts or lists of code points, bit-parallel over whole strings; of one above `most`, if given, only that it is."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) or len(b)
    where: dict[str | int, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    limit = 1 << 62 if most is None else most + len(b)  # the score falls by one at most with each character that is left
    for c in b:
        limit -= 1
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        if score > limit:
            return score
        right = right << 1 | 1
        left <<= 1
        up = (left | ~(diagonal | right)) & full
        down = right & diagonal & full
    return score


def within(left: list[np.ndarray], right: list[np.ndarray], most: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """Whether each pair of texts (arrays of code points) is at an edit distance of at most `most`: the bit-parallel program over all pairs of as many blocks of 64 characters at once."""
    ok = np.zeros(len(left), bool)
    todo, cores = [], []
    for i, (a, b) in enumerate(zip(left, right)):
        if len(a) > len(b):
            a, b = b, a
        d = np.flatnonzero(a != b[: len(a)])
        if not len(d):
            ok[i] = len(b) - len(a) <= most[i]
            continue
        start = int(d[0])
        d = np.flatnonzero(a[start:] != b[len(b) - len(a) + start :])
        stop = int(d[-1]) + 1 + start if len(d) else start
        if stop <= start:
            ok[i] = len(b) - len(a) <= most[i]
            continue
        a, b = a[start:stop], b[start : stop + len(b) - len(a)]
        if len(b) <= most[i]:
            ok[i] = True
            continue
        todo.append(i)
        cores.append((a, b))
    blocks = np.array([len(a) + 63 >> 6 for a, _ in cores], np.int64)
    order = np.lexsort(([len(b) for _, b in cores], blocks)).tolist()
    at = 0
    while at < len(order):
        high = int(blocks[order[at]])
        part = order[at : at + max(1, min(at_once, (1 << 22) // high))]
        part = part[: int(np.searchsorted(blocks[part], high, "right"))]
        at += len(part)
        rows = [todo[k] for k in part]
        if len(part) < AT_ONCE * high:
            ok[rows] = [levenshtein(cores[k][0].tolist(), cores[k][1].tolist(), int(most[i])) <= most[i] for k, i in zip(part, rows)]
        else:
            ok[rows] = _near([cores[k] for k in part], most[rows])
    return ok


def _near(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Whether the edit distances of pairs of texts that aren't empty, the first of each of equally many blocks, are at most `most`. Pairs that can't be any more are left out on the way."""
    p, q = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    blocks, one, top = int(p.max() + 63 >> 6), np.uint64(1), np.uint64(63)
    codes = np.concatenate([a for a, _ in pairs] + [b for _, b in pairs])
    kind = np.zeros(int(codes.max()) + 1, np.int64)
    kind[codes] = 1
    kinds = int(kind.sum())
    if len(pairs) > 64 and len(pairs) * kinds * blocks > 1 << 23:  # many scripts at once: a smaller table at a time
        half = len(pairs) // 2
        return np.concatenate([_near(pairs[:half], most[:half]), _near(pairs[half:], most[half:])])
    codes = (np.cumsum(kind) - 1)[codes]
    # where each kind of character is in the first text of each pair
    pair, place = np.repeat(np.arange(len(p)), p), np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
    table = np.zeros((len(p) * kinds, blocks), np.uint64)
    np.add.at(table.reshape(-1), ((pair * kinds + codes[: len(pair)]) * blocks + (place >> 6)), one << (place & 63).astype(np.uint64))
    text = np.zeros((int(q.max()), len(p)), np.int64)
    pair, place = np.repeat(np.arange(len(q)), q), np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q)
    text[place, pair] = pair * kinds + codes[len(codes) - len(pair) :]
    up, down = np.full((blocks, len(p)), ~np.uint64(0)), np.zeros((blocks, len(p)), np.uint64)
    bit, score, ok, at = (p - 1 & 63).astype(np.uint64), np.zeros(len(p), np.int64), np.zeros(len(p), bool), np.arange(len(p))
    zeros, ones = np.zeros(len(p), np.uint64), np.ones(len(p), np.uint64)
    # no path of at most so many edits leaves the blocks so near to the diagonal; what they get from outside is never too low
    wide, last = int(most.max()), -1
    with np.errstate(over="ignore"):
        for j in range(len(text)):
            while last < min(blocks - 1, j + wide >> 6):
                last += 1
                score = score + (64 if last < blocks - 1 else p - 64 * last)
            same = table[text[j]]
            plus, minus = ones, zeros  # what comes in from above
            for b in range(max(0, j - wide >> 6), last + 1):
                eq, pv, mv = same[:, b], up[b], down[b]
                xv = eq | mv
                eq = eq | minus
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                if b == last:
                    low = bit if last == blocks - 1 else top
                    score = score + ((ph >> low) & one).view(np.int64) - ((mh >> low) & one).view(np.int64)
                out_plus, out_minus = ph >> top, mh >> top
                ph, mh = ph << one | plus, mh << one | minus
                up[b], down[b] = mh | ~(xv | ph), ph & xv
                plus, minus = out_plus, out_minus
            over = q == j + 1
            if over.any():
                ok[at[over]] = score[over] <= most[over]
            if j & 15 == 15:
                # a path through another row of this column, or on to the end, makes up for one edit a row at most
                row = p if last == blocks - 1 else 64 * (last + 1)
                stay = (q > j + 1) & (score - np.abs(row - (p - q + (j + 1))) <= most)
                n = int(stay.sum())
                if not n:
                    break
                if n < 0.8 * len(stay):
                    p, q, most, bit, score, at, zeros, ones = (x[stay] for x in (p, q, most, bit, score, at, zeros, ones))
                    text, up, down = text[:, stay], up[:, stay], down[:, stay]
    return ok


def histograms(lines: list[str]) -> np.ndarray:
    """Counts of each text's characters in 64 classes; texts at an edit distance of d differ by at most d in what they have more or less."""
    return _counts([np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in lines], 1, 64).astype(np.int16)


def _counts(codes: list[np.ndarray], grams: int, classes: int) -> np.ndarray:
    """Counts of each text's runs of so many characters in classes by a hash. An edit takes at most `grams` of them away and brings as many (up to 255 are counted, which only brings texts closer)."""
    out = np.zeros((len(codes), classes), np.uint8)
    for k in range(0, len(codes), 2048):
        part = codes[k : k + 2048]
        n = np.array([len(c) for c in part])
        flat = np.concatenate(part).astype(np.uint64) if len(part) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(part)), n)
        kind = flat.copy()
        for g in range(1, grams):
            kind = kind[:-1] * np.uint64(0x9E3779B1) + flat[g:]
            inside = row[:-1] == row[1:]  # no run goes from one text to the next
            kind, row, flat = kind[inside], row[:-1][inside], np.append(flat[:g], flat[g:][inside])
        if grams > 1:
            kind = hashing.mix(kind)
        got = np.bincount(row * classes + (kind % np.uint64(classes)).astype(np.int64), minlength=len(part) * classes)
        out[k : k + 2048] = np.minimum(got, 255).reshape(len(part), classes)
    return out


def _more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much the counts of each row of a exceed those of b, at most 255 each, in all; eight counts are added at a time."""
    x = (np.maximum(a, b) - b).view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    x = (x & low) + (x >> np.uint64(8) & low)
    return x.sum(1).view(np.uint16).reshape(-1, 4).sum(1, dtype=np.int64)


class _Texts:
    """Texts of which pairs are compared: by SimHashes as candidates are, by lengths and counts, which never refuse a similar pair, and then as they are."""

    def __init__(self, lines: list[str], least: float, distance: int):
        sims = [simhash(h, runs) for h, runs, *_ in _lines(pa.array(lines, pa.large_string()))]
        self.sim, self.distance = np.concatenate(sims).view(np.uint64), distance
        self.codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in lines]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.rest, self.unlike = 1 - least, np.zeros(0, np.int64)
        self.counts = [(g, _counts(self.codes, g, n)) for g, n in ((1, 64), (2, 256), (3, 1024))]
        self.lines, self.spaces = lines, np.array([t.count(" ") for t in lines], np.int64)

    def most(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The edit distances up to which the texts x and y are similar."""
        return np.floor(np.maximum(self.size[x], self.size[y]) * self.rest + 1e-9).astype(np.int64)

    def likely(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the texts x and y may be similar, pair by pair."""
        most = self.most(x, y)
        out = (np.bitwise_count(self.sim[x] ^ self.sim[y]) <= self.distance) & (np.abs(self.size[x] - self.size[y]) <= most)
        for grams, counts in self.counts:
            left = np.flatnonzero(out)
            for k in range(0, len(left), 2048):
                i = left[k : k + 2048]
                a, b = counts[x[i]], counts[y[i]]
                out[i] = np.maximum(_more(a, b), _more(b, a)) <= grams * most[i]
        if len(self.unlike):  # pairs of several clusters are compared once
            name = np.minimum(x, y) * len(self.size) + np.maximum(x, y)
            out &= self.unlike[np.minimum(np.searchsorted(self.unlike, name), len(self.unlike) - 1)] != name
        return out

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the texts x and y are, pair by pair."""
        most = self.most(x, y)
        out = np.zeros(len(x), bool)
        # texts of as many words are, if to exchange the words that differ, place by place, isn't too much
        for i in np.flatnonzero(self.spaces[x] == self.spaces[y]).tolist():
            a, b = self.lines[x[i]].split(" "), self.lines[y[i]].split(" ")
            out[i] = sum(max(len(v), len(w)) for v, w in zip(a, b) if v != w) <= most[i]
        left = np.flatnonzero(~out)
        out[left] = within([self.codes[i] for i in x[left].tolist()], [self.codes[i] for i in y[left].tolist()], most[left])
        name = np.minimum(x, y) * len(self.size) + np.maximum(x, y)
        self.unlike = np.union1d(self.unlike, name[~out])
        return out


def settle(lines: list[str], cluster: np.ndarray, member: np.ndarray, least: float, distance: int = DISTANCE) -> np.ndarray:
    """The least place of each text's group: what similar pairs of a cluster chain together. member: places in lines, by cluster."""
    label = np.arange(len(lines))
    if not len(member):
        return label
    texts = _Texts(lines, least, distance)
    # neighbours of a cluster begin alike, so chains of similar texts are found first
    rank = np.empty(len(lines), np.int64)
    rank[sorted(range(len(lines)), key=lines.__getitem__)] = np.arange(len(lines))
    order = np.lexsort((rank[member], cluster))
    cluster, member = np.unique(cluster[order], return_inverse=True)[1], member[order]
    at, k, wait, waiting, held, holding = np.arange(len(member) - 1), 1, [], 0, [], 0
    while True:
        at = at[: np.searchsorted(at, len(member) - k)]
        at = at[cluster[at] == cluster[at + k]]
        x, y = member[at], member[at + k]
        apart = (label[x] != label[y]) & (np.bitwise_count(texts.sim[x] ^ texts.sim[y]) <= distance)
        x, y = x[apart], y[apart]
        wait.append(np.minimum(x, y) * len(lines) + np.maximum(x, y))
        waiting += len(x)
        turn = k & k - 1 == 0 or not len(at)
        if turn or waiting >= ROUND:
            new = np.unique(np.concatenate(wait))
            for i in range(0, len(new), 8 * ROUND):
                part = new[i : i + 8 * ROUND]
                held.append(part[texts.likely(*np.divmod(part, len(lines)))])
                holding += len(held[-1])
            wait, waiting = [], 0
        if turn or holding >= 4 * ROUND:
            # what is likely waits until it is many: comparing few pairs at once takes nearly as long
            new = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            for i in range(0, len(new), 4 * ROUND):
                p, q = np.divmod(new[i : i + 4 * ROUND], len(lines))
                far = label[p] != label[q]
                p, q = p[far], q[far]
                good = texts.similar(p, q)
                label = unite(label, p[good], q[good])
            held, holding = [], 0
            # clusters that are one group are done
            first = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
            done = np.minimum.reduceat(label[member], first) == np.maximum.reduceat(label[member], first)
            at = at[~done[cluster[at]]]
        if not len(at):
            return label
        k += 1


def verified_groups(members: DataFrame, texts: DataFrame, least: float, distance: int, large: int = LARGE) -> DataFrame:
    """(node, component): the groups of two and more texts (rid, line, component) that similar pairs of one cluster (members: cluster, rid) chain together.

    component is what all clusters hang together by. Its texts are sent to one task once. The clusters of a component of more than
    `large` members are spread over tasks, each with the texts it needs, and the tasks' groups are put together by connected components.
    """
    placed = members.select("cluster", "rid").join(texts.select("rid", "component"), "rid")
    big = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > large).select("component", F.ceil(F.col("n") / large).cast("long").alias("slots"))
    big = cut(big, "large")
    some = not big.isEmpty()
    whole = texts.select("component", F.lit(0).cast("long").alias("slot"), "rid", "line")
    placed = placed.withColumn("slot", F.lit(0).cast("long"))
    if some:
        placed = placed.drop("slot").join(maybe_broadcast(big), "component", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("cluster"), F.col("slots")), F.lit(0)))
        need = placed.where("slots is not null").select("component", "slot", "rid").distinct()
        whole = whole.join(maybe_broadcast(big.select("component")), "component", "left_anti").unionAll(need.join(texts.select("rid", "line"), "rid").select("component", "slot", "rid", "line"))
    rows = whole.select("component", "slot", F.lit(0).cast("long").alias("cluster"), "rid", "line").unionAll(placed.select("component", "slot", "cluster", "rid", F.lit(None).cast("string")))
    rows = rows.repartition("component", "slot").sortWithinPartitions("component", "slot", F.col("line").isNull(), "rid")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("component", "node", "root")])

    def run(batches):
        now, at = None, {}
        of, rid, line, cluster, member, chars = [], [], [], [], [], 0

        def flush():
            nonlocal at, of, rid, line, cluster, member, chars
            label = settle(line, np.array(cluster, np.int64), np.array(member, np.int64), least, distance)
            ids = np.array(rid, np.int64)
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            some = np.bincount(label, minlength=len(ids))[label] > 1
            cols = (np.array(of, np.int64)[some], ids[some], low[label][some])
            at, of, rid, line, cluster, member, chars = {}, [], [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=schema.names)

        for batch in batches:
            for c, slot, k, x, t in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (c, slot) != now:
                    # whole components are settled together, as many as make it worth while
                    if len(member) > TOGETHER or chars > TOGETHER_CHARS:
                        yield flush()
                    now, at = (c, slot), {}
                if t is not None:
                    at[x] = len(rid)
                    of.append(c)
                    rid.append(x)
                    line.append(t)
                    chars += len(t)
                else:
                    cluster.append(k)
                    member.append(at[x])
        if rid:
            yield flush()
        del rid, line, cluster, member
        hashing.give_back()

    groups = small_batches(rows).mapInArrow(run, schema)
    if not some:
        return groups.select("node", F.col("root").alias("component"))
    groups = cut(groups, "parts")
    apart = groups.join(maybe_broadcast(big.select("component")), "component", "left_semi")
    together = groups.join(maybe_broadcast(big.select("component")), "component", "left_anti").select("node", F.col("root").alias("component"))
    return together.unionAll(components(apart, "node", "root"))


_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def fetch(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(rid, line): the normalised texts of the wanted occurrences (rid, doc_id, thash, line_no). A text is sent at most once, and cut into lines once."""
    want = need.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("line_no", "rid")).alias("want"))
    want = F.broadcast(want) if fits(need) else want
    d, n = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("thash"), "text").alias("d"), want.alias("n")
    got = d.join(n, F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.thash") == F.col("n.thash"))).select(F.lower("d.text").alias("text"), F.transform("n.want", lambda x: x["line_no"]).alias("numbers"), F.transform("n.want", lambda x: x["rid"]).alias("rids"))
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("line", T.StringType())])

    def run(batches):
        for b in batches:
            ids, found = [], []
            for text, numbers, rids in zip(*(b.column(i).to_pylist() for i in range(3))):
                lines = text.split("\n")
                ids += rids
                found += [" ".join(_WORD.findall(lines[k])) for k in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=schema.names)
        hashing.give_back()

    return small_batches(got).mapInArrow(run, schema).dropDuplicates(["rid"])


def removals(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, thash, gone ARRAY<INT>): the numbers of the lines that each text loses."""
    docs = docs.select("doc_id", "text")
    read = cut(scan(docs, ROWS, BANDS), "lines")
    occ = read.where("lid is not null").select("doc_id", "thash", "line_no", "lid")
    n = read.agg(F.sum(F.length("rids") / 8)).first()[0] or 0
    buckets = min(1 << 20, 1 + int(n) * AT_A_TIME * 24 // BUCKET_BYTES)
    parts = []
    for start in range(0, BANDS, AT_A_TIME):
        parts.append(cut(meet(spread(read, [start], buckets), distance, similarity, 1 + buckets // 8), "clusters"))
    members = cut(members_of(reduce(DataFrame.unionAll, parts)), "clusters")
    for t in parts:
        drop_cut(t)
    close = cut(components(members, "first", "rid"), "components")
    # all but the lines that are alone, which most are
    twice = occ.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1").select(rid(F.col("lid")).alias("node"))
    some = cut(close.select("node").unionAll(twice).distinct(), "some")
    some_of = cut(occ.join(maybe_broadcast(some), rid(F.col("lid")) == F.col("node"), "left_semi"), "lines")
    drop_cut(read)
    drop_cut(some)
    occ, at = some_of, F.struct("doc_id", "thash", "line_no")
    one = cut(occ.groupBy("lid").agg(F.min(at).alias("first"), F.count("*").alias("n")).withColumn("rid", rid(F.col("lid"))), "distinct-lines")
    need = cut(close.withColumnRenamed("node", "rid").join(one.select("rid", "first.*"), "rid"), "need")
    texts = cut(fetch(docs, need.drop("component")).join(need.select("rid", "component"), "rid"), "texts")
    drop_cut(need)
    drop_cut(close)
    groups = cut(verified_groups(members, texts, similarity, distance), "groups")
    for t in (members, texts):
        drop_cut(t)
    grouped = groups.join(one.select(F.col("rid").alias("node"), "lid", "first"), "node")
    kept = grouped.groupBy("component").agg(F.min("first").alias("kept"))
    fuzzy = grouped.join(kept, "component").select("lid", "kept")
    exact = one.where("n > 1").join(fuzzy.select("lid"), "lid", "left_anti").select("lid", F.col("first").alias("kept"))
    hit = occ.join(fuzzy.unionAll(exact), "lid").where(~at.eqNullSafe(F.col("kept")))
    out = cut(hit.groupBy("doc_id", "thash").agg(F.collect_set("line_no").alias("gone")), "removals")
    for t in (occ, one, groups):
        drop_cut(t)
    return out


def dedup(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with text without the removed lines, and n_lines INT and n_removed INT added."""
    docs = docs.drop("n_lines", "n_removed")
    gone = removals(docs, distance, similarity).select(F.col("doc_id").alias("__id"), F.col("thash").alias("__thash"), F.col("gone").alias("__gone"))

    @F.pandas_udf(T.StringType())
    def without(text: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, numbers):
            if t is None or g is None:
                out.append(None)
            else:
                g = set(g.tolist())
                out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in g))
        return pd.Series(out, dtype=object)

    # else a filter on the text has it computed twice, by two Python workers of a task at once
    without = without.asNondeterministic()
    d = docs.withColumn("__t", F.xxhash64("text"))
    got = d.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__thash")), "left")
    less = without(F.when(F.col("__gone").isNotNull(), F.col("text")), F.col("__gone"))
    return got.select(
        *(F.coalesce(less, F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that occur before, exactly or nearly."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
