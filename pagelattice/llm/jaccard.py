"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Each text is read once: MinHash signature of its n-grams, cut into bands; a 128-bit hash of its word sequence. Documents of
   the same word sequence are one representative from here on; their pairs have similarity 1 and need no search.
2. Bands and rows are chosen for a target recall at the threshold. Band hashes are shuffled; representatives that share one are
   candidates. A bucket links its members to its least member, found by partial aggregation, which is enough to find the families
   that candidates form.
3. Full n-gram sets are made again, for candidates only, and sent to the blocks of their family. A block of up to `BLOCK`
   members is verified at once: the intersections of all its pairs are one product of incidence matrices. A larger family is
   several blocks, and each pair of blocks that some bucket joins is verified. So no partner or candidate is capped, and the
   texts of a pair are never sent once for each pair.
4. A task gives each member's number of links and the member it hangs together with (`links`, whose rows grow with the members),
   or the pairs themselves (`join`). Classes are the connected components.

A word is a run of ASCII letters and digits or of characters outside ASCII, in lower case; a text of fewer words than n has one
n-gram, all its words.

Defined cases: null doc_id, null text and texts without words have no partner; repeated rows (one doc_id and text) are one
document; rows of one doc_id with different texts all count: a pair has the largest similarity of them, the doc_id is in one class
and has the sum of its texts' links; a document isn't paired with itself; ties in similarity all count; an empty table gives an empty
result; very long texts are hashed whole, in memory in proportion to the longest; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut, drop_cut, maybe_broadcast, small_batches
from . import hashing
from .components import components

N = 3
THRESHOLD = 0.6
RECALL = 0.98
#: Hash functions of a signature at most.
HASHES = 128
#: Members of a family that are verified in one product.
BLOCK = 1024


def bands_rows(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which a pair at the threshold is found with the given probability and the signature has no more than the given hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches the recall with so few hashes")


def _family(k: int, seed: int = 0x5EED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)


def _sid(w: hashing.Words, k: int) -> bytes:
    """A hash of the word sequence of the k-th text."""
    return hashlib.blake2b(w.hashes[w.first[k] : w.first[k + 1]], digest_size=16).digest()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, sid BINARY: hash of the word sequence, bands ARRAY<BIGINT>) of documents with words."""
    low = docs.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("text"))
    schema = T.StructType([low.schema["doc_id"], T.StructField("sid", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))])
    mult, add = _family(bands * rows)

    def run(batches):
        for b in batches:
            data, off = hashing.buffers(b.column(1))
            keep, sid, out = [], [], []
            for i, j in hashing.pieces(off, 1 << 19):
                w = hashing.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                g, first = hashing.ngrams(w.hashes, w.first, n)
                have = np.flatnonzero(np.diff(first) > 0)
                if not len(have):
                    continue
                g32, starts = (g >> np.uint64(32)).astype(np.uint32), first[have]
                sig = np.empty((len(have), bands * rows), np.uint32)
                buf = np.empty_like(g32)
                for k in range(bands * rows):
                    np.multiply(g32, mult[k], out=buf)
                    np.add(buf, add[k], out=buf)
                    sig[:, k] = np.minimum.reduceat(buf, starts)
                key = np.zeros((len(have), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = hashing.mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::rows].astype(np.uint64) + np.uint64(1))
                keep += (have + i).tolist()
                out.append(key.view(np.int64))
                sid += [_sid(w, d) for d in have]
            flat = np.concatenate(out).ravel() if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(sid, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * bands, pa.int32()), pa.array(flat))], names=["doc_id", "sid", "bands"])
            del b, data, flat
        hashing.give_back()

    return small_batches(low).mapInArrow(run, schema)


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices over the elements that are shared."""
    both = sets if others is None else sets + others
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    item, col, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(item), -1)
    place[shared] = np.arange(len(shared))
    col = place[col]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    m, k = len(sets), len(both) if others is None else len(others)
    out = np.zeros((m, k), np.float32)
    wide = max(256, (1 << 22) // len(both))
    for a in range(0, len(shared), wide):
        p, q = np.searchsorted(col, [a, a + wide])
        x = np.zeros((len(both), min(wide, len(shared) - a)), np.float32)
        x[row[p:q], col[p:q] - a] = 1
        out += x @ x.T if others is None else x[:m] @ x[m:].T
    return out


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("jaccard", T.DoubleType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def verify(members: DataFrame, n: int, threshold: float, pairs: bool = True) -> DataFrame:
    """Of the pairs that reach the threshold, (a, b, jaccard) each; or, without pairs, (a, b, links) for each member of some pair: the least member that the task's pairs chain it to, and its partners counted by weight.

    members: (component, i, j, side, rid, text, sid, weight), sorted by the first five; the first three are the task; side 0 and 1 are paired, or all of side 2. Rows whose
    text isn't the representative's (another text of its doc_id) and repeated rows are passed over.
    """
    schema = PAIR if pairs else LINK

    def settle(side: np.ndarray, rid: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        size = np.array([len(s) for s in sets], np.float64)
        if side[0] == 2:
            left = right = np.arange(len(sets))
            common = intersections(sets)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return None
            common = intersections([sets[i] for i in left], [sets[i] for i in right])
        j = common / (size[left][:, None] + size[right][None, :] - common)
        if side[0] == 2:
            np.fill_diagonal(j, -1)
        if pairs:
            j = np.triu(j, 1) if side[0] == 2 else j
            x, y = np.nonzero(j >= threshold - 1e-9)
            a, b = rid[left[x]], rid[right[y]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.round(j[x, y].astype(np.float64), 6))], names=schema.names)
        near = j >= threshold - 1e-9
        links = np.zeros(len(sets), np.int64)
        links[left] = near @ weight[right]
        if side[0] != 2:
            links[right] = weight[left] @ near
        # the least member of each group: labels spread over the rows and columns of the matrix until they rest
        label = np.arange(len(sets))
        by_rid = np.argsort(rid, kind="stable")
        rank = np.empty(len(sets), np.int64)
        rank[by_rid] = np.arange(len(sets))
        label = rank.copy()
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        while len(x):
            before = label.copy()
            np.minimum.at(label, x, before[y])
            np.minimum.at(label, y, before[x])
            label = np.minimum(label, label[by_rid[label]])
            if np.array_equal(label, before):
                break
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(rid[by_rid[label[some]]]), pa.array(links[some])], names=schema.names)

    def run(batches):
        task, side, rid, weight, sets = None, [], [], [], []

        def done():
            got = settle(np.array(side), np.array(rid), np.array(weight), sets) if len(sets) > 1 else None
            return [got] if got is not None else []

        for batch in batches:
            data, off = hashing.buffers(batch.column(5))
            grams: list[np.ndarray] = []
            sids: list[bytes] = []
            for i, j in hashing.pieces(off, 1 << 19):
                w = hashing.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                g, first = hashing.ngrams(w.hashes, w.first, n)
                grams += [np.unique(g[first[k] : first[k + 1]]) for k in range(j - i)]
                sids += [_sid(w, k) for k in range(j - i)]
            for c, i, j, s, r, sid, m, own, g in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6, 7)), sids, grams):
                if (t := (c, i, j)) != task:
                    yield from done()
                    task, side, rid, weight, sets = t, [], [], [], []
                if sid == own and not (side and side[-1] == s and rid[-1] == r):
                    side.append(s)
                    rid.append(r)
                    weight.append(m)
                    sets.append(g)
        yield from done()
        sets = []
        hashing.give_back()

    return small_batches(members).mapInArrow(run, schema)


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, jaccard): each pair of documents once, id_a < id_b. Grows with the square of the largest groups; `links` doesn't."""
    members, found = _search(docs, threshold, n, recall, block)
    same = members.select("rid", F.col("doc_id").alias("x")).join(members.select("rid", F.col("doc_id").alias("y")), "rid").where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    m = members.select("rid", "doc_id")
    near = found.join(m.select(F.col("rid").alias("a"), F.col("doc_id").alias("x")), "a").join(m.select(F.col("rid").alias("b"), F.col("doc_id").alias("y")), "b").where("x <> y").select("x", "y", "jaccard")
    return same.unionAll(near).groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("jaccard").alias("jaccard"))


def _search(docs: DataFrame, threshold: float, n: int, recall: float, block: int, pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members (rid, doc_id, weight: how many documents the representative stands for), what `verify` finds of representatives)."""
    docs = docs.select("doc_id", "text")
    bands, rows = bands_rows(threshold, recall)
    sig = cut(signatures(docs, n, bands, rows), "signatures")
    reps = cut(sig.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands")).withColumn("rid", F.monotonically_increasing_id()), "representatives")
    one = sig.select("sid", "doc_id").distinct().join(reps.select("sid", "rid"), "sid").select("rid", "doc_id")
    members = cut(one, "members")
    drop_cut(sig)
    # buckets: every member is linked to the least
    keys = reps.select("rid", F.posexplode("bands").alias("band", "key"))
    full = keys.groupBy("band", "key").agg(F.min("rid").alias("least"), F.max("rid").alias("most")).where("least <> most").select("band", "key", "least")
    linked = cut(keys.join(full, ["band", "key"]).select("rid", "least").distinct(), "buckets")
    family = components(linked, "rid", "least")
    # the members of families of several blocks, sorted so that those of one bucket are near each other, are cut into blocks
    near = linked.groupBy("rid").agg(F.min("least").alias("least")).join(family.withColumnRenamed("node", "rid"), "rid")
    near = cut(near, "families")
    drop_cut(linked)
    large = near.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > block).select("component")
    large = cut(large, "large")
    some, old = not large.isEmpty(), [near, large]
    side = lambda rid, i, j, s: (rid, "component", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(s).alias("side"))
    if some:
        tall = near.join(maybe_broadcast(large), "component").select("component", "least", "rid").repartitionByRange("component", "least", "rid").sortWithinPartitions("component", "least", "rid")
        place = F.monotonically_increasing_id()
        tall = cut(tall.select("rid", "component", (F.shiftright(place, 33) * (1 << 30) + F.floor((place % (1 << 33)) / block)).cast("long").alias("block")), "blocks")
        near = near.join(maybe_broadcast(large), "component", "left_anti")
        # pairs of blocks that some bucket joins; within a block all pairs are verified anyway
        by_key = keys.join(tall, "rid").select("band", "key", "component", "block").distinct()
        joined = cut(by_key.join(by_key.withColumnRenamed("block", "other").drop("component"), ["band", "key"]).where("block < other").select("component", "block", "other").distinct(), "joined")
        old += [tall, joined]
        first = joined.select("component", F.col("block"), F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
        second = joined.select("component", F.col("other").alias("block"), F.col("block").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side"))
        cross = tall.join(first.unionAll(second), ["component", "block"]).select("rid", "component", "i", "j", "side")
        tasks = near.select(*side("rid", "component", "component", 2)).unionAll(tall.select(*side("rid", "block", "block", 2))).unionAll(cross)
    else:
        tasks = near.select(*side("rid", "component", "component", 2))
    weights = members.groupBy("rid").agg(F.count("*").alias("weight"))
    at = tasks.join(reps.select("rid", "doc_id", "sid"), "rid").join(weights, "rid").select("doc_id", "sid", "rid", "weight", "side", "component", "i", "j")
    at = cut(at, "tasks")
    drop_cut(reps)
    # the texts of candidates: a small list of ids goes to the texts, else both are shuffled
    texts = docs.where("doc_id is not null and text is not null").join(maybe_broadcast(at), "doc_id").select("component", "i", "j", "side", "rid", F.lower("text").alias("text"), "sid", "weight")
    texts = texts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "rid")
    found = cut(verify(texts, n, threshold, pairs), "pairs")
    for t in (at, *old):
        drop_cut(t)
    return members, found


def _classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, g): a class of each document that has words; one of several texts joins their groups."""
    groups = components(found, "a", "b")
    own = members.join(groups.withColumnRenamed("node", "rid"), "rid", "left").select("doc_id", F.coalesce("component", "rid").alias("g"))
    own = cut(own.distinct(), "groups")
    several = own.groupBy("doc_id").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("doc_id", "a")
    several = cut(several, "several")
    if not several.isEmpty():
        more = components(several.join(own, "doc_id").select("a", F.col("g").alias("b")), "a", "b")
        own = own.join(more.withColumnRenamed("node", "g"), "g", "left").select("doc_id", F.coalesce("component", "g").alias("g")).distinct()
    return own


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each doc_id: the least doc_id of the documents that pairs chain together, and the number of documents that this one makes a pair with. Documents without a pair are a class of their own."""
    members, found = _search(docs, threshold, n, recall, block, pairs=False)
    own = _classes(members, found)
    least = own.groupBy("g").agg(F.min("doc_id").alias("class_id"))
    classes = own.join(least, "g").select("doc_id", "class_id")
    # of one representative's documents, each is linked with the others and with all that its partners stand for
    weights = members.groupBy("rid").agg((F.count("*") - 1).alias("same"))
    near = found.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("near"))
    count = members.join(weights, "rid").join(near, "rid", "left").groupBy("doc_id").agg(F.sum(F.col("same") + F.coalesce("near", F.lit(0))).alias("n_links"))
    known = classes.join(count, "doc_id")
    every = docs.where("doc_id is not null").select("doc_id").distinct()
    return every.join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """docs without the documents that a chain of pairs joins with a smaller doc_id; all other rows and columns stay. Rows that share a doc_id are one document and stay or go together."""
    own = _classes(*_search(docs, threshold, n, RECALL, BLOCK, pairs=False))
    least = own.groupBy("g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    gone = cut(own.join(least, "g").where("doc_id <> least").select("doc_id").distinct(), "gone")
    return docs.join(maybe_broadcast(gone), "doc_id", "left_anti")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class by chains of pairs whose word 3-grams have a Jaccard similarity of at least 0.6, and with how many documents it makes such a pair."""
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
