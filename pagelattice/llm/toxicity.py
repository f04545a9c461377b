"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the embeddings of its hashed features: the word and its first 4 to 7 bytes. Filters of
several widths slide over the words of a whole text; each filter is pooled by its `POOL` largest values (max pooling that
can count), and a logistic unit joins them.

It is trained on every labelled document, in tasks: a shuffle by doc_id packs the labelled texts into units of about `UNIT`
bytes, as numbers of their words, so that they are hashed once. A first pass counts every feature's documents by label. In each of
`ROUNDS` passes every unit descends from the same parameters through its documents, and the results are averaged, those of a feature by the
documents that have it in a unit. A fifth of the labelled documents, by a hash of doc_id, doesn't train but is scored, all of it, for the
thresholds (all labelled documents, if none of a fifth is toxic); a language with too few held-out positives uses the threshold of all languages together. Sums are of integers, so neither
the order of rows nor that of tasks changes the model. Scores are multiples of 1 / `STEPS`, so the calibration's counts by score are exact.

Scoring needs no shuffle: convolutions are linear, so each hashed feature's product with each filter is a row of one
table of bounded size (at most 2**BITS rows) that is broadcast, and a text is scored by summing rows of it.

Defined cases: null or wordless text scores 0 and isn't toxic; a null or unseen language uses the common threshold;
repeated rows get the same score; a score equal to its threshold isn't toxic; extra columns pass through, those named like the added ones
are replaced; without both labels, every score is 0 and nothing is toxic; an empty table gives an empty table; very long texts are
scored whole, in memory in proportion to the longest; of several labels of a document the toxic one counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut, drop_cut, maybe_broadcast, small_batches
from . import hashing

BITS = 18
PREFIXES = (4, 5, 6, 7)
WIDTHS = (1, 2, 3)
FILTERS = 4
DIM = 8
POOL = 3
#: Bytes of texts of a unit; a longer text is a unit of its own. Labels for which there is a partition of units.
UNIT, LABELS = 8 << 20, 2500
#: Passes over the units, documents of a step, and the rate of steps.
ROUNDS, BATCH, RATE = 4, 64, 0.05
#: Sums of parameters are of integers: multiples of this.
GRAIN = 2.0**-30
STEPS = 1 << 16
#: Held-out positives that a language needs for a threshold of its own.
LEAST = 12


def features(words: hashing.Words) -> np.ndarray:
    """Buckets of the features of each word, shape (words, 1 + prefixes)."""
    cols = [words.hashes] + [words.prefix(k) for k in PREFIXES]
    return np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in cols], axis=1)


@dataclass
class Model:
    """Tables and thresholds of a trained classifier."""

    table: np.ndarray  # (1 + known features, sum(WIDTHS) * FILTERS): features times filters; the first row is zero
    place: np.ndarray  # (2**BITS): a feature's row
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS * POOL + 1)
    common: float = 2.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, sums: np.ndarray) -> np.ndarray:
        """The POOL largest activations of every filter over one text. sums: its words' rows."""
        return _pool(_conv(sums, self.bias))[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, off = hashing.buffers(texts)
        out = np.zeros(len(off) - 1)
        for i, j in hashing.pieces(off, 1 << 18):
            w = hashing.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            f = self.place[features(w)]
            sums = self.table[f[:, 0]]
            for k in range(1, f.shape[1]):
                sums += self.table[f[:, k]]
            for d in range(i, j):
                a, b = w.first[d - i], w.first[d - i + 1]
                if b > a:
                    out[d] = self.score(sums[a:b])
        return out

    def score(self, sums: np.ndarray) -> float:
        """The score of one text of at least one word. sums: its words' rows."""
        z = self.pooled(sums).ravel() @ self.out[:-1] + self.out[-1]
        return float(np.round(STEPS / (1 + np.exp(-np.clip(z, -30, 30)))) / STEPS)


def _conv(sums: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Activations (positions, filters of all widths) from the words' products with the filters' taps."""
    n, k = len(sums), 0
    z = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        part = z[:, i * FILTERS : (i + 1) * FILTERS]
        for tap in range(width):
            part[: n - tap] += sums[tap:, k * FILTERS : (k + 1) * FILTERS]
            k += 1
    z += bias
    return np.maximum(z, 0, out=z)


def _pool(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest POOL values of each column, descending, and their rows (-1 where there are fewer rows)."""
    n = len(z)
    if n > POOL:
        rows = np.argpartition(z, n - POOL, axis=0)[n - POOL :]
    else:
        rows = np.repeat(np.arange(n)[:, None], z.shape[1], 1)
    v = np.take_along_axis(z, rows, 0)
    o = np.argsort(-v, axis=0, kind="stable")
    v, rows = np.take_along_axis(v, o, 0), np.take_along_axis(rows, o, 0)
    if n < POOL:
        v = np.concatenate([v, np.zeros((POOL - n, z.shape[1]), np.float32)])
        rows = np.concatenate([rows, np.full((POOL - n, z.shape[1]), -1)])
    return v, rows


@dataclass
class Unit:
    """Labelled documents: document i has the words at[first[i]:first[i + 1]], of which word w has the features feats[w]."""

    key: int
    first: np.ndarray
    at: np.ndarray
    feats: np.ndarray  # (distinct words, 1 + prefixes)
    toxic: np.ndarray
    held: np.ndarray
    weight: np.ndarray
    used: np.ndarray  # features of documents that train, ascending
    df: np.ndarray  # (2, used): how many of those documents have them, by label
    langs: list[str | None]

    def words(self, i: int) -> np.ndarray:
        return self.at[self.first[i] : self.first[i + 1]]

    def rows(self, held: bool) -> np.ndarray:
        """Documents with words that are held out, or that train."""
        return np.flatnonzero((self.held == held) & (np.diff(self.first) > 0))


_UNIT = "key long, first binary, at binary, feats binary, toxic binary, held binary, weight binary, used binary, df binary, langs array<string>"
_KINDS = {"first": np.int64, "at": np.uint32, "feats": np.int32, "toxic": np.uint8, "held": np.bool_, "weight": np.float64, "used": np.int32, "df": np.int32}


def _units(b: pa.RecordBatch):
    for i in range(b.num_rows):
        got = {n: np.frombuffer(b.column(n)[i].as_buffer(), kind) for n, kind in _KINDS.items()}
        got |= {"feats": got["feats"].reshape(-1, 1 + len(PREFIXES)), "df": got["df"].reshape(2, -1)}
        yield Unit(b.column("key")[i].as_py(), langs=b.column("langs")[i].as_py(), **got)


def _pack(batches):
    """Units of the rows (doc_id, toxic, lang, weight, held, text) as they come; where one ends depends on the sizes of texts only."""
    whole, room, docs, seen, base = [], UNIT, [], [], 0

    def unit():
        u, first, back = np.unique(np.concatenate([h for h, _ in seen]), return_index=True, return_inverse=True)
        at = back[np.concatenate([d[0] for d in docs])].astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])]).astype(np.int64)
        feats = np.concatenate([f for _, f in seen])[first].astype(np.int32)
        toxic, held, weight = (np.array([d[k] for d in docs], kind) for k, kind in ((2, np.uint8), (3, np.bool_), (4, np.float64)))
        df = np.zeros((2, 1 << BITS), np.int32)
        for i in np.flatnonzero(~held):
            df[toxic[i], np.unique(feats[np.unique(at[ends[i] : ends[i + 1]])])] += 1
        used = np.flatnonzero(df.any(0)).astype(np.int32)
        cols = [[docs[0][1]], *([x.tobytes()] for x in (ends, at, feats, toxic, held, weight, used, np.ascontiguousarray(df[:, used]))), [[d[5] for d in docs]]]
        kinds = [pa.int64(), *[pa.binary()] * len(_KINDS), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", *_KINDS, "langs"])

    for b in batches:
        data, off = hashing.buffers(pc.utf8_lower(b.column("text")))
        key, toxic, lang, weight, held = (b.column(n).to_pylist() for n in ("key", "toxic", "lang", "weight", "held"))
        i = 0
        while i < b.num_rows:
            j = i
            while j < b.num_rows and off[j + 1] - off[i] <= min(room, hashing.PIECE):
                j += 1
            if j == i and off[i + 1] - off[i] > room and docs:
                yield unit()
                room, docs, seen, base = UNIT, [], [], 0
                continue
            j = max(j, i + 1)
            w = hashing.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            u, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            seen.append((u, features(w.of(first))))
            for d in range(i, j):
                docs.append((back[w.first[d - i] : w.first[d - i + 1]] + base, key[d], toxic[d], held[d], weight[d], lang[d]))
            base += len(u)
            room -= int(off[j] - off[i])
            i = j
    if docs:
        yield unit()
    hashing.give_back()


def _count(batches):
    """Of every feature, the documents that train by label; at 1 << BITS, all of them."""
    df = np.zeros((2, (1 << BITS) + 1), np.int64)
    for b in batches:
        for u in _units(b):
            df[:, u.used] += u.df
            df[:, -1] += np.bincount(u.toxic[u.rows(False)], minlength=2)
    at = np.flatnonzero(df.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[0, at]), pa.array(df[1, at])], names=["key", "c0", "c1"])


class State:
    """Parameters with the sums of their squared gradients; emb: of the known features (buckets, ascending)."""

    def __init__(self, known: np.ndarray, odds: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        taps, nf = sum(WIDTHS), len(WIDTHS) * FILTERS
        emb = rng.normal(0, 0.05, (len(known), DIM)).astype(np.float32)
        # the first coordinate of an embedding starts as its smoothed log-odds by documents
        emb[:, 0] = np.clip(odds, -1, 4) * 0.5
        filt = rng.normal(0, 0.15, (taps, FILTERS, DIM)).astype(np.float32)
        filt[:, :, 0] += 0.5
        out = np.concatenate([rng.normal(0.3, 0.05, nf * POOL), [-2.0]]).astype(np.float32)
        self.known, self.value = known, {"emb": emb, "filt": filt, "bias": np.full(nf, -0.5, np.float32), "out": out}
        self.acc = {k: np.full_like(v, 1e-4) for k, v in self.value.items()}

    def model(self) -> Model:
        v, rows_of = self.value, np.zeros(1 << BITS, np.int32)
        rows_of[self.known] = np.arange(1, len(self.known) + 1)
        taps = v["filt"].reshape(-1, DIM)
        return Model(np.concatenate([np.zeros((1, len(taps))), v["emb"] @ taps.T]).astype(np.float32), rows_of, v["bias"], v["out"])

    def dense(self) -> np.ndarray:
        """What isn't of one feature, and its squared gradients, in one row each."""
        return np.stack([np.concatenate([x[k].ravel() for k in ("filt", "bias", "out")]) for x in (self.value, self.acc)]).astype(np.float64)

    def set_dense(self, rows: np.ndarray) -> None:
        for x, row in zip((self.value, self.acc), rows):
            at = 0
            for k in ("filt", "bias", "out"):
                x[k] = row[at : at + x[k].size].reshape(x[k].shape).astype(np.float32)
                at += x[k].size


def descend(u: Unit, state: State, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass through a unit's training documents. What it changes: in the embeddings of its used features, in the sums of their squared gradients, and in the dense rows."""
    rows = u.rows(False)
    mark = np.zeros(len(u.feats), bool)
    for i in rows:
        mark[u.words(i)] = True
    words, place = np.flatnonzero(mark), np.cumsum(mark) - 1
    local, at = np.zeros(1 << BITS, np.int32), np.searchsorted(state.known, u.used)
    local[u.used] = np.arange(len(u.used))
    local = local[u.feats[words]]
    emb, acc_emb = state.value["emb"][at], state.acc["emb"][at]
    value, acc = ({k: x[k].copy() for k in ("filt", "bias", "out")} for x in (state.value, state.acc))
    filt, bias, out = value["filt"], value["bias"], value["out"]
    text = {i: place[u.words(i)] for i in rows}

    for batch in np.array_split(np.random.default_rng(seed).permutation(rows), -(-len(rows) // BATCH)):
        mark = np.zeros(len(words), bool)
        for i in batch:
            mark[text[i]] = True
        own = np.flatnonzero(mark)
        row_of = np.cumsum(mark) - 1
        table = emb @ filt.reshape(-1, DIM).T
        sums_of = table[local[own, 0]]
        for k in range(1, local.shape[1]):
            sums_of += table[local[own, k]]
        grad = {k: np.zeros_like(v) for k, v in value.items()}
        ids, grads = [], []
        for i in batch:
            t = text[i]
            v, at_rows = _pool(_conv(sums_of[row_of[t]], bias))
            x = v.ravel()
            p = 1 / (1 + np.exp(-np.clip(x @ out[:-1] + out[-1], -30, 30)))
            e = (p - u.toxic[i]) * (1.0 + u.toxic[i]) / len(batch)
            grad["out"][:-1] += e * x
            grad["out"][-1] += e
            g = e * out[:-1].reshape(v.shape) * (v > 0)
            grad["bias"] += g.sum(0)
            first = 0
            for wi, width in enumerate(WIDTHS):
                cols = slice(wi * FILTERS, (wi + 1) * FILTERS)
                r, gg = at_rows[:, cols], g[:, cols]
                keep = (gg != 0) & (r >= 0)
                if keep.any():
                    pr, pf = r[keep], np.broadcast_to(np.arange(FILTERS), r.shape)[keep]
                    pg = gg[keep].astype(np.float32)
                    for tap in range(width):
                        ok = pr + tap < len(t)
                        fe = local[t[pr[ok] + tap]]
                        np.add.at(grad["filt"][first + tap], pf[ok], pg[ok, None] * emb[fe].sum(1))
                        ids.append(fe.ravel())
                        grads.append(np.repeat(pg[ok, None] * filt[first + tap][pf[ok]], fe.shape[1], 0))
                first += width
        for k, v in value.items():
            acc[k] += grad[k] * grad[k]
            v -= RATE * grad[k] / np.sqrt(acc[k])
        if ids:
            f, inv = np.unique(np.concatenate(ids), return_inverse=True)
            ge = np.zeros((len(f), DIM), np.float32)
            np.add.at(ge, inv, np.concatenate(grads))
            acc_emb[f] += ge * ge
            emb[f] -= RATE * ge / np.sqrt(acc_emb[f])
    dense = np.stack([np.concatenate([x[k].ravel() for k in ("filt", "bias", "out")]) for x in (value, acc)]).astype(np.float64)
    return emb - state.value["emb"][at], acc_emb - state.acc["emb"][at], dense - state.dense()


def _round(units: DataFrame, state: State, df: np.ndarray, n_docs: int, seed: int) -> None:
    """Every unit descends from state; the average of what they change is added to it. df: how many documents have a known feature."""
    shared = units.sparkSession.sparkContext.broadcast(state)
    n, width = len(state.known), 2 * DIM
    extra = -(-state.dense().size // width)
    names = ["key", *(f"v{k}" for k in range(width))]

    def run(batches):
        s = shared.value
        total = np.zeros((n + extra, width), np.int64)
        flat = np.zeros(extra * width)
        for b in batches:
            for u in _units(b):
                m = len(u.rows(False))
                if not m:
                    continue
                emb, acc, dense = descend(u, s, abs(hash((seed, u.key))))
                moved = np.flatnonzero(emb.any(1) | acc.any(1))
                change = np.concatenate([emb[moved], acc[moved]], 1).astype(np.float64)
                total[np.searchsorted(s.known, u.used[moved])] += np.rint(change * (u.df.sum(0)[moved, None] / GRAIN)).astype(np.int64)
                flat[: dense.size] = dense.ravel()
                total[n:] += np.rint(flat.reshape(extra, width) * (m / GRAIN)).astype(np.int64)
        at = np.flatnonzero(total.any(1))
        for i in range(0, len(at), 1 << 14):
            part = at[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c) for c in np.ascontiguousarray(total[part].T))], names=names)
        del s, total
        vars(shared).pop("_value", None)
        hashing.give_back()

    # cut, so that the shuffle's files go
    sums = cut(units.mapInArrow(run, ", ".join(f"{x} long" for x in names)).groupBy("key").agg(*(F.sum(x).alias(x) for x in names[1:])), "round")
    got = sums.toArrow()
    drop_cut(sums)
    shared.destroy()
    key = got["key"].to_numpy()
    mean = np.stack([got[x].to_numpy() for x in names[1:]], 1) * GRAIN
    own = key < n
    at, change = key[own], mean[own] / df[key[own], None]
    state.value["emb"][at] += change[:, :DIM].astype(np.float32)
    state.acc["emb"][at] += change[:, DIM:].astype(np.float32)
    flat, dense = np.zeros((extra, width)), state.dense()
    flat[key[~own] - n] = mean[~own] / n_docs
    state.set_dense(dense + flat.ravel()[: dense.size].reshape(2, -1))


def train(units: DataFrame, *, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit on the documents of units that aren't held out, all of them; calibrate on all that are."""
    counts = cut(units.mapInArrow(_count, "key long, c0 long, c1 long").groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "counts")
    got = counts.toArrow().sort_by("key")
    drop_cut(counts)
    key, df = got["key"].to_numpy(), np.stack([got["c0"].to_numpy(), got["c1"].to_numpy()])
    if not len(key) or not df[:, -1].all():
        taps, nf = sum(WIDTHS), len(WIDTHS) * FILTERS
        empty = Model(np.zeros((1, taps * FILTERS), np.float32), np.zeros(1 << BITS, np.int32), np.zeros(nf, np.float32), np.zeros(nf * POOL + 1, np.float32))
        empty.out[-1] = -30
        return empty
    # features that no training document has stay unknown
    ends, known, df = df[:, -1], key[:-1], df[:, :-1]
    odds = np.log((df[1] + 0.5) / (ends[1] + 1)) - np.log((df[0] + 0.5) / (ends[0] + 1))
    odds[df.sum(0) < 3] = 0
    state = State(known, odds, seed)
    for k in range(rounds):
        _round(units, state, df.sum(0), int(ends.sum()), seed + k)
    model = state.model()
    del state
    shared = units.sparkSession.sparkContext.broadcast(model)

    def scored(units: DataFrame, all_: bool) -> DataFrame:
        def run(batches):
            m = shared.value
            for b in batches:
                for u in _units(b):
                    f = m.place[u.feats]
                    sums = m.table[f[:, 0]]
                    for k in range(1, f.shape[1]):
                        sums += m.table[f[:, k]]
                    rows = np.flatnonzero(u.held | all_)
                    s = [m.score(sums[u.words(i)]) if len(u.words(i)) else 0.0 for i in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([u.langs[i] for i in rows], pa.string()), pa.array(s, pa.float64()), pa.array(u.weight[rows]), pa.array(u.weight[rows] * u.toxic[rows]), pa.array(u.toxic[rows].astype(np.int64))], names=["lang", "s", "w", "t", "n"])
            del m
            vars(shared).pop("_value", None)
            hashing.give_back()

        return cut(units.mapInArrow(run, "lang string, s double, w double, t double, n long").groupBy("lang", "s").agg(*sums), "held")

    sums = [F.sum(c).alias(c) for c in ("w", "t", "n")]
    by = scored(units, False)
    if not by.agg(F.sum("n")).first()[0]:
        drop_cut(by)
        by = scored(units, True)
    all_ = by.groupBy("s").agg(*sums).toArrow()  # at most STEPS + 1 rows
    model.common = calibrate(all_["s"].to_numpy(), _share(all_), all_["w"].to_numpy())

    def own(table: pa.Table) -> pa.Table:
        enough = pc.sum(table["n"]).as_py() >= LEAST
        limit = [calibrate(table["s"].to_numpy(), _share(table), table["w"].to_numpy())] if enough else []
        return pa.table({"lang": table["lang"].slice(0, len(limit)), "limit": pa.array(limit, pa.float64())})

    limits = by.where("lang is not null").groupBy("lang").applyInArrow(own, "lang string, limit double").toArrow()
    model.thresholds = dict(sorted(zip(limits["lang"].to_pylist(), limits["limit"].to_pylist())))
    drop_cut(by)
    shared.destroy()
    return model


def _share(table: pa.Table) -> np.ndarray:
    """The toxic part of each row's weight."""
    return table["t"].to_numpy() / table["w"].to_numpy()


def calibrate(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the highest weighted F1; the middle between the neighbouring scores."""
    if not len(score) or not toxic.any():
        return 0.5
    o = np.argsort(-score, kind="stable")
    s, w, t = score[o], weight[o], toxic[o]
    tp, all_ = np.cumsum(w * t), np.cumsum(w)
    f1 = 2 * tp / (all_ + (w * t).sum())
    f1[np.flatnonzero(s[1:] == s[:-1])] = -1  # no cut between equal scores
    best = int(np.argmax(f1))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + below) / 2)


def sample(docs: DataFrame, labels: DataFrame, per_stratum: int, most: int = 8000, most_bytes: int = 64 << 20) -> DataFrame:
    """For callers that hold documents back: (doc_id, toxic, lang, weight, text): at most per_stratum documents of each language and label by a hash of doc_id, `most` in all and texts of most_bytes together, the strata in turn. weight: how many of its stratum a document stands for."""
    spark = docs.sparkSession
    y = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = F.octet_length("text").alias("size")
    meta = docs.where("doc_id is not null and text is not null").select("doc_id", "lang", size).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("size").alias("size")).join(y, "doc_id")
    w = Window.partitionBy("lang", "toxic")
    counts = meta.groupBy(F.col("lang").alias("__l"), F.col("toxic").alias("__t")).agg(F.count("*").alias("n"))
    h = F.xxhash64("doc_id", F.lit(11))
    # a task ranks the labelled documents of one language and label, which are narrow rows; beforehand each goes only if its hash may be among the least
    share = (F.lit(4.0 * per_stratum) + 64) / F.col("n")
    near = meta.join(counts, F.col("lang").eqNullSafe(F.col("__l")) & (F.col("toxic") == F.col("__t"))).select("doc_id", "lang", "toxic", "size", "n", h.alias("h"))
    near = near.where((F.col("h") / 2.0**64 + 0.5) < share)
    ranked = near.withColumn("k", F.row_number().over(w.orderBy("h", "doc_id"))).where(F.col("k") <= per_stratum)
    picked = ranked.orderBy("k", "h", "doc_id").limit(most).select("doc_id", "toxic", "lang", "n", "size").toArrow()
    fits = np.cumsum(picked["size"].to_numpy()) <= most_bytes
    picked = picked.filter(pa.array(fits))
    taken = picked.group_by(["lang", "toxic"]).aggregate([("n", "count"), ("n", "max")]).to_pylist()
    of = {(r["lang"], r["toxic"]): r["n_max"] / r["n_count"] for r in taken}
    weight = [of[k] for k in zip(picked["lang"].to_pylist(), picked["toxic"].to_pylist())]
    ids = spark.createDataFrame(picked.select(["doc_id", "toxic", "lang"]).append_column("weight", pa.array(weight, pa.float64())))  # bounded by the parameters, so it may be broadcast
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    return got.groupBy("doc_id", "toxic", "lang", "weight").agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, lang, weight, text): every labelled document with a text, once; of several rows of a doc_id the least language and the least text."""
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = docs.where("doc_id is not null and text is not null").select("doc_id", "lang", "text").join(maybe_broadcast(y), "doc_id")
    parts = max(1, -(-labels.count() // LABELS))
    once = got.repartition(parts, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("lang").alias("lang"), F.min("text").alias("text"))
    return once.select("doc_id", "toxic", "lang", F.lit(1.0).alias("weight"), "text")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Train on all labelled documents among docs, or only on those of sample(), if its per_stratum is given."""
    keys = {k: options.pop(k) for k in ("per_stratum", "most", "most_bytes") if k in options}
    rows = sample(docs, labels, **keys).repartition(1) if keys else labelled(docs, labels)
    key = F.xxhash64("doc_id", F.lit(11))
    rows = rows.select(key.alias("key"), "toxic", F.col("lang").cast("string").alias("lang"), "weight", (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 4).alias("held"), "text").sortWithinPartitions("key")
    units = cut(small_batches(rows).mapInArrow(_pack, _UNIT), "units")
    model = train(units, **options)
    drop_cut(units)
    hashing.give_back()
    return model


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """docs (without text, unless keep_text) with toxicity_score DOUBLE, toxicity_threshold DOUBLE and toxic BOOLEAN added; such columns of docs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity_score", "toxicity_threshold", "toxic")
    names = [c for c in docs.columns if keep_text or c != "text"]
    work = docs.select(*names, *([] if keep_text else ["text"]))
    at = work.columns.index("text")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("toxicity_score", T.DoubleType()), T.StructField("toxicity_threshold", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def run(batches):
        m = shared.value
        for whole in batches:
            for i, j in hashing.pieces(hashing.buffers(whole.column(at))[1], 1 << 21):
                b = whole.slice(i, j - i)
                s = m.scores(pc.utf8_lower(b.column(at)))
                langs = b.column(names.index("lang")).to_pylist() if "lang" in names else [None] * b.num_rows
                limit = np.array([m.thresholds.get(x, m.common) for x in langs], float)
                cols = [b.column(k) for k in range(len(names))] + [pa.array(s), pa.array(limit), pa.array((s > limit) & (s > 0))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "toxicity_score", "toxicity_threshold", "toxic"])
                del b, cols
            del whole
        # the model is read again by the worker's next task
        del m
        vars(shared).pop("_value", None)
        hashing.give_back()

    return small_batches(work).mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's language, score, threshold and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "lang", "text"), model, keep_text=False)
