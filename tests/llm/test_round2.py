"""Findings of the second round."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from pagelattice.llm import bpe, hashing, lines, store, toxicity
from pagelattice.session import cut
from tests.llm.helpers import docs, words


def test_bands_are_the_same_for_every_input():
    assert len({lines.bands_for(n) for n in (10, 1 << 27, (1 << 27) + 1, (1 << 33) + 1)}) == 1


def test_settle_compares_few_pairs_of_a_family(monkeypatch):
    """All groups of similar pairs, without comparing all pairs."""
    r = random.Random(6)
    texts = []
    for k in range(4):
        base = [f"{w}{k}{i}" for i, w in enumerate(words(40, k).split())]
        for _ in range(60):
            w = list(base)
            w[r.randrange(40)] = "x" * r.randrange(1, 9)
            texts.append(" ".join(w))
    texts = sorted(set(texts), key=lambda t: r.random())
    n = len(texts)
    want = np.arange(n)
    for i in range(n):
        for j in range(i):
            most = int(max(len(texts[i]), len(texts[j])) * 0.15 + 1e-9)
            if lines.levenshtein(texts[i], texts[j], most) <= most:
                want = lines.unite(want, np.array([i]), np.array([j]))
    compared, plain = [], lines.within
    monkeypatch.setattr(lines, "within", lambda a, b, most: compared.append(len(a)) or plain(a, b, most))
    got = lines.settle(texts, np.zeros(n, np.int64), np.arange(n), 0.85)
    assert (got == want).all() and len(set(want.tolist())) == 4
    assert sum(compared) < 4 * n


def test_cut_leaves_no_shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    t = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert t.count() == 7 and files.getAllFiles().size() <= before + 3


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """Each of 600 clean and 600 toxic documents of one language counts once, whatever the order and number of partitions."""
    data = [(k, f"{words(20, k)} " + ("vile" if k % 2 else "kind") + f" mark{k}", "en", "a", 1, "", 0.0) for k in range(1200)]
    d, y = docs(spark, data), spark.createDataFrame([(k, k % 2) for k in range(1200)], "doc_id long, toxic int")
    rows = toxicity.labelled(d, y)
    assert rows.count() == 1200
    counted, plain = [], toxicity._round
    monkeypatch.setattr(toxicity, "_round", lambda units, state, *a: counted.append(state.known) or plain(units, state, *a))
    one, other = toxicity.fit(d, y), toxicity.fit(d.repartition(7).orderBy(F.desc("doc_id")), y.repartition(3))
    held = {r[0] for r in rows.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 4).collect()}
    # the mark of every document that isn't held out is among the features
    marks = pa.array([f"mark{k}" for k in range(1200) if k not in held])
    assert set(toxicity.features(hashing.words(*hashing.buffers(marks)))[:, 0].tolist()) <= set(counted[0].tolist())
    assert (one.table == other.table).all() and one.common == other.common and one.thresholds == other.thresholds
    got = toxicity.score(d, one, keep_text=False).select("doc_id", "toxic").collect()
    assert all(r["toxic"] == bool(r["doc_id"] % 2) for r in got)


def test_store_encodes_whole_texts_as_the_library(spark):
    """Also those that begin with a space or hold long runs of white space."""
    enc = store._encoder(bpe.VOCABULARY)
    r = random.Random(5)
    texts = [" lead", None, "", "\n", *("".join(r.choice(" \n\t\0ab1é'.s한") for _ in range(r.randrange(1, 30))) for _ in range(500))]
    ids, off = enc.encode(texts)
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == (enc.library.encode_ordinary(t) if t else [])
    far = "a b" + " \n" * 600_000 + "c"  # the library stops at such a run
    assert enc.library.decode(enc.encode([far])[0].tolist()) == far


def test_line_dedup_runs_one_python_worker_a_task(spark, monkeypatch):
    """The pipeline's filter on the new text doesn't have it computed twice."""
    gone = lambda d, *_: d.select("doc_id", F.xxhash64("text").alias("thash"), F.array(F.lit(0)).alias("gone"))
    monkeypatch.setattr(lines, "removals", gone)
    d = docs(spark, [(1, "one line\nanother", "en", "a", 16, "", 0.0), (2, "only", "en", "a", 4, "", 0.0), (3, None, "en", "a", None, "", 0.0)])
    out = corpus_pipeline.dedup_lines(spark, d, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "another", 7), (3, None, None)}
