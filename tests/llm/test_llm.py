"""The pipeline's operators against brute force, exact round trips and held-out accuracy, and on nulls, ties and empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import bpe, chat, components, hashing, jaccard, lines, media, mixing, quality, queries, secrets, store, toxicity
from pagelattice.session import cut

from ..conftest import SMALL, rows_of
from .helpers import SCHEMA, docs, words

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SMALL).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# hashing


def test_words_like_regex():
    texts = ["One two, THREE", "", "x", None, "été-au 3.5", "a" * 3000 + " b"]
    data, off = hashing.buffers(pa.array([None if t is None else t.lower() for t in texts]))
    w = hashing.words(data, off)
    seen = {}
    for i, t in enumerate(texts):
        mine = w.hashes[w.first[i] : w.first[i + 1]]
        theirs = WORD.findall((t or "").lower())
        assert len(mine) == len(theirs)
        for h, x in zip(mine.tolist(), theirs):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_ngrams():
    h = np.arange(1, 8, dtype=np.uint64)
    g, first = hashing.ngrams(h, np.array([0, 4, 4, 6, 7]), 3)
    assert first.tolist() == [0, 2, 2, 3, 4] and len(set(g.tolist())) == 4


# 1 secrets


def test_trigram_queries():
    assert secrets.query_of(r"[0-9a-f]{40}") is secrets.ANY
    assert secrets.query_of(r"a.c") is secrets.ANY
    assert secrets.query_of("abcd") == ("and", frozenset({("tri", b"abc"), ("tri", b"bcd")}))
    assert secrets.query_of("(?:abc|xyz)+") == ("or", frozenset({("tri", b"abc"), ("tri", b"xyz")}))
    assert secrets.query_of("(abc)?") is secrets.ANY


def test_index_never_misses():
    r = random.Random(5)
    patterns = [*secrets.RULES.values(), "ab+c[xy]d?e", "(?:foo|ba[rz])qux", "x{3}y{2,}z", "(?i)HeLLo wor", "a(?=b)bcd", "a[^b]cde"]
    texts = ["".join(r.choice("abcdexyzfoqur ") for _ in range(200)) for _ in range(300)]
    texts += ["AKIA" + "A" * 16, "Password = hunter22", "hello WORld", "fooqux", "-----BEGIN RSA PRIVATE KEY-----", "xxxyyz", "http://u:p@h", "abbcxe"]
    data, off = hashing.buffers(pa.array(texts))
    for p in patterns:
        q = secrets.query_of(p)
        index = secrets.Index(data, off, {t: 0 for t in secrets.trigrams(q)})
        found = set(index.find(q).tolist())
        assert {i for i, t in enumerate(texts) if re.search(p, t, re.ASCII)} <= found


def test_scan_cases(spark):
    key = "AKIA" + "B" * 16
    data = [(1, f"é {key} and {key}", None, None, None, None, None), (None, f"password=abcdef1\n{'0' * 40}", None, None, None, None, None), (2, None, None, None, None, None, None), (3, "", None, None, None, None, None)]
    got = sorted((r["doc_id"] or 0, r["rule"], r["match_no"], r["start_char"]) for r in secrets.scan(docs(spark, data + data[:1])).collect())
    assert got == [(0, "hex_digest", 1, 17), (0, "password_assignment", 1, 0)] + [(1, "aws_access_key", k, s) for k, s in ((1, 2), (1, 2), (2, 27), (2, 27))]
    assert secrets.scan(docs(spark, [])).count() == 0 and secrets.scan(docs(spark), {}).count() == 0
    assert secrets.scan(docs(spark)).count() == 0


# 2 BPE


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.load(bpe.VOCABULARY)


def test_bpe_like_library(vocab, spark):
    import tiktoken

    tk = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n", "a\n", " \n a", "  a  b\n\n c ", "\t x\n", "a　b 1²3", "don't  it's\n we'll", "x" * 3000, "\0 a\0b", "\n\nb", "a \nb", "\U0001f600 \U0001f600"]
    enc = bpe.Encoder(vocab, memory=500)
    for i in range(0, len(texts), 40):
        ids, off = enc.encode(texts[i : i + 40])
        for k, t in enumerate(texts[i : i + 40]):
            assert ids[off[k] : off[k + 1]].tolist() == tk.encode_ordinary(t)
    r = random.Random(2)
    some = [bytes(r.choice(b"abcthe \xc3\xa9on") for _ in range(r.randrange(1, 25))) for _ in range(2000)]
    some = sorted(set(some))
    coded, visited = bpe.encode_words(some, vocab)
    assert coded == [vocab.merge(w) for w in some]
    assert visited == len({w[:k] for w in some for k in range(1, len(w) + 1)})  # every trie node once


def test_bpe_lanes(vocab):
    r = random.Random(4)
    texts = ["".join(r.choice("abcthe é\u4e2don .,12") for _ in range(r.randrange(1, 40))).encode() for _ in range(12000)] + [b"x" * 64, b"y" * 65, b"=" * 64, b" " * 63, b"", bytes(range(256))]
    some = sorted(set(texts), key=lambda w: w[::-1])
    ids, count, visited = bpe.walk_lanes([w for w in some if len(w) <= bpe.LANE_BYTES], vocab)
    plain = [vocab.merge(w) for w in some]
    nodes = len({w[:k] for w in some if len(w) <= bpe.LANE_BYTES for k in range(1, len(w) + 1)})
    assert ids.tolist() == [t for w, p in zip(some, plain) if len(w) <= bpe.LANE_BYTES for t in p] and len(count) == sum(len(w) <= bpe.LANE_BYTES for w in some)
    assert nodes <= visited <= 1.3 * nodes  # only the paths to the lanes' first words are walked again
    assert bpe.encode_words(some, vocab)[0] == plain
    odd = bpe.Vocabulary({k: v for k, v in vocab.ranks.items() if v < 20000})
    some = some[::3]
    assert bpe.encode_words(some, odd)[0] == [odd.merge(w) for w in some]


def test_bpe_memory_keeps_frequent_words(vocab):
    enc, plain = bpe.Encoder(vocab, memory=40), bpe.Encoder(vocab)
    r = random.Random(6)
    for k in range(30):
        texts = [" ".join(r.choice("the of river stone cloud".split()) + r.choice(["", ".", str(r.randrange(999))]) for _ in range(20)), None, "", "x" * 70]
        a, b = enc.encode(texts), plain.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        if k % 5 == 4:
            enc.rest()
            assert 0 < len(enc.known) <= 10


def test_bpe_nul_after_space(vocab, spark):
    texts = ["a \0b", "\0", "x \0 y", "a\n\0b c", "\0\0a \0\0b"]
    got = bpe.encode(docs(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]), verify=True).collect()
    assert all(r["round_trip"] for r in got)
    assert {r["doc_id"]: r["token_ids"] for r in got} == {i: [t for w in re.findall(" ?[a-z]+|\n| ?[^\\sa-z]+|\\s", x) for t in vocab.merge(w.encode())] for i, x in enumerate(texts)}


def test_bpe_cases(spark):
    e = bpe.encode(docs(spark), verify=True)
    got = e.collect()
    assert len(got) == 14 and "extra" in e.columns
    for r in got:
        assert r["round_trip"] is None if r["text"] is None else r["round_trip"] and r["n_tokens"] == len(r["token_ids"])
    back = bpe.decode(e).where("not (text <=> decoded)")
    assert back.count() == 0
    assert bpe.encode(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, [50_000_000]), (2, None), (3, []), (4, [-1])], "i int, token_ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).orderBy("i").collect()] == [None, None, "", None]


# 3 media


def test_matroska_round_trip(spark):
    d = docs(spark).select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    m = media.mux_texts(d.select(F.col("rid").alias("doc_id"), "text")).withColumn("codec", F.lit("clash")).withColumn("kept", F.lit(1))
    p = media.parse_packets(m)
    assert p.columns[:2] == ["doc_id", "kept"]
    files = {r["doc_id"]: bytes(r["media"]) for r in m.collect() if r["media"] is not None}
    texts = {r["rid"]: r["text"] for r in d.collect()}
    by = {}
    for r in p.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(files)
    for k, rows in by.items():
        if not texts[k]:
            assert [r["error"] for r in rows] == ["no packets"]
            continue
        rows.sort(key=lambda r: r["packet_no"])
        parts = [files[k][r["byte_start"] : r["byte_start"] + r["byte_size"]] for r in rows]
        assert b"".join(parts) == texts[k].encode() and [zlib.crc32(x) for x in parts] == [r["crc32"] for r in rows]
        assert [r["pts_ns"] for r in rows] == [i * 20_000_000 for i in range(len(rows))]
        assert all(r["duration_ns"] == 20_000_000 for r in rows)
    assert {r["lacing"] for rows in by.values() for r in rows} >= {"none", "xiph", "fixed", "ebml"}


@pytest.mark.parametrize("lacing", [1, 3])
def test_lacing(lacing):
    r = random.Random(lacing)
    for _ in range(200):
        frames = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 254, 255, 256, 600]))) for _ in range(r.randrange(2, 9))]
        block = media._laced(frames, lacing)
        assert [block[a : a + n] for a, n in media.frames_of(block, 0, len(block), lacing)] == frames


def test_matroska_broken():
    good = media.mux(bytes(range(256)) * 40)
    whole, error = media.packets(good)
    assert error is None and any(r[10] for r in whole)
    for cut_at in range(0, len(good), 997):
        rows, error = media.packets(good[:cut_at])
        assert rows == whole[: len(rows)] or not rows or error
    assert media.packets(b"")[1] and media.packets(b"RIFF....")[1] == "no EBML header" or media.packets(b"RIFF....")[1]
    # a live stream: segment and clusters of unknown size
    head = media.element(media.EBML, media._uint(0x4286, 1))
    block = media.element(media.SIMPLE, b"\x81\x00\x05\x80abc")
    live = head + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    for t in (0, 10):
        live += media.CLUSTER.to_bytes(4, "big") + b"\xff" + media._uint(media.TIME, t) + block
    rows, error = media.packets(live)
    assert error is None and [(r[0], r[2], r[8]) for r in rows] == [(1, 5_000_000, 3), (1, 15_000_000, 3)]


# 4 Jaccard join


def grams(t, n=3):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_pairs(rows, threshold):
    out = {}
    sets = [(i, grams(t)) for i, t in {(i, t) for i, t in rows if i is not None and t is not None}]
    sets = [(i, g) for i, g in sets if g]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a != b and (j := len(x & y) / len(x | y)) >= threshold - 1e-9:
            k = (min(a, b), max(a, b))
            out[k] = max(out.get(k, 0), j)
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_jaccard_join(spark, block):
    d = docs(spark).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100).withColumn("extra", F.lit("")).withColumn("score", F.lit(0.0)))
    want = brute_pairs([(r["doc_id"], r["text"]) for r in d.collect()], 0.6)
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in jaccard.join(d, block=block).collect()}
    assert want and set(got) <= set(want) and len(set(want) & set(got)) >= 0.9 * len(want)
    assert all(abs(want[k] - v) < 1e-5 for k, v in got.items())


@pytest.mark.parametrize("block", [3, 1024])
def test_jaccard_links(spark, block):
    """Classes and numbers of links against all pairs; op4 reads no other column."""
    d = docs(spark).where("doc_id is null or doc_id <> 10").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100).withColumn("extra", F.lit("")).withColumn("score", F.lit(0.0)))
    d = d.withColumnsRenamed({"extra": "rid", "source": "component"}).withColumn("sid", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = brute_pairs(rows, 0.6)
    found = set(tuple(sorted((r["id_a"], r["id_b"]))) for r in jaccard.join(d, block=block).collect())
    assert len(found) >= 0.98 * len(want) and found <= set(want)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[max(find(a), find(b))] = min(find(a), find(b))
    n = Counter(i for p in found for i in p)
    got = jaccard.links(d, block=block).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted((i, find(i), n[i]) for i in root)
    assert jaccard.links(docs(spark, [])).count() == 0


def test_jaccard_links_several_texts(spark):
    """One doc_id with two texts of two groups joins them, and has the links of both."""
    a, b = words(40, 1), words(40, 2)
    got = jaccard.links(docs(spark, [(i, t, None, None, None, None, None) for i, t in [(5, a), (1, a), (1, b), (1, b), (9, b), (7, None), (8, ""), (None, a)]]))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (5, 1, 1), (7, 7, 0), (8, 8, 0), (9, 1, 1)]


def test_jaccard_dedup(spark):
    got = [r["doc_id"] for r in jaccard.deduplicate(docs(spark)).collect()]
    assert Counter(got) == Counter([1, 4, 5, None, 6, 7, 8, 9, 10, 10, 11])
    assert jaccard.deduplicate(docs(spark, [])).count() == 0 and jaccard.join(docs(spark, [])).count() == 0


def test_banding():
    b, r = jaccard.bands_rows(0.6)
    assert 1 - (1 - 0.6**r) ** b >= jaccard.RECALL and b * r <= jaccard.HASHES
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert jaccard.intersections(sets).tolist() == [[len(set(a) & set(b)) if len(set(a) & set(b)) else 0 for b in map(list, sets)] for a in map(list, sets)] or jaccard.intersections(sets)[0, 1] == 2


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


# 5 store


def test_store(spark):
    d = docs(spark)
    book, s = store.build(d)
    v = store.verify(book, s).collect()
    assert len(v) == 14 and all(r["verified"] for r in v)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in v) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in d.collect())
    used = {a for r in v for a in r["recipe"] or ()}
    assert used == {bytes(r["address"]).hex() for r in s.collect()} and s.count() == len(used)
    ids = sorted(tuple(r["token_ids"]) for r in bpe.encode(d).where("text is not null").collect())
    assert sorted(tuple(r["token_ids"]) for r in store.reconstruct(book, s).collect()) == ids
    # a damaged and a missing chunk show
    first = s.orderBy("address").first()["address"]
    bad = s.withColumn("ids", F.when(F.col("address") == F.lit(bytes(first)), F.lit(b"\0\0")).otherwise(F.col("ids")))
    for t in (bad, s.where(F.col("address") != F.lit(bytes(first)))):
        assert {r["verified"] for r in store.verify(book, t).collect() if bytes(first).hex() in (r["recipe"] or ())} == {False}
    assert store.verify(*store.build(docs(spark, []))).count() == 0


def test_store_lost_ids(spark):
    book, s = store.build(docs(spark))
    root = F.udf(lambda r, n: store.merkle([(bytes.fromhex(a), k) for a, k in zip(r, n)]).hex())
    # document 11 is one id over and over: its chunks turned round are the same stream
    less = book.where("n_chunks > 0").withColumn("recipe", F.expr("slice(recipe, 1, n_chunks - 1)")).withColumn("sizes", F.expr("slice(sizes, 1, n_chunks - 1)")).withColumn("merkle_root", root("recipe", "sizes"))
    turned = book.where("n_chunks > 1 and doc_id <> 11").withColumn("recipe", F.reverse("recipe")).withColumn("sizes", F.reverse("sizes")).withColumn("merkle_root", root("recipe", "sizes"))
    for bad in (less, less.withColumn("n_tokens", F.expr("aggregate(sizes, 0L, (a, b) -> a + b)")), turned, book.where("n_tokens > 0").withColumn("n_tokens", F.col("n_tokens") + 1)):
        got = store.verify(bad, s).collect()
        assert got and not any(r["verified"] for r in got)
    assert store.joined([store.fingerprints(np.array(x), np.array([0, len(x)]))[0].item() for x in ([5, 6], [7])], [2, 1]) == store.fingerprints(np.array([5, 6, 7]), np.array([0, 3]))[0]


def test_chunk_cuts():
    r = np.random.default_rng(0)
    a = r.integers(0, 50_000, 20_000).astype(np.int32)
    at = np.flatnonzero(store.rolling(a) >> np.uint64(64 - store.BITS) == 0)
    ends = store.cuts(np.array([0, len(a)]), at)[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(a) and sizes[:-1].min() >= store.LEAST and sizes.max() <= store.MOST
    b = np.concatenate([a[:5000], a[:37], a[5000:]])  # after an insertion the cuts fall back into step
    at_b = np.flatnonzero(store.rolling(b) >> np.uint64(64 - store.BITS) == 0)
    moved = {e - 37 for e in store.cuts(np.array([0, len(b)]), at_b)[0]}
    assert len(moved & set(ends)) > 0.8 * (len(ends) - len([e for e in ends if e < 5000]))
    assert store.cuts(np.array([0, 0, 3]), np.zeros(0, int)) == [[], [3]]
    assert store.merkle([(b"a", 1), (b"b", 2)]) != store.merkle([(b"b", 2), (b"a", 1)]) != store.merkle([])


# 6 quality


def test_quality_cases(spark):
    got = quality.decide(quality.ledger(docs(spark)))
    rows = got.collect()
    assert len(rows) == 14 and "extra" not in got.columns
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["fail_bits"] == by[4]["fail_bits"] == by[8]["fail_bits"] == quality.BIT["empty"] and not by[5]["keep"]
    assert by[1]["fail_bits"] == 0 and by[1]["keep"]
    assert quality.ledger(docs(spark, [])).count() == 0
    a = {(r["policy"], r["rule"]): r for r in quality.ablation(quality.ledger(docs(spark))).collect()}
    assert a["v1", "empty"]["n_only_rule"] == 3 and a["v1", "empty"]["n_kept_without_rule"] == 14


def test_quality_keeps_clean(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    q = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    r = quality.decide(quality.ledger(d)).join(q, "doc_id").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert r > 0.98


def test_quality_long_texts(spark):
    r = random.Random(6)
    texts = ["alpha beta " * (n // 2) for n in (19_998, 20_000, 30_000, 200_000)] + [" ".join(f"word{r.randrange(4000)}" for _ in range(30_000)), " ".join(f"word{r.randrange(20_000)}" for _ in range(300_000))]
    got = quality.decide(quality.ledger(docs(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]))).collect()
    assert [r["fail_bits"] for r in sorted(got, key=lambda r: r["doc_id"])] == [quality.BIT["few_distinct_words"]] * 4 + [0] * 2


# 7 mixing


def test_subset_sum():
    r = random.Random(2)
    for _ in range(300):
        k = r.randint(1, 4)
        size = np.array(r.sample(range(1, 30), k))
        count = np.array([r.randint(0, 4) for _ in range(k)])
        budget = r.randint(0, 120)
        best = max(s for s in (sum(a * b for a, b in zip(t, size)) for t in itertools.product(*[range(c + 1) for c in count])) if s <= budget)
        take, total = mixing.subset_sum(size, count, budget)
        assert total == best == (take * size).sum() and (take <= count).all()
        take = mixing.fit(size, count, budget)
        assert (take <= count).all() and (take * size).sum() <= budget


def test_mix(spark):
    data = [(i, words(1 + i % 23, i), "en", "hot" if i % 3 else "cold", 0, "", 0.0) for i in range(600)]
    d = docs(spark, data)
    got = mixing.mix(d, {"hot": 1.0, "cold": 3.0}, 1200).collect()
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += len(r["text"].split())
    assert tokens == {"hot": 300, "cold": 900}
    again = mixing.mix(d.repartition(7), {"hot": 1.0, "cold": 3.0}, 1200).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in again)
    # brute force: of each source and length the least hashes
    h = {r["doc_id"]: r["h"] for r in d.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("h")).collect()}
    chosen = {r["doc_id"] for r in got}
    groups = {}
    for i, t, _, s, *_ in data:
        groups.setdefault((s, len(t.split())), []).append(i)
    for ids in groups.values():
        ids.sort(key=lambda i: (h[i], i))
        n = len(chosen & set(ids))
        assert set(ids[:n]) == chosen & set(ids)


def test_mix_cases(spark):
    got = mixing.mix(docs(spark))
    ids = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    assert not set(ids) & {4, 5, 6, 8} and ids[3] in (0, 2) and ids[10] in (0, 2)
    assert mixing.mix(docs(spark, [])).count() == 0
    all_ = mixing.mix(docs(spark), {"a": 1.0, "b": 1.0}, 10**9)
    assert all_.count() == 10


def test_fit_largest_and_even():
    take = mixing.fit([10000, 9999, 7000, 7001, 6000], [1] * 5, 20001)
    assert take.tolist() == [0, 0, 1, 1, 1]
    r = random.Random(3)
    for _ in range(60):
        size = np.array(r.sample(range(3000, 12000), 10))
        budget = r.randint(20_000, 50_000)
        best = max(t for k in range(11) for c in itertools.combinations(size.tolist(), k) if (t := sum(c)) <= budget)
        assert (mixing.fit(size, np.ones(10, int), budget) * size).sum() == best
    assert (mixing.fit([4000, 6000], [500, 500], 3_000_001) * np.array([4000, 6000])).sum() == 3_000_000
    size, count = np.arange(1, 4001), np.ones(4000, int)
    budget = int(size.sum()) * 6 // 10
    take = mixing.fit(size, count, budget)
    assert (take * size).sum() == budget
    assert all(0.5 < take[k : k + 1000].mean() < 0.7 for k in range(0, 4000, 1000))  # short and long alike
    assert (take != mixing.fit(size, count, budget, seed=1)).sum() > 1000


def test_mix_scarce_source(spark):
    data = [(i, words(50, i), "en", "big", 0, "", 0.0) for i in range(400)] + [(1000, words(5, 1), "en", "tiny", 0, "", 0.0)]
    got = Counter(r["source"] for r in mixing.mix(docs(spark, data)).collect())
    assert got["tiny"] == 1 and got["big"] > 380


# 8 chat


def test_templates():
    def show(t, **v):
        return chat.compile_template(t)(v)[0]

    assert show("{{ 1 + 2 * 3 }}{{ 'a' ~ 1 }}{{ x|default('d') }}") == "7a1d"
    assert show("{% for m in xs %}{{ loop.index }}{{ m.k|upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"k": "a"}, {"k": "b"}]) == "1A,2B"
    assert show("{% if a %}1{% elif b == 'x' %}2{% else %}3{% endif %}", b="x") == "2"
    assert show("a {%- set y = x ~ '!' -%} b{{ y }}{# gone #}", x="q") == "abq!"
    assert show("{{ 'y' if m['k'] else 'n' }}{{ m.k[0] }}{{ xs|join('-') }}", m={"k": "zz"}, xs=[1, 2]) == "yz1-2"
    text, spans = chat.compile_template("u{% generation %}{{ x }}{% endgeneration %}v")({"x": "hey"})
    assert text == "uheyv" and spans == [(1, 4)]
    assert chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% endif %}") == [("text", "ab1c")]  # folded
    for bad in ("{{ f() }}", "{{ _x }}", "{{ x.__class__ }}", "{{", "{% for x %}", "{% if a %}", "{{ a b }}", "{{ x|nope }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert show("{{ x.upper }}", x="s") == ""


PUBLISHED = """{%- set ns = namespace(n=0, system='') -%}
{% if messages[0]['role'] == 'system' %}
    {% set ns.system = messages[0].content | trim %}
    {% set rest = messages[1:] %}
{% else %}
    {% set rest = messages %}
{% endif %}
{% for m in rest %}
    {% if (m['role'] == 'user') != (loop.index0 % 2 == 0) %}
        {{ raise_exception('roles must alternate') }}
    {% endif %}
    {% set ns.n = ns.n + 1 %}
<{{ m.role }}>{{ (ns.system + '|' if loop.first and ns.system else '') + m.content }}</{{ m.role }}>
{% endfor %}
{% if tools is defined and tools is not none %}{{ tools | tojson }}{% endif %}
{{ ns.n }}{% if add_generation_prompt %}<assistant>{% endif %}"""


def test_published_templates():
    def show(t, blocks=False, **v):
        return chat.compile_template(t, blocks)(v)[0]

    m = [{"role": r, "content": c} for r, c in (("system", " S "), ("user", "a"), ("assistant", "b"))]
    assert show(PUBLISHED, True, messages=m, tools=[{"a": 1}], add_generation_prompt=True) == '<user>S|a</user>\n<assistant>b</assistant>\n[{"a": 1}]2<assistant>'
    with pytest.raises(chat.TemplateError, match="alternate"):
        show(PUBLISHED, True, messages=m[1:2] * 2)
    assert show("{{ {'a': {'b': [1, 2]}}['a'].b[-1] }}{{ 7 // 2 }}{{ 7 % 4 }}{{ 'abc'[::-1] }}{{ 'c' not in 'ab' }}") == "233cbatrue"
    assert show("{{ xs|selectattr('k', 'equalto', 'a')|map(attribute='k')|join(',') }}{% for k, v in d.items() %}{{ k }}={{ v }};{% else %}none{% endfor %}", xs=[{"k": "a"}, {"k": "b"}], d={"x": 1, "y": None}) == "ax=1;y=;"
    assert show("{% for x in xs %}{% if x == 2 %}{% continue %}{% endif %}{% if x > 3 %}{% break %}{% endif %}{{ x }}{% set y = x %}{% endfor %}{{ y }}{% for x in [] %}{% else %}e{% endfor %}", xs=[1, 2, 3, 4, 5]) == "13e"
    assert show("{% set x %}q{{ 1 }}{% endset %}{{ x }}{% for i in range(3) if i is odd %}{{ i }}{% endfor %}{{ x is string }}{{ z is defined }}{{ m.k is defined }}{{ m.q is undefined }}", m={"k": None}) == "q11truefalsetruetrue"
    assert show("  {% if true %}\n a\n  {% endif %}\nb", True) == " a\nb" and show("  {% if true %}\n a{% endif %}\nb") == "  \n a\nb"
    for bad, v in (("{{ 1 / x }}", {"x": 0}), ("{{ x.items() }}", {"x": 3}), ("{% for a, b in x %}{% endfor %}", {"x": [1]}), ("{{ range(99999999) }}", {}), ("{{ x - 1 }}", {"x": "a"}), ("{{ x|abs }}", {"x": "a"}), ("{{ {x: 1} }}", {"x": []}), ("{% set x.a = 1 %}", {"x": {}})):
        with pytest.raises(chat.TemplateError):
            show(bad, **v)
    for bad in ("{{ x.format('a') }}", "{% break %}", "{{ x is odder }}", "{{ x[] }}", "{{ x|map('__class__' }}", "{{ cycler() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_refused_chats(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.render_chats(df, "{% if messages[0].role != 'user' %}{{ raise_exception('no') }}{% endif %}{{ messages[0].content }}").collect()}
    assert got == {1: (1, "a", ""), 2: (1, None, None)}


def test_chat_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "a"), (2, None, None, None), (None, 0, "user", "q"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.render_chats(df, "{% for m in messages %}{{ m.role }}:{% generation %}{{ m.text }}{% endgeneration %} {% endfor %}").collect()}
    assert got[1]["rendered"] == "user:a user:a assistant:a assistant:b " and got[1]["generated"] == "5-6,12-13,24-25,36-37" and got[1]["n_messages"] == 4
    assert got[2]["rendered"] == ": " and got[2]["generated"] == "" and got[None]["rendered"] == "user:q "
    assert chat.render_chats(df.limit(0)).count() == 0


# 9 lines


def brute_lines(rows):
    occ = {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0])):
        for k, x in enumerate(t.split("\n")):
            if w := tuple(WORD.findall(x.lower())):
                occ.setdefault(w, []).append((i, k, t))
    keys = list(occ)
    data, off = hashing.buffers(pa.array([" ".join(k) for k in keys], pa.large_string()))
    w = hashing.words(data, off)
    sim = lines.simhash(w.hashes, w.first).view(np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(keys)):
        for b in (np.flatnonzero(np.bitwise_count(sim[a + 1 :] ^ sim[a]) <= 3) + a + 1).tolist():
            x, y = " ".join(keys[a]), " ".join(keys[b])
            n = max(len(x), len(y))
            if n - plain_distance(x, y) >= 0.85 * n - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).extend(occ[k])
    gone = {}
    for g in groups.values():
        for i, k, t in sorted(g, key=lambda o: (o[0] is not None, o[0], o[1]))[1:]:
            gone.setdefault((i, t), set()).add(k)
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in rows if t is not None}


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_levenshtein():
    r = random.Random(1)
    for _ in range(1000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in "ab")
        assert lines.levenshtein(a, b) == plain_distance(a, b)


def test_simhash():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    first = np.array([0, 1, 3, 700, 1000])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    want = [np.packbits((2 * bits[a:b].sum(0) > b - a).astype(np.uint8)).view(np.int64)[0] for a, b in zip(first, first[1:])]
    assert lines.simhash(h, first).tolist() == want


def test_masks_cover():
    r = random.Random(3)
    for m in (4, 5, 6):
        for _ in range(300):
            d = sum(1 << b for b in r.sample(range(64), 3))
            assert any(d & x == 0 for x in lines.masks(m, 3))


def near_lines(rows, least):
    """The normalised lines, and the indices of all pairs of the edit similarity, by comparing every line with every other."""
    keys = sorted({" ".join(w) for t in rows if t for x in t.split("\n") if (w := WORD.findall(x.lower()))}, key=lambda k: (len(k), k))
    size, h = np.array([len(k) for k in keys]), lines.histograms(keys)
    out = []
    for b in range(len(keys)):
        most = int((1 - least) * size[b] + 1e-9)
        a = int(np.searchsorted(size, size[b] - most))
        d = h[a:b] - h[b]  # an edit changes one character's count up and one's down
        for i in (np.flatnonzero(np.maximum(np.where(d > 0, d, 0).sum(1), -np.where(d < 0, d, 0).sum(1)) <= most) + a).tolist():
            if lines.levenshtein(keys[i], keys[b], most) <= most:
                out.append((i, b))
    return keys, out


def test_line_pairs_recall(spark):
    r = random.Random(4)
    texts = [t[0] for t in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for n in (6, 8, 12, 20, 30, 60):
        for k in range(40):
            w = words(n, 100 * n + k).split()
            other = list(w)
            for i in r.sample(range(n), max(1, n // 10)):
                other[i] = r.choice(words(5, i).split())
            typo = " ".join(w)
            for i in r.sample(range(len(typo)), len(typo) // 25):
                typo = typo[:i] + "q" + typo[i + 1 :] if typo[i] != " " else typo
            texts.append("\n".join(map(" ".join, (w, other))) + "\n" + typo)
    keys, want = near_lines(texts, 0.85)
    d = docs(spark, [(i, k, None, None, None, None, None) for i, k in enumerate(keys)])
    of = {x["rid"]: x["doc_id"] for x in lines.occurrences(d).select("doc_id", lines.rid(F.col("lid")).alias("rid")).collect()}
    pairs = [(r["a"], r["b"]) for r in lines.close_pairs(lines.band_rows(d, *lines.bands_for(len(keys))), lines.DISTANCE, lines.SIMILARITY).collect()]
    got = {(min(of[a], of[b]), max(of[a], of[b])) for a, b in pairs}
    assert len(want) > 500 and len(got) == len(pairs)
    assert len(got & set(want)) >= 0.9 * len(want)


@pytest.mark.parametrize("large", [1, 100_000])
def test_line_dedup(spark, monkeypatch, large):
    monkeypatch.setattr(lines.verified_groups, "__defaults__", (large,))
    shared = words(80, 77)
    data = [(i, "\n".join([words(30, 1000 + i), shared + " tail" * (i % 2), "", "***", "Same  line."]), None, None, None, None, None) for i in range(30)]
    d = docs(spark, data)
    got = {(r["doc_id"], i): r for i, r in enumerate(lines.dedup(d).collect())}
    want = brute_lines([(r[0], r[1]) for r in data])
    assert {k[0]: r["text"] for k, r in got.items()} == {i: t for (i, _), t in want.items()}
    assert sum(r["n_removed"] for r in got.values()) >= 29 * 2


def test_line_dedup_cases(spark):
    out = lines.dedup(docs(spark))
    got = out.collect()
    assert len(got) == 14 and {"extra", "n_removed"} <= set(out.columns)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0]["text"] is None and by[4][0]["text"] == "" and by[8][0]["text"] == "  \n\n \t "
    assert by[1][0]["n_removed"] == 0 and [r["text"] for r in by[3]] == ["", ""]
    assert lines.dedup(docs(spark, [])).count() == 0


# 10 toxicity


@pytest.fixture(scope="module")
def trained(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(d, y, per_stratum=250), d, y


def test_toxicity_held_out(spark, trained):
    model, d, y = trained
    seen = [r[0] for r in toxicity.sample(d, y, 250).select("doc_id").collect()]
    s = toxicity.score(d.select("doc_id", "lang", "text"), model, keep_text=False).join(y.select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    rest = s[~s.doc_id.isin(seen)]
    clean, bad = rest[rest.y == 0], s[s.y == 1]
    assert clean.toxic.mean() < 0.03 and bad.toxic.mean() > 0.9
    assert set(model.thresholds) >= {"en"}


def test_toxicity_cases(spark, trained):
    model = trained[0]
    out = toxicity.score(docs(spark).withColumn("toxic", F.lit("clash")), model)
    rows = out.collect()
    assert len(rows) == 14 and {"extra", "toxicity_score"} <= set(out.columns) and out.columns.count("toxic") == 1
    for r in rows:
        assert r["toxic"] is False or r["text"]
        if not (r["text"] or "").strip():
            assert r["toxicity_score"] == 0 and r["toxic"] is False
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = toxicity.fit(docs(spark), spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score(docs(spark), none).collect())


def test_calibrate():
    assert 0.2 < toxicity.calibrate(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0]), np.ones(4)) < 0.8
    assert toxicity.calibrate(np.zeros(0), np.zeros(0), np.zeros(0)) == 0.5


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "source mixing", "BPE encoding"]
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        before = d
        d = cut(stage(spark, d, SMALL), "t")
        assert d.count() > 0
        if k < 4:
            assert d.columns == P.COLUMNS
            assert d.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if k == 1:
            assert d.where("n_chars <> length(text)").count() == 0
        if k == 2:
            assert jaccard.join(d).count() == 0
    assert d.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens"]


def test_pipeline_empty_and_odd(spark):
    import corpus_pipeline as P

    for data in ([], None):
        d = docs(spark, data)
        for k, (_, stage) in enumerate(P.STAGES):
            names = d.columns
            d = cut(stage(spark, d, SMALL), "t")
            assert k == 4 or d.columns == names
