"""Every opN_ query and the pipeline's run over the smallest tables, against naive versions of the same rules."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagelattice.llm import bpe, hashing, lines, media, mixing, queries, store, toxicity
from pagelattice.session import cut

from ..conftest import SMALL
from .test_llm import WORD, brute_pairs, near_lines

RUN = queries.queries()
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def table(spark):
    return sorted((r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), key=lambda d: d["doc_id"])


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.Vocabulary.load(bpe.VOCABULARY).ranks, special_tokens={})


def roots(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


# 2


def test_op2(spark, table, library):
    got = {r["doc_id"]: (r["token_ids"], r["n_tokens"], r["round_trip"]) for r in RUN["op2_bpe"](spark, SMALL).collect()}
    ids = {d["doc_id"]: None if d["text"] is None else library.encode_ordinary(d["text"]) for d in table}
    assert got == {k: (v, None if v is None else len(v), None if v is None else True) for k, v in ids.items()}


# 3


def matroska() -> tuple[bytes, list[tuple]]:
    """A file written out byte by byte, and (track, codec, milliseconds, nanoseconds of a frame, keyframe, lacing, frame, cued) of its frames."""
    h = bytes.fromhex
    head = h("1a45dfa3 84 42868101")
    info = h("1549a966 87 2ad7b1 83 0f4240")
    audio = h("ae 95 d78101 838102 8685") + b"A_PCM" + h("23e383 84 01312d00")
    text = h("ae 8c d78102 838111 8684") + b"S_TX"
    tracks = h("1654ae6b a5") + audio + text
    plain = h("a3 87 81 000a 80") + b"abc"
    xiph = h("a3 4137 81 0014 02 02 01 ff2d") + b"x" + b"y" * 300 + b"zz"
    fixed = h("a3 89 81 0050 04 01") + b"ppqq"
    ebml = h("a0 9b a1 93 82 fff6 06 02 85 bd") + b"aaaaabbbcccc" + h("9b8128 fb819c")
    cluster = h("1f43b675 416f e78201f4") + plain + xiph + fixed + ebml
    cues = h("1c53bb6b 8e bb8c b38201f4 b786 f78101 f18136")
    body = info + tracks + cluster + cues
    want = [(1, "A_PCM", 510, 20_000_000, True, "none", b"abc", True)]
    want += [(1, "A_PCM", 520 + 20 * k, 20_000_000, False, "xiph", f, True) for k, f in enumerate((b"x", b"y" * 300, b"zz"))]
    want += [(1, "A_PCM", 580 + 20 * k, 20_000_000, False, "fixed", f, True) for k, f in enumerate((b"pp", b"qq"))]
    want += [(2, "S_TX", 490 + 13.333333 * k, 13_333_333, False, "ebml", f, False) for k, f in enumerate((b"aaaaa", b"bbb", b"cccc"))]
    return head + h("18538067 01") + len(body).to_bytes(7, "big") + body, want


def test_matroska_by_hand():
    data, want = matroska()
    rows, error = media.packets(data)
    assert error is None and len(rows) == len(want)
    for (track, codec, pts, each, key, lacing, _, start, size, cluster, cued, crc), w in zip(rows, want):
        assert (track, codec, round(pts / 1e6, 4), each, key, lacing, data[start : start + size], cued) == (*w[:2], round(w[2], 4), *w[3:])
        assert crc == zlib.crc32(w[6]) and data[cluster : cluster + 4] == bytes.fromhex("1f43b675")
    # one cue fewer: nothing is cued
    assert not any(r[10] for r in media.packets(data[: data.index(bytes.fromhex("1c53bb6b"))])[0])


def test_op3(spark, table):
    """Every document's bytes come back from the byte ranges' checksums, in frames of 512 bytes."""
    by = defaultdict(list)
    for r in RUN["op3_media_packets"](spark, SMALL).collect():
        by[r["doc_id"]].append(r)
    for d in table:
        raw = (d["text"] or "").encode()
        rows = sorted(by.pop(d["doc_id"], []), key=lambda r: r["packet_no"] or 0)
        if d["text"] is None:
            assert not rows
        elif not raw:
            assert [r["error"] for r in rows] == ["no packets"]
        else:
            parts = [raw[i : i + 512] for i in range(0, len(raw), 512)]
            assert [(r["crc32"], r["byte_size"], r["pts_ns"], r["error"]) for r in rows] == [(zlib.crc32(p), len(p), 20_000_000 * k, None) for k, p in enumerate(parts)]
    assert not by


# 4


def test_op4(spark, table):
    want = brute_pairs([(d["doc_id"], d["text"]) for d in table], 0.6)
    least = roots([d["doc_id"] for d in table], want)
    n = Counter(i for p in want for i in p)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in RUN["op4_ngram_join"](spark, SMALL).collect()}
    same = sum(got[i] == (least[i], n[i]) for i in least)
    assert want and len(got) == len(least) and same >= 0.98 * len(least)
    assert sum(k for _, k in got.values()) >= 0.98 * 2 * len(want)


# 5


def naive_chunks(ids: list[int]) -> list[list[int]]:
    out, start = [], 0
    mixed = [int(x) for x in hashing.mix(np.array(ids, np.uint64) + np.uint64(0xA5A5))]
    for i in range(len(ids)):
        size = i - start + 1
        whole = sum(mixed[i - j] << j for j in range(min(store.WINDOW, i + 1))) & MASK
        top = int(hashing.mix(np.array([whole], np.uint64))[0]) >> 64 - store.BITS
        if size == store.MOST or size >= store.LEAST and top == 0:
            out.append(ids[start : i + 1])
            start = i + 1
    return out + [ids[start:]] * (start < len(ids))


def naive_root(leaves: list[bytes]) -> bytes:
    """The Merkle root by halves: the left one is the largest power of two below the number of leaves."""
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.blake2b(b"\1" + naive_root(leaves[:k]) + naive_root(leaves[k:]), digest_size=16).digest()


def test_op5(spark, table, library):
    got = {r["doc_id"]: r for r in RUN["op5_token_store"](spark, SMALL).collect()}
    assert set(got) == {d["doc_id"] for d in table} and all(r["verified"] for r in got.values())
    for d in table[::4] + sorted(table, key=lambda d: -len(d["text"] or ""))[:3]:
        if not d["text"]:
            continue
        ids, r = library.encode_ordinary(d["text"]), got[d["doc_id"]]
        parts = naive_chunks(ids)
        keys = [hashlib.blake2b(np.array(p, "<u2").tobytes(), digest_size=16).digest() for p in parts]
        leaves = [hashlib.blake2b(b"\0" + k + len(p).to_bytes(8, "little"), digest_size=16).digest() for k, p in zip(keys, parts)]
        assert (r["n_tokens"], r["recipe"], r["sizes"]) == (len(ids), [k.hex() for k in keys], [len(p) for p in parts])
        assert r["merkle_root"] == naive_root(leaves).hex()


# 7


def naive_mix(rows: list[dict], hashes: dict) -> set:
    """Checks of a mix can't name the one right choice, so: (budget, best sum) of each source, by every reachable sum."""
    by = defaultdict(list)
    for d in rows:
        n = len(re.findall(r"[^ \n\t\r]+", d["text"] or ""))
        if d["source"] is not None and n:
            by[d["source"]].append((n, hashes[d["doc_id"]], d["doc_id"]))
    have = {s: sum(n for n, *_ in v) for s, v in by.items()}
    weight = {s: t**mixing.POWER for s, t in have.items()}
    out = {}
    for s, v in by.items():
        budget = min(have[s], math.floor(sum(have.values()) * weight[s] / sum(weight.values()) + 1e-6))
        reach = 1
        for n, *_ in v:
            reach |= reach << n & (1 << budget + 1) - 1
        out[s] = (budget, reach.bit_length() - 1, v)
    return out


def check_mix(rows, chosen, hashes):
    for budget, best, items in naive_mix(rows, hashes).values():
        assert sum(n for n, _, i in items if i in chosen) == best <= budget
        lengths = defaultdict(list)
        for n, h, i in items:
            lengths[n].append((h, i))
        for group in lengths.values():  # of each length the least hashes
            k = sum(i in chosen for _, i in group)
            assert {i for _, i in sorted(group)[:k]} == {i for _, i in group if i in chosen}


@pytest.fixture(scope="module")
def hashes(spark):
    from pyspark.sql import functions as F

    return {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("h")).collect()}


def test_op7(spark, table, hashes):
    got = RUN["op7_source_mix"](spark, SMALL).collect()
    n = {d["doc_id"]: len(re.findall(r"[^ \n\t\r]+", d["text"] or "")) for d in table}
    assert all(r["n_tokens"] == n[r["doc_id"]] > 0 for r in got) and len({r["doc_id"] for r in got}) == len(got)
    check_mix(table, {r["doc_id"] for r in got}, hashes)


# 9


def naive_dedup(rows: list[tuple]) -> dict:
    """doc_id -> the text without lines that occur before, exactly or at an edit similarity of 0.85 (all pairs of lines are compared)."""
    keys, pairs = near_lines([t for _, t in rows], lines.SIMILARITY)
    number = {k: i for i, k in enumerate(keys)}
    group = roots(range(len(keys)), pairs)
    seen, out = set(), {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = None
            continue
        kept = []
        for x in t.split("\n"):
            w = WORD.findall(x.lower())
            g = group[number[" ".join(w)]] if w else None
            if g is None or g not in seen:
                kept.append(x)
            if g is not None:
                seen.add(g)
        out[i] = "\n".join(kept)
    return out


def test_op9(spark, table):
    want = naive_dedup([(d["doc_id"], d["text"]) for d in table])
    got = {r["doc_id"]: r for r in RUN["op9_line_dedup"](spark, SMALL).collect()}
    assert set(got) == set(want)
    same = sum(got[i]["text"] == t for i, t in want.items())
    assert same >= 0.98 * len(want)
    removed = sum((d["text"] or "").count("\n") - (want[d["doc_id"]] or "").count("\n") for d in table if want[d["doc_id"]])
    assert removed > 50
    for d in table:
        r = got[d["doc_id"]]
        assert d["text"] is None or r["n_lines"] == d["text"].count("\n") + 1


# 10


def naive_scores(model: toxicity.Model, texts) -> list[float]:
    """Convolution and pooling, a filter and a place at a time."""
    out = []
    for t in texts:
        data, off = hashing.buffers(__import__("pyarrow").array([(t or "").lower()]))
        rows = [[int(model.place[k]) for k in f] for f in toxicity.features(hashing.words(data, off))]
        if not rows:
            out.append(0.0)
            continue
        z, tap, unit = float(model.out[-1]), 0, 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                act = []
                for i in range(len(rows)):
                    total = float(model.bias[unit])
                    for j in range(min(width, len(rows) - i)):
                        total += sum(float(model.table[k][(tap + j) * toxicity.FILTERS + f]) for k in rows[i + j])
                    act.append(max(0.0, total))
                best = sorted(act, reverse=True)[: toxicity.POOL]
                z += sum(v * float(model.out[k * len(toxicity.WIDTHS) * toxicity.FILTERS + unit]) for k, v in enumerate(best))
                unit += 1
            tap += width
        out.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))


def test_op10(spark, table, model):
    got = {r["doc_id"]: r for r in RUN["op10_toxicity"](spark, SMALL).collect()}
    some = [d for d in table if len(d["text"] or "") < 3000]
    assert len(got) == len(table) and len(some) > 100
    for d, s in zip(some, naive_scores(model, [d["text"] for d in some])):
        r = got[d["doc_id"]]
        limit = model.thresholds.get(d["lang"], model.common)
        assert abs(r["toxicity_score"] - s) < 1e-4 and abs(r["toxicity_threshold"] - limit) < 1e-9
        assert r["toxic"] == (r["toxicity_score"] > limit and r["toxicity_score"] > 0)


# pipeline


def test_pipeline_stages(spark, table, model, hashes, library):
    """Each stage on what its predecessor kept, and run() as all of them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, kept = {d["doc_id"]: d for d in table}, []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), "stage")
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    clean, deduped, single, mixed, coded = kept
    verdict = {r["doc_id"]: r["toxic"] for r in RUN["op10_toxicity"](spark, SMALL).collect()}
    assert clean == {i: d for i, d in rows.items() if not verdict[i]}
    want = naive_dedup([(i, d["text"]) for i, d in clean.items()])
    want = {i: t for i, t in want.items() if t is None or t == clean[i]["text"] or WORD.search(t.lower())}
    assert sum(i in deduped and deduped[i]["text"] == t for i, t in want.items()) >= 0.98 * len(want) and len(set(deduped) ^ set(want)) <= 0.02 * len(want)
    assert all(d["n_chars"] == len(d["text"]) for d in deduped.values() if d["text"] != clean[d["doc_id"]]["text"])
    pairs = brute_pairs([(i, d["text"]) for i, d in deduped.items()], 0.6)
    least = roots(deduped, pairs)
    assert len(set(single) ^ {i for i, x in least.items() if i == x}) <= 0.02 * len(deduped)
    assert all(single[i] == deduped[i] for i in single)
    check_mix(list(single.values()), set(mixed), hashes)
    assert all(mixed[i] == single[i] for i in mixed)
    assert coded == {i: {"doc_id": i, "lang": d["lang"], "source": d["source"], "token_ids": library.encode_ordinary(d["text"]), "n_tokens": len(library.encode_ordinary(d["text"]))} for i, d in mixed.items()}
    assert {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()} == coded
