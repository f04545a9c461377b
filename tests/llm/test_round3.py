"""Findings of the third round."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagelattice.llm import hashing, lines
from tests.llm.helpers import docs, words


def test_band_records_go_by_buckets(spark):
    """Not a row for each line and band: all records are there, in fewer rows than there are lines."""
    d = docs(spark, [(i, "\n".join(words(12, 100 * i + k) for k in range(50)), None, None, None, None, None) for i in range(20)])
    n = lines.occurrences(d).select("lid").distinct().count()
    rows = lines.band_rows(d, lines.ROWS, lines.BANDS)
    got = rows.select(F.length("records")).toPandas().to_numpy()
    assert n == 1000 and len(got) < n and got.sum() == n * lines.BANDS * 24


def test_band_keys_are_those_of_the_least_hashes():
    r = np.random.default_rng(1)
    n = r.integers(1, 300, 200)
    first = np.append(0, np.cumsum(n))
    g = r.integers(0, 1 << 63, int(first[-1]), dtype=np.uint64)
    got = lines.band_keys(g, first, 3, 5, 2)
    with np.errstate(over="ignore"):
        for k in range(len(n)):
            for b in range(5):
                key = np.zeros(1, np.uint64)
                for i in range((2 + b) * 3, (3 + b) * 3):
                    key = hashing.mix(key * lines._MULTIPLIER + (g[first[k] : first[k + 1]] * lines._ODD[i]).min())
                assert got[k, b] == key[0] >> np.uint64(32)


def test_pairs_at_once_are_as_one_by_one(monkeypatch):
    """Near the limit and far from it, over several blocks, with characters of several scripts."""
    r = random.Random(2)
    monkeypatch.setattr(lines, "AT_ONCE", 0)
    for letters in ("abcdefgh ", "abc한글é\U0001f600 "):
        a, b = [], []
        for _ in range(300):
            x = [r.choice(letters) for _ in range(r.randrange(1, 500))]
            y = list(x)
            for _ in range(r.randrange(len(x) // 4 + 2)):
                i = r.randrange(len(y))
                y[i : i + 1] = r.choice([[], [r.choice(letters)], [y[i], r.choice(letters)]]) if len(y) > 1 else ["z"]
            a.append("".join(x))
            b.append("".join(y))
        most = np.array([int(max(len(x), len(y)) * 0.15) for x, y in zip(a, b)])
        got = lines.within(*([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in c] for c in (a, b)), most)
        want = [lines.levenshtein(x, y) <= m for x, y, m in zip(a, b, most)]
        assert got.tolist() == want and 50 < sum(want) < 290


def test_settle_takes_exchanged_words_without_comparing_characters(monkeypatch):
    """Texts that differ in one word each are one group; the edit distance of none of them is computed."""
    base = words(40, 3).split()
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(40)]
    compared, plain = [], lines.within
    monkeypatch.setattr(lines, "within", lambda a, b, most: compared.append(len(a)) or plain(a, b, most))
    got = lines.settle(texts, np.zeros(40, np.int64), np.arange(40), 0.85)
    assert set(got.tolist()) == {0} and sum(compared) == 0
