"""Fixtures that every operator must cope with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double"

WORDS = "river stone cloud paper green walk seven light under bread".split()


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, one doc_id with two texts."""
    long = "\n".join(words(40, k) for k in range(400))
    base = words(60, 1)
    near = base.replace(base.split()[5], "changed", 1)
    out = [
        (1, base, "en", "a", len(base), "x", 1.0),
        (2, near, "en", "a", len(near), "y", None),
        (3, base, "en", "b", len(base), None, 2.0),
        (3, base, "en", "b", len(base), None, 2.0),
        (4, "", "en", "a", 0, "", 0.0),
        (5, None, "en", "a", None, "", 0.0),
        (None, words(30, 2), "en", "b", 1, "", 0.0),
        (6, words(50, 3), None, None, 1, "", 0.0),
        (7, long, "de", "b", len(long), "", 0.0),
        (8, "  \n\n \t ", "de", "b", 6, "", 0.0),
        (9, "한글 텍스트 é ñ \U0001f600 " + words(10, 4), "fr", "a", 1, "", 0.0),
        (10, words(50, 5), "en", "a", 1, "", 0.0),
        (10, words(50, 6), "en", "a", 1, "", 0.0),
        (11, "x" * 20000, "es", "a", 20000, "", 0.0),
    ]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
