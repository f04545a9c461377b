"""Secret scans over a trigram inverted index.

Each rule's regex is analysed into a Boolean query over trigrams that any match must contain (exact sets, prefixes and
suffixes of the parts are combined as the regex is built). The index is cut into segments of documents that lie together
in a task: postings list, for every trigram that some rule asks for, the documents of the segment that have it. A query
intersects and unites postings; only the documents that are left are verified with the regex. A rule without mandatory
trigrams scans every document. Index and texts of a segment sit in one task, so there is no shuffle, and memory is bounded
by the segment.

Trigrams are of UTF-8 bytes with ASCII letters in lower case, which only lets more candidates through. Rules are compiled
for ASCII classes.

Defined cases: null or empty text has no findings; repeated rows give repeated findings; null doc_id is kept; matches of a
rule don't overlap and are numbered from 1 in a document; empty matches don't count.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import hashing

RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b",
    "password_assignment": r"""(?i)\b(?:password|passwd|pwd)[ \t]*[=:][ \t]*["']?[^ \t\r\n"']{6,64}""",
    "token_assignment": r"""(?i)\b(?:token|secret|api_?key)[ \t]*[=:][ \t]*["']?[0-9a-zA-Z_+/=-]{16,128}""",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,64}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "url_credentials": r"\b[a-z][a-z0-9+.-]{1,20}://[^ \t\r\n:@/]{1,64}:[^ \t\r\n:@/]{1,64}@",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,64}",
    "hex_digest": r"\b[0-9a-f]{40}\b",
}

#: Sets of strings larger than this are given up for what is known of their ends.
MOST = 64
#: Bytes of text in a segment of the index.
SEGMENT = 1 << 21

ANY = True  # the query that every document meets


def both(*qs):
    """Conjunction."""
    parts: set = set()
    for q in qs:
        if q is not ANY:
            parts |= q[1] if q[0] == "and" else {q}
    return ANY if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def either(qs):
    """Disjunction."""
    parts: set = set()
    for q in qs:
        if q is ANY:
            return ANY
        parts |= q[1] if q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def contains(strings) -> object:
    """That a document contains one of the byte strings."""
    return either([both(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) if len(s) > 2 else ANY for s in strings])


class Part:
    """What is known of a part of a regex: all its strings (exact) or how they begin and end, and a query."""

    def __init__(self, exact=None, prefix=frozenset([b""]), suffix=frozenset([b""]), query=ANY):
        self.exact, self.prefix, self.suffix, self.query = exact, prefix, suffix, query

    def open(self) -> Part:
        """The same without an exact set."""
        if self.exact is None:
            return self
        return Part(None, cut(self.exact, lambda s: s[:2]), cut(self.exact, lambda s: s[-2:]), both(self.query, contains(self.exact)))


def cut(strings, f) -> frozenset:
    out = frozenset(map(f, strings))
    return out if len(out) <= MOST else frozenset([b""])


def cross(a, b) -> frozenset:
    return frozenset(x + y for x in a for y in b)


def follow(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return Part(cross(a.exact, b.exact))
    ends, begins = a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix
    query = both(a.open().query, b.open().query, contains(cross(ends, begins)) if len(ends) * len(begins) <= MOST * 4 else ANY)
    prefix = cut(cross(a.exact, begins), lambda s: s[:2]) if a.exact is not None and len(a.exact) * len(begins) <= MOST * 4 else a.open().prefix if a.exact is None or b"" not in a.exact else frozenset([b""])
    suffix = cut(cross(ends, b.exact), lambda s: s[-2:]) if b.exact is not None and len(ends) * len(b.exact) <= MOST * 4 else b.open().suffix if b.exact is None or b"" not in b.exact else frozenset([b""])
    return Part(None, prefix, suffix, query)


def branch(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return Part(frozenset().union(*(p.exact for p in parts)))
    parts = [p.open() for p in parts]
    return Part(None, cut(frozenset().union(*(p.prefix for p in parts)), bytes), cut(frozenset().union(*(p.suffix for p in parts)), bytes), either([p.query for p in parts]))


def folded(code: int) -> bytes:
    return chr(code).encode("utf-8", "replace").lower()


def analyse(tree) -> Part:
    out = Part(frozenset([b""]))
    for op, arg in tree:
        out = follow(out, one(op, arg))
    return out


def one(op, arg) -> Part:
    if op is C.LITERAL:
        return Part(frozenset([folded(arg)]))
    if op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
        codes = {x for k, v in arg for x in ([v] if k is C.LITERAL else range(v[0], min(v[1], v[0] + 200) + 1))}
        chars = {folded(x) for x in codes}
        return Part(frozenset(chars)) if len(chars) <= MOST // 2 and len(codes) <= 200 else Part()
    if op is C.BRANCH:
        return branch([analyse(t) for t in arg[1]])
    if op is C.SUBPATTERN:
        return analyse(arg[3])
    if op is C.ATOMIC_GROUP:
        return analyse(arg)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, tree = arg
        inner, out = analyse(tree), Part(frozenset([b""]))
        for _ in range(min(low, 4)):
            out = follow(out, inner)
        if high == low <= 4:
            return out
        if low == 0 and high == 1:
            return branch([Part(frozenset([b""])), inner])
        return follow(out, Part(None)) if low <= 4 else follow(follow(out, Part(None)), inner)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return Part(frozenset([b""]))
    return Part()  # any character, negated classes, references


def query_of(pattern: str):
    """The trigram query of a regex: ("tri", bytes), ("and"/"or", set) or ANY."""
    return analyse(_parser.parse(pattern, re.ASCII)).open().query


def trigrams(q) -> set[bytes]:
    return set() if q is ANY else {q[1]} if q[0] == "tri" else set().union(*(trigrams(x) for x in q[1]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Index:
    """Postings of the asked-for trigrams over a segment of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, wanted: dict[bytes, int]):
        self.n, self.wanted = len(off) - 1, wanted
        keys = np.array(sorted(w[0] << 16 | w[1] << 8 | w[2] for w in wanted), np.uint32)
        self.postings: dict[bytes, np.ndarray] = {}
        if len(data) < 3 or not len(keys):
            return
        # most places are ruled out by 16 bits
        sieve = np.zeros(1 << 16, bool)
        squeeze = lambda a, b, c: (a << np.uint16(8) | b) ^ c * np.uint16(0x9D5)
        k16 = keys.astype(np.uint16)
        sieve[squeeze((keys >> 16).astype(np.uint16), k16 >> np.uint16(8), k16 & np.uint16(255))] = True
        x = _FOLD[data].astype(np.uint16)
        at = np.flatnonzero(sieve[squeeze(x[:-2], x[1:-1], x[2:])])
        code = x[at].astype(np.uint32) << 16 | x[at + 1].astype(np.uint32) << 8 | x[at + 2]
        slot = np.searchsorted(keys, code)
        slot[slot == len(keys)] = 0
        doc = np.searchsorted(off, at, "right") - 1
        good = (keys[slot] == code) & (at + 2 < off[doc + 1])
        pairs = np.unique(slot[good].astype(np.int64) << 32 | doc[good])
        first = np.searchsorted(pairs >> 32, np.arange(len(keys) + 1))
        for i, k in enumerate(keys.tolist()):
            self.postings[bytes((k >> 16, k >> 8 & 255, k & 255))] = pairs[first[i] : first[i + 1]] & 0xFFFFFFFF

    def find(self, q) -> np.ndarray:
        """The documents that meet the query."""
        if q is ANY:
            return np.arange(self.n)
        if q[0] == "tri":
            return self.postings.get(q[1], np.zeros(0, np.int64))
        lists = sorted((self.find(x) for x in q[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if q[0] == "and" else np.union1d(out, x)
        return out


SCHEMA = [("rule", T.StringType()), ("match_no", T.IntegerType()), ("start_char", T.IntegerType()), ("n_chars", T.IntegerType()), ("redacted", T.StringType())]


def redact(secret: str) -> str:
    """The first four characters of a secret."""
    return secret[:4] + "****"


def scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, match_no, start_char, n_chars, redacted): each match of each rule in text."""
    rules = RULES if rules is None else rules
    plan = [(name, pattern, query_of(pattern)) for name, pattern in rules.items()]
    wanted = {t: i for i, t in enumerate(sorted(set().union(*(trigrams(q) for *_, q in plan))))} if plan else {}
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, k) for n, k in SCHEMA)])

    def run(batches):
        compiled = [(name, re.compile(pattern, re.ASCII), q) for name, pattern, q in plan]
        for b in batches:
            data, off = hashing.buffers(b.column(1))
            rows: list[tuple] = []
            for i, j in hashing.pieces(off, SEGMENT):
                index = Index(data[off[i] : off[j]], off[i : j + 1] - off[i], wanted)
                texts: dict[int, str] = {}
                for name, rx, q in compiled:
                    for d in index.find(q).tolist():
                        if d not in texts:
                            texts[d] = data[off[i + d] : off[i + d + 1]].tobytes().decode()
                        k = 0
                        for m in rx.finditer(texts[d]):
                            if m.end() > m.start():
                                k += 1
                                rows.append((i + d, name, k, m.start(), m.end() - m.start(), redact(m[0])))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())], names=["doc_id", *(n for n, _ in SCHEMA)])

    return docs.mapInArrow(run, schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every finding of every rule in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    parts = []
    for name, pattern in RULES.items():
        p = pattern.replace("'", "''")
        parts.append(f"select doc_id, '{name}' as rule, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as gap from documents")
    return (
        "with found as (" + " union all ".join(parts) + "), numbered as (select doc_id, rule, m, gap, unnest(range(1, len(m) + 1)) as k from found) "
        "select doc_id, rule, k::int as match_no, (list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::int as start_char, "
        "length(m[k])::int as n_chars, left(m[k], 4) || '****' as redacted from numbered"
    )


ORACLE = {"op1_secret_scan": _sql()}
