"""BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into pre-tokens as its vocabulary's pattern says. The distinct pre-tokens ("words") of a batch that aren't
known yet form a trie. The trie is walked depth first: the state of a node is the last token of the encoding of the
prefix that the node stands for, so the encoding of a prefix that many words share is computed once. That the state
suffices follows from how BPE merges: the encoding of a prefix p that ends in token t is the encoding of p without t,
followed by t, and exactly one token t that p ends in fits the last token before it, namely the one for which BPE, given
both tokens' bytes, yields just these two. Sorted words are the trie's depth-first order, so the walk keeps one stack of
states, and a word starts at the depth of its longest common prefix with the word before. Many words are walked in lanes: each
lane takes a run of neighbouring words depth first with a stack of its own, and numpy moves all lanes by one byte at once. Only
the path to a lane's first word is computed again.

Everything happens inside the tasks that read the texts: no shuffle, a memory of known words that is bounded; when it is full,
and from task to task, the words that were met most often stay.

Defined cases: null text gives null ids, empty text none; repeated rows and extra columns pass through; columns named like
the added ones are replaced; a text of one very long word takes memory in proportion to the word.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import small_batches
from .hashing import buffers, give_back, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a Python worker remembers at most.
MEMORY = 80_000
#: Words up to this length in bytes are walked in lanes, those beyond one by one.
LANE_BYTES = 64
#: Trie nodes from which lanes pay, and about how many of them a lane has.
LANES_FROM, LANE_NODES = 1 << 15, 128
#: Places of the table of known pairs (a power of two).
PAIRS = 1 << 20
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


#: Lengths of tokens, in the order in which they are tried; only one can fit.
ORDER = (6, 5, 4, 3, 2, 1)
#: Bytes at a word's end by which the tokens it may end in are remembered.
NEAR = 6


class Vocabulary:
    """Byte strings and ranks of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        #: lengths of tokens of more than NEAR bytes by their last NEAR + 2 bytes (fewer, if they are shorter), longest first
        far: dict[bytes, set[int]] = {}
        for k in ranks:
            if len(k) > NEAR:
                far.setdefault(k[-NEAR - 2 :], set()).add(len(k))
        self.far = {k: tuple(sorted(v, reverse=True)) for k, v in far.items()}
        self._near: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._whole: dict[int, bool] = {}
        self._tables: Tables | None = None

    @property
    def tables(self) -> Tables:
        if self._tables is None:
            self._tables = Tables(self)
        return self._tables

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def endings(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens of up to NEAR bytes that the tail ends in."""
        if len(self._near) > 100_000:
            self._near.clear()
        out = [(n, t) for n in ORDER if n <= len(tail) and (t := self.ranks.get(tail[-n:])) is not None]
        self._near[tail] = tuple(out)
        return self._near[tail]

    def halves(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge makes t; (t, t) for a single byte."""
        known = self._halves.get(t)
        if known is None:
            word, ranks = self.bytes_of[t], self.ranks
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._halves[t] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (t, t)
        return known

    def whole(self, t: int) -> bool:
        """Whether BPE makes one token of t's bytes."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = self.merge(self.bytes_of[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b after token a: undo their merges, latest first; no pair that met at the border may have been merged before the merge that took one of the two away."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is not None:
            return known
        if len(self._pairs) > 200_000:
            self._pairs.clear()
        if not (self.whole(a) and self.whole(b)):
            out = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        else:
            x, y, limit, out = a, b, 1 << 60, True
            while True:
                both = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                if both is not None and both < limit:
                    out = False
                    break
                u, v = self.halves(x), self.halves(y)
                # the later merge of the two is undone; at equal ranks the right one, as BPE merges the left one first
                if x > y and len(self.bytes_of[x]) > 1:
                    limit, x = x, u[1]
                elif len(self.bytes_of[y]) > 1:
                    limit, y = y + 1, v[0]
                elif len(self.bytes_of[x]) > 1:
                    limit, x = x, u[1]
                else:
                    break
        self._pairs[key] = out
        return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Tables:
    """A vocabulary as arrays: tokens by their bytes, halves by token, pairs that merge, and pairs known to fit."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        n = len(vocab.bytes_of)
        self.size = np.array([len(b) for b in vocab.bytes_of], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(vocab.bytes_of), np.uint8)
        self.lengths = [int(k) for k in np.unique(self.size) if 0 < k <= LANE_BYTES]
        # tokens by (length, last eight bytes, the bytes before): open addressing
        self.bits = max(8, (4 * n).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        at = self.start[1:]
        tail, rest = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(LANE_BYTES):
                have = np.flatnonzero(self.size > k)
                self.extend(tail, rest, have, self.flat[at[have] - 1 - k], k)
            self.tail, self.rest = tail, rest
            left = np.flatnonzero((self.size > 0) & (self.size <= LANE_BYTES))
            place = self._place(tail[left], rest[left], self.size[left])
            while len(left):
                free = self.slot[place] < 0
                self.slot[place[free]] = left[free]
                own = self.slot[place] == left
                left, place = left[~own], (place[~own] + 1) & ((1 << self.bits) - 1)
        # pairs whose bytes together are a token
        keys, merged = [], []
        get = vocab.ranks.get
        for word, t in vocab.ranks.items():
            for k in range(1, len(word)):
                a = get(word[:k])
                if a is not None and (b := get(word[k:])) is not None:
                    keys.append(a << 32 | b)
                    merged.append(t)
        o = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair, self.merged = np.array(keys, np.int64)[o], np.array(merged, np.int64)[o]
        self.left, self.right, self.whole = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        self.fit = np.full(PAIRS, -1, np.int64)

    @staticmethod
    def extend(tail: np.ndarray, rest: np.ndarray, at: np.ndarray, byte: np.ndarray, k: int) -> None:
        """Put the byte that stands k places before the end to the keys at the given places."""
        if k < 8:
            tail[at] |= byte.astype(np.uint64) << np.uint64(8 * k)
        else:
            rest[at] = (rest[at] + byte + np.uint64(1)) * _MIX

    def _place(self, tail: np.ndarray, rest: np.ndarray, size) -> np.ndarray:
        h = (tail ^ rest ^ (np.asarray(size).astype(np.uint64) << np.uint64(56))) * _MIX
        h ^= h >> np.uint64(29)
        return ((h * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, data: np.ndarray, end: np.ndarray, tail: np.ndarray, rest: np.ndarray, size: int) -> np.ndarray:
        """The tokens that are the `size` bytes of data before each end, -1 for none; tail and rest: their keys."""
        out = np.full(len(end), -1, np.int32)
        left, place = np.arange(len(end)), self._place(tail, rest, size)
        while len(left):
            t = self.slot[place]
            same = (t >= 0) & (self.tail[t] == tail[left]) & (self.rest[t] == rest[left]) & (self.size[t] == size)
            out[left[same]] = t[same]
            on = (t >= 0) & ~same
            left, place = left[on], (place[on] + 1) & ((1 << self.bits) - 1)
        if size > 8:  # the bytes before the last eight are compared as they are
            hit = np.flatnonzero(out >= 0)
            for k in range(8, size):
                wrong = data[end[hit] - 1 - k] != self.flat[self.start[out[hit] + 1] - 1 - k]
                out[hit[wrong]] = -1
                hit = hit[~wrong]
        return out

    def learn(self, tokens: np.ndarray) -> None:
        """Fill in the halves of tokens, and whether they are whole."""
        new = self.left[tokens] < 0
        if new.any():
            for t in set(tokens[new].tolist()):
                self.left[t], self.right[t] = self.vocab.halves(t)
                self.whole[t] = self.vocab.whole(t)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.fits of many pairs; known ones are looked up."""
        key = a.astype(np.int64) << 31 | b
        place = ((key.astype(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64) & (PAIRS - 1)
        got = self.fit[place]
        out = (got & 1).astype(bool)
        miss = np.flatnonzero(got >> 1 != key)
        if len(miss):
            out[miss] = self._fits(a[miss].astype(np.int64), b[miss].astype(np.int64))
            self.fit[place[miss]] = key[miss] << 1 | out[miss]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.learn(np.concatenate([a, b]))
        out = np.ones(len(a), bool)
        odd = np.flatnonzero(~(self.whole[a] & self.whole[b]))
        for i in odd.tolist():
            out[i] = self.vocab.fits(int(a[i]), int(b[i]))
        at = np.flatnonzero(self.whole[a] & self.whole[b])
        x, y, limit = a[at], b[at], np.full(len(at), 1 << 60)
        while len(at):
            k = np.minimum(np.searchsorted(self.pair, key := x << 32 | y), len(self.pair) - 1)
            bad = (self.pair[k] == key) & (self.merged[k] < limit) if len(self.pair) else np.zeros(len(at), bool)
            out[at[bad]] = False
            self.learn(x)
            self.learn(y)
            first, second = self.size[x] > 1, self.size[y] > 1
            undo_left = first & ((x > y) | ~second)
            go = ~bad & (first | second)
            limit = np.where(undo_left, x, y + 1)[go]
            at, x, y = at[go], np.where(undo_left, self.right[x], x)[go], np.where(undo_left, y, self.left[y])[go]
        return out


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[list[list[int]], int]:
    """Encodings of distinct words, and the number of trie nodes whose state was computed."""
    ids, ends, visited = encode_flat(words, vocab)
    return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())], visited


def encode_flat(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids of all words one after the other, where each word's end, trie nodes whose state was computed) of distinct words."""
    size = np.array([len(w) for w in words], np.int64)
    if int(size.sum()) < LANES_FROM:
        coded, visited = walk(words, vocab)
        return np.array([t for ids in coded for t in ids], np.int32), np.cumsum(np.array([len(ids) for ids in coded], np.int64)), visited
    short = np.flatnonzero(size <= LANE_BYTES)
    long = np.flatnonzero(size > LANE_BYTES)
    ids, count, visited = walk_lanes([words[i] for i in short.tolist()], vocab)
    if not len(long):
        return ids, np.cumsum(count), visited
    coded, more = walk([words[i] for i in long.tolist()], vocab)
    n = np.zeros(len(words), np.int64)
    n[short], n[long] = count, [len(c) for c in coded]
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]), np.int32)
    mine = np.repeat(size <= LANE_BYTES, n)
    out[mine] = ids
    out[~mine] = [t for c in coded for t in c]
    return out, ends, visited + more


def walk_lanes(words: list[bytes], vocab: Vocabulary, per_lane: int = LANE_NODES) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids of all words, their number by word, nodes whose state was computed) of distinct words of up to LANE_BYTES bytes, walked depth first in lanes."""
    tables = vocab.tables
    order = np.array(sorted((i for i in range(len(words)) if words[i]), key=words.__getitem__), np.int64)
    count = np.zeros(len(words), np.int64)
    if not len(order):
        return np.zeros(0, np.int32), count, 0
    ranked = [words[i] for i in order.tolist()]
    size = np.array([len(w) for w in ranked], np.int64)
    data = np.frombuffer(b"".join(ranked), np.uint8)
    begin = np.cumsum(size) - size
    # bytes that a word shares with the one before it
    shared = np.zeros(len(size), np.int64)
    on = np.arange(1, len(size))
    while len(on):
        d = shared[on]
        on = on[(d < size[on]) & (d < size[on - 1])]
        d = shared[on]
        on = on[data[begin[on] + d] == data[begin[on - 1] + d]]
        shared[on] += 1
    # lanes: runs of words
    lane = (np.cumsum(size - shared) - 1) // per_lane
    heads = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    shared[heads] = 0
    own = size - shared
    after = np.cumsum(own)
    total = int(after[-1])
    # a node for each byte that isn't shared
    depth = np.arange(total) - np.repeat(after - own - shared, own)
    end = np.repeat(begin, own) + depth + 1
    # the tokens that a node's path ends in, longest first
    tail, rest = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    at, found, done = np.arange(total), [], 0
    for n in tables.lengths:
        with np.errstate(over="ignore"):
            for k in range(done, n):
                at = at[depth[at] >= k]
                tables.extend(tail, rest, at, data[end[at] - 1 - k], k)
            done = n
            if not len(at):
                break
            t = tables.find(data, end[at], tail[at], rest[at], n)
        hit = t >= 0
        found.append((n, at[hit], t[hit]))
    del tail, rest
    many = np.zeros(total + 1, np.int64)
    for _, nodes, _ in found:
        many[nodes + 1] += 1
    first = np.cumsum(many)
    token, length = np.empty(int(first[-1]), np.int32), np.empty(int(first[-1]), np.int32)
    free = first[:-1].copy()
    for n, nodes, t in reversed(found):
        token[free[nodes]], length[free[nodes]] = t, n
        free[nodes] += 1
    del found, free, many, end
    tables.learn(token)
    # all lanes go on by one node at a time, those with the most nodes first
    start = (after - own)[heads]
    nodes_of = np.diff(np.append(start, total))
    o = np.argsort(-nodes_of, kind="stable")
    start, nodes_of = start[o], nodes_of[o]
    stack = np.zeros((len(start), LANE_BYTES), np.int64)
    last, before = np.full(total, -1, np.int32), np.full(total, -1, np.int64)
    for step in range(int(nodes_of[0])):
        k = int(np.searchsorted(-nodes_of, -step, "left"))
        row = np.arange(k)
        node = start[:k] + step
        d = depth[node]
        stack[row, d] = node
        c = first[node]
        while True:
            t, n = token[c], length[c]
            root = n > d
            up = stack[row, np.where(root, 0, d - n)]
            ok = tables.whole[t]
            inner = np.flatnonzero(~root)
            ok[inner] = tables.fits(last[up[inner]], t[inner])
            up[root] = -1
            got = node[ok]
            last[got], before[got] = t[ok], up[ok]
            if ok.all():
                break
            miss = ~ok
            row, node, d, c = row[miss], node[miss], d[miss], c[miss] + 1
            if (c >= first[node + 1]).any():
                raise ValueError("the vocabulary lacks a token for a single byte")
    # ids from a word's last node back to its first
    now, back = after - 1, []
    live = np.arange(len(order))
    n_ids = np.zeros(len(order), np.int64)
    while len(live):
        back.append((live, last[now]))
        n_ids[live] += 1
        now = before[now]
        keep = now >= 0
        live, now = live[keep], now[keep]
    count[order] = n_ids
    ends = np.cumsum(count)
    place = ends[order] - 1
    out = np.empty(int(ends[-1]), np.int32)
    for words_at, ids in back:
        out[place[words_at]] = ids
        place[words_at] -= 1
    return out, count, total


def walk(words: list[bytes], vocab: Vocabulary) -> tuple[list[list[int]], int]:
    """Encodings of distinct words, walked one by one, and the number of trie nodes whose state was computed."""
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list[list[int]] = [[]] * len(words)
    ranks, near, far, endings, fits, whole, known = vocab.ranks, vocab._near, vocab.far, vocab.endings, vocab.fits, vocab.whole, vocab._pairs
    last: list[int] = []  # last[d]: last token of the encoding of the path's first d + 1 bytes
    size: list[int] = []  # its length
    before, visited = b"", 0
    for i in order:
        w = words[i]
        depth, most = 0, min(len(before), len(w))
        if w.startswith(before):
            depth = most
        else:
            while before[depth] == w[depth]:
                depth += 1
        del last[depth:], size[depth:]
        visited += len(w) - depth
        for d in range(depth, len(w)):
            e = d + 1
            tail = w[e - NEAR : e] if e > NEAR else w[:e]
            for found, t in near.get(tail) or endings(tail):
                if found < e:
                    ok = known.get(last[d - found] << 32 | t)
                    if ok or ok is None and fits(last[d - found], t):
                        break
                elif whole(t):
                    break
            else:
                for n in (*far.get(w[max(0, e - NEAR - 2) : e], ()), *far.get(w[e - NEAR - 1 : e], ())):
                    found = n
                    if n <= e and (t := ranks.get(w[e - n : e])) is not None and (fits(last[d - n], t) if n < e else whole(t)):
                        break
            last.append(t)
            size.append(found)
        ids, d = [], len(w)
        while d:
            ids.append(last[d - 1])
            d -= size[d - 1]
        out[i] = ids[::-1]
        before = w
    return out, visited


class Encoder:
    """Encodes batches of texts; remembers words between batches."""

    def __init__(self, vocab: Vocabulary, pattern: str = PATTERN, memory: int = MEMORY):
        self.vocab, self.memory = vocab, memory
        self.split = regex.compile(pattern).findall
        self.simple = pattern == PATTERN
        self._forget()

    def rest(self) -> None:
        """Give back most of what was remembered: workers live on after their task, and other tasks need the memory. The words met most often stay."""
        self._forget(self.memory // 4)
        self.vocab._near.clear()
        self.vocab._pairs.clear()

    def _forget(self, keep: int = 0) -> None:
        """Remember only so many of the words met at least twice, the most frequent ones."""
        old = [] if not keep else list(self.known)
        if old:
            met = self.met[: len(old)]
            best = np.flatnonzero(met > 1)
            if len(best) > keep:
                best = np.sort(best[np.argsort(-met[best], kind="stable")[:keep]])
            n = self.first[best + 1] - self.first[best]
            ends = np.cumsum(n)
            tokens = self.tokens[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[best] - ends + n, n)]
        self.known = _Numbers()
        self.tokens = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 12, np.int64)
        self.met = np.zeros(1 << 12, np.int64)
        self.done = 0
        if old and len(best):
            self.known.new = [old[i] for i in best.tolist()]
            self.known.update(zip(self.known.new, range(len(best))))
            self._store(tokens, ends)

    def _pieces(self, text: str) -> list[str]:
        """Stretches whose encodings, one after the other, are the text's.

        With the byte-level pattern, a text without adjacent white space and NUL (the mark of "no space before it") can be cut before every space and line feed: the
        space goes with what follows it, the line feed is a pre-token of its own. Then the stretches are taken whole.
        """
        if self.simple and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or text[-1:].isspace() or any(c in text for c in _WHITE)):
            parts = text.replace("\n", " \n").split(" ")
            if parts[0]:
                parts[0] = "\0" + parts[0]  # no space before it
            return parts
        return ["\0" + w for w in self.split(text)]

    def _learn(self) -> None:
        """Encode the words that were met since the last call."""
        new = self.known.new
        if new:
            self._store(*self._code([w[1:] if w[:1] == "\0" else w if w[:1] == "\n" else " " + w for w in new]))

    def _store(self, flat: np.ndarray, ends: np.ndarray) -> None:
        """Take over the ids of the new words."""
        at, n = int(self.first[self.done]), len(ends)
        while at + len(flat) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        while self.done + n + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.tokens[at : at + len(flat)] = flat
        self.first[self.done + 1 : self.done + n + 1] = at + ends
        self.done += n
        self.known.new = []

    def _code(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches one after the other, and where each one's end."""
        pre: dict[str, int] = {}
        number, split = pre.setdefault, self.split
        of: list[int] = []
        ends = np.empty(len(stretches), np.int64)
        for k, s in enumerate(stretches):
            if self.simple and s.isascii() and s[1:].isalpha() and (s[0] == " " or s[0].isalpha()):
                of.append(number(s, len(pre)))  # letters are one pre-token
            else:
                for p in split(s):
                    of.append(number(p, len(pre)))
            ends[k] = len(of)
        flat, stop, _ = encode_flat([p.encode("utf-8", "replace") for p in pre], self.vocab)
        return _gather(flat, np.concatenate([[0], stop]), np.array(of, np.int64), ends)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the offsets of each text's."""
        if self.done > self.memory:
            self._forget(self.memory // 2)
        number = self.known.__getitem__
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                parts = self._pieces(text)
                counts[i] = len(parts)
                words.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        index = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.met[: self.done] += np.bincount(index, minlength=self.done)
        ids, ends = _gather(self.tokens, self.first, index, np.cumsum(counts))
        return ids, np.concatenate([[0], ends])


def _gather(tokens: np.ndarray, first: np.ndarray, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the words with the given numbers, one after the other, and where those of each text end that ends after so many words."""
    start = first[index]
    n = first[index + 1] - start
    stop = np.cumsum(n)
    ids = tokens[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - stop + n, n)]
    return ids, np.concatenate([[0], stop])[ends]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


_WORKER: dict[tuple[str, str], Encoder] = {}


def worker_encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """The Python worker's encoder of a vocabulary file; its vocabulary is kept from task to task."""
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _WORKER[path, pattern]


def decode_bytes(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.bytes_of.__getitem__, ids.tolist()))


def round_trips(texts: pa.Array, ids: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Whether the bytes of each text's ids are the text's bytes."""
    t = vocab.tables
    n = t.size[ids]
    stop = np.cumsum(n)
    made = t.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(t.start[ids] - stop + n, n)]
    ends = np.concatenate([[0], stop])[off]
    data, at = buffers(texts)
    out = np.diff(ends) == np.diff(at)
    for k in np.flatnonzero(out).tolist():
        out[k] = np.array_equal(made[ends[k] : ends[k + 1]], data[at[k] : at[k + 1]])
    return out


def slices(column: pa.Array, most: int = 1 << 20):
    """Runs of rows of at most so many bytes of text together (a longer text is a run of its own)."""
    yield from pieces(buffers(column)[1], most)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep_text: bool = True, verify: bool = False) -> DataFrame:
    """docs with token_ids ARRAY<INT> and n_tokens INT; with verify also round_trip BOOLEAN: whether decoding gives the text again."""
    added = ["token_ids", "n_tokens"] + ["round_trip"] * verify
    docs = docs.drop(*added)
    kept = [c for c in docs.columns if keep_text or c != "text"]
    docs = docs.select(*kept, docs["text"].alias("__text"))
    kinds = [T.ArrayType(T.IntegerType(), False), T.IntegerType(), T.BooleanType()]
    schema = T.StructType(docs.schema.fields[:-1] + [T.StructField(n, k) for n, k in zip(added, kinds)])

    def run(batches):
        enc = worker_encoder(vocabulary, pattern)
        for whole in batches:
            for i, j in slices(whole.column(whole.num_columns - 1)):
                b = whole.slice(i, j - i)
                texts = b.column(b.num_columns - 1).to_pylist()
                ids, off = enc.encode(texts)
                none = np.array([t is None for t in texts], bool)
                cols = [b.column(k) for k in range(len(kept))]
                cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32(), mask=np.append(none, False)) if none.any() else pa.array(off, pa.int32()), pa.array(ids)))
                cols.append(pa.array(np.diff(off), pa.int32(), mask=none))
                if verify:
                    cols.append(pa.array(round_trips(b.column(b.num_columns - 1), ids, off, enc.vocab), mask=none))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *added])
                del b, cols, texts, ids
            del whole
            give_back()
        enc.rest()
        give_back()

    return small_batches(docs).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str = VOCABULARY, ids: str = "token_ids") -> DataFrame:
    """df with decoded STRING: the text of its ids; null for null ids or an id outside the vocabulary. Invalid UTF-8 becomes U+FFFD."""
    df = df.drop("decoded")
    schema = T.StructType(df.schema.fields + [T.StructField("decoded", T.StringType())])
    at = df.columns.index(ids)

    def run(batches):
        vocab = worker_encoder(vocabulary).vocab
        n = len(vocab.bytes_of)
        for b in batches:
            rows = (None if r is None or any(x is None or not 0 <= x < n for x in r) else b"".join(map(vocab.bytes_of.__getitem__, r)).decode("utf-8", "replace") for r in b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.string())], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number, and whether decoding them gives the text again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, keep_text=False, verify=True)
