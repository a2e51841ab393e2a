"""SimHash near-dedup with pigeonring filtering.

Each text gets a 128-bit SimHash of its distinct words, weighted by the square root of their counts.
In scripts that are written without spaces each character counts as a word, and pairs of neighbours are
what is hashed. Texts too short for a fingerprint are grouped by a hash of their normalised text instead.
Equal fingerprints collapse first, so a group of thousands of copies costs one row. `within` then finds every
pair within `budget` bits: the bits are cut into five segments whose shares of the budget add up to it, so that
a pair agrees in some segment but for two or three bits (the pigeonhole principle). Each way to flip so many
bits of a segment names a bucket to compare with. Blocks of fingerprints meet two at a time, in tasks for each
segment and share of its flips; work grows as the square of the distinct texts, some thousandths of all pairs.

`similar` is the approximate search, for those who pass a recall. Candidates agree in
one key: `key_bits` consecutive bits of a ring, a seeded permutation of the 128 bits; several rings and
starts are indexed. The number of keys follows from `recall` at `budget` bits of distance alone: whether a
pair is found does not depend on what other rows there are. A pair then has to pass the
pigeonring test: if the distance is within `budget`, some start of the ring of m segments exists such that
for each l <= chain the first l segments from there differ in at most l * budget / m bits; pairs without
such a chain go before the full Hamming check. The test is exact (it loses no pair within the budget).

Groups are connected components of the pairs found; the least id of a group is the one that stays.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import checkpointed, ship, written
from loomkg.llm import _bytes as B
from loomkg.llm._run import arrow_map

BITS = 128
SEGMENTS = 16
CHAIN = 6
#: Bytes of the hash of a short text.
EXACT = 20
#: Bits of a key. More bits mean smaller buckets and more keys; 20 suit up to some 10**10 fingerprints.
KEY_BITS = 20
#: Stretches of equal keys up to this length are compared pair by pair, longer ones grow from seeds.
SMALL = 24
#: Segments of the exact search, and fingerprints of one of its blocks.
PARTS = 5
BLOCK = 1 << 21
#: Two buckets with more pairs than this are compared apart from the others, without the pairs of one component.
HEAVY = 1 << 14
#: Sizes of the pieces that other buckets are cut into, so that many of one size are compared at once.
SHAPES = (1, 2, 3, 4, 6, 8, 12, 16)
_SHAPE = np.searchsorted(SHAPES, np.arange(SHAPES[-1] + 2)).astype(np.uint8)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _unspaced(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the characters of scripts without spaces: Han, kana, Thai, Lao, Burmese, Khmer."""
    at = np.flatnonzero(buf >= 0xE0)
    at = at[at + 2 < len(buf)]
    a, b = buf[at], buf[at + 1]
    three = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F)))
    three |= ((a == 0xE2) & (b >= 0xBA)) | ((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xEF) & (((b >= 0xA4) & (b <= 0xAB)) | ((b >= 0xBC) & (b <= 0xBE))))
    four = (a == 0xF0) & (b >= 0xA0)
    keep = three | four
    return at[keep], np.minimum(at[keep] + np.where(four[keep], 4, 3), len(buf))


def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, ends of what is hashed, first of each text) of the words, characters without spaces being words."""
    s, e, first = B.spans(buf, offs, B.WORDS)
    cs, ce = _unspaced(buf)
    if not len(cs) or not len(s):
        return s, e, e, first
    # pieces of words begin at words, at such characters and behind them
    begin = np.unique(np.concatenate([s, cs, ce]))
    word = np.searchsorted(s, begin, side="right") - 1
    fine = (word >= 0) & (begin < e[word])
    begin, word = begin[fine], word[fine]
    end = np.minimum(np.r_[begin[1:], len(buf)], e[word])
    single = np.isin(begin, cs)
    hashed = end.copy()
    pair = np.flatnonzero(single[:-1] & single[1:] & (word[:-1] == word[1:]))
    hashed[pair] = end[pair + 1]
    return begin, end, hashed, np.searchsorted(begin, offs).astype(np.int64)


def _exact(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes | None:
    """Hash of the words, or of all but white space where there are none; None if that is nothing. Longer than a fingerprint."""
    said = b" ".join(bytes(B.WORDS[buf[a:b]]) for a, b in zip(s, e, strict=True)) or b" ".join(bytes(buf).split())
    return hashlib.blake2b(said, digest_size=EXACT).digest() if said else None


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 16) bytes of the 128-bit SimHash, number of words) of each text."""
    buf, offs = B.lowered(texts)
    return _fingerprints(buf, offs, *_units(buf, offs))


def _fingerprints(buf: np.ndarray, offs: np.ndarray, s: np.ndarray, end: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offs) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    if not len(s):
        return out, np.zeros(n, np.int64)
    h = B.hashes(buf, B.WORDS, s, e)
    # 24 bits of the text's place, 40 of the word's hash: the same 40 whatever the size of the batch
    shift = np.uint64(40)
    key = np.sort((B.owners(first).astype(np.uint64) << shift) | (h & ((np.uint64(1) << shift) - np.uint64(1))))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = np.sqrt(np.diff(np.r_[at, len(key)])).astype(np.float32)
    key = key[at]
    own = (key >> shift).astype(np.int64)
    x = key & ((np.uint64(1) << shift) - np.uint64(1))
    words = np.stack([B.mix(x ^ np.uint64(0x51ED270B9F6D1A27)), B.mix(x + np.uint64(0x2545F4914F6CDD1D))], axis=1).view(np.uint8)
    total = np.zeros((n, BITS), np.float32)
    step = 1 << 15
    for i in range(0, len(x), step):
        bits = np.unpackbits(words[i : i + step], axis=1, bitorder="little")
        signed = (bits.astype(np.float32) - np.float32(0.5)) * weight[i : i + step, None]
        o = own[i : i + step]
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        total[o[starts]] += np.add.reduceat(signed, starts, axis=0)
    out[:] = np.packbits(total > 0, axis=1, bitorder="little")
    return out, np.diff(first)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[a ^ b].sum(1, dtype=np.int64)


def pigeonring(a: np.ndarray, b: np.ndarray, budget: int, chain: int = CHAIN) -> np.ndarray:
    """Which pairs have a start whose every prefix of up to `chain` segments is within its share."""
    d = _ONES[a ^ b].astype(np.int16)
    run = np.zeros_like(d)
    fine = np.ones(d.shape, bool)
    for l in range(chain):
        run += np.roll(d, -l, axis=1)
        fine &= run * SEGMENTS <= (l + 1) * budget
    return fine.any(1)


def key_plan(budget: int, recall: float, key_bits: int = KEY_BITS) -> int:
    """Number of keys: independent keys reach `recall` for pairs at the full budget, so for all within it."""
    p = math.comb(BITS - budget, key_bits) / math.comb(BITS, key_bits)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _rings(bits: int, keys: int) -> list[np.ndarray]:
    """Bit positions of every key: consecutive stretches of seeded rings."""
    out: list[np.ndarray] = []
    rng = np.random.default_rng(20240229)
    while len(out) < keys:
        ring = rng.permutation(BITS)
        for start in range(0, BITS - bits + 1, bits):
            out.append(ring[start : start + bits])
    return out[:keys]


def _keys(f: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    bits = np.unpackbits(f, axis=1, bitorder="little")
    out = np.empty((len(f), len(rings)), np.int64)
    for i, at in enumerate(rings):
        v = np.zeros(len(f), np.int64)
        for j in at:
            v = (v << 1) | bits[:, j]
        out[:, i] = v
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, BITS // 8), np.uint8)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, BITS // 8)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Labels after joining the near pairs; `near` keeps only the pairs that joined two components."""
    root = label.copy()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for p in np.flatnonzero(near).tolist():
        x, y = find(int(a[p])), find(int(b[p]))
        if x == y:
            near[p] = False
        else:
            root[max(x, y)] = min(x, y)
    while (root[root] != root).any():
        root = root[root]
    return root


def _near(f: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs i, j are within the budget, their distances): the pigeonring test, then the full check."""
    at = np.flatnonzero(pigeonring(f[i], f[j], budget))
    d = distance(f[i[at]], f[j[at]])
    near = d <= budget
    return at[near], d[near]


def _small(f: np.ndarray, start: np.ndarray, size: np.ndarray, budget: int, forest: bool):  # noqa: ANN202
    """(i, j, distance) of the near pairs of many short stretches; pairs that differ by s in place are taken at once."""
    place = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    end = np.repeat(start + size, size)
    label = np.arange(len(f))
    for s in range(1, int(size.max())):
        live = place + s < end
        place, end = place[live], end[live]
        for c in range(0, len(place), 1 << 17):
            i = place[c : c + (1 << 17)]
            if forest:
                i = i[label[i] != label[i + s]]
            at, d = _near(f, i, i + s, budget)
            if len(at):
                i = i[at]
                keep = np.ones(len(i), bool)
                if forest:
                    label = _join(label, i, i + s, keep)
                yield i[keep], i[keep] + s, d[keep]


def _long(f: np.ndarray, lo: int, hi: int, budget: int, forest: bool):  # noqa: ANN202
    """The same of one long stretch. forest: a seed takes in all that are near, these take in more, and so on.

    A stretch of near copies then costs a few passes over it, however long it is.
    """
    if not forest:
        for i in range(lo, hi - 1):
            for c in range(i + 1, hi, 1 << 17):
                j = np.arange(c, min(hi, c + (1 << 17)))
                at, d = _near(f, np.full(len(j), i), j, budget)
                yield np.full(len(at), i), j[at], d
        return
    left = np.arange(lo, hi)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            rest = []
            for c in range(0, len(left), 1 << 17):
                j = left[c : c + (1 << 17)]
                at, d = _near(f, np.full(len(j), i), j, budget)
                if len(at):
                    yield np.full(len(at), i), j[at], d
                    queue += j[at].tolist()
                    j = np.delete(j, at)
                rest.append(j)
            left = np.concatenate(rest)


def _stretches(batches):  # noqa: ANN001, ANN202
    """(keys, fingerprints) of whole stretches of equal keys from batches sorted by key; a long one is gathered once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, f = batch.column(0).to_numpy(), _matrix(batch.column(1))
        if not len(key):
            continue
        last = np.flatnonzero(key != key[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        # what is held has one key; it ends here unless the whole batch goes on with it
        if held and (cut or held[-1][0][-1] != key[0]):
            held.append((key[:cut], f[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        elif cut:
            yield key[:cut], f[:cut]
        held.append((key[cut:], f[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def similar(prints: DataFrame, budget: int, recall: float, key_bits: int = KEY_BITS, forest: bool = False) -> DataFrame:
    """(a, b, distance) pairs of distinct fingerprints within the budget; prints: (f binary).

    forest: of the pairs that share a key only a spanning forest is given out, which has the same components.
    A task holds the fingerprints of one key at most, 16 bytes each.
    """
    ship(prints.sparkSession)
    n_keys = key_plan(budget, recall, key_bits)
    rings = _rings(key_bits, n_keys)

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        f = _matrix(b.column(0))
        k = _keys(f, rings) | (np.arange(n_keys, dtype=np.int64) << key_bits)
        again = pa.array(np.repeat(np.arange(len(f)), n_keys))
        return pa.record_batch([pa.array(k.ravel()), b.column(0).take(again)], ["key", "f"])

    keyed = arrow_map(prints.select("f"), spread, "key bigint, f binary")

    def pairs(batches):  # noqa: ANN001, ANN202
        for key, f in _stretches(batches):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            few = (size > 1) & (size <= SMALL)
            found = [_small(f, start[few], size[few], budget, forest)] if few.any() else []
            found += [_long(f, a, a + n, budget, forest) for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True)]
            for x in found:
                for i, j, d in x:
                    if len(i):
                        yield pa.record_batch([pa.array([f[p].tobytes() for p in i], pa.binary()), pa.array([f[p].tobytes() for p in j], pa.binary()), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

    grouped = keyed.repartition("key").sortWithinPartitions("key", "f")
    found = grouped.mapInArrow(pairs, "a binary, b binary, distance int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def parts(budget: int) -> list[tuple[np.ndarray, int]]:
    """(bit positions, most bits that differ) of the segments of the exact search.

    The numbers add up to the budget less what the segments round off: two fingerprints that differ by more in
    every segment differ in more than `budget` bits. So pairs within it agree so far in one segment at least.
    """
    m = max(PARTS, -(-(budget + 1) // 4))
    ring = np.random.default_rng(20240229).permutation(BITS)
    out = []
    for i, at in enumerate(np.array_split(ring, m)):
        # each takes its most plus one of budget + 1
        most = (budget + 1) // m - 1 + (i < (budget + 1) % m)
        if most >= 0:
            out.append((at, most))
    return out


def _flips(bits: int, most: int) -> list[int]:
    """All words of so many bits with up to `most` ones, the fewest first."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


class _Forest:
    """Spanning forest of the pairs found; no pass goes over all members, only over those of the pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[np.ndarray] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            far = self.root[r]
            if (far == r).all():
                break
            r = far
        self.root[x] = r
        return r

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r, s = self.roots(a), self.roots(b)
            apart = r != s
            a, b, r, s = a[apart], b[apart], r[apart], s[apart]
            # every root that is not the least of its pairs hangs on a lesser one, so no circle comes about
            high, at = np.unique(np.maximum(r, s), return_index=True)
            self.root[high] = np.minimum(r, s)[at]
            self.edges.append(np.stack([a[at], b[at]]))


def _across(w0: np.ndarray, w1: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int, forest: _Forest) -> None:
    """Near pairs of a and b, two large buckets or one with itself: not those of the component with most members.

    Which component that is, is asked again as members of a are done, the oftener the fewer are.
    """
    most = len(b)
    while len(a):
        both = forest.roots(np.concatenate([a, b]))
        name, count = np.unique(both, return_counts=True)
        if len(name) == 1:
            return
        in_a, in_b = np.split(both == name[count.argmax()], [len(a)])
        rest = b[~in_b]
        cost = np.cumsum(np.where(in_a, len(rest), len(b)))
        done = max(1, int(np.searchsorted(cost, most, side="right")))
        most = min(2 * most, max(1 << 22, len(b)))
        for p, q in ((a[:done][~in_a[:done]], b), (a[:done][in_a[:done]], rest)):
            step = max(1, (1 << 16) // max(1, len(q)))
            for c in range(0, len(p) if len(q) else 0, step):
                d = np.bitwise_count(w0[p[c : c + step], None] ^ w0[None, q])
                d += np.bitwise_count(w1[p[c : c + step], None] ^ w1[None, q])
                near = np.flatnonzero(d.ravel() <= budget)
                if len(near):
                    forest.add(p[c + near // len(q)], q[near % len(q)])
        a = a[done:]


def _pieces(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beginnings, places of their sizes in SHAPES, which bucket) of the pieces that buckets are cut into."""
    most = SHAPES[-1]
    n = (size + (most - 1)) // most
    which = np.repeat(np.arange(len(size)), n)
    at = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * most
    return first[which] + at, _SHAPE[np.minimum(size[which] - at, most)], which


class _Buckets:
    """Fingerprints in the order of their bits: the keys that occur, where their buckets begin, how large they are."""

    def __init__(self, f: np.ndarray, at: np.ndarray, behind: int) -> None:
        key = np.concatenate([_keys(f[c : c + (1 << 16)], [at])[:, 0] for c in range(0, len(f), 1 << 16)] or [np.zeros(0, np.int64)])
        by = np.argsort(key, kind="stable")
        key = key[by]
        w = np.ascontiguousarray(f).view(np.uint64)
        self.w0, self.w1 = w[by, 0], w[by, 1]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        self.key = key[first]
        self.size = np.diff(np.r_[first, len(key)])
        self.first = first + behind
        self.shape = _SHAPE[np.minimum(self.size, len(_SHAPE) - 1)]

    def index(self, bits: int) -> None:
        self.has = np.zeros(max(64, 1 << bits), bool)
        self.has[self.key] = True
        self.words = np.packbits(self.has, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def rank(self, key: np.ndarray) -> np.ndarray:
        """Places of keys that occur among all that do."""
        word = key >> 6
        below = (np.uint64(1) << (key & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def _search(a: np.ndarray, b: np.ndarray | None, at: np.ndarray, most: int, budget: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(f, (2, edges) of places in it): a spanning forest of the near pairs of a and b, or of a alone, that agree at `at`.

    Agree means that up to `most` of these bits differ. Both sides are sorted by these bits; for every way to flip
    so many of them, each bucket of a meets the bucket of b that its bits so flipped name. Of several turns each
    takes its share of the flips.
    """
    bits = len(at)
    alone = b is None
    x = _Buckets(a, at, 0)
    y = x if alone else _Buckets(b, at, len(a))
    w0, w1 = (x.w0, x.w1) if alone else (np.concatenate([x.w0, y.w0]), np.concatenate([x.w1, y.w1]))
    last = len(w0) - 1
    y.index(bits)
    forest = _Forest(len(w0))

    def meet(k: np.ndarray, l: np.ndarray) -> None:
        """All pairs of the buckets k of x and l of y."""
        m, n = x.shape[k], y.shape[l]
        cut = np.maximum(m, n) == len(SHAPES)
        some = np.flatnonzero(~cut)
        p, m, q, n = x.first[k[some]], m[some], y.first[l[some]], n[some]
        if cut.any():
            k, l = k[cut], l[cut]
            large = x.size[k] * y.size[l] > HEAVY
            for v, w in zip(k[large].tolist(), l[large].tolist(), strict=True):
                _across(w0, w1, x.first[v] + np.arange(x.size[v]), y.first[w] + np.arange(y.size[w]), budget, forest)
            k, l = k[~large], l[~large]
            p2, m2, which = _pieces(x.first[k], x.size[k])
            q2, n2, again = _pieces(y.first[l[which]], y.size[l[which]])
            p, m, q, n = (np.concatenate(v) for v in ((p, p2[again]), (m, m2[again]), (q, q2), (n, n2)))
        kind = m * len(SHAPES) + n
        by = np.argsort(kind, kind="stable")
        p, q, kind = p[by], q[by], kind[by]
        edge = np.r_[np.flatnonzero(np.diff(kind, prepend=np.uint8(255))), len(kind)]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            tall, wide = SHAPES[int(kind[lo]) // len(SHAPES)], SHAPES[int(kind[lo]) % len(SHAPES)]
            step = max(1, (1 << 16) // (tall * wide))
            for c in range(lo, hi, step):
                # pieces that are shorter than their shape run into the next bucket, whose pairs do no harm
                g = np.minimum(np.arange(tall)[:, None] + p[c : min(hi, c + step)], last)
                h = np.minimum(np.arange(wide)[:, None] + q[c : min(hi, c + step)], last)
                d = np.bitwise_count(w0[g][:, None] ^ w0[h][None])
                d += np.bitwise_count(w1[g][:, None] ^ w1[h][None])
                near = np.flatnonzero(d.ravel() <= budget)
                if len(near):
                    r, near = near // (wide * g.shape[1]), near % (wide * g.shape[1])
                    forest.add(g[r, near % g.shape[1]], h[near // g.shape[1], near % g.shape[1]])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    # alone, a pair of buckets is met from that without the highest of the flipped bits
    own, key = None, x.key
    step = 1 << 15
    buffer, found = np.empty(step, np.int64), np.empty(step, bool)
    for flip in sorted(_flips(bits, most)[turn::turns], key=int.bit_length):
        if flip == 0 and alone:
            meet(many := np.flatnonzero(x.size > 1), many)
            continue
        if alone and own != flip.bit_length():
            own = flip.bit_length()
            here = np.flatnonzero(x.key & (1 << (own - 1)) == 0)
            key = x.key[here]
        for c in range(0, len(key), step):
            n = min(step, len(key) - c)
            to = np.bitwise_xor(key[c : c + n], flip, out=buffer[:n])
            hit = np.flatnonzero(np.take(y.has, to, out=found[:n], mode="wrap"))
            if len(hit):
                held.append((here[c + hit] if alone else c + hit, y.rank(to[hit])))
                waiting += len(hit)
                if waiting > 1 << 18:
                    meet(*(np.concatenate(v) for v in zip(*held, strict=True)))
                    held, waiting = [], 0
    if held:
        meet(*(np.concatenate(v) for v in zip(*held, strict=True)))
    f = np.stack([w0, w1], axis=1).view(np.uint8)
    return f, np.concatenate(forest.edges, axis=1) if forest.edges else np.zeros((2, 0), np.int64)


def within(prints: DataFrame, budget: int) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within the budget, none left out but those that others join; prints: (f binary).

    Every two blocks of fingerprints meet in a task for each share of a segment's flips, which gives a spanning forest
    of its pairs. A task holds two blocks of `BLOCK` fingerprints of 16 bytes. The number of tasks follows from that
    of fingerprints.
    """
    spark = prints.sparkSession
    ship(spark)
    segments = parts(budget)
    blocks = max(1, -(-prints.count() // BLOCK))
    tiles = blocks * (blocks + 1) // 2
    # few tiles are cut by flips, so that cores do not wait for one another
    ways = [len(_flips(len(at), most)) for at, most in segments]
    turns = [-(-n * max(1, min(4, -(-12 // tiles))) // max(ways)) for n in ways]
    shares = [(i, k, n) for i, n in enumerate(turns) for k in range(n)]
    m = len(shares)
    tasks = tiles * m
    placed = prints.select("f", F.pmod(F.xxhash64("f"), F.lit(blocks)).cast("int").alias("block"))
    met = placed.select("f", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tile = (high * (high + 1) / 2).cast("int") + low
    sent = met.select("f", (F.col("block") == high).alias("right"), (F.col("block") == F.col("other")).alias("alone"), tile.alias("tile")).select(
        "f", "right", "alone", F.explode(F.sequence(F.col("tile") * m, F.col("tile") * m + (m - 1))).alias("task")
    )

    def search(batches):  # noqa: ANN001, ANN202
        held: dict[int, tuple[bool, list, list]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            f, right, task = _matrix(batch.column(0)), np.asarray(batch.column(1)), batch.column(3).to_numpy()
            for t in np.unique(task).tolist():
                alone, left, other = held.setdefault(t, (batch.column(2)[int(np.flatnonzero(task == t)[0])].as_py(), [], []))
                left.append(f[(task == t) & ~right])
                other.append(f[(task == t) & right])
        for t in list(held):
            alone, left, other = held.pop(t)
            a, b = np.concatenate(left), np.concatenate(other)
            del left, other
            if alone:
                a, b = b, None
            elif not len(a) or not len(b):
                continue
            part, turn, turns = shares[t % m]
            f, (i, j) = _search(a, b, *segments[part], budget, turn, turns)
            del a, b
            for c in range(0, len(i), 50_000):
                yield pa.record_batch([pa.array([x.tobytes() for x in f[at[c : c + 50_000]]], pa.binary()) for at in (i, j)], ["a", "b"])

    found = sent.repartitionById(tasks, F.col("task")).mapInArrow(search, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): least node of each connected component; hooking with pointer jumping, in few rounds.

    Raises an error if labels still change after `rounds`.
    """
    both = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), name="edges")
    label = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).select(F.col("x").alias("node"), "root")
    label = checkpointed(label)
    for _ in range(rounds):
        around = both.join(label.select(F.col("node").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        hooked = label.join(around.withColumnRenamed("x", "node"), "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        nxt = checkpointed(nxt)
        if not nxt.where("old <> root").limit(1).count():
            return nxt.select("node", "root")
        label = nxt.select("node", "root")
    raise RuntimeError(f"components still change after {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 18, min_words: int = 8) -> DataFrame:
    """(id, duplicate_of, distance) of every document that a lesser id of its group stands for.

    All pairs of fingerprints within the budget count, without exception.

    A text of fewer than `min_words` words (characters, in scripts without spaces) is grouped with those of the
    same words only, and one without any word with those that differ in white space only. A null or blank text
    and a null id are in no group. Rows that repeat an id
    with texts of different groups belong to the group of its least fingerprint. distance is that between
    the two fingerprints, which may exceed the budget where a chain of pairs links them. Very long texts are read
    whole; a bit whose weights tie is 0, and of ids that tie there is but one. Column names of the input other
    than the two do not matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = B.lowered(b.column(1))
        s, end, hashed, first = _units(buf, offs)
        f, n = _fingerprints(buf, offs, s, end, hashed, first)
        key: list[bytes | None] = [x.tobytes() for x in f]
        for i in np.flatnonzero(n < min_words).tolist():
            own = slice(int(first[i]), int(first[i + 1]))
            key[i] = _exact(buf[offs[i] : offs[i + 1]], s[own] - offs[i], end[own] - offs[i])
        out = pa.record_batch([b.column(0), pa.array(key, pa.binary())], ["k", "f"])
        return out.filter(out.column(1).is_valid())

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    by_doc = written(arrow_map(rows, of, f"k {kind}, f binary", 1).groupBy("k").agg(F.min("f").alias("f")), name="prints")
    prints = written(by_doc.groupBy("f").agg(F.min("k").alias("k")), name="distinct")
    long = prints.where(F.length("f") < EXACT)
    roots = components(within(long, budget))
    # the least id of a component stays
    member = roots.join(prints, roots["node"] == prints["f"]).select("node", "root", "k")
    best = member.groupBy("root").agg(F.min(F.struct("k", "node")).alias("m")).select("root", F.col("m.k").alias("duplicate_of"), F.col("m.node").alias("kept_f"))
    linked = member.join(best, "root").select(F.col("node").alias("f"), "duplicate_of", "kept_f")
    own = prints.join(linked, "f", "left").select("f", F.coalesce("duplicate_of", "k").alias("duplicate_of"), F.coalesce("kept_f", "f").alias("kept_f"))

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v[: BITS // 8] for v in s), np.uint8).reshape(-1, BITS // 8) for s in (a, b))
        return pd.Series(distance(x, y).astype(np.int32))

    out = by_doc.join(own, "f").where("k <> duplicate_of").select(F.col("k").alias(id_col), "duplicate_of", apart("f", "kept_f").alias("distance"))
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents without those that another of their group stands for; rows that repeat an id share its fate.

    Nulls, empty, short and very long texts and ties as in `near_duplicates`: rows in no group stay, with all
    their columns, whatever their names; an empty table stays empty.
    """
    gone = near_duplicates(docs, id_col, text_col, **params).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")

