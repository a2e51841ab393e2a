"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

The array is sparse. Suffixes start at anchors, positions that hold the least hash of some window of
`gap` word pairs; an anchor depends on its window alone, so copies of a passage have the same anchors, at
most `gap` words apart. A suffix can match another in `least` words only if the hash of its first `least`
words occurs in two documents, so the others are pruned before any text moves (the duplicate detection of
prefix doubling). What is left is cut to `least + gap` words: the next anchor continues a longer passage.

Each task sorts its suffixes and sends one front-coded run per bucket: for every suffix the length of the
prefix it shares with its predecessor, and the rest. Buckets split by the hash of the first `least` words, so
all suffixes that share them meet. There a loser tree merges the runs: a comparison starts from the known
common prefixes with the last winner, and looks at bytes only where those are equal, never at a byte twice.
Neighbours of the merged order give the longest match of every suffix with another document; of a group of
equal openings only those entries are held that await the next other document. The number of buckets follows
from the bytes of all suffixes, `BUCKET` each, and a task merges one bucket at a time.

That reports passages from an anchor on. `passages`, which the query uses, looks at every position: each window of
`least` words belongs to the least hash among its first `gap` word pairs, so equal windows belong to equal anchors.
Windows are pruned by their anchor's opening, as suffixes are, and the rest are compared one by one, by 64-bit
hashes of the window and of that opening; it sorts hashes, not suffixes, and does not compare bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship, shuffle_partitions, written
from loomkg.llm import _bytes as B
from loomkg.llm._run import arrow_map

#: Windows in a bucket of `passages`.
WINDOWS = 1 << 22
#: Bytes of suffixes in a bucket, and of those that a task gathers before it sends runs.
BUCKET = 64 << 20
GATHER = 48 << 20


def anchors(h: np.ndarray, first: np.ndarray, gap: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions among all words, hash of the `least` words from there) of the anchors that have so many words left."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h)
    if n < max(least, gap + 1):
        return none
    v = B.rolled(h, 2)
    m = len(v) - gap + 1
    if m < 1:
        return none
    low, reach = v, 1
    while reach < gap:
        step = min(reach, gap - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    # a window of pairs lies in one text if its last pair ends before the next text
    end = np.repeat(first[1:], np.diff(first))
    low = np.where(np.arange(m) + gap + 1 <= end[:m], low, np.uint64(0))
    # the greatest of the minima of all windows that hold a position
    pad = np.zeros(gap - 1, np.uint64)
    high, reach = np.concatenate([pad, low, pad]), 1
    while reach < gap:
        step = min(reach, gap - reach)
        high = np.maximum(high[: len(high) - step], high[step:])
        reach += step
    at = np.flatnonzero(high[: len(v)] == v)
    at = at[at + least <= end[at]]
    if not len(at):
        return none
    up, down = B._powers(n)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=p[1:])
    return at, B.mix((p[at + least] - p[at]) * down[at])


def _normal(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased words, each closed by a space, and where each starts and ends."""
    size = e - s
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(start[-1]), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[start[1:] - 1] = False
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[s] = 1
    inside[e] -= 1
    out[keep] = B.WORDS[buf[np.cumsum(inside[:-1], dtype=np.int8) > 0]]
    return out.tobytes(), start[:-1], start[1:] - 1


def common(a: bytes, b: bytes, lo: int = 0) -> int:
    """Length of the common prefix, known to be at least lo."""
    hi = min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    step = 16
    while True:
        if a[lo : lo + step] != b[lo : lo + step]:
            break
        lo += step
        step *= 2
    while step > 1:
        step //= 2
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += step
    return lo


def encode(run: list[tuple[bytes, int, int, int]]) -> bytes:
    """Front-coded run of sorted (suffix, number of its id, position, number of its source)."""
    shared, rest, last = np.empty(len(run), np.int32), [], b""
    for i, r in enumerate(run):
        k = common(last, r[0])
        shared[i] = k
        rest.append(r[0][k:])
        last = r[0]
    size = np.fromiter(map(len, rest), np.int32, len(rest))
    head = np.stack([shared, size, *(np.array([r[c] for r in run], np.int32) for c in (1, 2, 3))])
    return zlib.compress(np.int32(len(run)).tobytes() + head.tobytes() + b"".join(rest), 1)


def decode(blob: bytes) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(suffix, bytes shared with the predecessor, number of its id, position, number of its source), one at a time."""
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    shared, size, doc, pos, source = (x.tolist() for x in np.frombuffer(raw, np.int32, 5 * n, 4).reshape(5, n))
    at, last = 4 + 20 * n, b""
    for i in range(n):
        s = last[: shared[i]] + raw[at : at + size[i]]
        at += size[i]
        yield s, shared[i], doc[i], pos[i], source[i]
        last = s


class LoserTree:
    """k-way merge of sorted runs, aware of common prefixes.

    Every waiting head keeps the length of its common prefix with the last string given out. Of two heads
    the one that shares more is the lesser; if they share the same, bytes beyond that decide, and the
    loser keeps the length found, now its prefix in common with the winner.
    """

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        k = 1
        while k < len(runs):
            k *= 2
        self.k = k
        self.head: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
        self.known = [0] * k
        self.loser = [-1] * k
        self.compared = 0
        winner = list(range(k))
        while len(winner) > 1:
            half = len(winner) // 2
            up = []
            for i in range(half):
                w, lost = self._play(winner[2 * i], winner[2 * i + 1])
                self.loser[half + i] = lost
                up.append(w)
            winner = up
        self.top = winner[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.known[a], self.known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        s, t = x[0], y[0]
        k = common(s, t, p)
        self.compared += k - p
        if s[k : k + 1] <= t[k : k + 1]:
            self.known[b] = k
            return a, b
        self.known[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple]]:
        """(suffix, bytes shared with the one given out before, rest of its entry)."""
        while True:
            w = self.top
            x = self.head[w]
            if x is None:
                return
            yield x[0], self.known[w], x[2:]
            x = self.head[w] = next(self.runs[w], None)
            # front coding gives the prefix shared with the string just given out
            self.known[w] = x[1] if x is not None else 0
            i = (w + self.k) // 2
            while i:
                w, self.loser[i] = self._play(w, self.loser[i])
                i //= 2
            self.top = w


def merged(runs: list[tuple[bytes, list]], least: int) -> Iterator[tuple]:
    """(id, position, words, source) of the suffixes that match another id's in `least` words or more; runs: (blob, ids).

    An entry's longest match is with the nearest other id before it or behind it in the order. It waits for the
    latter with those of its own id only, so a passage of any number of copies needs no memory.
    """

    def tagged(blob: bytes, ids: list) -> Iterator[tuple]:
        for s, k, d, p, q in decode(blob):
            yield s, k, ids[d], p, ids[q]

    # [position, source, words in common with another id before, with the next entry] of the entries of one id
    waiting: list[list] = []
    doc, back = None, 0

    def close(ahead: int) -> Iterator[tuple]:
        for i in range(len(waiting) - 1, -1, -1):
            p, source, before, after = waiting[i]
            ahead = min(ahead, after)
            if max(before, ahead) >= least:
                yield doc, p, max(before, ahead), source
        waiting.clear()

    for s, k, (d, p, q) in LoserTree([tagged(*r) for r in runs]):
        # suffixes end with a space, so whole words in common are its spaces in common
        w = s.count(b" ", 0, k)
        if w < least:
            yield from close(0)
            doc, back = d, 0
        elif d == doc:
            back = min(back, w)
            waiting[-1][3] = w
        else:
            yield from close(w)
            doc, back = d, w
        # the last number is set when the next entry of the same id comes; until then nothing limits it
        waiting.append([p, q, back, 1 << 30])
    yield from close(0)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 35, gap: int = 16) -> DataFrame:
    """(id, start_word, n_words, source, copy): spans that repeat in another document, joined where they overlap.

    Words are runs of letters and digits in lower case (by Unicode's rules). Every passage of `least + gap - 1` words or more (50 by
    default) that two documents share is reported, from one of its first `gap` words to its end, and nothing
    shorter than `least` words. source: the least id among the documents of the span's matches; copy: whether
    that is another document. Texts that are null, empty or short have no rows; rows with a null id are left out;
    rows that repeat an id are one document, whose spans are those of any of its rows; very
    long texts are read whole; of equal anchors in a window all are taken, and equal suffixes are in the order of
    their runs, which changes no span; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    most = least + gap
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("k"), text.alias("t"))

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = B.lowered(b.column(1))
        s, e, first = B.spans(buf, offs, B.WORDS)
        at, th = anchors(B.hashes(buf, B.WORDS, s, e), first, gap, least)
        own = np.searchsorted(first, at, side="right") - 1
        return pa.record_batch([pa.array(th.view(np.int64)), b.column(0).take(pa.array(own)), pa.array((at - first[own]).astype(np.int32))], ["h", "k", "p"])

    found = arrow_map(rows, find, f"h bigint, k {kind}, p int", 1)
    # one exchange by hash: only hashes of two documents at least go on
    shared = found.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("h", F.col("a").alias("least_k"))
    shared = written(shared, name="shared")
    by_doc = found.join(shared.hint("shuffle_hash"), "h").groupBy("k")
    places = written(by_doc.agg(F.array_sort(F.collect_set(F.struct("p", F.col("least_k").alias("s")))).alias("ps")), name="places")
    # some 7 bytes a word
    total = places.agg(F.sum(F.size("ps"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total * most * 7 // BUCKET))
    chosen = rows.join(places.withColumnRenamed("k", "pk"), F.col("k") == F.col("pk")).select("k", "t", "ps")

    def runs(batches):  # noqa: ANN001, ANN202
        held: dict[int, list] = {}
        ids: list = []
        size = 0

        def send():  # noqa: ANN202
            for b, run in held.items():
                run.sort(key=lambda r: r[0])
                numbers = sorted({ids[r[1]] for r in run} | {r[3] for r in run})
                to = {k: i for i, k in enumerate(numbers)}
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([encode([(s, to[ids[d]], p, to[q]) for s, d, p, q in run])], pa.binary()), pa.array([numbers], pa.list_(id_type))], ["bucket", "run", "ids"])

        id_type = None
        for batch in batches:
            for piece in B.pieces(batch, 1, 1 << 22):
                id_type = piece.column(0).type
                buf, offs = B.lowered(piece.column(1))
                s, e, first = B.spans(buf, offs, B.WORDS)
                h = B.hashes(buf, B.WORDS, s, e)
                norm, a, z = _normal(buf, s, e)
                lists = piece.column(2)
                base = np.repeat(first[:-1], lists.value_lengths().to_numpy())
                inner = lists.flatten()
                at = base + np.asarray(inner.field(0))
                source = inner.field(1).to_pylist()
                own = np.searchsorted(first, at, side="right") - 1
                fine = (at + least <= first[own + 1]) & (own == np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy()))
                at, own = at[fine], own[fine]
                source = [q for q, x in zip(source, fine.tolist(), strict=True) if x]
                if not len(at):
                    continue
                up, down = B._powers(len(h))
                p = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * up[: len(h)], out=p[1:])
                bucket = (B.mix(B.mix((p[at + least] - p[at]) * down[at]) + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)
                stop = np.minimum(at + most, first[own + 1]) - 1
                n0 = len(ids)
                ids += piece.column(0).to_pylist()
                for b, x, y, d, pos, q in zip(bucket.tolist(), a[at].tolist(), (z[stop] + 1).tolist(), (own + n0).tolist(), (at - first[own]).tolist(), source, strict=True):
                    held.setdefault(b, []).append((norm[x:y], d, pos, q))
                    size += y - x
                if size > GATHER:
                    yield from send()
                    held, ids, size = {}, [], 0
        yield from send()

    sent = chosen.mapInArrow(runs, f"bucket int, run binary, ids array<{kind}>")

    def merge(batches):  # noqa: ANN001, ANN202
        by: dict[int, list] = {}
        id_type = None
        for batch in batches:
            id_type = batch.column(2).type.value_type
            for b, r, i in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                by.setdefault(b, []).append((r, i))
        for got in by.values():
            out: list[tuple] = []
            for row in merged(got, least):
                out.append(row)
                if len(out) >= 50_000:
                    yield _rows(out, id_type)
                    out = []
            if out:
                yield _rows(out, id_type)

    def _rows(out: list, id_type: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (id_type, pa.int32(), pa.int32(), id_type), strict=True)], ["k", "p", "w", "source"])

    hits = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(merge, f"k {kind}, p int, w int, source {kind}")
    return _joined(hits, id_col)


def _joined(hits: DataFrame, id_col: str) -> DataFrame:
    """Spans of the hits (k, p, w, source) of each document: those that overlap or touch become one."""
    from pyspark.sql import Window

    by = Window.partitionBy("k").orderBy("p", "w")
    ends = F.max(F.col("p") + F.col("w")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", (F.coalesce(ends, F.lit(-1)) < F.col("p")).cast("int")).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("k", "span").agg(F.min("p").alias("start_word"), (F.max(F.col("p") + F.col("w")) - F.min("p")).alias("n_words"), F.min("source").alias("source"))
    return spans.select(F.col("k").alias(id_col), "start_word", "n_words", "source", (F.col("source") != F.col("k")).alias("copy"))


def windows(h: np.ndarray, first: np.ndarray, gap: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all windows of `least` words that lie in one text, the position of the anchor of each)."""
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(h)) + least <= end)
    if not len(at):
        return at, at
    low = B.rolled(h, 2)
    place, reach = np.arange(len(low)), 1
    while reach < gap:
        step = min(reach, gap - reach)
        # of equal hashes the first
        behind = low[step:] < low[:-step]
        low, place = np.where(behind, low[step:], low[:-step]), np.where(behind, place[step:], place[:-step])
        reach += step
    return at, place[at]


def _window_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    up, down = B._powers(len(h))
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=p[1:])
    return B.mix((p[at + n] - p[at]) * down[at])


def _shared(h: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The least document of each window that occurs in two documents at least, else -1.

    Row i has the windows first[i] to first[i + 1], at q[i] and on; h: hash of the opening at its anchor p.
    """
    least = np.full(len(w), -1, np.int64)
    count = np.diff(first)
    # equal windows are as far before their anchor; so no more than a window a row is sorted at once
    for t in range(int((p - q).max()) + 1 if len(q) else 0):
        at = p - t - q
        row = np.flatnonzero((at >= 0) & (at < count))
        if not len(row):
            continue
        x = first[row] + at[row]
        by = np.lexsort((doc[row], h[row], w[x]))
        row, x = row[by], x[by]
        start = np.flatnonzero(np.r_[True, (w[x[1:]] != w[x[:-1]]) | (h[row[1:]] != h[row[:-1]])])
        size = np.diff(np.r_[start, len(x)])
        few, many = doc[row[start]], doc[row[start + size - 1]]
        least[x] = np.repeat(np.where(few != many, few, -1), size)
    return least


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 35, gap: int = 16) -> DataFrame:
    """(id, start_word, n_words, source, copy): all words of passages of `least` words that another document has too.

    Every window of `least` words at every position counts; nothing shorter does. Spans that overlap or touch are
    joined. `gap` changes no result. Words, source, copy and odd rows are as in `repeats`; of texts that repeat an id,
    too, each gives its own windows. `least` must be greater than `gap`. A task holds the windows of `WINDOWS` or of one opening.
    """
    if not 1 < gap < least:
        raise ValueError("gap must be between 2 and least - 1")
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    opening = least - gap + 1
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("k"), text.alias("t"))

    def words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = B.lowered(b.column(1))
        s, e, first = B.spans(buf, offs, B.WORDS)
        return B.hashes(buf, B.WORDS, s, e), first

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        h, first = words(b)
        at = np.unique(windows(h, first, gap, least)[1])
        own = np.searchsorted(first, at, side="right") - 1
        th = _window_hashes(h, at, opening)
        return pa.record_batch([pa.array(th.view(np.int64)), b.column(0).take(pa.array(own)), pa.array((at - first[own]).astype(np.int32))], ["h", "k", "p"])

    found = arrow_map(rows, find, f"h bigint, k {kind}, p int", 1)
    # one exchange by hash: only hashes of two documents at least go on
    two = written(found.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("h"), name="shared")
    by_doc = found.join(two.hint("shuffle_hash"), "h").groupBy("k")
    places = written(by_doc.agg(F.array_sort(F.collect_set("p")).alias("ps")), name="places")
    total = places.agg(F.sum(F.size("ps"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total * gap // WINDOWS))
    chosen = rows.join(places.withColumnRenamed("k", "pk"), F.col("k") == F.col("pk")).select("k", "t", "ps")

    def spread(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, first = words(b)
        at, anchor = windows(h, first, gap, least)
        lists = b.column(2)
        wanted = np.repeat(first[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
        wanted = wanted[wanted < np.repeat(first[1:], lists.value_lengths().to_numpy())]
        live = np.isin(anchor, wanted)
        at, anchor = at[live], anchor[live]
        if not len(at):
            return None
        # the windows of an anchor are neighbours
        start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        p, q = anchor[start], at[start]
        own = np.searchsorted(first, p, side="right") - 1
        ends = (np.r_[start, len(at)] * 8).astype(np.int32)
        w = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(_window_hashes(h, at, least))])
        columns = [pa.array(_window_hashes(h, p, opening).view(np.int64)), b.column(0).take(pa.array(own)), pa.array((p - first[own]).astype(np.int32)), pa.array((q - first[own]).astype(np.int32)), w]
        return pa.record_batch(columns, ["h", "k", "p", "q", "w"])

    sent = arrow_map(chosen, spread, f"h bigint, k {kind}, p int, q int, w binary", 1)

    def compare(batches):  # noqa: ANN001, ANN202
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        every = pa.Table.from_batches(got).combine_chunks()
        del got
        h, p, q = (every.column(c).to_numpy() for c in (0, 2, 3))
        names = every.column(1).combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        order = pc.sort_indices(names.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        doc = rank[names.indices.to_numpy()]
        size = pc.binary_length(every.column(4)).to_numpy() // 8
        first = np.r_[0, np.cumsum(size)]
        w = np.concatenate([np.frombuffer(c.buffers()[2], np.uint64)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] // 8 :][: int(pc.sum(pc.binary_length(c)).as_py()) // 8] for c in every.column(4).chunks])
        source = _shared(h, doc, p, q, first, w)
        row = np.repeat(np.arange(len(p)), size)
        at = np.flatnonzero(source >= 0)
        if not len(at):
            return
        start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
        length = np.diff(np.r_[start, len(at)])
        src = np.minimum.reduceat(source[at], start)
        own = row[at[start]]
        begin = q[own] + (at[start] - first[own])
        values = names.dictionary.take(order)
        for c in range(0, len(start), 50_000):
            o = slice(c, c + 50_000)
            yield pa.record_batch([values.take(pa.array(doc[own[o]])), pa.array(begin[o].astype(np.int32)), pa.array((length[o] + least - 1).astype(np.int32)), values.take(pa.array(src[o]))], ["k", "p", "w", "source"])

    hits = sent.repartition(buckets, "h").mapInArrow(compare, f"k {kind}, p int, w int, source {kind}")
    return _joined(hits, id_col)
