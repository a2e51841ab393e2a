"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words in lower case (by Unicode's rules); the automaton holds all substrings of all items. Training
tokens stream through it and every position gets its longest matching length. Only stretches whose
`gram`-word windows all occur in an item are streamed: outside them no match of that many words exists,
so lengths of `gram` and more are exact. All stretches of a batch advance in step, one word each.

A match is removed if it has `max_words` words or covers `coverage` of an item that holds it. A document
of whose words more than `document_share` are removed goes as a whole. Items below `gram` words are too
common as passages; they match where they stand alone as a line or text.

The automaton is sent to the executors in parts of at most `part_words` item words (some 50 bytes a word). A
worker holds at most `HELD` parts: where the items need more, the table is scanned once for each group of
parts, and what was found so far is written to the shared folder between the scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship, written
from loomkg.llm import _bytes as B

#: Bytes of text that are scanned at once.
PIECE = 1 << 22
#: Parts of the automaton that a worker holds at once.
HELD = 8


@dataclass
class Automaton:
    """Flattened suffix automaton: transitions sorted by state * words + word."""

    vocabulary: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    shortest: np.ndarray
    grams: np.ndarray
    gram: int
    short: dict[int, np.ndarray]

    @staticmethod
    def of(items: list[np.ndarray], gram: int) -> Automaton:
        """items: word hashes of each item; those of fewer than `gram` words are kept by number of words only."""
        short = {n: np.unique([B.rolled(x, n)[0] for x in items if len(x) == n]) for n in {len(x) for x in items} if 0 < n < gram}
        items = [x for x in items if len(x) >= gram]
        vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        nxt: list[dict[int, int]] = [{}]
        link, length, shortest = [-1], [0], [1 << 30]
        for item in items:
            last = 0
            ends: list[int] = []
            for w in np.searchsorted(vocabulary, item).tolist():
                if w in nxt[last]:
                    q = nxt[last][w]
                    if length[q] == length[last] + 1:
                        cur = q
                    else:
                        cur = Automaton._clone(nxt, link, length, shortest, last, w, q)
                        link[q] = cur
                else:
                    cur = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    shortest.append(1 << 30)
                    p = last
                    while p != -1 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                    if p != -1:
                        q = nxt[p][w]
                        if length[p] + 1 == length[q]:
                            link[cur] = q
                        else:
                            clone = Automaton._clone(nxt, link, length, shortest, p, w, q)
                            link[q] = link[cur] = clone
                last = cur
                ends.append(cur)
            # every state on the suffix path of a prefix occurs in this item
            for cur in ends:
                while cur > 0 and shortest[cur] > len(item):
                    shortest[cur] = len(item)
                    cur = link[cur]
        v = max(len(vocabulary), 1)
        flat = sorted((s * v + w, t) for s, d in enumerate(nxt) for w, t in d.items())
        keys, targets = (np.array([x[i] for x in flat], kind) for i, kind in ((0, np.int64), (1, np.int32)))
        grams = np.unique(np.concatenate([B.rolled(x, gram) for x in items])) if items else np.zeros(0, np.uint64)
        return Automaton(vocabulary, keys, targets, np.array(link, np.int32), np.array(length, np.int32), np.array(shortest, np.int32), grams, gram, short)

    @staticmethod
    def _clone(nxt: list, link: list, length: list, shortest: list, p: int, w: int, q: int) -> int:
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        shortest.append(shortest[q])
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def stream(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each step: (stretches, position, matching length, least item length) of stretches [start, end) of word ids."""
        v = max(len(self.vocabulary), 1)
        order = np.argsort(starts - ends, kind="stable")
        state, have = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        longest = ends[order] - starts[order] if len(order) else np.zeros(0, np.int64)
        for step in range(int(longest[0]) if len(order) else 0):
            live = order[: int(np.searchsorted(-longest, -step, side="left"))]
            w = words[starts[live] + step]
            todo = np.arange(len(live))
            while len(todo):
                r = live[todo]
                k = state[r] * v + w[todo]
                at = np.searchsorted(self.keys, k)
                at[at == len(self.keys)] = 0
                known = (w[todo] >= 0) & (self.keys[at] == k)
                hit = r[known]
                state[hit], have[hit] = self.targets[at[known]], have[hit] + 1
                miss = r[~known]
                root = state[miss] == 0
                have[miss[root]] = 0
                back = miss[~root]
                state[back] = self.link[state[back]]
                have[back] = self.length[state[back]]
                todo = todo[~known][~root]
            # the state of the match itself: its links hold shorter suffixes only
            yield live, starts[live] + step, have[live], self.shortest[state[live]]

    def spans(self, h: np.ndarray, first: np.ndarray, max_words: int, coverage: float) -> tuple[np.ndarray, np.ndarray]:
        """(marks of words to remove, longest match of gram words and more ending at each word)."""
        mark, best = np.zeros(len(h) + 1, np.int64), np.zeros(len(h), np.int64)
        if len(h) < self.gram or not len(self.grams):
            return mark[:-1] > 0, best
        g = B.rolled(h, self.gram)
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        ok = np.flatnonzero(self.grams[at] == g)
        own = np.searchsorted(first, ok, side="right")
        inside = ok + self.gram <= first[own]
        ok = ok[inside]
        if not len(ok):
            return mark[:-1] > 0, best
        new = np.flatnonzero(np.r_[True, (np.diff(ok) > 1) | (own[inside][1:] != own[inside][:-1])])
        starts, ends = ok[new], ok[np.r_[new[1:] - 1, len(ok) - 1]] + self.gram
        words = np.full(len(h), -1, np.int64)
        inner = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]))
        at = np.searchsorted(self.vocabulary, h[inner])
        at[at == len(self.vocabulary)] = 0
        words[inner] = np.where(self.vocabulary[at] == h[inner], at, -1)
        for _, place, have, least in self.stream(words, starts, ends):
            best[place] = np.maximum(best[place], np.where(have >= self.gram, have, 0))
            cut = (have >= max_words) | ((have >= self.gram) & (have >= coverage * least))
            np.add.at(mark, place[cut] - have[cut] + 1, 1)
            np.add.at(mark, place[cut] + 1, -1)
        return np.cumsum(mark[:-1]) > 0, best


def _lines(parts: list[Automaton], buf: np.ndarray, offs: np.ndarray, s: np.ndarray, h: np.ndarray, marks: np.ndarray, best: np.ndarray) -> None:
    """Mark the lines whose words are those of a short item."""
    sizes = sorted({n for p in parts for n in p.short})
    if not sizes:
        return
    start = np.union1d(offs[:-1], np.flatnonzero(buf == 10) + 1)
    first = np.searchsorted(s, start)
    words = np.diff(np.r_[first, len(s)])
    for n in sizes:
        at = first[words == n]
        if not len(at):
            continue
        acc = np.zeros(len(at), np.uint64)
        for i in range(n):
            acc = acc * B.BASE + h[at + i]
        acc = B.mix(acc)
        for p in parts:
            known = p.short.get(n)
            if known is not None:
                i = np.searchsorted(known, acc)
                i[i == len(known)] = 0
                hit = at[known[i] == acc]
                marks[(hit[:, None] + np.arange(n)).ravel()] = True
                best[hit + n - 1] = np.maximum(best[hit + n - 1], n)


def automata(items: DataFrame, text_col: str = "text", gram: int = 8, part_words: int = 2_000_000) -> list[Automaton]:
    """Automata of the non-null items in parts of at most `part_words` words (an item is not split)."""
    out: list[Automaton] = []
    part: list[np.ndarray] = []
    size = 0
    for row in items.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string")).distinct().toLocalIterator():
        buf, offs = B.lowered(pa.array([row[0]], pa.large_string()))
        s, e, _ = B.spans(buf, offs, B.WORDS)
        h = B.hashes(buf, B.WORDS, s, e)
        if part and size + len(h) > part_words:
            out.append(Automaton.of(part, gram))
            part, size = [], 0
        part.append(h)
        size += len(h)
    return [*out, Automaton.of(part, gram)] if part else out


def find(texts: pa.Array, parts: list[Automaton], max_words: int, coverage: float, before: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, ends, first of each text, bytes, marks of words to remove, longest match ending at each word).

    before: what earlier parts found in each text, as (word, longest match, mark) triples in one list of numbers.
    """
    buf, offs = B.flat(texts)
    s, e, first = B.spans(buf, offs, B.WORDS)
    marks, best = np.zeros(len(s), bool), np.zeros(len(s), np.int64)
    if not len(s):
        return s, e, first, buf, marks, best
    low, low_offs = B.lowered(texts)
    h = B.hashes(low, B.WORDS, *B.spans(low, low_offs, B.WORDS)[:2])
    for part in parts:
        m, b = part.spans(h, first, max_words, coverage)
        marks |= m
        best = np.maximum(best, b)
    _lines(parts, buf, offs, s, h, marks, best)
    if before is not None:
        n = before.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 3
        word, longest, mark = np.asarray(before.flatten(), np.int64).reshape(-1, 3).T
        at = np.repeat(first[:-1], n) + word
        marks[at] |= mark > 0
        best[at] = np.maximum(best[at], longest)
    return s, e, first, buf, marks, best


def found(texts: pa.Array, parts: list[Automaton], max_words: int, coverage: float, before: pa.Array | None) -> pa.Array:
    """What to pass on as `before`."""
    _, _, first, _, marks, best = find(texts, parts, max_words, coverage, before)
    at = np.flatnonzero(marks | (best > 0))
    own = np.searchsorted(first, at, side="right") - 1
    flat = np.stack([at - first[own], best[at], marks[at]], axis=1).ravel().astype(np.int64)
    offsets = 3 * np.r_[0, np.cumsum(np.bincount(own, minlength=len(texts)))]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def scan(texts: pa.Array, parts: list[Automaton], max_words: int, coverage: float, document_share: float, before: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(clean texts, longest match, words removed, whether the whole document goes) of each text; nulls stay null."""
    n = len(texts)
    longest, removed, whole = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    s, e, first, buf, marks, best = find(texts, parts, max_words, coverage, before)
    at = np.flatnonzero(best)
    if not len(at):
        return texts, longest, removed, whole
    offs = B.flat(texts)[1]
    own = np.searchsorted(first, at, side="right") - 1
    np.maximum.at(longest, own, best[at])
    gone = np.flatnonzero(marks)
    removed = np.bincount(np.searchsorted(first, gone, side="right") - 1, minlength=n)
    whole = removed > document_share * np.maximum(np.diff(first), 1)
    touched = np.flatnonzero(removed)
    clean: dict[int, str] = {}
    for d in touched.tolist():
        a, b = int(first[d]), int(first[d + 1])
        m = marks[a:b].astype(np.int8)
        edges = np.diff(np.r_[0, m, 0])
        keep, pos = [], int(offs[d])
        for i, j in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            keep.append(bytes(buf[pos : s[a + i]]))
            pos = int(e[a + j - 1])
        keep.append(bytes(buf[pos : offs[d + 1]]))
        clean[d] = b"".join(keep).decode("utf-8", "replace")
    if not clean:
        return texts, longest, removed, whole
    mask = np.zeros(n, bool)
    mask[touched] = True
    column = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
    return pc.replace_with_mask(column, pa.array(mask), pa.array([clean[d] for d in touched.tolist()], pa.string())), longest, removed, whole


def _finder(group: list, max_words: int, coverage: float):  # noqa: ANN202
    @F.arrow_udf("array<bigint>")
    def more(texts: pa.Array, before: pa.Array) -> pa.Array:
        loaded = [p.value for p in group]
        got = [found(b.column(0), loaded, max_words, coverage, b.column(1)) for b in B.pieces(pa.record_batch([texts, before], ["t", "f"]), 0, PIECE)]
        return pa.concat_arrays(got or [pa.array([], pa.list_(pa.int64()))])

    return more


def _groups(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, gram: int, max_words: int, coverage: float, part_words: int) -> tuple[DataFrame, list, bool]:
    """(table, broadcast parts of the last group, whether `__found` holds what the groups before it found)."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    every = [sc.broadcast(a) for a in automata(items, item_col, gram, part_words)]
    groups = [every[i : i + HELD] for i in range(0, len(every), HELD)] or [[]]
    for i, group in enumerate(groups[:-1]):
        before = F.col("__found") if i else F.lit(None).cast("array<bigint>")
        more = _finder(group, max_words, coverage)
        docs = written(docs.withColumn("__found", more(F.col(f"`{text_col}`").cast("string"), before)), name="leaks")
    return docs, groups[-1], len(groups) > 1


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "text", gram: int = 8, max_words: int = 13, coverage: float = 0.8, document_share: float = 0.5, part_words: int = 2_000_000) -> DataFrame:
    """(id, text, leaked, longest_match, removed_words, drop) for every row, in one narrow pass.

    leaked: something was removed; drop: more than `document_share` of the words, so the document should go.
    A null text stays null and an empty one empty; null ids pass; repeated rows are each cleaned; items that are
    null or without words match nothing, those shorter than `gram` words only a line or text of their words and
    no others, and repeated items count once; a match of exactly `max_words` or `coverage` is removed, and a
    document that loses exactly `document_share` stays; very long texts are read whole; an empty table gives
    no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    own, parts, again = _groups(own, items, "t", item_col, gram, max_words, coverage, part_words)

    def run(batches):  # noqa: ANN001, ANN202
        loaded = [p.value for p in parts]
        for batch in batches:
            for b in B.pieces(batch, 1, PIECE):
                text, longest, removed, whole = scan(b.column(1), loaded, max_words, coverage, document_share, b.column(2) if again else None)
                yield pa.record_batch([b.column(0), text, pa.array(removed > 0), pa.array(longest), pa.array(removed), pa.array(whole)], ["k", "t", "leaked", "longest_match", "removed_words", "drop"])

    out = own.mapInArrow(run, f"k {kind}, t string, leaked boolean, longest_match bigint, removed_words bigint, drop boolean")
    return out.withColumnsRenamed({"k": id_col, "t": text_col})


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "text", length_col: str | None = None, gram: int = 8, max_words: int = 13, coverage: float = 0.8, document_share: float = 0.5, part_words: int = 2_000_000) -> DataFrame:
    """The documents with matches removed and without those that are mostly benchmark, with all their columns.

    Nulls, empty and very long texts, ties, short and repeated items as in `decontaminate`; rows that repeat are
    each cleaned; `length_col`, if the table has it, follows the text that changes; other columns pass
    untouched, whatever their names; an empty table stays empty.
    """
    columns, schema = docs.columns, docs.schema
    docs, parts, again = _groups(docs, items, text_col, item_col, gram, max_words, coverage, part_words)

    @F.arrow_udf("t string, n bigint, whole boolean")
    def cleaned(texts: pa.Array, before: pa.Array) -> pa.Array:
        loaded = [p.value for p in parts]
        out = [pa.array([], pa.struct([("t", pa.string()), ("n", pa.int64()), ("whole", pa.bool_())]))]
        for b in B.pieces(pa.record_batch([texts, before], ["t", "f"]), 0, PIECE):
            text, _, removed, whole = scan(b.column(0), loaded, max_words, coverage, document_share, b.column(1) if again else None)
            out.append(pa.StructArray.from_arrays([text.cast(pa.string()), pa.array(removed.astype(np.int64)), pa.array(whole)], ["t", "n", "whole"]))
        return pa.concat_arrays(out)

    # not deterministic: else the filter would be pushed down and the scan run twice
    before = F.col("__found") if again else F.lit(None).cast("array<bigint>")
    rows = docs.withColumn("__c", cleaned.asNondeterministic()(F.col(f"`{text_col}`").cast("string"), before))
    cols = {c: F.col(f"`{c}`") for c in columns} | {text_col: F.col("__c.t")}
    if length_col in columns:
        cols[length_col] = F.when(F.col("__c.n") > 0, F.length("__c.t")).otherwise(F.col(f"`{length_col}`")).cast(schema[length_col].dataType)
    return rows.where(~F.col("__c.whole")).select(*[v.alias(c) for c, v in cols.items()])
