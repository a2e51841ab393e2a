"""Words hidden by substituted, starred, stretched, separated or spaced letters, found on Arrow buffers.

A part is a run of letters, digits and the symbols that stand for letters. Candidates are the parts that were
altered (a digit, symbol or star among letters, a letter three times in a row, an invisible character) and the
windows of parts joined by single separators or, between single letters, by spaces. Each is reduced to a
skeleton: substitutions undone, repeated letters once, i and l alike. Listed words are compared by skeleton
too, so a plain word never counts for having a listed word's skeleton: only candidates are reduced.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from loomkg.llm import _bytes as B

#: Parts joined at most, and bytes of a candidate at most; no listed word is longer.
JOINED = 14
LONGEST = 32
OPENING = 8
SHORTEST = 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"@$!*|")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PART = (_LETTER | _DIGIT | _SYMBOL).astype(np.uint8)
_SKELETON = np.arange(256, dtype=np.uint8)
_SKELETON[65:91] += 32
for _a, _b in zip(b"0134578@$!|l", b"oieastbasiii", strict=True):
    _SKELETON[_a] = _b
_SAME = np.arange(256, dtype=np.uint8)


def visible(texts: pa.Array) -> pa.Array:
    """The texts without zero-width characters and soft hyphens."""
    buf, offs = B.flat(texts)
    n = len(buf)
    gone = np.zeros(n + 2, bool)
    at = np.flatnonzero(buf == 0xE2)
    at = at[at + 2 < n]
    zero = at[((buf[at + 1] == 0x80) & (buf[at + 2] >= 0x8B) & (buf[at + 2] <= 0x8F)) | ((buf[at + 1] == 0x81) & (buf[at + 2] == 0xA0))]
    bom = np.flatnonzero(buf == 0xEF)
    bom = bom[bom + 2 < n]
    zero = np.r_[zero, bom[(buf[bom + 1] == 0xBB) & (buf[bom + 2] == 0xBF)]]
    soft = np.flatnonzero(buf == 0xC2)
    soft = soft[soft + 1 < n]
    soft = soft[buf[soft + 1] == 0xAD]
    if not len(zero) and not len(soft):
        return texts
    for d in range(3):
        gone[zero + d] = True
    for d in range(2):
        gone[soft + d] = True
    keep = ~gone[:n]
    left = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(left[offs])), pa.py_buffer(np.ascontiguousarray(buf[keep]))])


def counted(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=c[1:])
    return (c[ends] - c[starts]).astype(np.int64)


def openings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each span as one big-endian number; shorter spans are closed by zeros."""
    out = np.zeros(len(starts), np.uint64)
    if not len(buf):
        return out
    for i in range(OPENING):
        at = starts + i
        out = (out << np.uint64(8)) | np.where(at < ends, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint64)
    return out


def opening_keys(packed: np.ndarray, size: np.ndarray):
    """(which spans, keys) for every length of opening and for whole words, which are closed by a byte 1."""
    for length in range(SHORTEST, OPENING + 1):
        at = np.flatnonzero(size >= length)
        yield at, packed[at] & ~np.uint64((1 << (8 * (OPENING - length))) - 1)
    at = np.flatnonzero(size < OPENING)
    yield at, packed[at] | (np.uint64(1) << (8 * (OPENING - 1 - size[at])).astype(np.uint64))


def _reduced(word: bytes) -> bytes:
    b = _SKELETON[np.frombuffer(word, np.uint8)]
    return b[np.r_[True, b[1:] != b[:-1]]].tobytes() if len(b) else b""


def _starred(word: str) -> set[bytes]:
    """The word with one to three letters under stars, three letters or the two at the ends being left."""
    out = set()
    for i in range(len(word)):
        for j in range(i + 1, min(i + 4, len(word) + 1)):
            if len(word) - (j - i) >= 3 or (0 < i and j < len(word)):
                out.add(_reduced((word[:i] + "*" + word[j:]).encode()))
    return out


def folded(words: tuple[str, ...]) -> tuple[str, ...]:
    """The words in lower case, and the same without accents."""
    low = [w.lower() for w in words]
    bare = ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in low]
    return tuple(sorted({*low, *bare}))


def _hashes_of(words: set[bytes]) -> np.ndarray:
    buf, offs = B.flat(pa.array(sorted(words), pa.large_binary()).view(pa.large_string()))
    return np.unique(B.hashes(buf, _SAME, offs[:-1], offs[1:]))


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


class Skeletons:
    """Skeletons of listed words and of weighted openings, plain and under stars."""

    def __init__(self, words: tuple[str, ...], keys: np.ndarray, weights: np.ndarray) -> None:
        self.words = _hashes_of({_reduced(w.encode()) for w in words} | {x for w in words for x in _starred(w)})
        best: dict[int, float] = {}
        for key, weight in zip(keys.tolist(), weights.tolist(), strict=True):
            raw = int(key).to_bytes(OPENING, "big").rstrip(b"\0")
            whole = raw.endswith(b"\1")
            word = raw.rstrip(b"\1")
            forms = [word] + [word[:i] + b"*" + word[i + 1 :] for i in range(1, len(word)) if word[i] < 128 and len(word) > 4 - whole]
            for form in forms:
                small = _reduced(form)
                if len(small) > 3:
                    k = int.from_bytes((small + b"\1" if whole else small).ljust(OPENING, b"\0")[:OPENING], "big")
                    best[k] = max(weight, best.get(k, weight))
        order = sorted(best)
        self.keys = np.array(order, np.uint64)
        self.weights = np.array([best[k] for k in order])


def weigh(packed: np.ndarray, size: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Greatest weight among the openings of each span; 0 where none is listed."""
    out = np.zeros(len(packed))
    if not len(keys):
        return out
    for at, k in opening_keys(packed, size):
        i = np.searchsorted(keys, k)
        i[i == len(keys)] = 0
        hit = keys[i] == k
        out[at[hit]] = np.maximum(out[at[hit]], weights[i[hit]])
    return out


def candidates(low: np.ndarray, offs: np.ndarray):
    """(starts, ends of parts, first part, number of parts, trims) of the candidates in lower-cased bytes."""
    s, e, first = B.spans(low, offs, _PART)
    empty = np.zeros(0, np.int64)
    if not len(s):
        return s, e, [(empty, 0, empty, empty)]
    letter = np.flatnonzero(_LETTER[low])
    solid = np.flatnonzero((_LETTER | _DIGIT)[low])
    n_letters = counted(_LETTER[low], s, e)
    same = np.zeros(len(low), bool)
    same[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    same &= _LETTER[low]
    stretched = counted(same, s, np.maximum(e, s)) > 0
    flagged = (n_letters > 0) & (e - s >= 3) & (e - s <= 4 * LONGEST) & ((n_letters < e - s) | stretched)
    i = np.flatnonzero(flagged)
    out = [(i, 1, s[i], e[i])]
    # the same without symbols, and without digits too, at either end
    for inner in (solid, letter):
        lo = inner[np.minimum(np.searchsorted(inner, s[i]), len(inner) - 1)]
        hi = inner[np.maximum(np.searchsorted(inner, e[i]) - 1, 0)] + 1
        other = (hi > lo) & ((lo != s[i]) | (hi != e[i]))
        out.append((i[other], 1, lo[other], hi[other]))
    if len(s) > 1:
        own = B.owners(first)
        gap = s[1:] - e[:-1]
        near = (own[1:] == own[:-1]) & (gap >= 0) & (gap <= 2)
        blank = counted(_SPACE[low], e[:-1], s[1:]) > 0
        size = e - s
        single = (size == 1) | ((size == 2) & (low[s] >= 0xC3))
        link = near & (~blank | (single[1:] & single[:-1])) & (gap > 0)
        # links ahead of each part without a break
        stop = np.flatnonzero(np.r_[~link, True])
        ahead = stop[np.searchsorted(stop, np.arange(len(s)))] - np.arange(len(s))
        letters_before = np.r_[0, np.cumsum(n_letters)]
        bytes_before = np.r_[0, np.cumsum(size)]
        for w in range(2, JOINED + 1):
            i = np.flatnonzero(ahead >= w - 1)
            if not len(i):
                break
            some = (letters_before[i + w] - letters_before[i] >= 2) & (bytes_before[i + w] - bytes_before[i] <= LONGEST) & (bytes_before[i + w] - bytes_before[i] >= 3)
            i = i[some]
            hi = solid[np.maximum(np.searchsorted(solid, e[i + w - 1]) - 1, 0)] + 1
            fine = hi > s[i + w - 1]
            out.append((i[fine], w, s[i[fine]], hi[fine]))
    return s, e, out


def hidden(low: np.ndarray, offs: np.ndarray, known: Skeletons) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes where it starts and ends, whether a listed word, weight of its opening) of the candidates that hit."""
    s, e, groups = candidates(low, offs)
    found = []
    for i, w, lo, hi in groups:
        if not len(i):
            continue
        # bytes of all parts of all candidates, one candidate after the other
        part = (i[:, None] + np.arange(w)).ravel()
        a, b = s[part].copy(), e[part].copy()
        a[::w], b[w - 1 :: w] = lo, hi
        size = np.maximum(b - a, 0)
        total = np.cumsum(size)
        at = np.repeat(a - (total - size), size) + np.arange(int(total[-1]))
        raw = _SKELETON[low[at]]
        of = np.repeat(np.repeat(np.arange(len(i)), w), size)
        keep = np.r_[True, (raw[1:] != raw[:-1]) | (of[1:] != of[:-1])] if len(raw) else np.zeros(0, bool)
        raw, of = raw[keep], of[keep]
        edge = np.searchsorted(of, np.arange(len(i) + 1))
        x, y = edge[:-1], edge[1:]
        listed = among(B.hashes(raw, _SAME, x, y), known.words) & (y - x >= 3)
        weight = weigh(openings(raw, x, y), y - x, known.keys, known.weights)
        hit = listed | (weight > 0)
        found.append((lo[hit], hi[hit], listed[hit], weight[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
