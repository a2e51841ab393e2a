"""Vectorised text primitives over Arrow string buffers: no Python object is made per word.

Words are runs of "word" bytes of a 256-entry table. A word's hash is a polynomial over its bytes
modulo 2**64 taken from prefix sums, so any span costs two look-ups, then a mixing step. Work is
split into chunks of bounded size, so a very long document needs no more memory than its bytes
and a few arrays of one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 21
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(lower: bool, word: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if word:
        ok = np.zeros(256, bool)
        ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    else:
        ok = np.ones(256, bool)
        ok[[9, 10, 12, 13, 32]] = False
    t[~ok] = 0
    return t


#: Letters, digits and all non-ASCII bytes; the rest separates. Lower-cases ASCII only: `lowered` does the rest.
WORDS = _table(True, True)
#: All that is not ASCII white space, as it is.
TOKENS = _table(False, False)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    if data is None or not len(data):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]]
    return b, o - o[0]


def lowered(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """`flat` of the texts in lower case by Unicode's rules, with a closing sigma as any other.

    Lower-casing turns word bytes into word bytes, so word i of the result is word i of `flat`, though
    not at the same bytes.
    """
    buf, offs = flat(column)
    if not (buf >= 128).any():
        return buf, offs
    texts = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(buf)])
    try:
        low = pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        # bytes that are no UTF-8 stay
        raw = texts.cast(pa.large_binary()).to_pylist()
        low = pa.array([x.decode("utf-8", "surrogateescape").replace("\u0130", "i").lower().encode("utf-8", "surrogateescape") for x in raw], pa.large_binary()).view(pa.large_string())
    buf, offs = flat(low)
    sigma = np.flatnonzero((buf[:-1] == 0xCF) & (buf[1:] == 0x82)) + 1
    if len(sigma):
        buf = buf.copy()
        buf[sigma] = 0x83
    return buf, offs


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text with a closing entry) of the words; none crosses texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = table[buf] != 0
    edge = np.empty(n, bool)
    edge[0] = w[0]
    np.logical_and(w[1:], ~w[:-1], out=edge[1:])
    inner = offs[1:-1]
    inner = inner[inner < n]
    edge[inner] = w[inner]
    starts = np.flatnonzero(edge)
    last = np.empty(n, bool)
    last[-1] = w[-1]
    np.logical_and(w[:-1], ~w[1:], out=last[:-1])
    inner = inner[inner > 0] - 1
    last[inner] = w[inner]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    m = max(CHUNK, 1 << int(max(n, 1) - 1).bit_length()) + 1
    if m not in _POW:
        _POW.clear()
        up = np.full(m, BASE, np.uint64)
        down = np.full(m, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POW[m] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW[m]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(buf: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of the mapped bytes; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        hi = int(ends[i:j].max())
        up, down = _powers(hi - lo)
        p = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((table[buf[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=p[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values by text, in double."""
    c = np.zeros(len(values) + 1)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the last k - 1 entries are missing."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * BASE + h[i : i + n]
    return mix(acc)


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 24):
    """The batch in slices whose texts have about `most` bytes at most; a longer text is alone."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    i, n = 0, len(sizes)
    while i < n:
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
