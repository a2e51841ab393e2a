"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds turn the score
into P(grade >= g) = sigmoid(score - threshold_g). Expected grade and tail probability select documents.
Features: lower-cased words, pairs of words and runs of symbols, hashed; the score is the mean weight of
a text's features. Training uses at most `max_train` rated documents (by hash of the id).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.llm import _bytes as B
from loomkg.llm._run import arrow_map, bounded

BITS = 18
SCALE = 20.0

_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature index) of every feature, by text."""
    buf, offs = B.flat(texts)
    top = np.uint64(64 - BITS)
    owns, idx = [], []
    s, e, first = B.spans(buf, offs, B.WORDS)
    if len(s):
        h = B.hashes(buf, B.WORDS, s, e)
        own = B.owners(first)
        owns.append(own)
        idx.append(h >> top)
        pair = own[1:] == own[:-1]
        owns.append(own[1:][pair])
        idx.append(B.rolled(h, 2)[pair] >> top)
    s, e, first = B.spans(buf, offs, _SYMBOLS)
    if len(s):
        owns.append(B.owners(first))
        idx.append(B.mix(B.hashes(buf, _SYMBOLS, s, e) + np.uint64(77)) >> top)
    if not owns:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owns), np.concatenate(idx).astype(np.int64)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own, idx = hashed(texts)
        n = len(texts)
        count = np.bincount(own, minlength=n)
        return SCALE * np.bincount(own, self.weights[idx], n) / np.maximum(count, 1), count

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(docs: np.ndarray, idx: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 150, rate: float = 0.03, l2: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows; thresholds are a first one plus positive gaps, so stay ordered.

    Only weights of features that occur are moved; the others stay 0, where their penalty holds them.

    docs, idx, val: the sparse features (val is the share of the text's features); grade: 0..grades - 1 of each text.
    """
    n, k = len(grade), grades - 1
    theta = np.zeros(k)
    if n:
        share = np.clip([(grade >= g + 1).mean() for g in range(k)], 1e-3, 1 - 1e-3)
        theta = np.maximum.accumulate(np.log((1 - share) / share)) + 1e-3 * np.arange(k)
    seen, idx = np.unique(idx, return_inverse=True)
    size = len(seen)
    w = np.zeros(size)
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    par = np.concatenate([w, theta[:1], gap])
    m, v = np.zeros_like(par), np.zeros_like(par)
    val = val * SCALE
    for t in range(1, rounds + 1 if n and k else 1):
        w, first, gap = par[:size], par[size : size + 1], par[size + 1 :]
        theta = np.cumsum(np.r_[first, np.exp(gap)])
        z = np.bincount(docs, w[idx] * val, n)
        edge = np.concatenate([np.full((n, 1), -40.0), np.clip(theta[None, :] - z[:, None], -39, 39), np.full((n, 1), 40.0)], axis=1)
        cdf = 1 / (1 + np.exp(-edge))
        rows = np.arange(n)
        hi, lo = cdf[rows, grade + 1], cdf[rows, grade]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = (d_hi - d_lo) / n
        d_theta = np.array([-(d_hi[grade == j].sum() - d_lo[grade == j + 1].sum()) / n for j in range(k)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(idx, dz[docs] * val, size) + l2 * w, tail[:1], tail[1:] * np.exp(gap)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[seen] = par[:size]
    return OrdinalModel(weights, np.cumsum(np.r_[par[size : size + 1], np.exp(par[size + 1 :])]) if k else np.zeros(0))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "rating", grades: int = 3, max_train: int = 8000) -> OrdinalModel:
    """Fit on at most `max_train` documents with a rating 0..grades - 1; others and nulls are left out."""
    some = bounded(ratings.where(F.col(rating_col).between(0, grades - 1)).select(F.col(id_col).alias("k"), F.col(rating_col).cast("int").alias("y")), "k", max_train)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(some), "k")

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        own, idx = hashed(b.column(1))
        key, count = np.unique((own << BITS) | idx, return_counts=True)
        cut = np.searchsorted(key >> BITS, np.arange(n + 1)).astype(np.int32)
        total = np.bincount(own, minlength=n)
        share = (count / np.maximum(total, 1)[key >> BITS]).astype(np.float32)
        offs = pa.array(cut)
        return pa.record_batch([b.column(0), b.column(2), pa.ListArray.from_arrays(offs, pa.array((key & ((1 << BITS) - 1)).astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(share))], ["k", "y", "i", "v"])

    kind = rows.schema["k"].dataType.simpleString()
    got = arrow_map(rows.select("k", "t", "y"), of, f"k {kind}, y int, i array<int>, v array<float>", 1).drop("k").toArrow()
    size = got.column("i").combine_chunks().value_lengths().to_numpy() if got.num_rows else np.zeros(0, np.int64)
    flat = [np.asarray(got.column(c).combine_chunks().flatten()) if got.num_rows else np.zeros(0) for c in ("i", "v")]
    return fit(np.repeat(np.arange(len(size)), size), flat[0].astype(np.int64), flat[1].astype(float), got.column("y").to_numpy().astype(np.int64), grades)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", tail: int = 1, least: float = 0.5) -> DataFrame:
    """(id, expected_grade, tail_probability, keep) for every row, in one narrow pass; keep: P(grade >= tail) >= least.

    A null or empty text has score 0, so the thresholds alone decide; a null id stays null; repeated rows are each
    scored; a tie with `least` is kept; very long texts are read whole; other columns are not read, whatever their names; an empty table gives no rows.
    """
    wide = docs.sparkSession.sparkContext.broadcast(model)

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        s, _ = wide.value.scores(b.column(1))
        p = wide.value.tails(s)
        at = p[:, tail - 1] if 0 < tail <= p.shape[1] else np.ones(len(p))
        return pa.record_batch([b.column(0), pa.array(p.sum(1)), pa.array(at), pa.array(at >= least)], ["k", "e", "p", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")), of, f"k {kind}, e double, p double, keep boolean", 1)
    return out.withColumnsRenamed({"k": id_col, "e": "expected_grade", "p": "tail_probability"})


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the two binary labels: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", (F.col("quality") * (F.lit(2) - F.col("toxic"))).cast("int").alias("rating"))
