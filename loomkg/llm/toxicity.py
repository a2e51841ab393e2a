"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon has two parts: a list of words, and openings of words (3 to 8 bytes, or a whole short word) with
their log-odds among labelled rows. Openings catch inflected and compound forms that no list holds. Words
hidden by substituted, starred, stretched, separated or spaced letters are undone first (`obfuscation`) and
count in the same densities as plain ones. Features are computed on Arrow buffers of whole texts.

All that is fitted comes from a bounded sample of labelled rows (`max_train`, by hash of the id). Log-odds of
openings count near copies once, and those that a training row sees come from the other folds of rows. The
scores of a held-out part of the sample fit the isotonic map from raw score to probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship, written
from loomkg.llm import _bytes as B
from loomkg.llm import obfuscation as O
from loomkg.llm._run import arrow_map, bounded

LEXICON = tuple((
    "trash pathetic idiot idiots worthless disgusting stupid clown scum loser losers moron morons dumb imbecile "
    "bastard cretin filth filthy vermin parasite fool garbage bitch bitches asshole fuck fucking shit whore slut "
    "retard retarded kys ugly freak pig swine idiota estúpido estúpida imbécil basura asqueroso payaso dummkopf "
    "vollidiot abschaum arschloch wertlos connard connasse débile ordure salope abruti minable"
).split())
SECOND = "you your yours yourself ur u tu te ti tus vos vous toi ton ta du dich dir dein deine ihr euch usted ustedes".split()
NAMES = (
    "lexicon_share", "lexicon_count", "lexicon_kinds", "opening_share", "opening_sum", "opening_top", "near_second_share", "second_share",
    "capital_share", "shouted_share", "punctuation_share", "exclamation_share", "mixed_share", "hidden_share", "words",
)
#: What trees may split on: all but the number of words.
USED = len(NAMES) - 1
NEAR = 4
FOLDS = 4
#: Rows at the base rate that are added to the counts of an opening, least rows it occurs in, and its least log-odds.
SHRINK, LEAST_ROWS, LEAST_ODDS = 10.0, 4.0, 0.7
#: Key of "has a listed word", which no opening has: its log-odds are those of listed words that few labelled rows hold.
ANY_LISTED = 1
#: Log-odds of listed words where no labelled row has any.
UNSEEN = 3.0
#: An opening of this weight makes a word count as listed for nearness to the second person.
HEAVY = 1.5
PIECE = 1 << 21

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGITISH = np.zeros(256, bool)
_DIGITISH[48:58] = True
_DIGITISH[list(b"@$*!")] = True
_MIXED = B.WORDS.copy()
_MIXED[list(b"@$*!")] = list(b"@$*!")
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def _hash_words(words: tuple[str, ...] | list[str]) -> np.ndarray:
    buf, offs = B.lowered(pa.array(sorted(set(words)), pa.large_string()))
    s, e, _ = B.spans(buf, offs, B.WORDS)
    return np.unique(B.hashes(buf, B.WORDS, s, e))


class Lexicon:
    """Listed words and weighted openings, ready for look-up."""

    def __init__(self, words: tuple[str, ...] = LEXICON, keys: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.list = O.folded(tuple(words))
        self.words = _hash_words(self.list)
        self.second = _hash_words(SECOND)
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.weights = np.zeros(0) if weights is None else weights
        own = self.keys == ANY_LISTED
        self.listed = float(self.weights[own][0]) if own.any() else UNSEEN
        self.keys, self.weights = self.keys[~own], self.weights[~own]
        self.skeletons = O.Skeletons(self.list, self.keys, self.weights)


def features(texts: pa.Array, lexicon: Lexicon | None = None) -> np.ndarray:
    """(n, 15) dense features in the order of NAMES; a null or empty text has zeros."""
    lexicon = lexicon or Lexicon()
    texts = O.visible(texts)
    buf, offs = B.flat(texts)
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(buf):
        return out
    s, e, first = B.spans(buf, offs, B.WORDS)
    low, low_offs = B.lowered(texts)
    ls, le, _ = B.spans(low, low_offs, B.WORDS)
    if not len(ls):
        return out
    h = B.hashes(low, B.WORDS, ls, le)
    words = np.maximum(np.diff(first), 1)
    own = B.owners(first)
    bad, you = O.among(h, lexicon.words), O.among(h, lexicon.second)
    weight = O.weigh(O.openings(low, ls, le), le - ls, lexicon.keys, lexicon.weights)
    kind = np.where(bad, h, np.uint64(0))
    # what hides a word counts at the first word that it covers
    at, end, listed, opening = O.hidden(low, low_offs, lexicon.skeletons)
    masked = np.zeros(len(h), bool)
    if len(at):
        w = np.searchsorted(le, at, side="right")
        last = np.searchsorted(ls, end)
        fine = np.flatnonzero(w < last)
        fine = fine[np.searchsorted(low_offs, at[fine], side="right") - 1 == own[w[fine]]]
        fine = fine[~bad[w[fine]] & (weight[w[fine]] < HEAVY)]
        w, last, listed, opening = w[fine], last[fine], listed[fine], opening[fine]
        # the pieces of one word count as one
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, w + 1, 1)
        np.add.at(edge, np.maximum(last, w + 1), -1)
        words = np.maximum(words - B.sums(np.cumsum(edge[:-1]) > 0, first).astype(np.int64), 1)
        bad[w] |= listed
        kind[w] = np.where(listed & (kind[w] == 0), h[w], kind[w])
        np.maximum.at(weight, w, opening)
        masked[w] = True
    weight[bad] = np.maximum(weight[bad], lexicon.listed)
    insult = bad | (weight >= HEAVY)
    near = np.zeros(len(h), bool)
    for d in range(1, NEAR + 1):
        if len(h) > d:
            same = own[d:] == own[:-d]
            near[d:] |= you[:-d] & same
            near[:-d] |= you[d:] & same
    up = O.counted(_UPPER[buf], s, e)
    shouted = (up == e - s) & (e - s >= 2)
    n_bad = B.sums(bad, first)
    out[:, 0] = n_bad / words
    out[:, 1] = n_bad
    at = np.flatnonzero(bad)
    if len(at):
        o, k = own[at], kind[at]
        order = np.lexsort((k, o))
        o, k = o[order], k[order]
        out[:, 2] = np.bincount(o[np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])]], minlength=n)
    out[:, 3] = B.sums(weight >= HEAVY, first) / words
    out[:, 4] = B.sums(weight, first)
    hit = np.flatnonzero(weight)
    if len(hit):
        np.maximum.at(out[:, 5], own[hit], weight[hit])
    out[:, 6] = B.sums(insult & near, first) / words
    out[:, 7] = B.sums(you, first) / words
    size = np.maximum(np.diff(offs), 1)
    letters = O.counted(_LETTER[buf], offs[:-1], offs[1:])
    out[:, 8] = O.counted(_UPPER[buf], offs[:-1], offs[1:]) / np.maximum(letters, 1)
    out[:, 9] = B.sums(shouted, first) / words
    out[:, 10] = O.counted(_PUNCT[buf], offs[:-1], offs[1:]) / size
    out[:, 11] = O.counted(buf == 33, offs[:-1], offs[1:]) / size
    ms, me, mfirst = B.spans(low, low_offs, _MIXED)
    mixed = (O.counted(_DIGITISH[low], ms, me) > 0) & (O.counted(_LETTER[low], ms, me) > 1)
    out[:, 12] = B.sums(mixed, mfirst) / words
    out[:, 13] = B.sums(masked, first) / words
    out[:, 14] = np.diff(first)
    return out


@dataclass
class Trees:
    """Depth-limited regression trees on logistic loss; nodes in heap order."""

    depth: int = 3
    rounds: int = 40
    rate: float = 0.15
    bins: int = 48
    l2: float = 1.0
    least: int = 10
    gain: float = 4.0
    base: float = 0.0
    split: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        self.base = float(np.log(p0 / (1 - p0)))
        # labels are noisy: a leaf needs a fortieth of the rows
        least = max(self.least, n // 40)
        if n < 2 * least:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        cuts = [np.unique(np.r_[c, 0.0]) if (x[:, j] == 0).any() else c for j, c in enumerate(cuts)]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width = max(len(c) for c in cuts) + 1
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, hs = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            split = np.full(2**self.depth - 1, -1)
            cut = np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                base, m = 2**level - 1, 2**level
                best, which, where = np.full(m, self.gain), np.full(m, -1), np.zeros(m, np.int64)
                for j in range(k):
                    key = (node - base) * width + b[:, j]
                    sg, sh, sn = (np.bincount(key, w, m * width).reshape(m, width).cumsum(1) for w in (g, hs, None))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + self.l2) + (tg - sg) ** 2 / (th - sh + self.l2) - tg**2 / (th + self.l2)
                    gain[(sn < least) | (tn - sn < least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(m), at]
                    better = top > best
                    best[better], which[better], where[better] = top[better], j, at[better]
                for i in range(m):
                    if which[i] >= 0:
                        split[base + i], cut[base + i] = which[i], cuts[which[i]][where[i]]
                j = which[node - base]
                right = (j >= 0) & (b[np.arange(n), np.maximum(j, 0)] > where[node - base])
                node = 2 * node + 1 + right
            lo = 2**self.depth - 1
            leaf = -self.rate * np.bincount(node - lo, g, 2**self.depth) / (np.bincount(node - lo, hs, 2**self.depth) + self.l2)
            f += leaf[node - lo]
            self.split.append(split)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = split[node]
                node = 2 * node + 1 + ((j >= 0) & (x[rows, np.maximum(j, 0)] > cut[node]))
            f += leaf[node - (2**self.depth - 1)]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising piecewise linear map from score to probability.

    A knot is the mean score of a block; its level counts `prior` rows at the base rate, so that a few noisy
    labels make no block of their own, and documents between two blocks lean to neither.
    """
    # equal scores share a block, whatever their labels
    xs, inverse = np.unique(score, return_inverse=True)
    size = np.bincount(inverse, minlength=len(xs)).astype(float)
    mean = np.bincount(inverse, y, len(xs)) / np.maximum(size, 1)
    blocks: list[list[float]] = []
    for x, v, n in zip(xs.tolist(), mean.tolist(), size.tolist(), strict=True):
        blocks.append([v, n, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            w = a[1] + b[1]
            a[0], a[2], a[1] = (a[0] * a[1] + b[0] * b[1]) / w, (a[2] * a[1] + b[2] * b[1]) / w, w
    base = float(y.mean()) if len(y) else 0.0
    level = np.array([(v * w + base * prior) / (w + prior) for v, w, _ in blocks])
    return np.array([x for _, _, x in blocks]), np.maximum.accumulate(level) if len(level) else level


@dataclass
class ToxicityModel:
    trees: Trees
    knots: np.ndarray
    levels: np.ndarray
    lexicon: Lexicon

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = self.trees.score(x[:, :USED])
        return np.interp(s, self.knots, self.levels) if len(self.knots) else 1 / (1 + np.exp(-s))

    def judge(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability of each text; 0 for one without words."""
        x = features(texts, self.lexicon)
        return np.where(x[:, USED] > 0, self.probability(x), 0.0)


def fit_model(x: np.ndarray, y: np.ndarray, lexicon: Lexicon | None = None) -> ToxicityModel:
    """Every third row is held out for the isotonic calibration."""
    held = np.arange(len(y)) % 3 == 2
    trees = Trees().fit(x[~held][:, :USED], y[~held])
    knots, levels = isotonic(trees.score(x[held][:, :USED]), y[held]) if held.sum() >= 20 else (np.zeros(0), np.zeros(0))
    return ToxicityModel(trees, knots, levels, lexicon or Lexicon())


def cluster_of(texts: pa.Array) -> np.ndarray:
    """Least hash of two consecutive words of each text, which near copies share as a rule; 0 for a text without words."""
    low, offs = B.lowered(texts)
    s, e, first = B.spans(low, offs, B.WORDS)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(s):
        return out
    h = B.hashes(low, B.WORDS, s, e)
    own = B.owners(first)
    pair = h.copy()
    two = np.flatnonzero(own[1:] == own[:-1])
    pair[two] = B.mix(h[two] * B.BASE + h[two + 1])
    # the last word of a text stands for itself only where it is the only one
    last = first[1:][np.diff(first) > 1] - 1
    pair[last] = np.uint64(2**64 - 1)
    some = np.flatnonzero(np.diff(first))
    out[some] = np.minimum.reduceat(pair, first[some])
    return out


def keys_of(texts: pa.Array, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the distinct openings and short whole words of each text, and ANY_LISTED; listed: hashes of words."""
    low, offs = B.lowered(O.visible(texts))
    s, e, first = B.spans(low, offs, B.WORDS)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own, packed = B.owners(first), O.openings(low, s, e)
    has = np.unique(own[O.among(B.hashes(low, B.WORDS, s, e), listed)])
    size = np.minimum(e - s, O.OPENING)
    order = np.lexsort((size, packed, own))
    own, packed, size = own[order], packed[order], size[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (packed[1:] != packed[:-1]) | (size[1:] != size[:-1])]
    own, packed, size = own[new], packed[new], size[new]
    at, key = (np.concatenate(x) for x in zip(*O.opening_keys(packed, size), strict=True))
    own, key = np.r_[own[at], has], np.r_[key, np.full(len(has), ANY_LISTED, np.uint64)]
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
    return own[new], key[new]


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-odds of the label given the opening, over those of the label, shrunk by SHRINK rows at the base rate."""
    return np.log((toxic + SHRINK * share) / (clean + SHRINK * (1 - share))) - np.log(share / (1 - share))


def _specific(toxic: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Without openings that owe nine tenths of their rows to one longer opening or whole word, which stands for them."""
    size = {k: v.sum() for k, v in toxic.items()}
    covered = set()
    for k, n in size.items():
        raw = k.to_bytes(O.OPENING, "big").rstrip(b"\0")
        shorter = int.from_bytes(raw[:-1].ljust(O.OPENING, b"\0"), "big")
        if n >= 0.9 * size.get(shorter, np.inf):
            covered.add(shorter)
    return {k: v for k, v in toxic.items() if k not in covered}


def _learned(counts: dict[int, np.ndarray], total: np.ndarray, left_out: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) from counts[key][label, fold]; total: the same for all rows."""
    use = [f for f in range(FOLDS) if f != left_out]
    rows = total[:, use].sum(1)
    if not len(counts) or rows.min() <= 0:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys = np.array(sorted(counts), np.uint64)
    c = np.stack([counts[int(k)] for k in keys])[:, :, use].sum(2)
    w = log_odds(c[:, 1], c[:, 0], rows[1] / rows.sum())
    fine = (c[:, 1] >= LEAST_ROWS * len(use) / FOLDS) & (w >= LEAST_ODDS)
    return keys[fine], w[fine]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 12000, words: tuple[str, ...] = LEXICON) -> ToxicityModel:
    """Fit on at most `max_train` labelled documents; without any, every document scores 0.5.

    Rows with a null id or label, and texts without words, teach nothing. Rows that repeat an id are each used;
    near copies weigh as one in the log-odds. Nothing depends on the order of rows: ties are broken by value.
    """
    spark = docs.sparkSession
    ship(spark)
    some = bounded(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y")), "k", max_train)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(some), "k").select("t", (F.col("y") > 0).cast("int").alias("y"))

    def clustered(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), b.column(1), pa.array(cluster_of(b.column(0)).view(np.int64))], ["t", "y", "c"])

    sample = written(arrow_map(rows, clustered, "t string, y int, c bigint", 0), name="labelled").where("c <> 0")
    # at most one row of three numbers for each labelled row
    size = {(r.c, r.y): r.n for r in sample.groupBy("c", "y").agg(F.count("*").alias("n")).collect()}
    total = np.zeros((2, FOLDS))
    for c, y in size:
        total[y, c % FOLDS] += 1
    sizes, listed = spark.sparkContext.broadcast(size), spark.sparkContext.broadcast(Lexicon(words).words)

    def counts_of(y: int, known):  # noqa: ANN001, ANN202
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            own, key = keys_of(b.column(0), listed.value)
            if known is not None:
                keep = O.among(key, known.value)
                own, key = own[keep], key[keep]
            c = b.column(1).to_numpy()
            share = np.array([1 / sizes.value[x, y] for x in c.tolist()])
            fold = c % FOLDS
            parts = []
            for f in range(FOLDS):
                mine = fold[own] == f
                k, at = np.unique(key[mine], return_inverse=True)
                parts.append((k.view(np.int64), np.full(len(k), f, np.int32), np.bincount(at, share[own[mine]], len(k))))
            return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["key", "fold", "n"])

        got = arrow_map(sample.where(F.col("y") == y).select("t", "c"), of, "key bigint, fold int, n double", 0)
        by = got.groupBy("key").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0.0)).alias(f"f{f}") for f in range(FOLDS)])
        return by.where(" + ".join(f"f{f}" for f in range(FOLDS)) + f" >= {LEAST_ROWS - 1e-6}") if known is None else by

    as_key = lambda r: int(np.int64(r.key).view(np.uint64))
    toxic = {as_key(r): np.array([r[1 + f] for f in range(FOLDS)]) for r in counts_of(1, None).collect()}
    toxic = _specific(toxic)
    known = spark.sparkContext.broadcast(np.array(sorted(toxic), np.uint64))
    clean = {as_key(r): np.array([r[1 + f] for f in range(FOLDS)]) for r in counts_of(0, known).collect()}
    counts = {k: np.stack([clean.get(k, np.zeros(FOLDS)), v]) for k, v in toxic.items()}
    parts = spark.sparkContext.broadcast([Lexicon(words, *_learned(counts, total, f)) for f in range(FOLDS)])

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        fold = b.column(2).to_numpy() % FOLDS
        x = np.zeros((b.num_rows, len(NAMES)))
        for f in np.unique(fold).tolist():
            at = np.flatnonzero(fold == f)
            x[at] = features(b.column(0).take(pa.array(at)), parts.value[f])
        return pa.record_batch([b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "c", "x"])

    got = sorted(arrow_map(sample.select("t", "y", "c"), of, "y int, c bigint, x array<double>", 0).collect(), key=lambda r: (r.c, r.y, r.x))
    x = np.array([r.x for r in got]).reshape(len(got), len(NAMES))
    order = np.random.default_rng(7).permutation(len(got))
    return fit_model(x[order], np.array([float(r.y) for r in got])[order], Lexicon(words, *_learned(counts, total, None)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, toxicity, toxic) for every row, in one narrow pass.

    A null or empty text has toxicity 0 and is not toxic; a null id stays null; rows that repeat are each
    scored; a tie with the threshold is toxic; very long texts are read whole; other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.concatenate([known.value.judge(x.column(1)) for x in B.pieces(b, 1, PIECE)])
        return pa.record_batch([b.column(0), pa.array(p), pa.array(p >= threshold)], ["k", "toxicity", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")), of, f"k {kind}, toxicity double, toxic boolean", 1).withColumnRenamed("k", id_col)


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with all their columns; the score reads the text column alone.

    Null and empty texts, and all rows of clean text, stay as they are, with null ids and repeated rows; a tie
    with the threshold goes; very long texts are read whole; other columns pass untouched, whatever their
    names; an empty table stays empty.
    """
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        got = [known.value.judge(x.column(0)) for x in B.pieces(pa.record_batch([texts], ["t"]), 0, PIECE)]
        return pa.array(np.concatenate(got) if got else np.zeros(0))

    return docs.where(toxicity(F.col(text_col).cast("string")) < threshold)
