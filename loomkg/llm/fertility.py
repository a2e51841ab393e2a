"""Quality rules on tokeniser fertility: characters per token, byte-fallback share and token entropy.

A public SentencePiece vocabulary with byte fallback encodes every white-space-separated word with its
leading space mark; as its pieces do not cross words, word counts suffice and each distinct word of a
worker is encoded once. Rejection bands per language, or per script where no language is given, are
Tukey fences over all documents: a document outside [q1 - width * iqr, q3 + width * iqr] of its group in
any of the measures is rejected. Documents with fewer than `min_tokens` tokens are too short to judge and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import written
from loomkg.llm import _bytes as B
from loomkg.llm._run import arrow_map

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MEASURES = ("chars_per_token", "byte_fallback_share", "token_entropy")
SCRIPTS = ("none", "latin", "latin_ext", "greek", "cyrillic", "other")
KNOWN = 400_000

_LOADED: dict[str, tuple] = {}


class Encoder:
    """Distinct words of this worker and their tokens, as sorted hashes and a flat array of ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def lookup(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Row of each word; new words are encoded first."""
        if len(self.known) > KNOWN:
            self.clear()
        pos = np.searchsorted(self.known, h)
        pos[pos == len(self.known)] = 0
        new = np.flatnonzero(self.known[pos] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            u, first = np.unique(h[new], return_index=True)
            at = new[first]
            words = [bytes(buf[a:b]).decode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
            ids = self.sp.encode(words, num_threads=1)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            where = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))])
            known = np.concatenate([self.known, u])
            order = np.argsort(known, kind="stable")
            self.known, self.at, self.size = known[order], np.concatenate([self.at, where])[order], np.concatenate([self.size, size])[order]
            pos = np.searchsorted(self.known, h)
        return pos


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def measure(texts: pa.Array, path: str = VOCABULARY) -> dict[str, np.ndarray]:
    """Measures of each text; a text without words has no tokens and zeros."""
    enc = encoder(path)
    buf, offs = B.flat(texts)
    n = len(offs) - 1
    s, e, first = B.spans(buf, offs, B.TOKENS)
    if not len(s):
        z = np.zeros(n)
        return {"tokens": z.astype(np.int64), "chars_per_token": z, "byte_fallback_share": z, "token_entropy": z, "script": np.zeros(n, np.int64)}
    h = B.hashes(buf, B.TOKENS, s, e)
    row = enc.lookup(buf, s, e, h)
    size = enc.size[row]
    own = B.owners(first)
    tokens = np.bincount(own, size, n).astype(np.int64)
    # the tokens of all words, one after another
    total = int(size.sum())
    jump = np.repeat(enc.at[row] - (np.cumsum(size) - size), size)
    ids = enc.flat[jump + np.arange(total)].astype(np.int64)
    towner = np.repeat(own, size)
    fallback = np.bincount(towner, enc.byte[ids], n)
    key = np.sort((towner << 20) | ids)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
    count = np.diff(np.r_[at, total]).astype(float)
    some = np.maximum(tokens, 1)
    entropy = np.log2(some) - np.bincount((key[at] >> 20), count * np.log2(np.maximum(count, 1)), n) / some
    # characters: bytes that do not continue one, outside white space
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(((buf & 0xC0) != 0x80) & (B.TOKENS[buf] != 0), out=lead[1:])
    chars = lead[offs[1:]] - lead[offs[:-1]]
    kinds = np.stack([_share(buf, offs, lo, hi) for lo, hi in ((65, 123), (0xC3, 0xCA), (0xCD, 0xD0), (0xD0, 0xD4), (0xD4, 0xF8))], axis=1)
    latin = kinds[:, 0] + kinds[:, 1]
    other = kinds[:, 2:]
    script = np.where(latin >= other.max(1), np.where(latin == 0, 0, np.where(kinds[:, 1] > 0, 2, 1)), 3 + other.argmax(1))
    return {"tokens": tokens, "chars_per_token": chars / some, "byte_fallback_share": fallback / some, "token_entropy": np.where(tokens > 0, entropy, 0.0), "script": script}


def _share(buf: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= lo) & (buf < hi), out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, band, script, tokens, measures) of every row; band: the language, or the script where that is null."""

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(b.column(1), vocabulary)
        script = pa.DictionaryArray.from_arrays(pa.array(m["script"].astype(np.int32)), pa.array(SCRIPTS)).cast(pa.string())
        return pa.record_batch([b.column(0), b.column(2), script, pa.array(m["tokens"]), *[pa.array(m[x]) for x in MEASURES]], ["k", "l", "script", "tokens", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = arrow_map(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), lang.alias("l")), of, f"k {kind}, l string, script string, tokens bigint, " + ", ".join(f"{x} double" for x in MEASURES), 1)
    return rows.withColumn("band", F.coalesce("l", F.concat(F.lit("script:"), "script"))).drop("l")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY, width: float = 3.0, min_tokens: int = 50) -> DataFrame:
    """(id, band, script, tokens, chars_per_token, byte_fallback_share, token_entropy, keep) of every row.

    Entropy is compared per bit of the logarithm of the token count, as it grows with length. A null or empty
    text has no tokens and is kept as too short; a null language falls back to the script; a null id stays
    null; repeated rows are each judged; a value that ties with the edge of its band is kept; very long texts are
    measured whole; other columns are not read; an empty table gives no rows.
    """
    rows = written(measured(docs, id_col, text_col, lang_col, vocabulary), name="fertility")
    values = {
        "chars_per_token": F.col("chars_per_token"),
        "byte_fallback_share": F.col("byte_fallback_share"),
        "token_entropy": F.col("token_entropy") / F.log2(F.col("tokens") + 1.0),
    }
    long = rows.where(F.col("tokens") >= min_tokens)
    bands = long.groupBy("band").agg(*[F.percentile_approx(v, [0.25, 0.75], 2000).alias(f"q_{x}") for x, v in values.items()])
    joined = rows.join(bands, "band", "left")
    fine = F.lit(True)
    for x, v in values.items():
        q1, q3 = F.get(f"q_{x}", F.lit(0)), F.get(f"q_{x}", F.lit(1))
        room = F.greatest((q3 - q1) * width, F.abs(q3) * 0.1, F.lit(0.02))
        fine = fine & v.between(q1 - room, q3 + room)
    keep = (F.col("tokens") < min_tokens) | F.coalesce(fine, F.lit(True))
    return joined.select(F.col("k").alias(id_col), "band", "script", "tokens", *MEASURES, keep.alias("keep"))
