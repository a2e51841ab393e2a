"""Strings and text: similarity of names, chunkers, BM25, stripping of reasoning blocks, prompts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkg.common import ship


def jaro_winkler(a: str | bytes, b: str | bytes) -> float:
    """Jaro-Winkler on UTF-8 bytes; the prefix bonus (up to 4 bytes, 0.1 each) always counts."""
    x, y = (s.encode() if isinstance(s, str) else s for s in (a, b))
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    window = max(max(len(x), len(y)) // 2 - 1, 0)
    taken = bytearray(len(y))
    left = []
    for i, c in enumerate(x):
        for j in range(max(0, i - window), min(len(y), i + window + 1)):
            if not taken[j] and y[j] == c:
                taken[j] = 1
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    t = sum(p != q for p, q in zip(left, (c for c, u in zip(y, taken, strict=True) if u), strict=True)) // 2
    jaro = (m / len(x) + m / len(y) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple, float | None] = {}

    def one(p, q):  # noqa: ANN001, ANN202
        if p is None or q is None:
            return None
        if (p, q) not in memo:
            memo[p, q] = jaro_winkler(p, q)
        return memo[p, q]

    return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


def strip_think(text: Column) -> Column:
    """Cut a leading reasoning block with the white space after it; an unclosed block leaves nothing."""
    end = F.instr(text, "</think>")
    rest = F.regexp_replace(F.substring(text, end + 8, F.length(text)), r"^[ \t\r\n]+", "")
    return F.when(end > 0, rest).when(F.instr(text, "<think>") > 0, F.lit("")).otherwise(text)


def token_windows(docs: DataFrame, id_col: str, text_col: str, window: int = 256, overlap: int = 50) -> DataFrame:
    """(id, chunk, text) windows of white-space tokens; a last window of less than a quarter is dropped unless it is the only one."""
    step = window - overlap
    tokens = F.filter(F.split(F.col(text_col), r"\s+"), lambda t: t != "")
    rows = docs.select(F.col(id_col), tokens.alias("__t")).where(F.size("__t") > 0)
    starts = F.sequence(F.lit(0), F.size("__t") - 1, F.lit(step))
    at = rows.select(id_col, "__t", F.explode(starts).alias("__s"))
    piece = F.slice("__t", F.col("__s") + 1, window)
    kept = at.where((F.col("__s") == 0) | (F.size("__t") - F.col("__s") >= window // 4))
    return kept.select(id_col, (F.col("__s") / step).cast("int").alias("chunk"), F.array_join(piece, " ").alias("text"))


def char_chunks(text: str, size: int = 1000, overlap: float = 0.1) -> list[str]:
    """Chunks of up to `size` characters with an overlap, ending at a sentence if one ends beyond the half."""
    out, at = [], 0
    back = int(size * overlap)
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(s, at + size // 2, end) + len(s) for s in (". ", "! ", "? ", "\n"))
            if cut > at + size // 2:
                end = cut
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - back, at + 1)
    return out


def paragraph_chunks(text: str, most: int = 2000, least: int = 200) -> list[tuple[int, int, str]]:
    """(start, end, text): paragraphs packed up to `most` characters; a tiny last chunk joins the one before."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\n](?:.|\n(?!\s*\n))*", text) if m.group().strip()]
    out: list[list[int]] = []
    for s, e in spans:
        while e - s > most:
            out.append([s, s + most])
            s += most
        if out and e - out[-1][0] <= most and (out[-1][1] - out[-1][0] < most):
            out[-1][1] = e
        else:
            out.append([s, e])
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        last = out.pop()
        out[-1][1] = last[1]
    return [(s, e, text[s:e].strip()) for s, e in out]


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, kind: str = "char", **options) -> DataFrame:
    """(id, chunk, start, end, text) by the character or paragraph chunker; start and end are null for characters."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def cut(t: pd.Series) -> pd.Series:
        def one(x: str | None) -> list:
            if not x:
                return []
            if kind == "char":
                return [{"start": None, "end": None, "text": c} for c in char_chunks(x, **options)]
            return [{"start": s, "end": e, "text": c} for s, e, c in paragraph_chunks(x, **options)]

        return t.map(one)

    return docs.select(F.col(id_col), F.posexplode(cut(F.col(text_col))).alias("chunk", "c")).select(id_col, "chunk", "c.start", "c.end", "c.text")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "qid", query_col: str = "query", mode: str = "and", k1: float = 1.2, b: float = 0.75, max_terms: int = 20) -> DataFrame:
    """(query id, id, score, rank): BM25 over whole texts, the first `max_terms` words of each query; ties by id.

    Only the postings of query terms are built: the terms are few, so the texts are exploded against them and
    aggregated before anything is exchanged.
    """
    words = queries.select(query_id, F.explode(F.array_distinct(F.slice(terms(F.col(query_col)), 1, max_terms))).alias("term"))
    wanted = words.select("term").distinct()
    split = docs.select(F.col(id_col), terms(F.col(text_col)).alias("__t")).withColumn("len", F.size("__t"))
    stats = split.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = split.select(id_col, "len", F.explode("__t").alias("term")).join(F.broadcast(wanted) if wanted.limit(100_001).count() <= 100_000 else wanted, "term").groupBy("term", id_col).agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats)).join(words, "term").groupBy(query_id, id_col).agg(F.sum(part).alias("score"), F.count("*").alias("hits"))
    if mode == "and":
        need = words.groupBy(query_id).agg(F.count("*").alias("need"))
        scored = scored.join(need, query_id).where("hits = need")
    by = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def group_prompts(members: DataFrame, group_col: str, member_col: str, min_size: int = 3, max_members: int = 10) -> DataFrame:
    """(group_id, member_count, prompt): sorted members of each group of some size, the first few named."""
    g = members.groupBy(F.col(group_col).alias("group_id")).agg(F.sort_array(F.collect_list(member_col)).alias("m")).where(F.size("m") >= min_size)
    head = F.array_join(F.slice("m", 1, max_members), ", ")
    more = F.when(F.size("m") > max_members, F.concat(F.lit("...and "), (F.size("m") - max_members).cast("string"), F.lit(" others"))).otherwise(F.lit(""))
    return g.select(F.col("group_id").cast("string").alias("group_id"), F.size("m").alias("member_count"), F.concat(head, more).alias("prompt"))
