"""Edge cases, brute-force comparisons and held-out accuracy of the text operators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomkg.llm import _bytes as B
from loomkg.llm import decontaminate, fertility, histogram_sort, license_scan, line_dedup, ordinal_quality, packing, simhash_pigeonring, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, k string, t string, `row` int, keep string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(4000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, x, None if j % 3 == 0 else "en", "s", None if x is None else len(x), "z", "k", "t", 7, "q") for j, (i, x) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, repeated and null ids, clashing extra columns."""
    base = prose(120)
    texts = [None, "", "   \n\n ", base, base, base + " extra", prose(60_000), "x", "\0\n\0", "é" * 50, base, base.upper()]
    return frame(spark, texts, [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 3, None])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, prose(30)), (1, None), (2, "short one"), (3, "")], "item_id bigint, text string")


def test_spans_do_not_cross_texts():
    buf, offs = B.flat(pa.array(["ab", "cd ef", "", None, "gh"]))
    s, e, first = B.spans(buf, offs, B.WORDS)
    assert [bytes(buf[a:b]) for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"ef", b"gh"]
    assert first.tolist() == [0, 1, 3, 3, 3, 4]
    h = B.hashes(buf, B.WORDS, s, e)
    assert len(set(h.tolist())) == 4


# quality ---------------------------------------------------------------------------------------------------


def test_ordinal_recovers_graded_ratings():
    rng = np.random.default_rng(0)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    texts, grade = [], []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        texts.append(" ".join(str(rng.choice(good if rng.random() < g / 3 else bad)) for _ in range(40)))
        grade.append(g)
    own, idx = ordinal_quality.hashed(pa.array(texts[:600]))
    total = np.bincount(own)
    m = ordinal_quality.fit(own, idx, 1 / total[own], np.array(grade[:600]), 4)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(m.scores(pa.array(texts[600:]))[0])
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.abs(tails.sum(1) - np.array(grade[600:])).mean() < 0.6
    assert np.corrcoef(tails.sum(1), grade[600:])[0, 1] > 0.85


def test_ordinal_fit_equals_a_plain_gradient_fit():
    """The same updates with dense arrays and the gradient taken by differences."""
    rng = np.random.default_rng(6)
    n, k = 40, 3
    dense = rng.random((n, 5)) * (rng.random((n, 5)) < 0.6)
    grade = rng.integers(0, k, n)
    docs, cols = np.nonzero(dense)
    places = np.array([3, 77, 1000, 40_000, 200_000])
    m = ordinal_quality.fit(docs, places[cols], dense[docs, cols], grade, k, rounds=12)

    def loss(par):
        z = ordinal_quality.SCALE * dense @ par[:5]
        theta = np.cumsum(np.r_[par[5], np.exp(par[6:])])
        cdf = 1 / (1 + np.exp(-np.concatenate([np.full((n, 1), -40.0), theta[None] - z[:, None], np.full((n, 1), 40.0)], axis=1)))
        return -np.log(cdf[np.arange(n), grade + 1] - cdf[np.arange(n), grade]).mean() + 0.5e-5 * (par[:5] ** 2).sum()

    share = np.array([(grade >= g + 1).mean() for g in range(k - 1)])
    theta = np.maximum.accumulate(np.log((1 - share) / share)) + 1e-3 * np.arange(k - 1)
    par = np.r_[np.zeros(5), theta[0], np.log(np.maximum(np.diff(theta), 1e-3))]
    a, b = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, 13):
        g = np.array([(loss(par + d) - loss(par - d)) / 2e-5 for d in 1e-5 * np.eye(len(par))])
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        par = par - 0.03 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(m.weights[places], par[:5], atol=1e-4) and np.count_nonzero(m.weights) <= 5
    assert np.allclose(m.thresholds, np.cumsum(np.r_[par[5], np.exp(par[6:])]), atol=1e-4)


def test_ordinal_edge_cases(spark, odd, empty):
    ratings = spark.createDataFrame([(3, 2), (5, 0), (6, 1), (None, 1), (7, None), (8, 9)], "doc_id bigint, rating int")
    m = ordinal_quality.train(odd, ratings)
    rows = ordinal_quality.score(odd, m).collect()
    assert len(rows) == odd.count() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert ordinal_quality.score(empty, m).count() == 0
    assert len(ordinal_quality.train(empty, ratings).thresholds) == 2


def test_ordinal_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = ordinal_quality.ratings_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    m = ordinal_quality.train(d, labels, max_train=2000)
    seen = ordinal_quality.bounded(labels.withColumnRenamed("doc_id", "k"), "k", 2000)
    rest = labels.join(seen.withColumnRenamed("k", "doc_id"), "doc_id", "left_anti")
    rows = ordinal_quality.score(d, m).join(rest, "doc_id").collect()
    right = np.mean([r.keep == (r.rating > 0) for r in rows])
    assert right > 0.9
    assert np.mean([r.keep for r in rows if r.rating == 2]) > 0.95


# fertility -------------------------------------------------------------------------------------------------


def test_fertility_equals_encoding_word_by_word():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    texts = ["Hello there world", "日本語 \U0001f600 ok", "", None, "a a a b", prose(300)]
    m = fertility.measure(pa.array(texts))
    for i, x in enumerate(texts):
        ids = [t for w in (x or "").split() for t in sp.encode(w)]
        assert m["tokens"][i] == len(ids)
        if ids:
            p = np.unique(ids, return_counts=True)[1] / len(ids)
            assert abs(m["token_entropy"][i] + (p * np.log2(p)).sum()) < 1e-9
            assert abs(m["byte_fallback_share"][i] - np.mean([sp.is_byte(t) for t in ids])) < 1e-12
            assert abs(m["chars_per_token"][i] - sum(map(len, x.split())) / len(ids)) < 1e-12


def test_fertility_rejects_outliers_only(spark, odd, empty):
    rng = random.Random(3)
    texts = [prose(200, rng) for _ in range(80)] + ["\U0001f600\U00012345 " * 200, "z" * 3000 + " a" * 100]
    out = {r.doc_id: r for r in fertility.judge(frame(spark, texts), lang_col="k").collect()}
    assert not out[80].keep and not out[81].keep
    assert sum(out[i].keep for i in range(80)) == 80
    assert fertility.judge(odd).count() == odd.count()
    assert fertility.judge(empty).count() == 0


# sharding --------------------------------------------------------------------------------------------------


def test_histogram_sort_balances_and_sorts(spark, odd, empty):
    rng = random.Random(4)
    texts = [prose(rng.randint(1, 200), rng) for _ in range(1500)]
    d = frame(spark, texts, [rng.randint(-500, 500) for _ in texts]).repartition(5)
    out = histogram_sort.shard(d, ["doc_id"], shard_bytes=60_000, tolerance=0.05)
    assert out.columns == [*[c for c in d.columns if c != "shard"], "shard"]
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert [r.doc_id for s in sorted(by) for r in by[s]] == sorted(r.doc_id for r in rows) and len(rows) == 1500
    sizes = [sum(len(r.text.encode()) for r in by[s]) for s in by]
    assert max(sizes) < 1.2 * sum(sizes) / len(sizes)
    assert histogram_sort.shard(empty, ["doc_id"]).count() == 0
    assert histogram_sort.shard(odd, ["lang", "doc_id"], shard_bytes=1000).count() == odd.count()
    assert histogram_sort.shard(frame(spark, ["same text"] * 50, [1] * 50), ["doc_id"], shard_bytes=20).select("shard").distinct().count() == 1


def test_histogram_key_orders_as_columns(spark):
    vals = [(None, "a"), (-5, "b"), (-5, "ba"), (3, None), (3, ""), (3, "é"), (2**62, "z"), (-(2**62), "")]
    d = spark.createDataFrame(vals, "a bigint, b string")
    rows = d.select("a", "b", histogram_sort.order_key(d, ["a", "b"]).alias("key")).collect()
    want = d.orderBy("a", "b").collect()
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: bytes(r.key))] == [(r.a, r.b) for r in want]


def test_histogram_key_orders_every_type(spark):
    import datetime as dt
    from decimal import Decimal

    nan, inf = float("nan"), float("inf")
    cases = {
        "double": [9.5, 10.0, 100.0, -3.0, -0.5, 0.0, 1e-300, -1e300, inf, -inf, nan, None],
        "float": [1.5, -1.5, 0.25, None],
        "decimal(12,3)": [Decimal(x) for x in ("9.5", "10", "-3", "-3.001", "0", "100.25", "-100.25")] + [None],
        "decimal(38,18)": [Decimal(x) for x in ("0.000000000000000001", "-0.000000000000000001", "12345678901234567890.5", "0")],
        "date": [dt.date(1969, 12, 31), dt.date(2020, 1, 1), dt.date(1, 1, 1), None],
        "timestamp": [dt.datetime(1960, 1, 1, 0, 0, 1), dt.datetime(1960, 1, 1), dt.datetime(2030, 5, 5), None],
        "boolean": [True, False, None],
        "string": ["", "a", "a\0", "a\0b", "a\1", "b", "\0", "\u00e9", None],
    }
    for kind, values in cases.items():
        d = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`x.y` {kind}, i int")
        rows = d.select("i", histogram_sort.order_key(d, ["x.y", "i"]).alias("key")).collect()
        got = [r.i for r in sorted(rows, key=lambda r: bytes(r.key))]
        assert got == [r.i for r in d.orderBy("`x.y`", "i").collect()], kind
        assert len({bytes(r.key) for r in d.select(histogram_sort.order_key(d, ["x.y"]).alias("key")).collect()}) == len(values)
    with pytest.raises(TypeError):
        histogram_sort.order_key(spark.createDataFrame([([1],)], "a array<int>"), ["a"])


# suffix dedup ----------------------------------------------------------------------------------------------


def brute_repeats(docs, least=35, gap=16):
    """Anchors by definition, longest matches by comparing all pairs of equal openings."""
    words, h = {}, {}
    for i, x in docs.items():
        buf, offs = B.flat(pa.array([x]))
        s, e, _ = B.spans(buf, offs, B.WORDS)
        words[i] = [bytes(B.WORDS[buf[a:b]]) for a, b in zip(s, e, strict=True)]
        h[i] = B.rolled(B.hashes(buf, B.WORDS, s, e), 2)
    at = {}
    for i in docs:
        n = len(h[i])
        sel = {p for w in range(n - gap + 1) for p in range(w, w + gap) if h[i][p] == h[i][w : w + gap].min()}
        for p in sel:
            if p + least <= len(words[i]):
                at.setdefault(tuple(words[i][p : p + least]), []).append((i, p))
    spans = {}
    for group in at.values():
        if len({i for i, _ in group}) < 2:
            continue
        for i, p in group:
            best = 0
            for j, q in group:
                if j != i:
                    w = least
                    while w < least + gap and p + w < len(words[i]) and q + w < len(words[j]) and words[i][p + w] == words[j][q + w]:
                        w += 1
                    best = max(best, w)
            spans.setdefault(i, []).append((p, p + best, min(j for j, _ in group)))
    out = set()
    for i, x in spans.items():
        now = None
        for p, q, s in sorted(x):
            if now and p <= now[1]:
                now = [now[0], max(now[1], q), min(now[2], s)]
            else:
                if now:
                    out.add((i, now[0], now[1] - now[0], now[2], now[2] != i))
                now = [p, q, s]
        out.add((i, now[0], now[1] - now[0], now[2], now[2] != i))
    return out


def test_suffix_dedup_equals_brute_force_and_finds_planted(spark, odd, empty):
    rng = random.Random(11)
    passage = [prose(n, rng) for n in (50, 51, 70, 200)]
    docs = {i: prose(rng.randint(1, 150), rng) for i in range(40)}
    for i in range(40, 70):
        docs[i] = prose(rng.randint(0, 60), rng) + " " + RNG.choice([str.upper, str])(passage[i % 4]) + ", " + prose(rng.randint(0, 60), rng)
    docs[70] = docs[71] = docs[5]
    got = suffix_dedup.repeats(frame(spark, list(docs.values()), list(docs)).repartition(6)).collect()
    assert {tuple(r) for r in got} == brute_repeats(docs)
    hit = {r.doc_id for r in got}
    assert set(range(40, 70)) <= hit and not hit & (set(range(40)) - {5})
    assert suffix_dedup.repeats(empty).count() == 0
    assert {r.doc_id for r in suffix_dedup.repeats(odd).collect()} == {3, 4, 5}


def brute_passages(docs, least=35):
    """All windows of all positions."""
    at = {}
    for i, x in docs.items():
        buf, offs = B.flat(pa.array([x]))
        s, e, _ = B.spans(buf, offs, B.WORDS)
        words = [bytes(B.WORDS[buf[a:b]]) for a, b in zip(s, e, strict=True)]
        for p in range(len(words) - least + 1):
            at.setdefault(tuple(words[p : p + least]), []).append((i, p))
    out = {}
    for group in at.values():
        if len({i for i, _ in group}) > 1:
            for i, p in group:
                out.setdefault(i, []).append((p, p + least, min(group)[0]))
    spans = set()
    for i, x in out.items():
        now = []
        for p, q, s in sorted(x):
            if now and p <= now[-1][1]:
                now[-1] = [now[-1][0], max(now[-1][1], q), min(now[-1][2], s)]
            else:
                now.append([p, q, s])
        spans |= {(i, p, q - p, s, s != i) for p, q, s in now}
    return spans


def test_passages_are_reported_from_their_first_word_at_every_position(spark, odd, empty, tmp_path):
    from loomkg.llm import queries

    rng = random.Random(41)
    passage = [prose(n, rng) for n in (34, 35, 36, 40, 49, 50, 70, 200)] + [" ".join(["same"] * 60)]
    docs = {i: prose(rng.randint(1, 150), rng) for i in range(30)}
    for i in range(30, 90):
        docs[i] = prose(rng.randint(0, 60), rng) + " " + passage[i % 9] + ", " + prose(rng.randint(0, 60), rng) + " " + rng.choice(passage)
    docs[90] = docs[91] = docs[5]
    d = frame(spark, list(docs.values()), list(docs))
    want = brute_passages(docs)
    d.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in queries.op4_suffix_dedup(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in suffix_dedup.passages(d, gap=5).collect()} == want
    named = {(str(i), p, n, str(s), c) for i, p, n, s, c in brute_passages({i: docs[i] for i in range(30, 90)})}
    texts = frame(spark, [docs[i] for i in range(30, 90)], list(range(30, 90))).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {tuple(r) for r in suffix_dedup.passages(texts).collect()} == named
    assert suffix_dedup.passages(empty).count() == 0
    assert {r.doc_id for r in suffix_dedup.passages(odd).collect()} == {3, 4, 5}


def test_loser_tree_merges_and_compares_no_byte_twice():
    rng = random.Random(2)
    every = [("ab" * rng.randint(0, 40) + "".join(rng.choice("ab") for _ in range(10))).encode() for _ in range(500)]
    runs = [sorted(every[i::7]) for i in range(7)]
    blobs = [suffix_dedup.encode([(s, 0, 0, 0) for s in r]) for r in runs]
    assert [s for s, *_ in suffix_dedup.decode(blobs[0])] == runs[0]
    tree = suffix_dedup.LoserTree([iter([(s, k, 0) for s, k, *_ in suffix_dedup.decode(b)]) for b in blobs])
    out = [(s, k) for s, k, _ in tree]
    assert [s for s, _ in out] == sorted(every)
    for (a, _), (b, k) in zip(out, out[1:], strict=False):
        assert k == suffix_dedup.common(a, b)
    # characters looked at: never more than the strings have beyond what they share, once per round of the tree
    assert tree.compared <= sum(map(len, every))


def test_merge_gives_each_suffix_its_longest_match_with_another_id():
    rng = random.Random(23)
    for _ in range(30):
        entries = []
        for p in range(60):
            words = ["a", "b", "c"] + [rng.choice("xy") for _ in range(rng.randint(0, 5))]
            entries.append((" ".join(words[rng.randint(0, 1) :] + [""]).encode(), rng.randint(0, 5), p))
        runs = []
        for part in (entries[0::3], entries[1::3], entries[2::3]):
            runs.append((suffix_dedup.encode([(s, d, p, 0) for s, d, p in sorted(part)]), list(range(6))))
        words = [s.decode().split() for s, _, _ in entries]

        def match(i, j, words=words):
            return next((n for n, (x, y) in enumerate(zip(words[i], words[j], strict=False)) if x != y), min(len(words[i]), len(words[j])))

        want = set()
        for i, (_, d, p) in enumerate(entries):
            best = max((match(i, j) for j, e in enumerate(entries) if e[1] != d), default=0)
            if best >= 3:
                want.add((d, p, best, 0))
        assert set(suffix_dedup.merged(runs, 3)) == want


def test_a_passage_in_very_many_documents_waits_for_nothing():
    n = 200_000
    blob = suffix_dedup.encode([(b"w " * 40, i, 0, 0) for i in range(n)])
    it = suffix_dedup.merged([(blob, list(range(n)))], 35)
    assert next(it) == (0, 0, 40, 0)
    assert sum(1 for _ in it) == n - 1


# toxicity --------------------------------------------------------------------------------------------------


def test_isotonic_rises_and_averages():
    s = np.array([0.0, 1, 2, 3, 4, 5])
    x, y = toxicity.isotonic(s, np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(s, x, y).mean() - 0.5) < 1e-9


def test_toxicity_catches_plain_and_obfuscated(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = toxicity.train(d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    clean = {r.doc_id for r in d.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("toxic = 0").collect()}
    got = {r.doc_id for r in toxicity.score(d, m).where("toxic").collect()}
    assert len(got) > 40 and not got & clean
    rows = {(r.doc_id, r.toxic) for r in toxicity.score(odd, m).collect()}
    assert not any(t for _, t in rows) and toxicity.score(odd, m).count() == odd.count()
    assert toxicity.score(empty, m).count() == 0 and toxicity.reject_toxic(odd, m).columns == odd.columns
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id bigint, toxic int")).trees.split == []
    x = toxicity.features(pa.array(["you stup1d 1d10t", "you stupid idiot", "nice day", None]))
    at = toxicity.NAMES.index
    assert x[0, at("lexicon_count")] == x[1, at("lexicon_count")] == 2 and x[0, at("hidden_share")] > 0 and x[1, at("hidden_share")] == 0
    assert (x[:2, at("near_second_share")] > 0).all() and not x[3].any()


OBFUSCATIONS = {
    "plain": lambda w, r: w,
    "leet": lambda w, r: "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5"}.get(c, c) for c in w),
    "starred": lambda w, r: (lambda i: w[:i] + "*" + w[i + 1 :])(r.randrange(1, len(w))),
    "spaced": lambda w, r: " ".join(w),
    "dotted": lambda w, r: ".".join(w),
    "stretched": lambda w, r: (lambda i: w[:i] + w[i] * 4 + w[i + 1 :])(r.randrange(len(w))),
    "hyphenated": lambda w, r: (lambda i: w[:i] + "-" + w[i:])(r.randrange(1, len(w))),
    "invisible": lambda w, r: (lambda i: w[:i] + "\u200b" + w[i:])(r.randrange(1, len(w))),
    "capitals": lambda w, r: w.upper(),
}


@pytest.fixture(scope="module")
def toxicity_held_out(spark):
    """A model of 2,400 labelled rows and the labelled texts it has not seen."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(d, labels, max_train=2400)
    seen = toxicity.bounded(labels.where("toxic is not null").withColumnRenamed("doc_id", "k"), "k", 2400).select("k")
    rows = d.join(labels, "doc_id").join(seen, labels.doc_id == seen.k, "left_anti").select("text", "toxic").distinct().collect()
    return m, rows


@pytest.mark.parametrize("kind", sorted(OBFUSCATIONS))
def test_toxicity_catches_hidden_words_in_held_out_texts(toxicity_held_out, kind):
    import re

    m, rows = toxicity_held_out
    # words of the held-out toxic texts that no clean text has
    clean = {w for r in rows if not r.toxic for w in re.findall(r"[a-z]+", r.text.lower())}
    count = {}
    for r in rows:
        if r.toxic:
            for w in set(re.findall(r"[a-z]+", r.text.lower())) - clean:
                count[w] = count.get(w, 0) + 1
    marks = {w for w, n in count.items() if n >= 20}
    assert len(marks) >= 8
    rng, pattern = random.Random(13), re.compile(r"\b(" + "|".join(sorted(marks)) + r")\b", re.IGNORECASE)
    texts = [pattern.sub(lambda x: OBFUSCATIONS[kind](x[0].lower(), rng), r.text) for r in rows if r.toxic and pattern.search(r.text)]
    assert len(texts) > 50 and (m.judge(pa.array(texts)) >= 0.5).mean() >= 0.9


def test_toxicity_leaves_held_out_clean_texts(toxicity_held_out):
    m, rows = toxicity_held_out
    clean = [r.text for r in rows if not r.toxic]
    assert (m.judge(pa.array(clean)) < 0.5).mean() > 0.97


def test_toxicity_learns_unlisted_and_inflected_words(spark):
    rng = random.Random(19)
    texts, labels = [], []
    for i in range(1500):
        words = prose(rng.randint(20, 60), rng).split()
        bad = i % 8 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zorblax", "quemvu" + rng.choice(WORDS), "Wixtu" + rng.choice(WORDS)]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    m = toxicity.train(frame(spark, texts), spark.createDataFrame(labels[:900], "doc_id bigint, toxic int"))
    flagged = m.judge(pa.array(texts[900:])) >= 0.5
    bad = np.array([b for _, b in labels[900:]]) == 1
    assert flagged[bad].mean() > 0.95 and flagged[~bad].mean() < 0.02


def brute_tree(x, y, depth, least, l2=1.0, gain=4.0, rate=0.15):
    """One regression tree on the first gradients by trying every cut of every feature; leaf values of the rows."""
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def grow(at, level):
        best = (gain, None)
        if level < depth:
            for j in range(x.shape[1]):
                for c in np.unique(x[at, j])[:-1]:
                    left = x[at, j] <= c
                    if min(left.sum(), (~left).sum()) >= least:
                        a, b = at[left], at[~left]
                        v = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - g[at].sum() ** 2 / (h[at].sum() + l2)
                        if v > best[0] + 1e-12:
                            best = (v, (a, b))
        if best[1] is None:
            out[at] = -rate * g[at].sum() / (h[at].sum() + l2)
        else:
            for side in best[1]:
                grow(side, level + 1)

    out = np.zeros(len(y))
    grow(np.arange(len(y)), 0)
    return out + np.log(p / (1 - p))


def test_trees_equal_exhaustive_splits():
    rng = np.random.default_rng(4)
    for _ in range(5):
        x = rng.integers(0, 12, (400, 4)).astype(float)
        y = ((x[:, 0] > 5) & (x[:, 2] < 8) | (rng.random(400) < 0.1)).astype(float)
        t = toxicity.Trees(depth=2, rounds=1).fit(x, y)
        assert np.allclose(t.score(x), brute_tree(x, y, 2, 10), atol=1e-9)


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = toxicity.Trees().fit(x[:1000], y[:1000])
    assert ((t.score(x[1000:]) > 0) == y[1000:]).mean() > 0.95


# simhash ---------------------------------------------------------------------------------------------------


def test_simhash_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (400, 16), dtype=np.uint8)
    near = []
    for f in base:
        g = np.unpackbits(f)
        g[rng.permutation(128)[: rng.integers(1, 19)]] ^= 1
        near.append(np.packbits(g))
    f = np.unique(np.concatenate([base, near]), axis=0)
    d = simhash_pigeonring._ONES[f[:, None, :] ^ f[None, :, :]].sum(2)
    want = {tuple(sorted((f[i].tobytes(), f[j].tobytes()))) for i, j in zip(*np.nonzero(d <= 18), strict=True) if i < j}
    frame_ = spark.createDataFrame([(bytearray(x.tobytes()),) for x in f], "f binary")
    got = {(bytes(r.a), bytes(r.b)) for r in simhash_pigeonring.similar(frame_, 18, 0.95).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    more = np.stack([np.packbits(np.r_[np.unpackbits(base[0])[:110], rng.integers(0, 2, 18)].astype(np.uint8)) for _ in range(300)])
    every = spark.createDataFrame([(bytearray(x.tobytes()),) for x in np.unique(np.concatenate([f, more]), axis=0)], "f binary").cache()
    whole, forest = (simhash_pigeonring.similar(every, 18, 0.95, forest=x).cache() for x in (False, True))
    roots = [{bytes(r.node): bytes(r.root) for r in simhash_pigeonring.components(x.select("a", "b")).collect()} for x in (whole, forest)]
    assert roots[0] == roots[1] and forest.count() < whole.count() / 2


@pytest.mark.parametrize("apart", [14, 16, 18])
def test_simhash_recall_holds_at_every_distance(apart):
    rng = np.random.default_rng(apart)
    bits = rng.integers(0, 2, (4000, 128), dtype=np.uint8)
    other = bits.copy()
    other[np.arange(4000)[:, None], rng.random((4000, 128)).argsort(1)[:, :apart]] ^= 1
    rings = simhash_pigeonring._rings(simhash_pigeonring.KEY_BITS, simhash_pigeonring.key_plan(18, 0.95))
    x, y = (simhash_pigeonring._keys(np.packbits(b, axis=1, bitorder="little"), rings) for b in (bits, other))
    assert (x == y).any(1).mean() >= 0.94


def test_long_stretches_of_equal_keys_cost_a_few_passes(monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2, 128)
    # 100,000 distinct fingerprints within 18 bits of one another or so, and a few far from them
    bits = np.repeat(base[None], 100_000, axis=0)
    bits[np.arange(100_000)[:, None], rng.integers(0, 128, (100_000, 6))] ^= 1
    f = np.unique(np.packbits(np.concatenate([bits, rng.integers(0, 2, (5, 128))]).astype(np.uint8), axis=1), axis=0)
    seen = []
    whole = simhash_pigeonring._near
    monkeypatch.setattr(simhash_pigeonring, "_near", lambda *a: seen.append(len(a[1])) or whole(*a))
    got = [np.stack([i, j]) for i, j, _ in simhash_pigeonring._long(f, 0, len(f), 18, True)]
    assert sum(x.shape[1] for x in got) == len(f) - 6 and sum(seen) < 20 * len(f)


@pytest.mark.parametrize("heavy", [1 << 14, 8])
def test_simhash_finds_every_pair_within_the_budget(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash_pigeonring, "HEAVY", heavy)
    rng = np.random.default_rng(29)
    # bits of uneven weight, as those of texts in few languages, so that unrelated ones share buckets
    base = (rng.random((1000, 128)) < np.repeat([0.1, 0.3, 0.5, 0.8], 32)).astype(np.uint8)
    pairs = base[:600].copy()
    pairs[np.arange(600)[:, None], rng.random((600, 128)).argsort(1)[:, :18]] ^= 1
    many = np.repeat(base[999:], 400, axis=0)
    many[np.arange(400)[:, None], rng.integers(0, 128, (400, 5))] ^= 1
    f = np.unique(np.packbits(np.concatenate([base, pairs, many]), axis=1), axis=0)
    root = np.arange(len(f))
    for _ in range(20):
        for i in range(len(f)):
            near = simhash_pigeonring.distance(np.broadcast_to(f[i], f.shape), f) <= 18
            root[near] = root[near].min()
        if (root[root] == root).all():
            break
    at, most = simhash_pigeonring.parts(18)[0]
    assert sum(m + 1 for _, m in simhash_pigeonring.parts(18)) == 19 and sum(len(x) for x, _ in simhash_pigeonring.parts(18)) == 128
    g, edges = simhash_pigeonring._search(f[::2], f[1::2], at, most, 18)
    assert edges.shape[1] and (simhash_pigeonring.distance(g[edges[0]], g[edges[1]]) <= 18).all()
    frame_ = spark.createDataFrame([(bytearray(x.tobytes()),) for x in f], "f binary")
    got = {bytes(r.node): bytes(r.root) for r in simhash_pigeonring.components(simhash_pigeonring.within(frame_, 18)).collect()}
    want = {}
    for i, r in enumerate(root.tolist()):
        want.setdefault(r, set()).add(f[i].tobytes())
    assert got == {x: min(g) for g in want.values() if len(g) > 1 for x in g}


def test_blocks_of_fingerprints_meet_each_other(spark, monkeypatch):
    rng = np.random.default_rng(37)
    base = rng.integers(0, 2, (2000, 128), dtype=np.uint8)
    near = base.copy()
    near[np.arange(2000)[:, None], rng.random((2000, 128)).argsort(1)[:, :18]] ^= 1
    x, y = (np.packbits(b, axis=1) for b in (base, near))
    monkeypatch.setattr(simhash_pigeonring, "BLOCK", 900)
    prints = spark.createDataFrame([(bytearray(f.tobytes()),) for f in np.concatenate([x, y])], "f binary")
    got = {(bytes(r.a), bytes(r.b)) for r in simhash_pigeonring.within(prints, 18).collect()}
    assert got == {tuple(sorted((a.tobytes(), b.tobytes()))) for a, b in zip(x, y, strict=True)}


def test_few_pairs_of_large_blocks_are_compared():
    # of unrelated fingerprints a few in a thousand share a bucket for some flip, and each is sent once a block and segment
    for at, most in simhash_pigeonring.parts(18):
        assert len(simhash_pigeonring._flips(len(at), most)) / (1 << len(at)) < 5e-4


def test_few_pairs_of_uneven_fingerprints_are_compared():
    # bits of uneven weight share buckets far oftener than even ones; with six segments 0.0095 of all pairs were compared
    rng = np.random.default_rng(43)
    bits = rng.random((2000, 128)) < np.repeat([0.2, 0.35, 0.5, 0.7], 32)
    apart = bits[:1000, None] ^ bits[None, 1000:]
    assert sum((apart[:, :, at].sum(2) <= most).mean() for at, most in simhash_pigeonring.parts(18)) < 0.006


@pytest.mark.parametrize(("heavy", "alone"), [(1 << 14, True), (1 << 14, False), (300, True), (300, False)])
def test_turns_of_the_search_join_all_that_agree_in_a_segment(monkeypatch, heavy, alone):
    monkeypatch.setattr(simhash_pigeonring, "HEAVY", heavy)
    rng = np.random.default_rng(41)
    at, most = simhash_pigeonring.parts(18)[0]
    # buckets of one, few and many, near to one another or not
    base = (rng.random((60, 128)) < np.repeat([0.1, 0.3, 0.5, 0.8], 32)).astype(np.uint8)
    bits = np.repeat(base, rng.integers(1, 60, 60), axis=0)
    rest = np.setdiff1d(np.arange(128), at)
    bits[np.arange(len(bits))[:, None], rng.choice(rest, (len(bits), 9))] ^= 1
    far = bits[:150].copy()
    far[:, rest] = rng.integers(0, 2, (150, len(rest)))
    bits = np.concatenate([bits, far])
    bits[np.arange(len(bits)), rng.choice(at, len(bits))] ^= rng.integers(0, 2, len(bits)).astype(np.uint8)
    f = np.unique(np.packbits(bits, axis=1, bitorder="little"), axis=0)
    f = f[rng.permutation(len(f))]
    a, b = (f, None) if alone else (f[: len(f) // 3], f[len(f) // 3 :])
    ends = []
    for turn in range(3):
        g, edges = simhash_pigeonring._search(a, b, at, most, 18, turn, 3)
        assert (simhash_pigeonring.distance(g[edges[0]], g[edges[1]]) <= 18).all()
        ends.append([[x.tobytes() for x in g[e]] for e in edges])
    place = {x.tobytes(): i for i, x in enumerate(f)}
    got, want = np.arange(len(f)), np.arange(len(f))
    found = [(place[x], place[y]) for e in ends for x, y in zip(*e, strict=True)]
    d = simhash_pigeonring._ONES[f[:, None] ^ f[None]].sum(2)
    u = np.unpackbits(f, axis=1, bitorder="little")[:, at].astype(int)
    agree = (d <= 18) & ((u[:, None] != u[None]).sum(2) <= most)
    if not alone:
        agree[: len(a), : len(a)] = agree[len(a) :, len(a) :] = False
    for root, pairs in ((got, found), (want, np.argwhere(agree).tolist())):
        for i, j in pairs:
            if root[i] != root[j]:
                root[np.isin(root, [root[i], root[j]])] = min(root[i], root[j])
    if alone:
        assert (got == want).all()
    else:
        # near ones of one side may be joined besides
        assert all(got[i] == got[j] for i, j in np.argwhere(agree).tolist())
    assert len(np.unique(want)) < len(f) - 100


def test_near_copies_are_grouped_without_exception(spark):
    # with keys of equal bits some of those at the full budget were missed
    rng = random.Random(31)
    texts = [prose(120, rng) for _ in range(1200)]
    for x in list(texts):
        words = x.split()
        for i in rng.sample(range(120), 14):
            words[i] = rng.choice(WORDS)
        texts.append(" ".join(words))
    f, _ = simhash_pigeonring.fingerprints(pa.array(texts))
    apart = simhash_pigeonring.distance(f[:1200], f[1200:])
    assert 400 < (apart <= 18).sum() < 1200
    got = {(r.doc_id, r.duplicate_of, r.distance) for r in simhash_pigeonring.near_duplicates(frame(spark, texts)).collect()}
    assert got == {(i + 1200, i, d) for i, d in enumerate(apart.tolist()) if d <= 18}


def test_stretches_cross_batches():
    rng = random.Random(3)
    key = np.sort(np.array([rng.choice([1, 2, 2, 2, 2, 5, 9, 9, 9]) for _ in range(300)]))
    rows = pa.table({"key": key, "f": [bytes([i % 256, i // 256] + [0] * 14) for i in range(300)]})
    for step in (1, 7, 64, 300):
        out = list(simhash_pigeonring._stretches(rows.to_batches(step)))
        assert np.concatenate([k for k, _ in out]).tolist() == key.tolist()
        assert np.concatenate([f for _, f in out])[:, 0].tolist() == [i % 256 for i in range(300)]
        assert all(a[-1] != b[0] for (a, _), (b, _) in zip(out, out[1:], strict=False))


def test_fingerprints_do_not_depend_on_the_batch():
    texts = [prose(50) for _ in range(300)]
    f, _ = simhash_pigeonring.fingerprints(pa.array(texts))
    for i in (0, 7, 299):
        assert (simhash_pigeonring.fingerprints(pa.array([texts[i]]))[0][0] == f[i]).all()


def test_short_texts_and_texts_without_spaces_are_grouped(spark):
    rng = random.Random(17)
    han = ["".join(chr(rng.randint(0x4E00, 0x6E00)) for _ in range(300)) for _ in range(3)]
    thai = "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(200))
    near = han[0][:150] + "\u6f00" + han[0][151:]
    texts = ["Thank you!", "thank  YOU", "thank you all", "!!!", " !!!", "???", "", " ", None, "", *han, han[1], near, thai, thai, "東京", "東京", "東京都", "Thank you!", "x", "Straße 東京", "STRASSE 東京"]
    d = frame(spark, texts)
    got = {(r.doc_id, r.duplicate_of): r.distance for r in simhash_pigeonring.near_duplicates(d).collect()}
    assert set(got) == {(1, 0), (20, 0), (4, 3), (13, 11), (14, 10), (16, 15), (18, 17)}
    assert all(v == 0 for k, v in got.items() if k != (14, 10)) and got[14, 10] <= 18
    assert simhash_pigeonring.keep_one(d).count() == len(texts) - 7
    f, n = simhash_pigeonring.fingerprints(pa.array(["東京 tower2東", "ab cd", "東京", "é東ü"]))
    assert n.tolist() == [4, 2, 2, 3]


def test_pigeonring_loses_no_pair_within_the_budget():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (5000, 16), dtype=np.uint8)
    b = a.copy()
    for r in range(len(a)):
        for i in rng.permutation(128)[: rng.integers(0, 40)]:
            b[r, i // 8] ^= 1 << (i % 8)
    d = simhash_pigeonring.distance(a, b)
    ok = simhash_pigeonring.pigeonring(a, b, 18)
    other = simhash_pigeonring.pigeonring(a, np.roll(b, 1, axis=0), 18)
    assert ok[d <= 18].all() and other.mean() < 0.02


def test_components_by_brute_force(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r.node: r.root for r in simhash_pigeonring.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_simhash_groups(spark, odd, empty):
    rng = random.Random(9)
    base = prose(300, rng).split()
    texts = [prose(300, rng) for _ in range(30)]
    for i in range(5):
        x = list(base)
        for _ in range(3):
            x[rng.randrange(300)] = rng.choice(WORDS)
        texts.append(" ".join(x))
    texts += [texts[0]] * 3
    d = frame(spark, texts)
    got = {(r.doc_id, r.duplicate_of) for r in simhash_pigeonring.near_duplicates(d).collect()}
    assert got == {(i, 30) for i in range(31, 35)} | {(i, 0) for i in range(35, 38)}
    kept = simhash_pigeonring.keep_one(d)
    assert kept.columns == d.columns and kept.count() == 38 - 7
    assert simhash_pigeonring.near_duplicates(empty).count() == 0
    assert {(r.doc_id, r.duplicate_of) for r in simhash_pigeonring.near_duplicates(odd).collect()} == {(4, 3), (5, 3)}
    assert simhash_pigeonring.keep_one(odd).count() == odd.count() - 2


# line dedup ------------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = {}, []
    for i, x in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(x.split("\n")):
            if line.strip(" "):
                seen.setdefault(line.strip(" "), (i, n))
    for i, x in rows:
        if x is None:
            out.append((i, None))
            continue
        lines = x.split("\n")
        kept = [s for n, s in enumerate(lines) if not s.strip(" ") or seen[s.strip(" ")] == (i, n)]
        if any(s.strip(" ") for s in kept) or not any(s.strip(" ") for s in lines):
            out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (5, 2)])
def test_line_dedup_by_brute_force(spark, batches, fanout):
    rng = random.Random(6)
    lines = [f"line {i}" for i in range(60)] + ["", "  ", " line 3 "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(80)] + [(80, None), (81, ""), (3, "line 900\nline 3")]
    rows += [rows[10]]
    d = frame(spark, [x for _, x in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(d, batches=batches, fanout=fanout).collect()), key=str)
    want = brute_lines(rows)
    # of the two texts of id 3 either may come first
    swapped = brute_lines([(i, x) for i, x in rows if i != 3] + [(2.5 if "900" in x else 3, x) for i, x in rows if i == 3])
    swapped = sorted(((3 if i == 2.5 else i, x) for i, x in swapped), key=str)
    assert got in (want, swapped)
    assert spark.catalog.listTables() == [] or not any("loomkg" in t.name for t in spark.catalog.listTables())


def test_line_dedup_batches_any_id_that_has_an_order(spark):
    rng = random.Random(16)
    rows = [(f"doc-{i:07d}", "\n".join(f"line {rng.randrange(80)}" for _ in range(4))) for i in range(60)]
    d = spark.createDataFrame(rows, "`the.id` string, `the.text` string")
    assert len(line_dedup._batches(d, "the.id", 4)) == 4
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(d, "the.id", "the.text").collect())
    assert got == sorted(brute_lines(rows))
    ids = spark.createDataFrame([(i, str(i)) for i in range(40)], "n int, t string")
    for kind in ("date", "timestamp", "decimal(9,2)", "double", "string", "binary"):
        k = {"date": "date_add(date'2020-01-01', n)", "timestamp": "timestamp_seconds(n)", "binary": "encode(cast(n as string), 'utf-8')"}.get(kind, f"cast(n as {kind})")
        parts = line_dedup._batches(ids.selectExpr(f"{k} AS k", "t"), "k", 4)
        assert len(parts) == 4 and sum(p.count() for p in parts) == 40


def test_line_dedup_edge_cases(spark, odd, empty):
    out = line_dedup.dedup_lines(odd, length_col="n_chars")
    assert out.columns == odd.columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert 4 not in ids and ids.count(3) == 2 and None in ids
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert line_dedup.dedup_lines(empty).count() == 0


# license ---------------------------------------------------------------------------------------------------


def test_license_texts_and_headers_are_found_by_paragraph(spark):
    import textwrap

    def body(*names):
        return "\n\n".join(textwrap.fill(license_scan.TEMPLATES[n], 70) for n in names)

    mit = "MIT License\n\nCopyright (c) 2020 A. N. Author\n\n" + body("MIT permission") + "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n" + body("MIT disclaimer")
    header = "x = 1\n\n" + body("Apache-2.0 header") + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + body("Apache-2.0 header terms")
    d = frame(spark, [mit, header, "// SPDX-License-Identifier: MIT", prose(400)])
    got = {(r.doc_id, r.license) for r in license_scan.license_matches(d).collect()}
    assert got == {(0, "MIT permission"), (0, "MIT disclaimer"), (1, "Apache-2.0 header"), (1, "Apache-2.0 header terms"), (2, "SPDX MIT")} | {(1, "Apache-2.0")}


def test_license_scan_by_brute_force(spark, odd, empty):
    import re

    def grams(x):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in x))
        return set(zip(w, w[1:], strict=False))

    rng = random.Random(1)
    notes = list(license_scan.TEMPLATES.values())
    texts = []
    for _ in range(60):
        lines = [prose(rng.randint(0, 12), rng) if rng.random() < 0.5 else rng.choice(notes) for _ in range(6)]
        for i, x in enumerate(lines):
            w = x.split()
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.2 and len(w) > 2:
                w[1] += "\n"
            lines[i] = " ".join(w)
        texts.append("\n".join(lines) if rng.random() < 0.5 else "\n\n".join(lines))
    want = set()
    for i, x in enumerate(texts):
        units = [("line", n, u) for n, u in enumerate(x.split("\n"))] + [("paragraph", n, u) for n, u in enumerate(re.split("\n{2,}", x)) if "\n" in u.strip("\n")]
        for kind, n, u in units:
            for name, note in license_scan.TEMPLATES.items():
                a, b = grams(u), grams(note)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.7:
                    want.add((i, kind, n, name, round(2 * len(a & b) / (len(a) + len(b)), 6)))
    got = [tuple(r) for r in license_scan.license_matches(frame(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert license_scan.license_matches(odd).count() == 0 and license_scan.license_matches(empty).count() == 0
    assert license_scan.license_matches(frame(spark, ["Released under the MIT License."]), templates={}).count() == 0


def test_license_scan_reports_every_license_line_of_the_fixture():
    import re

    import pyarrow.parquet as pq

    known = license_scan.Templates(license_scan.TEMPLATES, 0.7)
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].combine_chunks()
    found = {(d, p) for ds, kind, place, _, _ in license_scan.scan(docs, known) if kind == "line" for d, p in zip(ds.tolist(), place.tolist(), strict=True)}
    line = re.compile(r"all rights reserved\W*|.*\b(licensed under|under the MIT License|waived all copyright|Mozilla Public License)\b.*", re.I)
    planted = {(i, n): x for i, text in enumerate(docs.to_pylist()) for n, x in enumerate((text or "").split("\n")) if len(x.split()) < 20 and line.fullmatch(x.strip())}
    assert sum(x.strip().lower().startswith("all rights") for x in planted.values()) > 50
    assert not [x for at, x in planted.items() if at not in found]


# packing ---------------------------------------------------------------------------------------------------


def test_packing_totals_follow_splits_not_rows(spark, tmp_path):
    rng = random.Random(41)
    docs = frame(spark, [prose(rng.randint(1, 20), rng) for _ in range(4000)])
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    some = spark.read.parquet(str(tmp_path / "d")).where("doc_id % 2 = 1")
    assert len(packing._totals(packing._placed(some, "doc_id", "text"))) <= 3
    rows = sorted(packing.pack(some, 64).collect())
    want = [t for r in some.orderBy("doc_id").collect() for t in r.text.split()]
    assert [t for r in rows for t in r.text.split(" ")] == want and [r.window_id for r in rows] == list(range(len(rows)))
    # behind a shuffle a split has no order of its own: documents then follow one another by id
    mixed = sorted(packing.pack(some.repartition(5), 64).collect())
    assert [t for r in mixed for t in r.text.split(" ")] == want


def test_packing_round_trip(spark, odd, empty, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng.randint(0, 300), rng) for _ in range(200)] + [None, ""]
    d = frame(spark, texts)
    d.repartition(7).write.parquet(str(tmp_path / "d"))
    for docs in (d, spark.read.parquet(str(tmp_path / "d"))):
        rows = sorted(packing.pack(docs, 64).collect())
        assert [r.window_id for r in rows] == list(range(len(rows)))
        assert all(r.tokens == 64 for r in rows[:-1]) and all(len(r.text.split(" ")) == r.tokens == sum(r.lengths) for r in rows)
        back = {}
        for r in rows:
            w = r.text.split(" ")
            for k, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
                back.setdefault(k, []).extend(w[s : s + n])
        assert {k: " ".join(v) for k, v in back.items()} == {i: " ".join(x.split()) for i, x in enumerate(texts) if x and x.split()}
    assert packing.pack(empty, 64).count() == 0
    assert sum(r.tokens for r in packing.pack(odd, 64).collect()) == sum(len((r.text or "").replace("\0", " ").split()) for r in odd.collect())


# decontamination -------------------------------------------------------------------------------------------


def brute_longest(words, items, gram):
    out = np.zeros(len(words), int)
    grams = {tuple(x[i : i + k]) for x in items for k in range(gram, 60) for i in range(len(x) - k + 1)}
    for i in range(len(words)):
        for k in range(gram, min(59, i + 1) + 1):
            if tuple(words[i - k + 1 : i + 1]) in grams:
                out[i] = k
    return out


def test_automaton_longest_matches_by_brute_force():
    rng = random.Random(7)
    few = [f"w{i}" for i in range(6)]
    items = [[rng.choice(few) for _ in range(rng.randint(4, 30))] for _ in range(12)]
    texts = [[rng.choice(few) for _ in range(80)] for _ in range(15)] + [[*items[0], "zz", *items[1]]]

    def hashes(x):
        buf, offs = B.flat(pa.array([" ".join(x)]))
        s, e, _ = B.spans(buf, offs, B.WORDS)
        return B.hashes(buf, B.WORDS, s, e)

    for cut in (12, 5):
        parts = [decontaminate.Automaton.of([hashes(x) for x in items[i : i + cut]], 3) for i in range(0, 12, cut)]
        for x in texts:
            h = hashes(x)
            best = np.max([p.spans(h, np.array([0, len(h)]), 13, 0.8)[1] for p in parts], axis=0)
            assert best.tolist() == brute_longest(x, [i for i in items if len(i) >= 3], 3).tolist()


def test_decontaminate_removes_items_and_nothing_else(spark, odd, empty, items):
    item = items.where("item_id = 0").first().text
    a, b = prose(40), prose(50)
    texts = [f"{a}. {item.upper()}, {b}", f"{a} {b}", item, f"{a} {' '.join(item.split()[:7])} {b}", f"{a} {' '.join(item.split()[3:20])} {b}", None, "short one", f"{a}\nSHORT one.\n{b} short one"]
    d = frame(spark, texts)
    out = {r.doc_id: r for r in decontaminate.decontaminate(d, items).collect()}
    assert out[0].leaked and item.split()[9].upper() not in out[0].text and a in out[0].text and b in out[0].text and out[0].longest_match == 30
    assert [out[i].leaked for i in range(8)] == [True, False, True, False, True, False, True, True]
    # an item of two words goes where it is a line of its own, and nowhere else
    assert out[7].text == f"{a}\n.\n{b} short one" and out[7].removed_words == 2 and out[6].drop
    assert out[2].drop and not out[0].drop and out[5].text is None and out[1].text == texts[1]
    kept = decontaminate.clean_documents(d, items, length_col="n_chars")
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 1, 3, 4, 5, 7}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    assert decontaminate.decontaminate(odd, items).where("leaked").count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0 and decontaminate.clean_documents(empty, items).count() == 0
    assert decontaminate.decontaminate(d, items.limit(0)).where("leaked").count() == 0
    small = decontaminate.decontaminate(d, items, part_words=5)
    assert {r.doc_id for r in small.where("leaked").collect()} == {0, 2, 4, 6, 7}


def test_decontaminate_in_groups_of_parts_gives_the_same(spark, monkeypatch):
    rng = random.Random(29)
    notes = [prose(rng.randint(1, 40), rng) for _ in range(12)]
    items = spark.createDataFrame([(i, x) for i, x in enumerate(notes)], "item_id bigint, text string")
    texts = [" ".join([prose(rng.randint(0, 30), rng), *rng.sample(notes, rng.randint(0, 3)), prose(5, rng)]) for _ in range(40)] + [None, "", notes[0] + "\n" + notes[1]]
    d = frame(spark, texts)
    want = sorted(decontaminate.decontaminate(d, items).collect())
    kept = sorted(decontaminate.clean_documents(d, items, length_col="n_chars").collect())
    assert any(r.leaked for r in want)
    monkeypatch.setattr(decontaminate, "HELD", 2)
    assert len(decontaminate.automata(items, part_words=40)) > 4
    assert sorted(decontaminate.decontaminate(d, items, part_words=40).collect()) == want
    assert sorted(decontaminate.clean_documents(d, items, length_col="n_chars", part_words=40).collect()) == kept


# upper and lower case --------------------------------------------------------------------------------------


def accented(n, rng):
    return " ".join("".join(rng.choice("abcdéñüçøжλ") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_lowered_follows_unicode_and_keeps_every_word_in_place():
    texts = ["CIÓN Über ÉTÉ", None, "", "ΟΔΟΣ, ЖУК", "\u212a\u0130 Ⱥx", "plain ASCII"]
    buf, offs = B.lowered(pa.array(texts))
    got = [bytes(buf[a:b]).decode() for a, b in zip(offs, offs[1:], strict=False)]
    assert got == [(x or "").replace("\u0130", "i").lower().replace("ς", "σ") for x in texts]
    assert B.spans(buf, offs, B.WORDS)[2].tolist() == B.spans(*B.flat(pa.array(texts)), B.WORDS)[2].tolist()
    broken = pa.array([b"\xff\xc3 \xc3\x89A"], pa.binary()).view(pa.string())
    assert bytes(B.lowered(broken)[0]) == b"\xff\xc3 \xc3\xa9a"


def test_capitals_with_accents_match_in_every_operator(spark):
    rng = random.Random(31)
    item, base = accented(30, rng), accented(120, rng)
    items = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    d = frame(spark, [f"{base} {item.upper()} {base}", base.upper(), base, f"{base[:200]} {item.upper()}. Ende"])
    out = {r.doc_id: r for r in decontaminate.decontaminate(d, items).collect()}
    assert out[0].text == f"{base}  {base}" and out[0].longest_match == 30 and out[3].removed_words == 30 and out[3].text == f"{base[:200]} . Ende"
    assert not out[1].leaked and not out[2].leaked
    kept = {r.doc_id: r.text for r in decontaminate.clean_documents(d, items).collect()}
    assert kept[0] == out[0].text and kept[1] == base.upper()
    f, _ = simhash_pigeonring.fingerprints(pa.array([base, base.upper()]))
    assert (f[0] == f[1]).all()
    assert {(r.doc_id, r.duplicate_of) for r in simhash_pigeonring.near_duplicates(d.where("doc_id in (1, 2)")).collect()} == {(2, 1)}
    spans = {(r.doc_id, r.start_word + r.n_words) for r in suffix_dedup.repeats(d.where("doc_id in (1, 2)")).collect()}
    assert spans == {(1, 120), (2, 120)}
    x = toxicity.features(pa.array(["ESTÚPIDO DÉBILE", "estúpido débile", "3STÚPIDO", "3stúpido"]), toxicity.Lexicon())
    assert x[0, 1] == 2 == x[1, 1] and x[0, 2] == x[1, 2] and x[2, 13] == x[3, 13] > 0
