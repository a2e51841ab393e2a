"""The pipeline, stage by stage, against plain Python on the rows that each stage got."""

import sys
from pathlib import Path

import pyarrow as pa
import pytest

from loomkg.llm import queries as llm
from loomkg.llm import toxicity

sys.path.insert(0, str(Path(__file__).parents[2]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        got = f(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        got.write.parquet(path)
        nxt = spark.read.parquet(path)
        out.append((name, docs.collect(), nxt.collect()))
        docs = nxt
    return out


def test_toxicity_stage(spark, stages):
    _, before, after = stages[0]
    m = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    p = [m.judge(pa.array([r.text]))[0] for r in before]
    assert sorted(after) == sorted(r for r, x in zip(before, p, strict=True) if x < 0.5)


def test_line_stage(stages):
    from tests.llm.test_operators import brute_lines

    _, before, after = stages[1]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(brute_lines([(r.doc_id, r.text) for r in before]))


def test_simhash_stage(spark, stages):
    from loomkg.llm.simhash_pigeonring import distance, fingerprints

    _, before, after = stages[2]
    f, n = fingerprints(pa.array([r.text for r in before]))
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    import numpy as np

    for i in range(len(before)):
        near = np.flatnonzero((distance(np.broadcast_to(f[i], f.shape), f) <= 18) & (n >= 8))
        if n[i] >= 8:
            for j in near:
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(before):
        groups.setdefault(find(i), []).append(r.doc_id)
    want = {min(g) for g in groups.values()}
    got = {r.doc_id for r in after}
    assert got >= want and len(got - want) <= 0.1 * max(1, len(before) - len(want))


def test_decontamination_stage(spark, stages):
    from tests.llm.test_operators import brute_longest

    _, before, after = stages[3]

    def words(x):
        import re

        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in x))

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(x[i : i + 8]) for x in items for i in range(len(x) - 7)}
    now = {r.doc_id: r.text for r in after}
    for r in before:
        w = words(r.text)
        if not any(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7)):
            assert now[r.doc_id] == r.text
        elif r.doc_id in now:
            assert brute_longest(words(now[r.doc_id]), items, 8).max(initial=0) < 13


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert sum(r.tokens for r in after) == sum(len(r.text.split()) for r in before)
    assert {k for r in after for k in r.doc_ids} == {r.doc_id for r in before if r.text.split()}


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_queries_with_sql(spark, name):
    from tests import oracle

    assert oracle.differ(oracle.connect(SF), llm.QUERIES[name](spark, SF), llm.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert llm.QUERIES[name](spark, SF).count() > 0
