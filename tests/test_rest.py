"""Vectors, text, entity resolution, models, plans, logs, streams, SQL surface, and all queries against their SQL."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkg import queries as base
from loomkg.functions import models, text
from loomkg.operators import adjacency, entity_resolution, metrics, vector
from loomkg.plans import knowledge, sessions
from loomkg.sources import logs
from loomkg.streaming import deltas
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, con, name):
    if name.startswith("select_") or name in base.ORACLES:
        assert oracle.differ(con, base.QUERIES[name](spark, SF), base.ORACLES[name]) is None
    else:
        assert base.QUERIES[name](spark, SF).count() > 0


def vec(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def test_distances(spark):
    d = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = d.select(*[F.round(vector.distance(m, F.col("a"), F.col("b")), 6).alias(m) for m in vector.METRICS]).collect()
    assert [r.l2 for r in got] == [0, 2, 4, 2] and [r.cosine for r in got] == [0, 1, 2, 1] and got[0].inner_product == -5
    with pytest.raises(ValueError, match="metric"):
        vector.check_metric("dot")


def test_blob_round_trip(spark):
    d = vec(spark, [(1, [0.5, -2.0])])
    assert d.select(vector.from_blob(vector.to_blob(F.col("vector")), 2).alias("v")).first().v == [0.5, -2.0]
    with pytest.raises(Exception, match="expected 12 bytes"):
        d.select(vector.from_blob(vector.to_blob(F.col("vector")), 3)).collect()


def test_knn_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 8))
    d = vec(spark, [(i, [float(z) for z in v]) for i, v in enumerate(x)])
    q = d.where("id < 7").withColumnRenamed("id", "qid")
    want = {(i, int(j)) for i in range(7) for j in np.argsort(((x[i].astype(np.float32) - x.astype(np.float32)) ** 2).sum(1))[:5]}
    assert {(r.qid, r.id) for r in vector.knn(d, q, 5, "l2").collect()} == want
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    assert {(r.qid, r.id) for r in vector.knn(d, q, 5, "l2").collect()} == want


def test_index(spark, tmp_path):
    with pytest.raises(ValueError, match="required"):
        vector.VectorIndex.create(spark, "x", metric="l2")
    with pytest.raises(ValueError, match="unknown parameter"):
        vector.VectorIndex.create(spark, "x", dimensions=2, colour=1)
    ix = vector.VectorIndex.create(spark, str(tmp_path / "ix"), dimensions=2, metric="l2", cells=2)
    assert ix.insert(vec(spark, [(1, [0.0, 0.0]), (2, [10.0, 0.0]), (None, [0.0, 10.0])])) == 3
    q = spark.createDataFrame([(0, [0.1, 0.1])], "qid long, vector array<float>")
    top = sorted(ix.search(q, 2).collect(), key=lambda r: r.rank)
    assert top[0].id == 1 and top[0].distance < 1
    with pytest.raises(ValueError, match="duplicate"):
        ix.insert(vec(spark, [(2, [1.0, 1.0])]))
    with pytest.raises(ValueError, match="dimensions"):
        ix.insert(vec(spark, [(9, [1.0])]))
    with pytest.raises(ValueError, match="no such id"):
        ix.delete([77])
    with pytest.raises(ValueError, match="delete and insert"):
        ix.update(1)
    ix.delete([2])
    again = vector.VectorIndex.load(spark, ix.path)
    assert {r.id for r in again.search(q, 5, exact=True).collect()} == {1, 3}
    again.insert(vec(spark, [(2, [5.0, 5.0])]))
    again.compact()
    assert {r.id for r in again.rows().collect()} == {1, 2, 3} and again.get(2).first().distance == 0


def test_index_recall(spark):
    assert base.QUERIES["recall_ivf"](spark, SF).first().recall >= 0.8


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_knn_searches_for_every_row(spark, metric):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    dot, sq = x @ x.T, (x * x).sum(1)
    dist = {"l2": sq[:, None] + sq - 2 * dot, "cosine": 1 - dot / np.sqrt(sq[:, None] * sq), "inner_product": -dot}[metric]
    got = {}
    for r in base.QUERIES[f"knn_{metric}_all"](spark, SF).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.distance
    assert set(got) == set(ids.tolist())
    for i, q in enumerate(ids.tolist()):
        assert [got[q][k] for k in sorted(got[q])] == pytest.approx(np.sort(dist[i])[:10].tolist(), abs=2e-5)


def test_bm25_takes_twenty_terms_by_brute_force(spark):
    import math
    import re
    from collections import Counter

    def words(x):
        return [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]

    docs = {r.doc_id: Counter(words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    mean = sum(c.total() for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    want = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect():
        q = list(dict.fromkeys(words(r.text)[:20]))
        hits = {d: c for d, c in docs.items() if q and all(w in c for w in q)}
        score = {d: sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in q) for d, c in hits.items()}
        for d in sorted(score, key=lambda d: (-round(score[d], 9), d))[:10]:
            want[r.item_id, d] = score[d]
    got = {(r.qid, r.doc_id): r.score for r in base.QUERIES["bm25_topk"](spark, SF).collect()}
    assert want and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-6 * max(1, want[k]) for k in want)


def test_jaro_winkler():
    jw = text.jaro_winkler
    assert abs(jw("martha", "marhta") - 0.9611) < 1e-3 and jw("", "") == 1 and jw("hello", "") == 0 and jw("abc", "xyz") == 0
    assert jw("hello", "hallo") == jw("hallo", "hello") and jw("sony vaio vpceb15fm", "sony vaio vpc-eb15fm") > 0.9
    assert jw("canon powershot sd1200", "canon sd1200 powershot") > 0.7


def test_chunkers(spark):
    long = "One sentence here. " * 200
    parts = text.char_chunks(long, 500)
    assert all(len(p) <= 500 for p in parts) and all(p.endswith(".") for p in parts) and parts[0] in long
    paras = text.paragraph_chunks("\n\n".join(f"para {i} " + "w " * 100 for i in range(20)), 800, 100)
    assert all(e - s <= 1000 for s, e, _ in paras) and len(paras) > 3
    d = spark.createDataFrame([(1, long), (2, None), (3, "")], "id long, text string")
    assert text.chunk_rows(d, "id", "text", size=500).select("id").distinct().count() == 1
    assert text.chunk_rows(d, "id", "text", "paragraph").count() >= 1


def test_entity_resolution(spark):
    rows = [(1, "Acme Corp", "a", [1.0, 0.0]), (2, "ACME corp", "b", [0.99, 0.05]), (3, "Zeta", "a", [0.0, 1.0]), (4, "Acme Corp", "a", [1.0, 0.01])]
    e = spark.createDataFrame(rows, "entity_id long, name string, source string, vector array<float>")
    scored = {(r.a, r.b): r.score for r in entity_resolution.score_pairs(entity_resolution.blocking(e, 3, 0.4), e).collect()}
    assert scored[1, 4] == 1.0 and scored[1, 2] == 0.9 and (1, 3) not in scored
    guarded = entity_resolution.score_pairs(entity_resolution.blocking(e, 3, 0.4), e, type_guard="same_source")
    assert {(r.a, r.b) for r in guarded.collect()} == {(1, 2), (2, 4)}
    for how in ("leiden", "components"):
        c = {r.entity_id: r.cluster_id for r in entity_resolution.resolve(e, 3, 0.4, 0.4, cluster_by=how, eb_threshold=100.0).collect()}
        assert c[1] == c[2] == c[4] != c[3] and len(c) == 4
    j = json.loads(entity_resolution.clusters_json(entity_resolution.resolve(e, 3, 0.4, 0.4)).first().json)
    assert set(j["clusters"]) == {"1", "2", "3", "4"}
    m = spark.createDataFrame([("x", "p", 3), ("y", "q", 1)], "name string, entity_type string, mention_count long")
    canon = entity_resolution.canonicalise(m, spark.createDataFrame([("x", 1), ("y", 1)], "name string, cluster_id int"))
    assert {tuple(r) for r in canon.collect()} == {("x", "x"), ("y", "x")}
    assert [tuple(r) for r in entity_resolution.coalesce_nodes(m, canon).collect()] == [("x", "p", 4)]


def test_metrics_of_nothing(spark):
    one = spark.createDataFrame([(1, 1), (2, 2)], "id int, cluster int")
    assert metrics.pairwise(one, one).first().f1 == 1.0 and metrics.pairwise(one, one, 0.0).first().f1 == 0.0
    assert metrics.bcubed(one, one).first().f1 == 1.0
    assert metrics.set_f1(one.limit(0), one.limit(0)).first().f1 == 0.0
    rel = spark.createDataFrame([(1, 1), (1, 2)], "qid int, id int")
    assert metrics.retrieval_recall(rel, rel, 1).first().recall == 2.0


def test_models(spark):
    r = models.ModelRegistry()
    r.register("e", models.HashEmbedder)
    r.register("c", models.RuleExtractor)
    with pytest.raises(ValueError, match="already"):
        r.register("e", models.HashEmbedder)
    assert r.dim("e") == 64 and r.frame(spark).count() == 2
    d = spark.createDataFrame([("Ada met Bob. Bob left.",), (None,)], "t string")
    out = d.select(models.embed(r, "e", F.col("t")).alias("v"), models.token_count(r, "e", F.col("t")).alias("n"), models.extract(r, "c", F.col("t")).alias("x"), models.summarize(r, "c", F.col("t")).alias("s")).collect()
    assert abs(np.linalg.norm(out[0].v) - 1) < 1e-6 and out[0].n == 7 and out[1].v is None
    assert [e.text for e in out[0].x.entities] == ["Ada", "Bob"] and out[0].x.relations[0].tail == "Bob"
    with pytest.raises(ValueError, match="both label lists"):
        models.extract(r, "c", F.col("t"), ["a"], None)
    with pytest.raises(ValueError, match="no such model"):
        r.unregister("z")
    assert models.parse_extraction('{"entities": [') == models.EMPTY and models.parse_extraction('[{"text": "a"}]')["entities"]
    assert models.strip_think_text("<think>a</think>  b") == "b" and models.strip_think_text("<think>a") == "" and models.strip_think_text("c") == "c"
    g = spark.createDataFrame([("g", x) for x in "abcd"] + [("h", "z")], "g string, m string")
    assert [x.group_id for x in models.label_groups(r, "c", g, "g", "m").collect()] == ["g"]


def test_plans(spark):
    dag, log = knowledge.Dag(), []
    dag.add("a", lambda: log.append("a"), stale=lambda: False)
    dag.add("b", lambda: log.append("b"))
    dag.add("c", lambda: log.append("c"), ("a", "b"), lambda: False)
    assert dag.run() == ["b", "c"]
    chunks = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    assert knowledge.pending(chunks, chunks.where("chunk_id = 1")).count() == 1
    names = spark.createDataFrame([("b",), ("a",), ("b",)], "name string")
    known = spark.createDataFrame([(5, "a")], "rowid long, name string")
    assert [tuple(r) for r in knowledge.embedding_map(names, known).collect()] == [(6, "b")]


def test_shell_commands(spark):
    line = "FOO=1 sudo -n /usr/bin/git status | grep x && ls; env A=b make test || true"
    d = spark.createDataFrame([(1, line), (2, None), (3, "for f in a b; do (cd /tmp); done"), (4, "if nohup ./run.sh; then echo; fi")], "id long, line string")
    got = {}
    for r in sessions.cli_calls(d, "id", "line").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.call)
    assert got == {1: ["git", "grep", "ls", "make", "true"], 3: ["cd"], 4: ["run.sh", "echo"]}


def test_event_calls(spark):
    import json

    def tool(name, **given):
        return {"type": "tool_use", "name": name, "input": given}

    content = [
        tool("Bash", command="cd x && make -j 4 -C sub all CC=gcc --silent test 2>&1 | tee log"), tool("Skill", skill=" pdf "), tool("Skill"), tool("Agent", subagent_type="plan"), tool("Read", file="a"), tool(""),
        {"type": "text", "text": "a <system-reminder>Contents of /a/b.md: x\nContents of /c.md</system-reminder> Contents of /no.md"}, {"type": "thinking"},
    ]
    d = spark.createDataFrame([(1, json.dumps({"content": content})), (2, json.dumps({"content": "plain"})), (3, None)], "id long, message string")
    got = sorted((r.ord, r.call_type, r.call_name) for r in sessions.event_calls(d, "id", "message").collect())
    want = [(0, "tool", "Bash"), (0, "cli", "cd"), (0, "cli", "make"), (0, "make_target", "all"), (0, "make_target", "test"), (0, "cli", "tee"), (1, "skill", "pdf"), (2, "tool", "Skill"), (3, "subagent", "plan"), (4, "tool", "Read"), (6, "rule", "/a/b.md"), (6, "rule", "/c.md")]
    assert got == sorted(want)


def test_message_kinds(spark):
    rows = [
        ("user", False, "tool_result", ""), ("user", True, "string", ""), ("assistant", None, "tool_use", ""), ("user", None, "text", "x"), ("odd", None, None, ""), ("user", None, "string", "hello"),
        ("user", None, "string", " \n<task-notification>done"), ("assistant", None, "thinking", ""), ("assistant", None, "text", ""), ("system", None, "string", "x"), ("user", None, "string", None),
    ]
    d = spark.createDataFrame(rows, "k string, m boolean, b string, t string")
    kinds = [r.x for r in d.select(sessions.message_kind(F.col("k"), F.col("m"), F.col("b"), F.col("t")).alias("x")).collect()]
    assert kinds == ["tool_result", "meta", "tool_use", "user_text", "other", "human", "task_notification", "thinking", "assistant_text", "other", "human"]


def test_knn_breaks_ties_by_id(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 3000)
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, vector array<float>")
    for metric in ("l2", "cosine", "inner_product"):
        got = {(r.qid, r["rank"]): r.id for r in vector.knn(v, q, 3, metric).collect()}
        assert got == {(a, n + 1): x for a in (1, 2) for n, x in enumerate(sorted(ids)[:3])}


def test_knn_distances_are_rounded_once(spark):
    # 1 - cos is 0.6753444998: to nine digits and then to six it would be 0.675345
    c = 1 - 0.6753444998
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [c, (1 - c * c) ** 0.5])], "id long, vector array<double>")
    got = vector.knn(v, v.withColumnRenamed("id", "qid"), 1, "cosine", self_join=True).select("qid", "id", F.round("distance", 6).alias("d")).collect()
    assert {tuple(r) for r in got} == {(1, 2, 0.675344), (2, 1, 0.675344)}


def test_knn_self_join_equals_its_sql_in_every_digit(spark, con):
    rel = con.sql(base.ORACLES["knn_self_join"])
    want = {tuple(r) for r in rel.fetchall()}
    assert {tuple(r) for r in base.QUERIES["knn_self_join"](spark, SF).select(*rel.columns).collect()} == want


def test_index_is_loaded_before_anything_is_inserted(spark, tmp_path):
    vector.VectorIndex.create(spark, str(tmp_path / "i"), dimensions=2)
    index = vector.VectorIndex.load(spark, str(tmp_path / "i"))
    assert index.dimensions == 2 and index.rows().count() == 0
    assert index.insert(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>")) == 1


def test_logs(spark, tmp_path):
    p = tmp_path / "logs"
    p.mkdir()
    (p / "a.jsonl").write_text('{"uuid": "1", "type": "user"}\nnot json\n{"uuid": "2", "parentUuid": "1", "type": "assistant"}\n')
    found = logs.files(spark, str(p))
    assert found.count() == 1 and logs.changed(found, found).count() == 0 and logs.changed(found, found.limit(0)).count() == 1
    ev = logs.read_events(spark, str(p))
    assert ev.where("broken IS NOT NULL").count() == 1
    e = ev.select("uuid", F.col("parentUuid").alias("parent_uuid"))
    assert [tuple(r) for r in sessions.parent_edges(e).collect()] == [("1", "2")]
    assert logs.read_text(spark, str(p / "a.jsonl")).count() == 1


def test_refresh_range_leaves_other_buckets(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    cube = sessions.time_cube(e, ["event_type"], "value")
    path = str(tmp_path / "cube")
    sessions.refresh_range(cube, path)
    n = spark.read.parquet(path).count()
    part = cube.where("granularity = 'daily'").orderBy("bucket").limit(1)
    sessions.refresh_range(part, path)
    assert n - 20 < spark.read.parquet(path).count() <= n


def test_stream_maintains_cache(spark, tmp_path):
    e = spark.createDataFrame([("A", "B", 1.0, 0)], "src string, dst string, weight double, edge_seq long")
    cache = adjacency.AdjacencyCache.create(spark, str(tmp_path / "c"), e)
    schema = "src string, dst string, weight double, op int, seq long"
    spark.createDataFrame([("B", "C", 1.0, 1, 5), ("A", "B", 1.0, 2, 6)], schema).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    deltas.maintain_cache(s, cache, str(tmp_path / "cp")).awaitTermination()
    assert [(r.src, r.dst) for r in cache.table("arcs").collect()] == [("B", "C")]


def test_stream_embeds_new_rows(spark, tmp_path):
    ix = vector.VectorIndex.create(spark, str(tmp_path / "ix"), dimensions=64, cells=2)
    r = models.ModelRegistry()
    r.register("e", models.HashEmbedder)
    spark.createDataFrame([(1, "one text"), (2, "two text")], "id long, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    deltas.embed_new(s, ix, lambda b: b.select("id", models.embed(r, "e", F.col("text")).alias("vector")), str(tmp_path / "cp")).awaitTermination()
    assert {x.id for x in ix.rows().collect()} == {1, 2}


def test_windows_on_a_stream(spark, tmp_path):
    e = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{SF}/events.parquet*")
    q = deltas.windowed(e).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 1000
    assert deltas.sessions(spark.read.parquet(f"{SF}/events.parquet")).agg(F.sum("n")).first()[0] == 1000


def test_sql_surface(spark):
    from loomkg.functions.register import register_all, register_model

    register_all(spark)
    spark.sql("CREATE OR REPLACE TEMP VIEW ed AS SELECT * FROM VALUES ('A','B'), ('B','C'), ('X','Y') AS t(src, dst)")
    assert {tuple(r) for r in spark.sql("SELECT node, depth FROM graph_bfs(TABLE(ed) WITH SINGLE PARTITION, 'A')").collect()} == {("A", 0), ("B", 1), ("C", 2)}
    assert spark.sql("SELECT max(component_id) FROM graph_components(TABLE(ed) WITH SINGLE PARTITION)").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM graph_leiden(TABLE(ed) WITH SINGLE PARTITION)").first()[0] == 5
    for name, args in {"graph_dfs": ", 'A'", "graph_shortest_path": ", 'A', 'C'", "graph_pagerank": "", "graph_degree": "", "graph_node_betweenness": "", "graph_edge_betweenness": "", "graph_closeness": "", "graph_select": ", '+C'"}.items():
        got = spark.sql(f"SELECT * FROM {name}(TABLE(ed) WITH SINGLE PARTITION{args})").collect()
        assert len(got) == (5 if "select" not in name and args == "" and "edge" not in name else 3)
    assert spark.sql("SELECT distance FROM graph_shortest_path(TABLE(ed) WITH SINGLE PARTITION, 'A', 'C') WHERE node = 'C'").first()[0] == 2
    reg = models.ModelRegistry()
    reg.register("em", models.HashEmbedder)
    reg.register("ch", models.RuleExtractor)
    assert len(register_model(spark, reg, "em") + register_model(spark, reg, "ch")) == 8
    assert spark.sql("SELECT size(em_embed('a b')), em_token_count('a b'), ch_summarize('x')").first()[1] == 2
    row = spark.sql("SELECT jaro_winkler('a', 'a') j, vec_l2(array(1F), array(3F)) l, vec_cosine(array(1F), array(-1F)) c, strip_think('<think>x</think> y') s").first()
    assert tuple(row) == (1.0, 4.0, 2.0, "y")


def test_entry_survives_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['loomkg.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'degree_weighted' in q and not any(k.startswith('op') for k in q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])


def test_generators(spark):
    from loomkg.operators.traverse import components
    from loomkg.sources.generators import preferential, random_pairs

    e = random_pairs(spark, 200, 6)
    assert e.count() == 1200 and e.where("src = dst").count() == 0
    p = preferential(spark, 100, 3)
    assert p.count() == 2 * 97 * 3 and components(p).select("component_id").distinct().count() == 1


@pytest.mark.parametrize("name", sorted(n for n in base.QUERIES if n.startswith("select_")))
def test_selectors_of_turns_that_are_not_there(spark, name):
    """In sf0.1 conversation 3 has turns 0 and 1 only."""
    d = SF.replace("sf0.001", "sf0.1")
    assert oracle.differ(oracle.connect(d), base.QUERIES[name](spark, d), base.ORACLES[name]) is None


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
@pytest.mark.parametrize("kind", ["normal", "signs", "zeros", "large", "tiny"])
def test_nearest_of_a_block_by_brute_force(metric, kind):
    """Vectors in batches, by id; ties, lengths beyond float, no length; with and without the pair of a vector with itself."""
    import pyarrow as pa

    rng = np.random.default_rng(42)
    x, q = rng.normal(size=(900, 6)).astype(np.float32), rng.normal(size=(300, 6)).astype(np.float32)
    if kind == "signs":
        x, q = np.sign(x[:, :2]), np.sign(q[:, :2])
    elif kind == "zeros":
        x[::3], q[::5] = 0, 0
    elif kind != "normal":
        x, q = x.astype(float) * (1e16 if kind == "large" else 1e-16), q.astype(float)
    a, b = q.astype(float), x.astype(float)
    dist = np.square(a[:, None] - b[None]).sum(2) if metric == "l2" else vector.matrix_distance(metric, a, b)
    for own in (False, True):
        near = vector._Nearest(metric, 7, own, [pa.array(range(120)), pa.array(range(120, 300))], [q[:120], q[120:]])
        for lo in range(0, 900, 300):
            near.add(pa.array(range(lo, lo + 300)), x[lo : lo + 300])
        rows = near.found().to_pylist()
        got = {i: [] for i in range(300)}
        for r in sorted(rows, key=lambda r: (round(r["distance"], 9), r["i"])):
            got[r["q"]].append(r["i"])
        d = dist.copy()
        if own:
            d[np.arange(300), np.arange(300)] = np.inf
        assert got == {i: np.lexsort((np.arange(900), np.round(d[i], 9)))[:7].tolist() for i in range(300)}


def test_knn_reads_vectors_and_queries_once(spark, monkeypatch):
    """Before, each block of queries was another scan of the vectors, and a task held distances of a whole block."""
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    d = vec(spark, [(i, [float(i), 1.0]) for i in range(30)])
    found = vector.knn(d, d.withColumnRenamed("id", "qid"), 2, "l2", self_join=True)
    # two tables and the layout of the blocks for each; it was a scan for each of the ten blocks
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
    assert {(r.qid, r.id) for r in found.collect() if r["rank"] == 1} == {(i, max(i - 1, 0) if i else 1) for i in range(30)}


def test_index_search_of_all_cells_is_exact(spark, tmp_path):
    rng = np.random.default_rng(1)
    d = vec(spark, [(i, [float(z) for z in v]) for i, v in enumerate(rng.normal(size=(200, 5)))])
    index = vector.VectorIndex.create(spark, str(tmp_path / "i"), dimensions=5, cells=4)
    index.insert(d)
    q = d.withColumnRenamed("id", "qid")
    found = index.search(q, 6, ef_search=128)
    # pairs are compared in blocks, not joined as rows
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda x: {(r.qid, r.id, r["rank"]) for r in x.collect()}
    assert rows(found) == rows(index.search(q, 6, exact=True))
