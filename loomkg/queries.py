"""Named queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkg.common import new_path
from loomkg.common import table as t
from loomkg.functions import text as tx
from loomkg.operators import adjacency, centrality, community, entity_resolution, metrics, node2vec, selector, traverse, vector
from loomkg.operators.edges import canonical
from loomkg.plans import knowledge, sessions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Graphs of the test tables ---------------------------------------------------------------------------------

TRADE = """trade AS (SELECT s_nationkey a, c_nationkey b, round(sum(l_extendedprice * (1 - l_discount)), 2) w FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 e AS (SELECT a::VARCHAR src, b::VARCHAR dst, w weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) r FROM trade WHERE a <> b) WHERE r <= 3)"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's three best customers abroad."""
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = x.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("w")).where("a <> b")
    best = w.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("w").desc(), "b"))).where("r <= 3")
    return canonical(best, "a", "b", "w")


REPLY = "e AS (SELECT conv_id || '.' || turn AS src, conv_id || '.' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, 1.0::DOUBLE weight FROM conversations QUALIFY dst IS NOT NULL)"


def replies(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").withColumn("node", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return canonical(sessions.sequence_edges(c, "conv_id", ["turn"], "node"))


CUSTSUPP = "e AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst, 1.0::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def custsupp(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return canonical(x.select("o_custkey", "l_suppkey").distinct().select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("s:"), "l_suppkey").alias("dst")))


KNNG = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) x FROM embeddings),
 p AS (SELECT a.vec_id s, b.vec_id d, 1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) dist FROM v a, v b WHERE a.vec_id <> b.vec_id),
 e AS (SELECT s::VARCHAR src, d::VARCHAR dst, round(1 - dist, 6) weight FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(dist, 9), d) r FROM p) WHERE r <= 4)"""


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = vector.knn(v, v.withColumnRenamed("id", "qid"), 4, "cosine", self_join=True)
    return canonical(near.select("qid", "id", F.round(1 - F.col("distance"), 6).alias("w")), "qid", "id", "w")


USERS = "e AS (SELECT 'u:' || user_id AS src, event_type AS dst, value AS weight, ts FROM events)"


def users(spark: SparkSession, d: str, start=None, end=None) -> DataFrame:  # noqa: ANN001
    x = t(spark, d, "events").withColumn("u", F.concat(F.lit("u:"), "user_id"))
    return canonical(x, "u", "event_type", "value", "ts", start, end)


# Centrality ------------------------------------------------------------------------------------------------

_DEG = """, x AS (SELECT src node, {o} o, {z} i FROM e UNION ALL SELECT dst, {z}, {i} FROM e),
 g AS (SELECT node, round(sum(i), 4) in_degree, round(sum(o), 4) out_degree, sum(i) + sum(o) d FROM x GROUP BY 1)
 SELECT node, in_degree, out_degree, round(d, 4) AS degree, round({c}, 4) AS centrality FROM g"""


def _deg(df: DataFrame) -> DataFrame:
    return df.select("node", *[F.round(c, 4).alias(c) for c in ("in_degree", "out_degree", "degree", "centrality")])


@query(f"WITH {TRADE}" + _DEG.format(o="weight", i="weight", z="0.0", c="d"))
def degree_weighted(spark, d):  # noqa: ANN001, ANN201
    return _deg(centrality.degree(trade(spark, d)))


@query(f"WITH {CUSTSUPP}" + _DEG.format(o="weight", i="weight", z="0.0", c="d / ((SELECT count(*) FROM g) - 1)"))
def degree_normalized(spark, d):  # noqa: ANN001, ANN201
    return _deg(centrality.degree(custsupp(spark, d), normalized=True))


@query(f"WITH {TRADE}" + _DEG.format(o="weight", i="0.0", z="0.0", c="d"))
def degree_forward(spark, d):  # noqa: ANN001, ANN201
    return _deg(centrality.degree(trade(spark, d), "forward"))


@query("WITH " + USERS.replace("FROM events", "FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'") + _DEG.format(o="weight", i="weight", z="0.0", c="d"))
def degree_temporal(spark, d):  # noqa: ANN001, ANN201
    import datetime as dt

    return _deg(centrality.degree(users(spark, d, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))))


_LEVELS = """WITH RECURSIVE {g}, a AS (SELECT DISTINCT src, dst FROM ({arcs})), n AS (SELECT src node FROM e UNION SELECT dst FROM e),
 r AS (SELECT node s, node t, 0 d FROM n UNION SELECT r.s, a.dst, r.d + 1 FROM r JOIN a ON r.t = a.src WHERE r.d < 12),
 dist AS (SELECT s, t, min(d) d FROM r GROUP BY 1, 2)"""
_BOTH = "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"
_FWD = "SELECT src, dst FROM e"
_SIGMA = """, g1 AS (SELECT x.s, x.t, x.d, y.t v FROM dist x JOIN a ON x.t = a.dst JOIN dist y ON y.s = x.s AND y.t = a.src AND y.d = x.d - 1),
 sig0 AS (SELECT s, t, 1::DOUBLE n, 0 d FROM dist WHERE d = 0)""" + "".join(f", sig{i} AS (SELECT g1.s, g1.t, sum(p.n) n, {i} d FROM g1 JOIN sig{i - 1} p ON p.s = g1.s AND p.t = g1.v WHERE g1.d = {i} GROUP BY 1, 2)" for i in range(1, 9)) + ", sig AS (" + " UNION ALL ".join(f"SELECT * FROM sig{i}" for i in range(9)) + ")"


@query(_LEVELS.format(g=TRADE, arcs=_FWD) + """ SELECT n.node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1.0) / sum(d) * (count(*) - 1.0) / ((SELECT count(*) FROM n) - 1) ELSE 0 END, 9) AS centrality FROM n JOIN dist ON dist.s = n.node GROUP BY 1""")
def closeness(spark, d):  # noqa: ANN001, ANN201
    return centrality.closeness(trade(spark, d)).select("node", F.round("centrality", 9).alias("centrality"))


def _bc_sql(arcs: str, scale: str) -> str:
    return _LEVELS.format(g=TRADE, arcs=arcs) + _SIGMA + f""" SELECT n.node, round(coalesce(c, 0) * {scale}, 6) AS centrality FROM n LEFT JOIN (SELECT p.t node, sum(p.n * q.n / w.n) c FROM sig p JOIN sig q ON q.s = p.t JOIN sig w ON w.s = p.s AND w.t = q.t AND w.d = p.d + q.d WHERE p.t <> p.s AND q.t <> p.t GROUP BY 1) USING (node)"""


@query(_bc_sql(_FWD, "1"))
def node_betweenness(spark, d):  # noqa: ANN001, ANN201
    return centrality.node_betweenness(trade(spark, d)).select("node", F.round("centrality", 6).alias("centrality"))


@query(_bc_sql(_BOTH, "1.0 / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2))"))
def node_betweenness_both_normalized(spark, d):  # noqa: ANN001, ANN201
    return centrality.node_betweenness(trade(spark, d), "both", normalized=True).select("node", F.round("centrality", 6).alias("centrality"))


@query(_LEVELS.format(g=TRADE, arcs=_FWD) + _SIGMA + """ SELECT a.src, a.dst, round(sum(p.n * q.n / w.n), 6) AS centrality FROM a JOIN sig p ON p.t = a.src JOIN sig q ON q.s = a.dst JOIN sig w ON w.s = p.s AND w.t = q.t AND w.d = p.d + q.d + 1 GROUP BY 1, 2""")
def edge_betweenness(spark, d):  # noqa: ANN001, ANN201
    return centrality.edge_betweenness(trade(spark, d)).select("src", "dst", F.round("centrality", 6).alias("centrality"))


# Traversal -------------------------------------------------------------------------------------------------

def _bfs_sql(g: str, arcs: str, start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {g}, a AS (SELECT DISTINCT src, dst FROM ({arcs})),
 r AS (SELECT {start} node, 0 d UNION SELECT a.dst, r.d + 1 FROM r JOIN a ON r.node = a.src WHERE r.d < {depth}),
 m AS (SELECT node, min(d)::INTEGER AS depth FROM r GROUP BY 1)
 SELECT m.node, m.depth, min(p.node) AS parent FROM m LEFT JOIN a ON a.dst = m.node AND m.depth > 0 LEFT JOIN m p ON p.node = a.src AND p.depth = m.depth - 1 GROUP BY 1, 2"""


@query(_bfs_sql(REPLY, _FWD, "'3.0'", 60))
def bfs_forward(spark, d):  # noqa: ANN001, ANN201
    return traverse.bfs(replies(spark, d), "3.0", 60)


@query(_bfs_sql(REPLY, "SELECT dst AS src, src AS dst FROM e", "'3.3'", 60))
def bfs_reverse(spark, d):  # noqa: ANN001, ANN201
    return traverse.bfs(replies(spark, d), "3.3", 60, "reverse")


@query(_bfs_sql(CUSTSUPP, _BOTH, "'s:1'", 3))
def bfs_both_max_depth(spark, d):  # noqa: ANN001, ANN201
    return traverse.bfs(custsupp(spark, d), "s:1", 3, "both")


@query()
def dfs_order(spark, d):  # noqa: ANN001, ANN201
    return traverse.dfs(trade(spark, d), "0", 100, "both")


@query(f"""WITH RECURSIVE {REPLY}, p AS (SELECT '3.0' node, ['3.0'] path UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node)
 SELECT unnest(path) AS node, (generate_subscripts(path, 1) - 1)::DOUBLE AS distance, (generate_subscripts(path, 1) - 1)::INTEGER AS path_order FROM p WHERE node = '3.3'""")
def shortest_path_unweighted(spark, d):  # noqa: ANN001, ANN201
    return traverse.shortest_path(replies(spark, d), "3.0", "3.3")


@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT '0' node, ['0'] path, [0.0::DOUBLE] dist, 0.0::DOUBLE cost UNION ALL SELECT e.dst, list_append(p.path, e.dst), list_append(p.dist, p.cost + e.weight), p.cost + e.weight FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 9 AND p.node <> '21'),
 b AS (SELECT * FROM p WHERE node = '21' ORDER BY round(cost, 4), path LIMIT 1)
 SELECT unnest(path) AS node, round(unnest(dist), 4) AS distance, (generate_subscripts(path, 1) - 1)::INTEGER AS path_order FROM b""")
def shortest_path_weighted(spark, d):  # noqa: ANN001, ANN201
    return traverse.shortest_path(trade(spark, d), "0", "21", weighted=True).select("node", F.round("distance", 4).alias("distance"), "path_order")


@query(f"""WITH RECURSIVE {REPLY}, a AS ({_BOTH}), r AS (SELECT src node, src seen FROM a UNION SELECT a.dst, r.seen FROM r JOIN a ON a.src = r.node),
 m AS (SELECT node, min(seen) root FROM r GROUP BY 1), s AS (SELECT root, count(*) n, dense_rank() OVER (ORDER BY root) - 1 id FROM m GROUP BY 1)
 SELECT node, id::BIGINT AS component_id, n::BIGINT AS component_size FROM m JOIN s USING (root)""")
def components(spark, d):  # noqa: ANN001, ANN201
    return traverse.components(replies(spark, d))


def _pagerank_sql(g: str, rounds: int = 20) -> str:
    head = f"WITH {g}, n AS (SELECT src node FROM e UNION SELECT dst FROM e), o AS (SELECT src node, count(*) c FROM e GROUP BY 1), k AS (SELECT count(*) c FROM n), r0 AS (SELECT node, 1.0::DOUBLE / k.c \"rank\" FROM n, k)"
    for i in range(1, rounds + 1):
        head += f""", r{i} AS (SELECT n.node, 0.15 / k.c + 0.85 * (coalesce(x.s, 0) + coalesce(l.s, 0) / k.c) "rank" FROM n CROSS JOIN k CROSS JOIN (SELECT sum("rank") s FROM r{i - 1} LEFT JOIN o USING (node) WHERE o.c IS NULL) l
 LEFT JOIN (SELECT e.dst node, sum("rank" / o.c) s FROM e JOIN o ON o.node = e.src JOIN r{i - 1} p ON p.node = e.src GROUP BY 1) x ON x.node = n.node)"""
    return head + f' SELECT node, round("rank", 9) AS "rank" FROM r{rounds}'


@query(_pagerank_sql(TRADE))
def pagerank_20(spark, d):  # noqa: ANN001, ANN201
    return traverse.pagerank(trade(spark, d)).select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(CUSTSUPP))
def pagerank_bipartite(spark, d):  # noqa: ANN001, ANN201
    return traverse.pagerank(custsupp(spark, d)).select("node", F.round("rank", 9).alias("rank"))


# Community -------------------------------------------------------------------------------------------------

@query(f"""WITH {KNNG}, l AS (SELECT vec_id::VARCHAR node, label FROM embeddings), b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
 c AS (SELECT x.label, sum(weight) tot, sum(CASE WHEN x.label = y.label THEN weight ELSE 0 END) i FROM b JOIN l x ON x.node = src JOIN l y ON y.node = dst GROUP BY 1)
 SELECT round(sum(i) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 6) AS modularity FROM c""")
def modularity_given(spark, d):  # noqa: ANN001, ANN201
    m = t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node"), F.col("label").alias("community_id"))
    return community.modularity(knn_graph(spark, d), m).select(F.round("modularity", 6).alias("modularity"))


@query()
def leiden_knn(spark, d):  # noqa: ANN001, ANN201
    return community.leiden(knn_graph(spark, d))


@query()
def leiden_multi_resolution(spark, d):  # noqa: ANN001, ANN201
    return community.multi_resolution(trade(spark, d))


@query(f"""WITH {TRADE}, n AS (SELECT src node, sum(weight) c FROM (SELECT src, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1),
 m AS (SELECT n_nationkey::VARCHAR node, n_regionkey::BIGINT community_id FROM nation)
 SELECT community_id, node, round(c, 4) AS centrality, "rank"::INTEGER AS "rank" FROM (SELECT m.community_id, n.node, n.c, row_number() OVER (PARTITION BY community_id ORDER BY round(c, 4) DESC, n.node) "rank" FROM n JOIN m USING (node)) WHERE "rank" <= 2""")
def community_representative(spark, d):  # noqa: ANN001, ANN201
    m = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").cast("bigint").alias("community_id"))
    return community.representatives(m, _deg(centrality.degree(trade(spark, d))), 2)


# Selector --------------------------------------------------------------------------------------------------

def _sel_sql(parts: str, direction: str, depth: str = "d") -> str:
    """r(node, d) of the selection, with the node index in id order."""
    return f"""WITH RECURSIVE {REPLY}, n AS (SELECT src node FROM e UNION SELECT dst FROM e), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 idx FROM n), {parts}
 SELECT i.node, min({depth})::INTEGER AS depth, '{direction}' AS direction, i.idx::BIGINT AS idx FROM r JOIN i USING (node) GROUP BY ALL"""


def _walk(name: str, seed: str, back: bool, limit: int = 99) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"{name} AS (SELECT {seed} node, 0 d UNION SELECT e.{b}, {name}.d + 1 FROM {name} JOIN e ON e.{a} = {name}.node WHERE {name}.d < {limit})"


@query(_sel_sql(_walk("r", "'3.3'", True), "ancestor"))
def select_ancestors(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "+3.3")


@query(_sel_sql(_walk("r", "'3.0'", False, 2), "descendant"))
def select_descendants(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "3.0+2")


@query(_sel_sql(_walk("u", "'3.2'", True, 1) + ", " + _walk("w", "'3.2'", False) + ", r AS (SELECT * FROM u UNION ALL SELECT * FROM w)", "both"))
def select_both(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "1+3.2+")


@query(_sel_sql(_walk("w", "'3.2'", False) + ", r AS (SELECT node, 0 d FROM w UNION SELECT e.src, r.d + 1 FROM r JOIN e ON e.dst = r.node)", "closure"))
def select_closure(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "@3.2")


@query(_sel_sql(_walk("u", "'3.2'", True) + ", " + _walk("w", "'5.0'", False) + ", r AS (SELECT node, 0 d FROM u UNION SELECT node, 0 FROM w)", "selected"))
def select_union(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "+3.2 5.0+")


@query(_sel_sql(_walk("u", "'3.3'", True) + ", " + _walk("w", "'3.1'", False) + ", r AS (SELECT node, 0 d FROM u WHERE node IN (SELECT node FROM w))", "selected"))
def select_intersection(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "+3.3,3.1+")


@query(_sel_sql(_walk("u", "'3.2'", True) + ", r AS (SELECT node, 0 d FROM n WHERE node NOT IN (SELECT node FROM u))", "selected"))
def select_complement(spark, d):  # noqa: ANN001, ANN201
    return _select(spark, d, "not +3.2")


def _select(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Conversation 3 is shorter in some of the tables; a turn that it lacks selects nothing, as in the SQL."""
    return selector.select(replies(spark, d), text, missing="empty")


# Vectors ---------------------------------------------------------------------------------------------------

_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) x FROM embeddings)"
_DIST = {
    "l2": "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))",
    "cosine": "1 - list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))",
    "inner_product": "-list_dot_product(a.x, b.x)",
}


def _knn_sql(metric: str, k: int, queries: str) -> str:
    return f"""WITH {_VEC}, p AS (SELECT a.vec_id qid, b.vec_id id, {_DIST[metric]} dist FROM v a, v b WHERE {queries})
 SELECT qid, id, round(dist, 6) AS distance, r::INTEGER AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) r FROM p) WHERE r <= {k}"""


def _knn(spark: SparkSession, d: str, metric: str, k: int = 10) -> DataFrame:
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.knn(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), k, metric).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(_knn_sql("l2", 10, "a.vec_id % 100 = 0"))
def knn_l2(spark, d):  # noqa: ANN001, ANN201
    return _knn(spark, d, "l2")


@query(_knn_sql("cosine", 10, "a.vec_id % 100 = 0").replace("round(dist, 6)", "round(dist, 6) + 0.0"))
def knn_cosine(spark, d):  # noqa: ANN001, ANN201
    return _knn(spark, d, "cosine")


@query(_knn_sql("inner_product", 10, "a.vec_id % 100 = 0"))
def knn_inner_product(spark, d):  # noqa: ANN001, ANN201
    return _knn(spark, d, "inner_product")


def _knn_all(spark: SparkSession, d: str, metric: str, k: int = 10) -> DataFrame:
    """Every row is a query; no SQL, as that compares all pairs."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.knn(v, v.withColumnRenamed("id", "qid"), k, metric).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query()
def knn_l2_all(spark, d):  # noqa: ANN001, ANN201
    return _knn_all(spark, d, "l2")


@query()
def knn_cosine_all(spark, d):  # noqa: ANN001, ANN201
    return _knn_all(spark, d, "cosine")


@query()
def knn_inner_product_all(spark, d):  # noqa: ANN001, ANN201
    return _knn_all(spark, d, "inner_product")


@query(_knn_sql("cosine", 5, "a.vec_id <> b.vec_id"))
def knn_self_join(spark, d):  # noqa: ANN001, ANN201
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.knn(v, v.withColumnRenamed("id", "qid"), 5, "cosine", self_join=True).withColumn("distance", F.round("distance", 6))


_SIGNS = "v AS (SELECT vec_id, [sign(embedding[1])::DOUBLE, sign(embedding[2])::DOUBLE] x FROM embeddings)"


@query(_knn_sql("l2", 10, "a.vec_id % 100 = 0").replace(_VEC, _SIGNS))
def knn_ties(spark, d):  # noqa: ANN001, ANN201
    """Vectors of two signs: nearly all distances tie, and the lesser ids win."""
    sign = F.transform(F.slice("embedding", 1, 2), lambda x: F.signum(x))
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), sign.alias("vector"))
    return vector.knn(v, v.where("id % 100 = 0").withColumnRenamed("id", "qid"), 10, "l2").withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def _index(spark: SparkSession, d: str) -> vector.VectorIndex:
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vector.VectorIndex.create(spark, new_path(spark, "ivf"), dimensions=64, cells=16)
    index.insert(v)
    return index


@query("SELECT vec_id AS id, embedding AS vector, 0.0::DOUBLE AS distance FROM embeddings WHERE vec_id = 7")
def knn_point(spark, d):  # noqa: ANN001, ANN201
    return _index(spark, d).get(7).select("id", "vector", "distance")


@query("SELECT vec_id AS id, embedding AS vector FROM embeddings WHERE vec_id NOT IN (1, 3)")
def index_insert_delete_scan(spark, d):  # noqa: ANN001, ANN201
    """Insert all, delete three, insert one of them again, load the index anew and read all that is live."""
    index = _index(spark, d)
    index.delete([1, 2, 3])
    index.insert(t(spark, d, "embeddings").where("vec_id = 2").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return vector.VectorIndex.load(spark, index.path).rows()


@query()
def recall_ivf(spark, d):  # noqa: ANN001, ANN201
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = _index(spark, d)
    q = v.withColumnRenamed("id", "qid")
    return vector.recall_at_k(index.search(q, 10, ef_search=64), vector.knn(v, q, 10, "cosine"))


# Text and entity resolution --------------------------------------------------------------------------------

_JW = "(jaro_similarity({a}, {b}) + 0.1 * p * (1 - jaro_similarity({a}, {b})))"
_PREFIX = "(CASE WHEN {a}[1] <> {b}[1] THEN 0 WHEN {a}[2] <> {b}[2] THEN 1 WHEN {a}[3] <> {b}[3] THEN 2 WHEN {a}[4] <> {b}[4] THEN 3 ELSE 4 END)"


@query(f"WITH n AS (SELECT DISTINCT p_name x FROM part), p AS (SELECT a.x a, b.x b, {_PREFIX.format(a='a.x', b='b.x')} p FROM n a, n b WHERE a.x < b.x) SELECT a, b, round({_JW.format(a='a', b='b')}, 6) AS score FROM p")
def jaro_winkler_pairs(spark, d):  # noqa: ANN001, ANN201
    n = t(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    p = n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return p.select("a", "b", F.round(tx.jaro_winkler_udf("a", "b"), 6).alias("score"))


_ER = f"""{_VEC}, p AS (SELECT a.vec_id q, b.vec_id i, {_DIST['cosine']} dist FROM v a, v b),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dist, 9), i) r FROM p) WHERE r <= 6 AND q <> i AND dist <= 0.65),
 bl AS (SELECT least(q, i) a, greatest(q, i) b, min(dist) dist FROM k GROUP BY 1, 2)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"), F.concat(F.lit("item "), "label").alias("name"), F.lit("").alias("source"), F.col("embedding").alias("vector"))


@query(f"WITH {_ER} SELECT a, b, round(dist, 6) AS dist FROM bl")
def er_blocking(spark, d):  # noqa: ANN001, ANN201
    return entity_resolution.blocking(_entities(spark, d), 5, 0.65).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"""WITH {_ER}, n AS (SELECT vec_id, 'item ' || label AS "name" FROM embeddings), s AS (SELECT bl.*, x."name" na, y."name" nb, {_PREFIX.format(a='x."name"', b='y."name"')} p FROM bl JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b)
 SELECT a, b, round(dist, 6) AS dist, round(CASE WHEN na = nb THEN 1.0 ELSE 0.4 * {_JW.format(a='na', b='nb')} + 0.6 * (1 - dist) END, 6) AS score FROM s""")
def er_scored_pairs(spark, d):  # noqa: ANN001, ANN201
    e = _entities(spark, d)
    return entity_resolution.score_pairs(entity_resolution.blocking(e, 5, 0.65), e, 0.4).select("a", "b", F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"))


@query()
def er_clusters(spark, d):  # noqa: ANN001, ANN201
    return entity_resolution.resolve(_entities(spark, d), 5, 0.65, 0.4, cluster_by="leiden")


@query(f"""WITH RECURSIVE {_ER}, n AS (SELECT vec_id, 'item ' || label AS "name" FROM embeddings), s AS (SELECT bl.*, x."name" na, y."name" nb, {_PREFIX.format(a='x."name"', b='y."name"')} p FROM bl JOIN n x ON x.vec_id = a JOIN n y ON y.vec_id = b),
 m AS (SELECT a, b FROM s WHERE CASE WHEN na = nb THEN 1.0 ELSE 0.4 * {_JW.format(a='na', b='nb')} + 0.6 * (1 - dist) END >= 0.35), g AS (SELECT a x, b y FROM m UNION SELECT b, a FROM m),
 r AS (SELECT vec_id x, vec_id seen FROM embeddings UNION SELECT g.y, r.seen FROM r JOIN g ON g.x = r.x) SELECT x AS entity_id, min(seen) AS cluster_root FROM r GROUP BY 1""")
def er_components(spark, d):  # noqa: ANN001, ANN201
    """Clusters with their singletons, named by their least entity."""
    found = entity_resolution.resolve(_entities(spark, d), 5, 0.65, 0.4, cluster_by="components")
    return found.select("entity_id", F.min("entity_id").over(Window.partitionBy("cluster_id")).alias("cluster_root"))


@query("""WITH m AS (SELECT p_name AS "name", p_brand AS cluster_id, count(*) n FROM part GROUP BY 1, 2), s AS (SELECT "name", sum(n) n FROM m GROUP BY 1)
 SELECT DISTINCT m."name", first_value(m."name") OVER (PARTITION BY cluster_id ORDER BY s.n DESC, m."name") AS canonical FROM m JOIN s USING ("name")""")
def er_canonical_names(spark, d):  # noqa: ANN001, ANN201
    p = t(spark, d, "part")
    return entity_resolution.canonicalise(p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("mention_count")), p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("cluster_id")).distinct()).distinct()


@query(f"""WITH {TRADE}, c AS (SELECT n_nationkey::VARCHAR k, n_regionkey::VARCHAR r FROM nation)
 SELECT x.r AS src, y.r AS dst, 'trade' AS rel_type, round(sum(weight), 2) AS weight FROM e JOIN c x ON x.k = src JOIN c y ON y.k = dst WHERE x.r <> y.r GROUP BY 1, 2""")
def er_canonical_edges(spark, d):  # noqa: ANN001, ANN201
    c = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_regionkey").cast("string").alias("canonical"))
    return entity_resolution.coalesce_edges(trade(spark, d).withColumn("rel_type", F.lit("trade")), c).withColumn("weight", F.round("weight", 2))


_PAIR = "pg AS (SELECT doc_id id, quality::BIGINT p, toxic::BIGINT g FROM labels), c AS (SELECT p, g, count(*) n FROM pg GROUP BY 1, 2), pp AS (SELECT p, sum(n) np FROM c GROUP BY 1), gg AS (SELECT g, sum(n) ng FROM c GROUP BY 1)"


def _clusterings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = t(spark, d, "labels")
    return x.select(F.col("doc_id").alias("id"), F.col("quality").alias("cluster")), x.select(F.col("doc_id").alias("id"), F.col("toxic").alias("cluster"))


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PAIR}, s AS (SELECT sum(n * n / np::DOUBLE) / sum(n) p, sum(n * n / ng::DOUBLE) / sum(n) r FROM c JOIN pp USING (p) JOIN gg USING (g)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def bcubed(spark, d):  # noqa: ANN001, ANN201
    return _r6(metrics.bcubed(*_clusterings(spark, d)))


@query(f"WITH {_PAIR}, s AS (SELECT tp / a p, tp / b r FROM (SELECT sum(n * (n - 1) / 2)::DOUBLE tp FROM c), (SELECT sum(np * (np - 1) / 2)::DOUBLE a FROM pp), (SELECT sum(ng * (ng - 1) / 2)::DOUBLE b FROM gg)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def pairwise_f1(spark, d):  # noqa: ANN001, ANN201
    return _r6(metrics.pairwise(*_clusterings(spark, d)))


@query("""WITH p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0), s AS (SELECT (SELECT count(*) FROM p JOIN g USING (doc_id)) / (SELECT count(*) FROM p)::DOUBLE p, (SELECT count(*) FROM p JOIN g USING (doc_id)) / (SELECT count(*) FROM g)::DOUBLE r)
 SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM s""")
def micro_f1(spark, d):  # noqa: ANN001, ANN201
    x = t(spark, d, "labels")
    return metrics.set_f1(x.where("quality = 1").select("doc_id"), x.where("toxic = 0").select("doc_id"))


_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH dt AS (SELECT doc_id, {_TERMS.format('text')} w FROM documents), q AS (SELECT item_id qid, unnest(list_distinct(({_TERMS.format('text')})[1:20])) term FROM benchmark),
 tf AS (SELECT term, doc_id, count(*) tf, any_value(l) l FROM (SELECT doc_id, len(w) l, unnest(w) term FROM dt) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
 df AS (SELECT term, count(*) df FROM tf GROUP BY 1), st AS (SELECT count(*) n, avg(len(w)) a FROM dt),
 s AS (SELECT qid, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) score, count(*) hits FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)
 SELECT qid, doc_id, round(score, 6) AS score, r::INTEGER AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) r FROM s WHERE hits = (SELECT count(*) FROM q q2 WHERE q2.qid = s.qid)) WHERE r <= 10""")
def bm25_topk(spark, d):  # noqa: ANN001, ANN201
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return tx.bm25(t(spark, d, "documents"), q, 10).withColumn("score", F.round("score", 6))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, len(t), 206)) s FROM w)
 SELECT doc_id, (s // 206)::INTEGER AS chunk, array_to_string(t[s + 1 : s + 256], ' ') AS text FROM s WHERE s = 0 OR len(t) - s >= 64""")
def token_window_chunks(spark, d):  # noqa: ANN001, ANN201
    return tx.token_windows(t(spark, d, "documents"), "doc_id", "text")


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>plan' || chr(10) || '</think> ' || chr(10) || text WHEN turn % 3 = 1 THEN '<think>' || text ELSE text END t FROM conversations)
 SELECT conv_id, turn, CASE WHEN contains(t, '</think>') THEN ltrim(substr(t, strpos(t, '</think>') + 8), chr(32) || chr(9) || chr(10) || chr(13)) WHEN contains(t, '<think>') THEN '' ELSE t END AS text FROM x""")
def think_strip(spark, d):  # noqa: ANN001, ANN201
    c = t(spark, d, "conversations")
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>plan\n</think> \n"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.strip_think(x).alias("text"))


@query("""WITH g AS (SELECT n_regionkey::VARCHAR group_id, list(n_name ORDER BY n_name) m FROM nation GROUP BY 1)
 SELECT group_id, len(m)::INTEGER AS member_count, array_to_string(m[1:3], ', ') || CASE WHEN len(m) > 3 THEN '...and ' || (len(m) - 3) || ' others' ELSE '' END AS prompt FROM g WHERE len(m) >= 3""")
def prompt_members(spark, d):  # noqa: ANN001, ANN201
    return tx.group_prompts(t(spark, d, "nation"), "n_regionkey", "n_name", 3, 3)


# Adjacency, plans, sessions --------------------------------------------------------------------------------

@query("""WITH e AS (SELECT 'u:' || user_id src, event_type dst, value w, event_id seq FROM events), n AS (SELECT src, dst, count(*) FILTER (seq % 10 = 0) d FROM e GROUP BY 1, 2),
 k AS (SELECT e.*, row_number() OVER (PARTITION BY src, dst ORDER BY seq) r FROM e), a AS (SELECT k.* FROM k JOIN n USING (src, dst) WHERE r > d),
 x AS (SELECT src node, 1 o, 0 i, w wo, 0.0 wi FROM a UNION ALL SELECT dst, 0, 1, 0.0, w FROM a)
 SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, round(sum(wi), 4) AS weighted_in_degree, round(sum(wo), 4) AS weighted_out_degree FROM x GROUP BY 1""")
def adjacency_degrees_after_delta(spark, d):  # noqa: ANN001, ANN201
    e = t(spark, d, "events").select(F.concat(F.lit("u:"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("weight"), F.col("event_id").alias("seq"))
    gone = e.where("seq % 10 = 0").select("src", "dst", "weight", F.lit(adjacency.DELETE).alias("op"), "seq")
    x = adjacency.degrees(adjacency.apply_delta(e, gone))
    return x.select("node", F.col("in_degree").cast("bigint").alias("in_degree"), F.col("out_degree").cast("bigint").alias("out_degree"), F.round("weighted_in_degree", 4).alias("weighted_in_degree"), F.round("weighted_out_degree", 4).alias("weighted_out_degree"))


@query(ORACLES["adjacency_degrees_after_delta"])
def adjacency_cache_after_delta(spark, d):  # noqa: ANN001, ANN201
    """The same degrees from a stored cache that was created, then rebuilt incrementally."""
    e = t(spark, d, "events").select(F.concat(F.lit("u:"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.col("value").alias("weight"), F.col("event_id").alias("edge_seq"))
    cache = adjacency.AdjacencyCache.create(spark, new_path(spark, "adjacency"), e)
    cache.incremental_rebuild(e.where("edge_seq % 10 = 0").select("src", "dst", "weight", F.lit(adjacency.DELETE).alias("op"), F.col("edge_seq").alias("seq")))
    x = cache.table("degree").where("in_degree + out_degree > 0")
    return x.select("node", F.col("in_degree").cast("bigint").alias("in_degree"), F.col("out_degree").cast("bigint").alias("out_degree"), F.round("weighted_in_degree", 4).alias("weighted_in_degree"), F.round("weighted_out_degree", 4).alias("weighted_out_degree"))


@query("""SELECT g AS granularity, date_trunc(u, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES ('hourly', 'hour'), ('daily', 'day'), ('weekly', 'week'), ('monthly', 'month')) v(g, u) GROUP BY 1, 2, 3""")
def rollup_time_cube(spark, d):  # noqa: ANN001, ANN201
    return sessions.time_cube(t(spark, d, "events"), ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(DISTINCT event_type) AS n_distinct, round(sum(value), 4) AS total FROM events GROUP BY 1")
def user_summary(spark, d):  # noqa: ANN001, ANN201
    return sessions.rollup(t(spark, d, "events"), ["user_id"], "event_type", "value").withColumn("total", F.round("total", 4))


@query(f"WITH {REPLY} SELECT src, dst FROM e")
def sequence_edges(spark, d):  # noqa: ANN001, ANN201
    return replies(spark, d).select("src", "dst")


@query("""WITH s AS (SELECT conv_id || ':' || turn AS dst, conv_id AS p FROM conversations WHERE turn = 0), r AS (SELECT conv_id p, conv_id || ':' || turn AS src, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || ':' || turn) r FROM conversations WHERE "role" = 'assistant')
 SELECT r.src, s.dst FROM s JOIN r USING (p) WHERE r = 1""")
def bridge_join(spark, d):  # noqa: ANN001, ANN201
    c = t(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"), F.col("conv_id").alias("prompt_id"), F.col("turn").alias("ts"), "role")
    return sessions.bridge_edges(c.where("ts = 0"), c.where("role = 'assistant'"))


@query("""SELECT event_id, round(round(value + 5 * user_id, 6) * CASE event_id % 5 WHEN 0 THEN 15.0 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 0.0 END / 1e6, 8) AS cost FROM events""")
def cost_model(spark, d):  # noqa: ANN001, ANN201
    e = t(spark, d, "events")
    kind = F.col("event_id") % 5
    model = F.when(kind == 0, "big-Opus-4").when(kind == 1, "x-sonnet").when(kind == 2, "HAIKU-mini").when(kind == 3, "unknown")
    b = F.round(sessions.billable(F.col("value"), F.col("user_id"), F.lit(0), F.lit(0)), 6)
    return e.select("event_id", sessions.cost(model, b).alias("cost"))


@query("""SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'meta' WHEN 1 THEN 'human' WHEN 2 THEN 'task_notification' WHEN 3 THEN 'tool_result' WHEN 4 THEN 'user_text' WHEN 5 THEN 'thinking'
 WHEN 6 THEN 'tool_use' WHEN 7 THEN 'assistant_text' ELSE 'other' END AS kind FROM events""")
def message_kinds(spark, d):  # noqa: ANN001, ANN201
    rows = [("user", "true", "string", "x"), ("user", "", "string", "hi"), ("user", "false", "string", "\n <task-notification>"), ("user", "", "tool_result", ""), ("user", "", "text", "<command>"), ("assistant", "", "thinking", ""), ("assistant", "", "tool_use", ""), ("assistant", "", "text", ""), ("system", "", "string", ""), ("summary", "", "", "")]
    given = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("kind", "meta", "block", "text"), r, strict=True)]) for r in rows]), (F.col("event_id") % 10 + 1).cast("int"))
    e = t(spark, d, "events").select("event_id", given.alias("g"))
    return e.select("event_id", sessions.message_kind(F.col("g.kind"), F.col("g.meta") == "true", F.col("g.block"), F.col("g.text")).alias("kind"))


@query("""WITH v(m, ord, call_type, call_name) AS (VALUES (0, 0, 'tool', 'Bash'), (0, 0, 'cli', 'cd'), (0, 0, 'cli', 'make'), (0, 0, 'make_target', 'all'), (0, 0, 'cli', 'tee'), (1, 0, 'skill', 'pdf'), (1, 1, 'tool', 'Read'), (2, 1, 'subagent', 'plan'), (3, 0, 'rule', '/r/a.md'))
 SELECT conv_id, turn, ord, call_type, call_name FROM conversations JOIN v ON v.m = turn % 4""")
def event_calls(spark, d):  # noqa: ANN001, ANN201
    messages = [
        '{"content": [{"type": "tool_use", "name": "Bash", "input": {"command": "A=1 cd x && sudo make -j 4 all 2>&1 | tee log"}}]}',
        '{"content": [{"type": "tool_use", "name": "Skill", "input": {"skill": "pdf"}}, {"type": "tool_use", "name": "Read", "input": {}}]}',
        '{"content": [{"type": "thinking"}, {"type": "tool_use", "name": "Agent", "input": {"subagent_type": "plan"}}]}',
        '{"content": [{"type": "text", "text": "<system-reminder>Contents of /r/a.md: x</system-reminder>"}]}',
    ]
    c = t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.element_at(F.array(*[F.lit(m) for m in messages]), (F.col("turn") % 4 + 1).cast("int")).alias("message"))
    return sessions.event_calls(c, "id", "message").select("id.conv_id", "id.turn", "ord", "call_type", "call_name")


@query("SELECT event_id::VARCHAR AS uuid, (event_id - 1)::VARCHAR AS parent_uuid, event_type AS \"type\", user_id AS input_tokens FROM events")
def jsonl_ingest(spark, d):  # noqa: ANN001, ANN201
    """Events written as JSON lines, with broken lines among them, and read again."""
    from loomkg.sources import logs

    e = t(spark, d, "events")
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("uuid"), (F.col("event_id") - 1).cast("string").alias("parentUuid"), F.col("event_type").alias("type"), F.struct(F.struct(F.col("user_id").alias("input_tokens")).alias("usage")).alias("message")))
    lines = e.select(F.explode(F.when(F.col("event_id") % 50 == 0, F.array(whole, F.lit("{broken"))).otherwise(F.array(whole))).alias("value"))
    path = new_path(spark, "lines")
    lines.write.text(path)
    got = logs.read_events(spark, path)
    return got.where("broken IS NULL").select("uuid", F.col("parentUuid").alias("parent_uuid"), "type", F.col("message.usage.input_tokens").alias("input_tokens"))


@query("""WITH c AS (SELECT g AS granularity, date_trunc(u, ts) AS bucket, event_type, count(*) AS n, sum(value) AS total FROM events, (VALUES ('hourly', 'hour'), ('daily', 'day'), ('weekly', 'week'), ('monthly', 'month')) v(g, u) GROUP BY 1, 2, 3)
 SELECT granularity, bucket, event_type, n, CASE WHEN granularity = 'daily' THEN round(total, 4) ELSE 0.0 END AS total FROM c""")
def rollup_range_refresh(spark, d):  # noqa: ANN001, ANN201
    """A stored cube without totals, of which the days alone are refreshed."""
    cube = sessions.time_cube(t(spark, d, "events"), ["event_type"], "value").withColumn("total", F.round("total", 4))
    path = new_path(spark, "cube")
    sessions.refresh_range(cube.withColumn("total", F.lit(0.0)), path)
    sessions.refresh_range(cube.where("granularity = 'daily'"), path)
    return spark.read.parquet(path).select("granularity", "bucket", "event_type", "n", "total")


@query(f"""WITH {TRADE}, g AS (SELECT src, dst, sum(weight) weight FROM e WHERE src <> dst GROUP BY 1, 2), dg AS (SELECT src node, sum(weight) c FROM (SELECT src, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1),
 s AS (SELECT node FROM dg ORDER BY round(c, 4) DESC, node LIMIT 2), k AS (SELECT node FROM s UNION SELECT dst FROM g JOIN s ON s.node = src UNION SELECT src FROM g JOIN s ON s.node = dst),
 i AS (SELECT * FROM g WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)), c AS (SELECT node FROM (SELECT src node FROM i UNION ALL SELECT dst FROM i) GROUP BY 1 HAVING count(*) >= 2)
 SELECT src, dst, round(weight, 2) AS weight FROM i WHERE src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c)""")
def kg_seed_expand_prune(spark, d):  # noqa: ANN001, ANN201
    e = trade(spark, d)
    seeds = knowledge.seeds_by(e, _deg(centrality.degree(e)), 2)
    return knowledge.seed_expand_prune(e, seeds, 1, 2).withColumn("weight", F.round("weight", 2))


@query(f"""WITH {TRADE}, ce AS (SELECT c_custkey chunk_id, c_nationkey::VARCHAR AS "name" FROM customer), s AS (SELECT 1 qid, c_custkey id FROM customer WHERE c_custkey % 100 = 0),
 x AS (SELECT DISTINCT qid, "name" node FROM s JOIN ce ON ce.chunk_id = s.id), y AS (SELECT qid, dst node FROM x JOIN e ON e.src = x.node UNION SELECT * FROM x)
 SELECT DISTINCT qid, chunk_id AS id FROM y JOIN ce ON ce."name" = y.node""")
def graphrag_retrieve(spark, d):  # noqa: ANN001, ANN201
    ce = t(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").cast("string").alias("name"))
    seeds = ce.where("chunk_id % 100 = 0").select(F.lit(1).alias("qid"), F.col("chunk_id").alias("id"))
    return knowledge.retrieve(seeds, ce, trade(spark, d), 1)


@query("""WITH c AS (SELECT l_suppkey k, l_returnflag v, count(*) n FROM lineitem GROUP BY 1, 2) SELECT k AS l_suppkey, v AS l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) r FROM c) WHERE r = 1""")
def majority_type(spark, d):  # noqa: ANN001, ANN201
    return knowledge.majority(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query()
def node2vec_embeddings(spark, d):  # noqa: ANN001, ANN201
    return node2vec.node2vec(trade(spark, d), dim=16, num_walks=4, walk_length=20, epochs=2)


@query()
def pca_projection(spark, d):  # noqa: ANN001, ANN201
    return knowledge.project(t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def window_tumbling(spark, d):  # noqa: ANN001, ANN201
    from loomkg.streaming.deltas import windowed

    return windowed(t(spark, d, "events")).withColumn("total", F.round("total", 4))
