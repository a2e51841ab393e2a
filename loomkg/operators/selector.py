"""Node-selector language: text to tree to DataFrame plan.

    expression = term {term}                 union
    term       = "not" atom | atom {"," atom}   complement, intersection
    atom       = ["@"] [[N] "+"] name ["+" [M]]  ancestors and descendants, @: closure
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.operators.edges import arcs, node_index, nodes


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(frozen=True)
class Node:
    """up, down: depth limits, None for not at all, -1 for any."""

    name: str
    up: int | None = None
    down: int | None = None
    closure: bool = False


@dataclass(frozen=True)
class Not:
    item: Node


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


_WORD = re.compile(r"[A-Za-z0-9_.\-]+")


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c in " \t":
            i += 1
        elif c in "+@,":
            out.append(Token(c, c, i))
            i += 1
        elif m := _WORD.match(text, i):
            w = m.group()
            rest = text[m.end() :].lstrip(" \t")
            kind = "not" if w == "not" and rest and rest[0] not in ",)" else "int" if w.isdigit() else "name"
            out.append(Token(kind, w, i))
            i = m.end()
        else:
            raise SelectorError(f"unexpected character {c!r} at position {i}")
    return [*out, Token("end", "", len(text))]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.i = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)].kind

    def expression(self):  # noqa: ANN201
        if self.kind() == "end":
            raise SelectorError("empty selector")
        tree = self.term()
        while self.kind() != "end":
            if self.kind() == ",":
                raise SelectorError(f"unexpected token ',' at position {self.now.at}")
            tree = Either(tree, self.term())
        return tree

    def term(self):  # noqa: ANN201
        if self.kind() == "not":
            self.i += 1
            return Not(self.atom())
        tree = self.atom()
        while self.kind() == ",":
            self.i += 1
            tree = Both(tree, self.atom())
        return tree

    def atom(self) -> Node:
        closure = self.kind() == "@"
        if closure:
            self.i += 1
        up = None
        if self.kind() == "int" and self.kind(1) == "+" and self.kind(2) in ("name", "int") and self._adjacent(0, 1):
            up = int(self.now.text)
            self.i += 2
        elif self.kind() == "+":
            up = -1
            self.i += 1
        if self.kind() not in ("name", "int"):
            raise SelectorError(f"unexpected token {self.now.text or 'end'!r} at position {self.now.at}")
        name = self.now.text
        self.i += 1
        down = None
        # a plus before a name belongs to the next term
        if self.kind() == "+" and self.kind(1) != "name":
            self.i += 1
            down = -1
            if self.kind() == "int" and self.kind(1) != "+":
                down = int(self.now.text)
                self.i += 1
        return Node(name, None if closure else up, None if closure else down, closure)

    def _adjacent(self, a: int, b: int) -> bool:
        x, y = self.tokens[self.i + a], self.tokens[self.i + b]
        return x.at + len(x.text) == y.at


def parse(text: str):  # noqa: ANN201
    return _Parser(text).expression()


def label(tree) -> str:  # noqa: ANN001
    if not isinstance(tree, Node):
        return "selected"
    if tree.closure:
        return "closure"
    if tree.up is not None and tree.down is not None:
        return "both"
    return "ancestor" if tree.up is not None else "descendant" if tree.down is not None else "self"


def _names(tree) -> set[str]:  # noqa: ANN001
    if isinstance(tree, Node):
        return {tree.name}
    if isinstance(tree, Not):
        return {tree.item.name}
    return _names(tree.left) | _names(tree.right)


def reach_from(edges: DataFrame, seeds: DataFrame, direction: str, limit: int = -1) -> DataFrame:
    """(node, depth) reached from the seeds (node) within `limit` steps, any number if negative."""
    from loomkg.common import checkpointed

    hops = arcs(edges, direction).select("src", "dst").distinct()
    done = front = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while limit < 0 or level < limit:
        level += 1
        step = front.select(F.col("node").alias("src")).join(hops, "src").select(F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(done, "node", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        done = done.unionAll(front)
    return done


def _local_reach(edges: DataFrame, seeds: list[str], direction: str, limit: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    from loomkg.operators.edges import Graph, in_one_task
    from loomkg.operators.traverse import reach

    def walk(g: Graph) -> pd.DataFrame:
        at = [i for i in (g.id_of(s) for s in seeds) if i >= 0]
        offs, to, _ = g.csr(direction)
        depth, _ = reach(offs, to, at, g.n, None if limit < 0 else limit)
        hit = np.flatnonzero(depth >= 0)
        return pd.DataFrame({"node": g.names[hit], "depth": depth[hit].astype(np.int32)})

    return in_one_task(edges, walk, "node string, depth int")


def select(edges: DataFrame, selector: str, local_arcs: int | None = None, missing: str = "error") -> DataFrame:
    """(node, depth, direction, idx) of the nodes that the selector names; idx is the node's index, for ordering.

    Every row carries one direction, that of the whole expression; set expressions have depth 0. A name that no edge
    has is an error, or selects nothing if missing is "empty".
    """
    from loomkg.operators.edges import LOCAL_ARCS, is_small

    if missing not in ("error", "empty"):
        raise ValueError("missing is error or empty")
    tree = parse(selector)
    small = is_small(edges, LOCAL_ARCS if local_arcs is None else local_arcs)
    every = nodes(edges)
    index = node_index(edges)
    if index.isEmpty():
        return index.select("node", F.lit(0).alias("depth"), F.lit("").alias("direction"), "idx")
    if missing == "error":
        known = {r.node for r in index.where(F.col("node").isin(sorted(_names(tree)))).collect()}
        for name in sorted(_names(tree)):
            if name not in known:
                raise SelectorError(f"node not found: {name}")

    def walk(seeds: DataFrame, names: list[str] | None, direction: str, limit: int) -> DataFrame:
        if small and names is not None:
            return _local_reach(edges, names, direction, limit)
        return reach_from(edges, seeds, direction, limit)

    def leaf(t: Node) -> DataFrame:
        start = edges.sparkSession.createDataFrame([(t.name,)], "node string")
        if t.closure:
            down = walk(start, [t.name], "forward", -1)
            return reach_from(edges, down, "reverse", -1)
        parts = [start.withColumn("depth", F.lit(0))]
        if t.up is not None:
            parts.append(walk(start, [t.name], "reverse", t.up))
        if t.down is not None:
            parts.append(walk(start, [t.name], "forward", t.down))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out.groupBy("node").agg(F.min("depth").alias("depth"))

    def build(t) -> DataFrame:  # noqa: ANN001
        if isinstance(t, Node):
            return leaf(t).select("node")
        if isinstance(t, Not):
            return every.subtract(leaf(t.item).select("node"))
        left, right = build(t.left), build(t.right)
        return left.intersect(right) if isinstance(t, Both) else left.union(right).distinct()

    got = leaf(tree) if isinstance(tree, Node) else build(tree).withColumn("depth", F.lit(0))
    return got.join(index, "node").select("node", "depth", F.lit(label(tree)).alias("direction"), "idx")


def select_local(g, selector: str):  # noqa: ANN001, ANN201
    """(node, depth, direction) in node order, on a graph in memory."""
    import numpy as np
    import pandas as pd

    from loomkg.operators.traverse import reach

    tree = parse(selector)
    for name in sorted(_names(tree)):
        if g.id_of(name) < 0:
            raise SelectorError(f"node not found: {name}")

    def walk(seeds: list[int], direction: str, limit: int) -> np.ndarray:
        offs, to, _ = g.csr(direction)
        return reach(offs, to, seeds, g.n, None if limit < 0 else limit)[0]

    def leaf(t: Node) -> np.ndarray:
        s = g.id_of(t.name)
        if t.closure:
            return walk(np.flatnonzero(walk([s], "forward", -1) >= 0).tolist(), "reverse", -1)
        got = [np.where(np.arange(g.n) == s, 0, -1)]
        if t.up is not None:
            got.append(walk([s], "reverse", t.up))
        if t.down is not None:
            got.append(walk([s], "forward", t.down))
        best = np.min([np.where(x < 0, g.n + 1, x) for x in got], axis=0)
        return np.where(best > g.n, -1, best)

    def build(t) -> np.ndarray:  # noqa: ANN001
        if isinstance(t, Node):
            return leaf(t) >= 0
        if isinstance(t, Not):
            return leaf(t.item) < 0
        a, b = build(t.left), build(t.right)
        return a & b if isinstance(t, Both) else a | b

    depth = leaf(tree) if isinstance(tree, Node) else np.where(build(tree), 0, -1)
    at = np.flatnonzero(depth >= 0)
    return pd.DataFrame({"node": g.names[at], "depth": depth[at], "direction": label(tree)})
