"""Model backends behind a small protocol, a registry, and the text-model functions as Arrow UDFs.

No model files ship here. HashEmbedder and RuleExtractor are deterministic stand-ins that exercise the
plumbing; they are no language models. A real backend registers a factory, built once per Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 16
EXTRACT_SCHEMA = "struct<entities:array<struct<text:string,type:string,score:double>>,relations:array<struct<head:string,rel:string,tail:string,score:double>>>"
EMPTY = {"entities": [], "relations": []}
_BUILT: dict[str, Any] = {}


class HashEmbedder:
    """Stand-in: signed hashing of words, unit length."""

    kind, dim, n_ctx = "embed", 64, 512

    def tokens(self, text: str) -> list[str]:
        return re.findall(r"\w+|[^\w\s]", text)

    def embed(self, text: str) -> np.ndarray:
        v = np.zeros(self.dim)
        for t in self.tokens(text.lower()):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32)


class RuleExtractor(HashEmbedder):
    """Stand-in: capitalised words are entities, neighbours in a sentence are related; chat repeats the prompt's end."""

    kind, n_ctx = "chat", 8192

    def chat(self, prompt: str, max_tokens: int, **_options: Any) -> str:
        return " ".join(self.tokens(prompt)[-max_tokens:])

    def extract(self, text: str, entity_labels: list[str] | None, relation_labels: list[str] | None) -> str:
        ents, rels, seen = [], [], set()
        kind = (entity_labels or ["entity"])[0]
        for sentence in re.split(r"[.!?\n]+", text):
            names = re.findall(r"\b[A-Z]\w+", sentence)
            for n in names:
                if n not in seen:
                    seen.add(n)
                    ents.append({"text": n, "type": kind, "score": 1.0})
            rels += [{"head": a, "rel": (relation_labels or ["near"])[0], "tail": b, "score": 1.0} for a, b in zip(names, names[1:], strict=False)]
        return json.dumps({"entities": ents, "relations": rels})


class ModelRegistry:
    """name -> factory; at most 16, names unique; a view as a DataFrame."""

    def __init__(self) -> None:
        self.models: dict[str, tuple[Callable[[], Any], str, int]] = {}

    def register(self, name: str, factory: Callable[[], Any], n_ctx: int | None = None) -> None:
        if name in self.models:
            raise ValueError(f"model already registered: {name}")
        if len(self.models) >= LIMIT:
            raise ValueError(f"more than {LIMIT} models")
        m = factory()
        self.models[name] = (factory, m.kind, min(n_ctx or m.n_ctx or 512, 8192))

    def unregister(self, name: str) -> None:
        if name not in self.models:
            raise ValueError(f"no such model: {name}")
        del self.models[name]

    def get(self, name: str) -> tuple[Callable[[], Any], str, int]:
        if name not in self.models:
            raise ValueError(f"no such model: {name}")
        return self.models[name]

    def dim(self, name: str) -> int:
        return self.get(name)[0]().dim

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, k, f().dim, c) for n, (f, k, c) in sorted(self.models.items())]
        return spark.createDataFrame(rows, "name string, kind string, dim int, n_ctx int")


def _built(name: str, factory: Callable[[], Any]) -> Any:
    if name not in _BUILT:
        _BUILT[name] = factory()
    return _BUILT[name]


def _mapped(name: str, factory: Callable[[], Any], kind: str, f: Callable[[Any, str], Any]) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        m = _built(name, factory)
        return texts.map(lambda t: None if t is None else f(m, t))

    return run


def embed(registry: ModelRegistry, name: str, text: Column) -> Column:
    """Unit-length embedding; no tokens or more than the context are errors."""
    factory, _, n_ctx = registry.get(name)

    def one(m: Any, t: str) -> np.ndarray:
        n = len(m.tokens(t))
        if not n:
            raise ValueError("text has no tokens")
        if n > n_ctx:
            raise ValueError(f"text has {n} tokens, the context {n_ctx}")
        return m.embed(t)

    return _mapped(name, factory, "array<float>", one)(text)


def tokenize_text(registry: ModelRegistry, name: str, text: Column) -> Column:
    return _mapped(name, registry.get(name)[0], "array<string>", lambda m, t: m.tokens(t))(text)


def token_count(registry: ModelRegistry, name: str, text: Column) -> Column:
    return _mapped(name, registry.get(name)[0], "int", lambda m, t: len(m.tokens(t)))(text)


def strip_think_text(text: str) -> str:
    if "</think>" in text:
        return text.split("</think>", 1)[1].lstrip(" \t\r\n")
    return "" if "<think>" in text else text


def chat(registry: ModelRegistry, name: str, prompt: Column, max_tokens: int | None = None, skip_think: bool = True, **options: Any) -> Column:
    factory, _, n_ctx = registry.get(name)
    return _mapped(name, factory, "string", lambda m, t: (strip_think_text if skip_think else str)(m.chat(t, max_tokens or n_ctx, **options)))(prompt)


def summarize(registry: ModelRegistry, name: str, text: Column, max_tokens: int = 256) -> Column:
    return chat(registry, name, F.concat(F.lit("Summarize in one sentence: "), text), max_tokens)


def parse_extraction(raw: str | None, only: str | None = None) -> dict:
    """Skeleton of what can be read: a bare array is wrapped, anything broken is empty."""
    try:
        x = json.loads(raw or "")
    except ValueError:
        return EMPTY
    if isinstance(x, list):
        x = {only or "entities": x}
    if not isinstance(x, dict):
        return EMPTY
    return {k: [e for e in x.get(k) or [] if isinstance(e, dict)] if isinstance(x.get(k), list) else [] for k in EMPTY}


def extract(registry: ModelRegistry, name: str, text: Column, entity_labels: list[str] | None = None, relation_labels: list[str] | None = None, what: str = "ner_re") -> Column:
    """Struct of entities and relations; for ner_re both label lists or neither."""
    if what == "ner_re" and (entity_labels is None) != (relation_labels is None):
        raise ValueError("give both label lists or neither")
    factory = registry.get(name)[0]

    def one(m: Any, t: str) -> str:
        x = parse_extraction(strip_think_text(m.extract(t, entity_labels, relation_labels)), "relations" if what == "relations" else "entities")
        return json.dumps({k: v if what == "ner_re" or k == what else [] for k, v in x.items()})

    return F.from_json(_mapped(name, factory, "string", one)(text), EXTRACT_SCHEMA)


def label_groups(registry: ModelRegistry, name: str, members: DataFrame, group_col: str, member_col: str, min_size: int = 3, max_members: int = 10) -> DataFrame:
    """(group_id, label, member_count)."""
    from loomkg.functions.text import group_prompts

    g = group_prompts(members, group_col, member_col, min_size, max_members)
    raw = F.trim(chat(registry, name, F.concat(F.lit("Label this group: "), F.col("prompt")), 64))
    return g.select("group_id", F.regexp_replace(raw, "^[\"']|[\"']$", "").alias("label"), "member_count")


def scalar_functions(name: str, factory: Callable[[], Any], kind: str, n_ctx: int) -> dict[str, Any]:
    """Arrow UDFs of one model by suffix, ready to register."""

    def embedded(m: Any, t: str) -> np.ndarray:
        n = len(m.tokens(t))
        if not n or n > n_ctx:
            raise ValueError(f"text has {n} tokens, the context {n_ctx}")
        return m.embed(t)

    out = {"tokenize": ("array<string>", lambda m, t: m.tokens(t)), "token_count": ("int", lambda m, t: len(m.tokens(t)))}
    if kind == "embed":
        out["embed"] = ("array<float>", embedded)
    else:
        out["chat"] = ("string", lambda m, t: strip_think_text(m.chat(t, n_ctx)))
        out["summarize"] = ("string", lambda m, t: strip_think_text(m.chat("Summarize in one sentence: " + t, 256)))
        out["extract"] = ("string", lambda m, t: json.dumps(parse_extraction(m.extract(t, None, None))))
    return {s: _mapped(name, factory, k, f) for s, (k, f) in out.items()}
