"""Pluggable parts with deterministic offline stand-ins, and the registry of ingestion pipelines.

The defaults are stand-ins: a hashed bag of words is no neural embedder, a lexical share no
cross-encoder, and the stub client no language model. Real ones are injected.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.pipelines import Blocks, Paragraphs, Pipeline, Words


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """Unit vectors of hashed, lower-cased words; the empty text is the null vector."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension
        self._known: dict[str, tuple[int, int]] = {}

    def _place(self, w: str) -> tuple[int, int]:
        at = self._known.get(w)
        if at is None:
            if len(self._known) > 1 << 19:
                self._known.clear()
            h = int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
            at = self._known[w] = (h % self.dimension, 1 if h >> 31 else -1)
        return at

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                d, sign = self._place(w)
                out[i, d] += sign
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embed_column(c: Column, make: Callable[[], Embedder] = HashedWords) -> Column:
    """Vectors of a text column; the model is made once a task and gets whole batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            v = model.embed([x or "" for x in s]).astype(np.float32)
            yield pd.Series([None if x is None else row for x, row in zip(s, v, strict=True)])

    return run(c)


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def score_column(a: Column, b: Column, make: Callable[[], PairScorer], batch: int = 4) -> Column:
    """Scores of text pairs in model batches of ``batch``; -inf where the model gives none."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for x, y in batches:
            pairs = list(zip(x.fillna(""), y.fillna(""), strict=True))
            out: list[float] = []
            for i in range(0, len(pairs), batch):
                got = list(model.score(pairs[i : i + batch]))
                out += got + [float("-inf")] * (len(pairs[i : i + batch]) - len(got))
            yield pd.Series(out, dtype="float64")

    return run(a, b)


@dataclass(frozen=True)
class Usage:
    """Token counters of a generation; the total is known only if both parts are."""

    input_tokens: int | None = None
    output_tokens: int | None = None
    cached_tokens: int | None = None
    thought_tokens: int | None = None
    tool_tokens: int | None = None

    @property
    def total_tokens(self) -> int | None:
        return None if self.input_tokens is None or self.output_tokens is None else self.input_tokens + self.output_tokens

    def lines(self) -> list[str]:
        every = {"input": self.input_tokens, "output": self.output_tokens, "cached": self.cached_tokens, "thought": self.thought_tokens, "tool": self.tool_tokens, "total": self.total_tokens}
        return [f"{k} tokens: {v}" for k, v in every.items() if v is not None]


@dataclass(frozen=True)
class Answer:
    text: str
    provider: str
    model: str
    usage: Usage = field(default_factory=Usage)


class Client(Protocol):
    def generate(self, system: str, user: str) -> Answer: ...


class StubClient:
    """Cites the first evidence; for tests and dry runs."""

    def generate(self, system: str, user: str) -> Answer:
        return Answer("See the evidence [E1]." if re.search(r"^E1$", user, re.M) else "The evidence doesn't answer this.", "stub", "stub", Usage(len((system + user).split()), 4))


class HttpClient:
    """A local generation server: one JSON request an answer, not streamed."""

    def __init__(self, url: str, model: str, temperature: float = 0.1, context: int = 8192, predict: int = 768, timeout: float = 300.0) -> None:
        self.url, self.model, self.timeout = url, model, timeout
        self.options = {"temperature": temperature, "num_ctx": context, "num_predict": predict}

    def generate(self, system: str, user: str) -> Answer:
        import json
        import urllib.request

        body = {"model": self.model, "system": system, "prompt": user, "stream": False, "options": self.options}
        r = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(r, timeout=self.timeout) as f:
            x = json.load(f)
        return Answer(x.get("response", "").strip(), "http", self.model, Usage(x.get("prompt_eval_count"), x.get("eval_count")))


class KeyedClient:
    """A cloud model behind an injected call; refuses to start without its key."""

    def __init__(self, call: Callable[[str, str, str], Answer], key: str | None) -> None:
        if not key:
            raise ValueError("the client needs an API key")
        self.call, self.key = call, key

    def generate(self, system: str, user: str) -> Answer:
        return self.call(self.key, system, user)


def client_for(provider: str, **how: object) -> Client:
    kinds: dict[str, Callable[..., Client]] = {"stub": StubClient, "http": HttpClient, "keyed": KeyedClient}
    name = provider.strip().lower()
    if name not in kinds:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(kinds)}")
    return kinds[name](**how)


def answers(prompts: DataFrame, make: Callable[[], Client] = StubClient, system: str = "") -> DataFrame:
    """query_id, answer of each prompt, in batches on the executors; a failed call gives a null answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append(client.generate(system, p).text)
                except Exception:  # noqa: BLE001  any failure of a remote call concerns one answer only
                    out.append(None)
            yield pd.DataFrame({"query_id": b["query_id"], "answer": out})

    return prompts.select("query_id", "prompt").mapInPandas(run, "query_id bigint, answer string")


# --- pipelines

_PIPELINES: dict[str, tuple[str, Callable[[], Pipeline]]] = {}
ALIASES = {"v2": "v2-basic"}


def register(name: str, factory: Callable[[], Pipeline], description: str = "") -> None:
    """The last registration of a name counts; a name keeps its place."""
    key = name.strip().lower()
    if not key:
        raise ValueError("a pipeline needs a name")
    _PIPELINES[key] = (description, factory)


def names() -> list[str]:
    return list(_PIPELINES)


def describe(name: str) -> str:
    return _PIPELINES[name.strip().lower()][0]


def create(name: str) -> Pipeline:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in _PIPELINES:
        raise ValueError(f"unknown pipeline {name!r}; known: {', '.join(_PIPELINES)}")
    return _PIPELINES[key][1]()


def select(spark: SparkSession, argument: str | None = None) -> str:
    """Argument, then INGESTION_PIPELINE, then spark.marginalia.pipeline, then the first one."""
    chosen = argument or os.environ.get("INGESTION_PIPELINE") or spark.conf.get("spark.marginalia.pipeline", None) or names()[0]
    create(chosen)
    return chosen.strip().lower()


for _p in (Words, Paragraphs, Blocks):
    register(_p.name, _p, _p.description)
