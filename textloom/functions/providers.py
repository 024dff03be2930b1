"""Seams for what would need an outside service, each with a deterministic offline default.

embedder: texts -> vectors; generator: prompts -> answers; reranker: pairs -> scores. A provider is a function of
lists that runs in Arrow batches on the executors; `register` adds one by name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]
Scorer = Callable[[list[str], list[str]], list[float]]


def hashed_terms(dimensions: int = 256) -> Embedder:
    """Unit vectors of signed hashed term counts."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for term in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.md5(term.encode()).digest()[:8], "big")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def extractive(prompts: list[str]) -> list[str]:
    """The prompt's context, or nothing: an answer that invents no fact."""
    return [p.split("CONTEXT:\n", 1)[1].strip() if "CONTEXT:\n" in p else "" for p in prompts]


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": hashed_terms}
GENERATORS: dict[str, Callable[[], Generator]] = {"extractive": lambda: extractive}
SCORERS: dict[str, Callable[[], Scorer]] = {}


def register(table: dict, name: str, make: Callable) -> None:
    table[name] = make


def _made(table: dict, name: str, kind: str):
    if name not in table:
        raise ValueError(f"no {kind} named {name}: {', '.join(sorted(table)) or 'none registered'}")
    return table[name]


def embed(text: Column, name: str = "hashed") -> Column:
    make = _made(EMBEDDERS, name, "embedder")

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(make()([t or "" for t in texts.to_pylist()]), pa.list_(pa.float32()))

    return run(text)


def generate(prompt: Column, name: str = "extractive") -> Column:
    make = _made(GENERATORS, name, "generator")

    @F.arrow_udf("string")
    def run(prompts: pa.Array) -> pa.Array:
        return pa.array(make()([p or "" for p in prompts.to_pylist()]), pa.string())

    return run(prompt)


def pair_score(query: Column, text: Column, name: str) -> Column:
    make = _made(SCORERS, name, "scorer")

    @F.arrow_udf("double")
    def run(queries: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array(make()([q or "" for q in queries.to_pylist()], [t or "" for t in texts.to_pylist()]), pa.float64())

    return run(query, text)


_tokenizers: dict[str, object] = {}  # of this worker process


def bpe_tokens(vocabulary: str) -> Callable[[str], int]:
    """A token counter by a byte-pair vocabulary of the `tokenizers` format: blank texts have none. Workers load it once."""

    def count(text: str) -> int:
        if not text.strip():
            return 0
        if vocabulary not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers[vocabulary] = Tokenizer.from_file(vocabulary)
        return len(_tokenizers[vocabulary].encode(text, add_special_tokens=False).ids)

    return count
