"""Model providers: an interface, a registry by `provider/model`, and offline ones for tests and plans."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def chat(self, messages: list[dict]) -> str: ...

    def chat_json(self, messages: list[dict], schema: dict) -> dict: ...

    def chat_stream(self, messages: list[dict]) -> Iterator[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def token_probs(self, messages: list[dict], choices: list[str]) -> dict[str, float]: ...

    def models(self) -> list[str]: ...


class HashingEmbedder:
    """Vectors of hashed character trigrams and words, unit length.  Equal texts have equal vectors anywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def one(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        low = text.lower()
        for g in [low[i : i + 3] for i in range(max(1, len(low) - 2))] + re.findall(r"\w+", low):
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1 if h >> 63 else -1
        return (v / max(float(np.linalg.norm(v)), 1e-9)).astype(np.float32).tolist()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]


class ExtractiveChat(HashingEmbedder):
    """Answers with the sentences of the material nearest the question; probabilities by word overlap."""

    def chat(self, messages: list[dict]) -> str:
        question, material = messages[-1]["content"], "\n".join(m["content"] for m in messages[:-1])
        parts = [s.strip() for s in re.split(r"(?<=[。！？.!?])\s*|\n", material) if s.strip()]
        words = set(re.findall(r"\w+", question.lower()))
        ranked = sorted(range(len(parts)), key=lambda i: (-len(words & set(re.findall(r"\w+", parts[i].lower()))), i))
        return " ".join(parts[i] for i in sorted(ranked[:3]))

    def chat_json(self, messages: list[dict], schema: dict) -> dict:
        kinds = {"array": [], "string": "", "boolean": False, "integer": 0, "number": 0.0, "object": {}}
        text = self.chat(messages)
        return {k: (text if v.get("type") == "string" else [text] if v.get("type") == "array" else kinds.get(v.get("type"))) for k, v in schema.get("properties", {}).items()}

    def chat_stream(self, messages: list[dict]) -> Iterator[str]:
        yield from re.findall(r"\S+\s*", self.chat(messages))

    def token_probs(self, messages: list[dict], choices: list[str]) -> dict[str, float]:
        text = json.dumps(messages, ensure_ascii=False).lower()
        weight = [1 + text.count(c.lower()) for c in choices]
        return {c: w / sum(weight) for c, w in zip(choices, weight, strict=True)}

    def models(self) -> list[str]:
        return ["extractive"]


class Registry:
    """Providers by name; a reference is `provider/model`, or a model of the default provider."""

    def __init__(self, default: str = "offline"):
        self.default, self.known = default, {"offline": ExtractiveChat()}

    def add(self, name: str, provider: Provider) -> None:
        self.known[name] = provider

    def resolve(self, ref: str) -> tuple[Provider, str]:
        name, slash, model = ref.partition("/")
        name, model = (name, model) if slash and name else (self.default, ref)
        if name not in self.known:
            raise KeyError(f"no provider named {name}")
        return self.known[name], model


def embed_column(df: DataFrame, provider: Provider, text: str, out: str = "embedding", batch: int = 16) -> DataFrame:
    """`df` with a vector of each text, some texts a call.  Fewer vectors than texts is an error."""
    names = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema) + f", `{out}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(names.index(text)).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in provider.embed(texts[i : i + batch])]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def chat_column(df: DataFrame, provider: Provider, prompt: str, out: str = "answer") -> DataFrame:
    """`df` with an answer to the messages (array of role and content) in each row."""
    names = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = [provider.chat(m) for m in b.column(names.index(prompt)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def messages_column(system, question):
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), question.alias("content")))
