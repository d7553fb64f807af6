"""The seam for embedding models: conditioning, adapters, retries, rate limits."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


@dataclass
class HashingEmbedder:
    """A model without weights: words hashed to signed dimensions. Deterministic everywhere."""

    dim: int = 64

    def embed(self, texts: list[str], kind: str = "doc") -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = hashlib.md5(word.encode()).digest()
                out[row, int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).tolist()


@dataclass(frozen=True)
class Conditioning:
    """How a model wants queries and documents told apart: prefixes, or nothing."""

    query: str = ""
    document: str = ""

    def apply(self, text: str, kind: str) -> str:
        return (self.query if kind == "query" else self.document) + text


DEFAULT = Conditioning(query="Query: ")


def model_version(version: str, *, title: bool = True, path: bool = True, heading: bool = True, tags: bool = True) -> str:
    """A version with a letter for each decoration that is off; changing one is a new version."""
    return version + "".join(c for c, on in zip("npht", (title, path, heading, tags), strict=True) if not on)


def resolve_adapter(model_id: str, adapters: dict[str, Conditioning]) -> Conditioning:
    """The adapter with the longest key that starts or ends the model's id (or its last part)."""
    names = {re.sub(r"[^a-z0-9.-]+", "-", n.lower()) for n in (model_id, model_id.rsplit("/", 1)[-1], model_id.split(":", 1)[0])}
    fits = [k for k in adapters if any(n.startswith(k.lower()) or n.endswith(k.lower()) for n in names)]
    return adapters[max(fits, key=len)] if fits else DEFAULT


@dataclass
class TokenBucket:
    """At most ``rate`` requests a second in one task (0: no limit)."""

    rate: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    ready: float = field(default=0.0)

    def take(self) -> None:
        if self.rate:
            now = self.clock()
            if self.ready > now:
                self.sleep(self.ready - now)
            self.ready = max(now, self.ready) + 1 / self.rate


def with_retries(call: Callable[[], list], attempts: int = 3, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep) -> list:
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            sleep(pause * n)
    return []


def embed(chunks: DataFrame, model: Embedder, *, kind: str = "doc", conditioning: Conditioning = DEFAULT, batch: int = 64, rate: float = 0.0, text: str = "decorated") -> DataFrame:
    """Adds ``embedding`` and ``error``: rows whose batch failed after all retries have a null vector."""
    fields = [f.name for f in chunks.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(rate)
        for b in batches:
            texts = [conditioning.apply(x.as_py() or "", kind) for x in b.column(fields.index(text))]
            vectors: list = []
            errors: list[str | None] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                bucket.take()
                try:
                    vectors += with_retries(lambda part=part: model.embed(part, kind))
                    errors += [None] * len(part)
                except Exception as e:  # a side output: the job goes on, the rows can be retried
                    vectors += [None] * len(part)
                    errors += [str(e)] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*fields, "embedding", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{ddl}, embedding array<float>, error string")
