"""Embedders: an interface, a client for the usual HTTP endpoint, and a
deterministic stand-in for offline work."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, FLOOR, FINGERPRINT_FLOOR = 32, 256, 0.999


class NoAnswer(RuntimeError):
    """The endpoint could not be reached."""


class Refused(RuntimeError):
    """The endpoint answered, but not with vectors."""


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of hashed lower-case words, normalised.  No model: a stand-in whose
    results any engine can reproduce."""

    dim: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for w in text.lower().split():
                out[k, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(size == 0, 1, size)


@dataclass(frozen=True)
class HttpEmbedder:
    """POSTs {"model", "input"} and reads {"data": [{"index", "embedding"}]}."""

    endpoint: str
    model: str = ""
    key: str | None = None
    allow_insecure: bool = False
    timeout: float = 120

    def embed(self, texts: list[str]) -> np.ndarray:
        check_transport(self.endpoint, self.allow_insecure)
        out: list = [None] * len(texts)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            body = json.dumps({"model": self.model, "input": part}).encode()
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(self.endpoint, body, headers), timeout=self.timeout) as r:
                    rows = json.load(r)["data"]
            except urllib.error.HTTPError as e:
                raise Refused(f"{self.endpoint}: {e.code}") from e
            except (KeyError, ValueError) as e:
                raise Refused(f"{self.endpoint}: no vectors in the answer") from e
            except OSError as e:
                raise NoAnswer(f"{self.endpoint}: {e}") from e
            for r in rows:
                if not 0 <= r["index"] < len(part):
                    raise Refused(f"index {r['index']} out of range")
                out[at + r["index"]] = r["embedding"]
            if any(x is None for x in out[at : at + len(part)]):
                raise Refused("the answer misses an input")
        made = np.asarray(out, np.float64).reshape(len(texts), -1)
        size = np.sqrt((made**2).sum(axis=1, keepdims=True))
        return made / np.where(size == 0, 1, size)


def check_transport(endpoint: str, allow_insecure: bool) -> None:
    """Plain text may not leave the machine unless that is asked for."""
    parts = urlsplit(endpoint)
    if parts.scheme == "http" and (parts.hostname or "") not in ("localhost", "127.0.0.1", "::1") and not allow_insecure:
        raise ValueError(f"{endpoint} would send texts unencrypted; pass allow_insecure to do so")


def calibrate(embedder, longest: str, budget: int) -> int:
    """The budget the endpoint accepts for the longest text: halved on each refusal,
    never on silence, and no lower than FLOOR."""
    while True:
        try:
            embedder.embed([longest[:budget]])
            return budget
        except Refused:
            budget //= 2
            if budget < FLOOR:
                raise


def embed(df: DataFrame, text: str, embedder, out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a text column, BATCH texts at a time."""
    names = [c for c in df.columns if c != text]
    schema = df.drop(text).withColumn(out, F.array().cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            rows = [v for at in range(0, len(texts), BATCH) for v in embedder.embed(texts[at : at + BATCH]).astype(np.float32).tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(rows, pa.list_(pa.float32()))], names=[*names, out])

    return df.mapInArrow(run, schema)


#: Sentences whose distances show whether an endpoint gives meaning (fixed values of ours).
PROBES = ("The cat sleeps on the warm sofa.", "A kitten is napping on the couch.", "Quarterly revenue grew by nine percent.")


def probe(embedder) -> dict[str, float]:
    """near, far: a sane endpoint has near > far and far not close to 1."""
    a, b, c = embedder.embed(list(PROBES))
    near, far = float(a @ b), float(a @ c)
    if near <= far or far > 0.95:
        raise ValueError(f"the endpoint doesn't tell texts apart: near {near:.3f}, far {far:.3f}")
    return {"near": near, "far": far}
