"""Seams to models and remote parsers: small registries of functions with deterministic offline defaults.

A provider is a plain function over a list of values of one Arrow batch; nothing here opens a connection.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDERS: dict[str, dict[str, Callable]] = {"embedding": {}, "parser": {}, "judge": {}}


def register(kind: str, name: str, provider: Callable) -> None:
    if kind not in PROVIDERS:
        raise KeyError(f"kinds are {sorted(PROVIDERS)}")
    PROVIDERS[kind][name] = provider


def provider(kind: str, name: str) -> Callable:
    try:
        return PROVIDERS[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} provider {name!r}; known: {sorted(PROVIDERS.get(kind, {}))}") from None


def hashed_embedding(texts: list[str | None], dims: int = 64) -> list[list[float] | None]:
    """Unit vectors of hashed character trigrams with signs; null for null, zeros for texts of fewer than three characters."""
    out: list[list[float] | None] = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        v = np.zeros(dims, dtype=np.float32)
        low = " ".join(t.lower().split())
        for i in range(len(low) - 2):
            h = zlib.crc32(low[i : i + 3].encode())
            v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return out


def lines_of_text(contents: list[bytes | None]) -> list[str | None]:
    """The offline parser: UTF-8 text as it is, null for anything else."""
    out: list[str | None] = []
    for c in contents:
        try:
            out.append(None if c is None or b"\0" in c[:8192] else c.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(None)
    return out


register("embedding", "hashed", hashed_embedding)
register("parser", "text", lines_of_text)


def embed(df: DataFrame, id_col: str, text_col: str, name: str = "hashed") -> DataFrame:
    """(id, embedding) by a registered provider, batch by batch."""
    f = provider("embedding", name)
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(b.column(1).to_pylist()), pa.list_(pa.float32()))], names=["id", "embedding"])

    return slim.mapInArrow(run, "id string, embedding array<float>")
