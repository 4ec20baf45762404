"""Embedding of texts by a function that the user brings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscale.functions.text import hash_embedding

#: Texts handed to an embedder at once.
BATCH = 16
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hash_embedder(dim: int = 768) -> Embedder:
    """The Python twin of hash_embedding."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return [[d[i % 32] / 255 for i in range(dim)] for d in digests]

    return embed


def embed(rows: DataFrame, embedder: Embedder, key: str = "timeline_id", text: str = "text", dim: int = 768, batch: int = BATCH) -> DataFrame:
    """(key, status, embedding, error) of every row: ok, blank (no text), or the failure of its batch.

    Batches are embedded on the executors; a failing one fails its own rows only. A vector of another size than dim has
    the status wrong_dim and is dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            filled = [(k, t) for k, t in zip(frame[key], frame[text], strict=True) if isinstance(t, str) and t.strip()]
            known = {k for k, _ in filled}
            out += [(k, "blank", None, None) for k in frame[key] if k not in known]
            for at in range(0, len(filled), batch):
                part = filled[at : at + batch]
                try:
                    vectors = embedder([t for _, t in part])
                    out += [(k, "ok", list(map(float, v)), None) if len(v) == dim else (k, "wrong_dim", None, f"{len(v)} values") for (k, _), v in zip(part, vectors, strict=True)]
                except ConnectionError as error:
                    out += [(k, "unavailable", None, str(error)[:500]) for k, _ in part]
                except Exception as error:  # noqa: BLE001  an embedder may fail in any way; the rows are tried again
                    out += [(k, "error", None, str(error)[:500]) for k, _ in part]
            yield pd.DataFrame(out, columns=[key, "status", "embedding", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, status string, embedding array<double>, error string")


def embed_by_hash(rows: DataFrame, key: str = "timeline_id", text: str = "text", dim: int = 768) -> DataFrame:
    """The same with hash_embedding, in column expressions."""
    blank = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
    return rows.select(key, F.when(blank, "blank").otherwise("ok").alias("status"), F.when(~blank, hash_embedding(F.col(text), dim)).alias("embedding"), F.lit(None).cast("string").alias("error"))
