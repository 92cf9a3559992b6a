"""Embedding of text columns by a pluggable provider: distinct texts once, bounded batches, smaller ones after a refusal."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.search import prepared_for_embedding

#: A provider takes texts and gives a vector for each, in order; it raises ValueError on texts that it refuses.
Provider = Callable[[list[str]], list[list[float]]]
#: Texts of a call, and the lengths to which a single refused text is cut in turn.
BATCH, CUTS = 16, (4096, 2048, 1024, 512, 256, 128, 64)


def hashing_provider(width: int = 64) -> Provider:
    """Vectors of signed word hashes, of length one; the same everywhere and without a model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(width)
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % width] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embedded(provider: Provider, texts: list[str]) -> list[list[float] | None]:
    """Vectors in order. A refused batch is halved; a refused text is cut shorter and shorter, and is null at last."""
    try:
        return list(provider(texts))
    except ValueError:
        if len(texts) > 1:
            half = len(texts) // 2
            return embedded(provider, texts[:half]) + embedded(provider, texts[half:])
    for size in CUTS:
        if size < len(texts[0]):
            try:
                return list(provider([texts[0][:size]]))
            except ValueError:
                pass
    return [None]


def with_embeddings(rows: DataFrame, text: str, provider: Provider, batch: int = BATCH) -> DataFrame:
    """rows with `embedding`; equal texts are embedded once."""
    keyed = rows.withColumn("__text", prepared_for_embedding(F.col(text))).withColumn("__key", F.sha2("__text", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for at in range(0, len(texts), batch):
                found = embedded(provider, texts[at : at + batch])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + batch]), pa.array(found, pa.list_(pa.float64()))], ["__key", "embedding"])

    once = keyed.select("__key", "__text").dropDuplicates(["__key"]).mapInArrow(run, "__key string, embedding array<double>")
    return keyed.join(once, "__key").drop("__key", "__text")
