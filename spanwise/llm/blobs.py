"""Shuffling packed numpy columns.

Operators that compare millions of hashed windows move them as binary blobs:
each map task sorts its records by bucket and writes one row a bucket and
flush. A record then costs its own bytes in the shuffle instead of a row, and
the reducing task works on whole arrays. Buckets are hash ranges whose number
follows the number of shuffle partitions, so a bucket's size stays bounded as
data and partitions grow together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from spanwise.session import partitions


def bucket_count(spark: SparkSession) -> int:
    return 3 * partitions(spark)


def schema(columns: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high half of a mixed 64-bit hash."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row a bucket with the bytes of each column's records."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_bucket, prepend=-1))
    ends = np.append(cut[1:], len(order))
    out: dict[str, object] = {"bucket": sorted_bucket[cut].astype(np.int32)}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())]
    return pd.DataFrame(out)


def unpack(frame: pd.DataFrame, columns: dict[str, str]) -> dict[str, np.ndarray]:
    """The records of a bucket; columns: name to numpy type."""
    return {c: np.frombuffer(b"".join(frame[c]), dtype=kind) for c, kind in columns.items()}


class Buffer:
    """Gathers records of several batches so that a flush fills its blobs."""

    def __init__(self, names: list[str], limit: int = 500_000) -> None:
        self.names, self.limit, self.size = names, limit, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *arrays: np.ndarray) -> bool:
        """True when the buffer should be flushed."""
        if len(arrays[0]):
            self.parts.append(arrays)
            self.size += len(arrays[0])
        return self.size >= self.limit

    def take(self) -> dict[str, np.ndarray] | None:
        if not self.parts:
            return None
        out = {c: np.concatenate([p[i] for p in self.parts]) for i, c in enumerate(self.names)}
        self.parts, self.size = [], 0
        return out


def slices(frame: pd.DataFrame, column: str, limit: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """A batch in parts of about ``limit`` characters, so that very long texts
    do not multiply the memory of the arrays made from them."""
    length = frame[column].str.len().fillna(0).to_numpy()
    part = np.cumsum(length) // limit
    for k in np.unique(part):
        yield frame[part == k]
