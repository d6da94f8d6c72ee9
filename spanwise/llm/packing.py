"""Packing documents into training sequences of balanced cost.

A sequence of n tokens costs about ``LINEAR * n`` for the layers that work token
by token, and each document in it ``QUADRATIC * length ** 2`` for attention, which
does not cross documents. Full-length pieces of long documents fill sequences of
their own. The other pieces of a group are taken in descending length, each into
the sequence of lowest cost that still has room for it; where none has room, the
piece is cut to what is free. A group opens just as many sequences as its tokens
need, so it pads less than one sequence whatever its documents are.

A group is about ``GROUP_TOKENS`` tokens of one input partition, in its order, so
packing moves no text and each task works on bounded memory: what follows the
scan is one pass. sequence_id holds the partition number and a count within it.

Cases: null texts are empty; an empty document is its end token alone. Repeated
rows are packed each. Documents of any length are cut into pieces of at most a
sequence. An empty table gives no pieces. Extra columns are not kept.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.tokens import ENTRIES, default_path, encoder
from spanwise.session import load

LENGTH = 2_048
END = 1
GROUP_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4_096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of a group."""
    out, sequence, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    count = -(-sum(r[0] for r in rest) // capacity)
    used = [0] * count
    queue = [(0.0, s) for s in range(count)]  # by cost, then number
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        aside, placed = [], False
        while queue:
            c, s = heapq.heappop(queue)
            if used[s] + n <= capacity:
                out.append((d, start, n, sequence + s, used[s]))
                used[s] += n
                if used[s] < capacity:
                    aside.append((c + cost(n), s))
                placed = True
                break
            aside.append((c, s))
        if placed:
            for x in aside:
                heapq.heappush(queue, x)
            continue
        aside.sort()  # no sequence has room for all of it: cut it over the cheapest
        for i, (c, s) in enumerate(aside):
            m = min(n, capacity - used[s])
            out.append((d, start, m, sequence + s, used[s]))
            used[s] += m
            start, n = start + m, n - m
            if used[s] < capacity:
                heapq.heappush(queue, (c + cost(m), s))
            if not n:
                for x in aside[i + 1 :]:
                    heapq.heappush(queue, x)
                break
    return out


def packed(docs: DataFrame, path: str | None = None, capacity: int = LENGTH, end: int = END, entries: int = ENTRIES, special: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) with their places, in SCHEMA; entries bounds
    the encoder's cache in each worker and changes no result; with special, literals
    of special tokens become their ids."""
    path = path or default_path()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, entries, special).encode
        tail = np.array([end], dtype="<u4").tobytes()
        base, done = TaskContext.get().partitionId() << 32, 0
        ids: list[bytes] = []
        names: list = []

        def flush() -> pd.DataFrame:
            nonlocal done, ids, names
            pieces = pack([len(x) // 4 for x in ids], capacity)
            frame = pd.DataFrame({
                "doc_id": pd.array([names[p[0]] for p in pieces], dtype="Int64"),
                "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
                "ids_crc32": [zlib.crc32(memoryview(ids[p[0]])[4 * p[1] : 4 * (p[1] + p[2])]) for p in pieces],
                "doc_tokens": [len(ids[p[0]]) // 4 for p in pieces],
                "sequence_id": [base + done + p[3] for p in pieces], "offset": [p[4] for p in pieces],
            })
            done += 1 + max((p[3] for p in pieces), default=-1)
            ids, names = [], []
            return frame

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                names.append(None if doc_id is None else int(doc_id))
                ids.append(encode(text) + tail)
                held += len(ids[-1]) // 4
                if held >= GROUP_TOKENS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    # ids travel as text, since pandas has no null integers
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(task, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"), special=True)
