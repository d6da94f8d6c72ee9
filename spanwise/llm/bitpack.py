"""Token ids in files of fixed-width packed bits.

Every id takes the least bits that hold the vocabulary (16 for 50,257 ids). Ids
are packed low bit first in blocks of ``BLOCK`` ids, each block padded to a byte.
A file is, little-endian:

- magic ``SPWBITS1``, width u32, ids a block u32;
- the blocks;
- block offsets u64 (one a block and the end of the last);
- the index of documents: present u8, doc_id i64, first id u64, number of ids u64;
- trailer: number of ids u64, of blocks u64, of documents u64, offset of the
  block offsets u64.

Any range of ids is read by seeking to its blocks and unpacking them with numpy.

Documents are dealt to files by ascending (id, hash of the text): a range sort
sets the boundaries, so rows that share an id spread over several ranges too. Each range is one task that encodes and writes its files in order
(a new file after ``FILE_IDS`` ids), under a name that holds the attempt; the
manifest lists the files of the attempts that succeeded, so a lost executor
leaves an unlisted file behind and nothing else. Files go to the folder that all
executors share, through the file system of its address.

Cases: null texts are empty and give the end id alone; null doc_ids come first;
repeated ids are ordered by a hash of the text, then the text. An empty table gives no files and no rows. Extra columns
are not stored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.llm.tokens import default_path, encoder
from spanwise.session import few_rows, lean_workers, load, materialize, new_path, partitions

MAGIC = b"SPWBITS1"
BLOCK = 4_096
FILE_IDS = 16_000_000
END = 2
_DOC = np.dtype([("present", "u1"), ("doc_id", "<i8"), ("first", "<u8"), ("n", "<u8")])


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids in ``width`` bits each, low bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file; ids come document by document."""

    def __init__(self, out, width: int, block: int = BLOCK) -> None:
        self.out, self.width, self.block = out, width, block
        self.rest, self.at, self.n, self.offsets, self.docs = np.zeros(0, np.uint32), 0, 0, [], []
        self._put(MAGIC + struct.pack("<II", width, block))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, self.n, len(ids)))
        self.n += len(ids)
        held = np.concatenate([self.rest, ids])
        full = len(held) // self.block * self.block
        for k in range(0, full, self.block):
            self.offsets.append(self.at)
            self._put(pack_bits(held[k : k + self.block], self.width))
        self.rest = held[full:]

    def close(self) -> None:
        if len(self.rest):
            self.offsets.append(self.at)
            self._put(pack_bits(self.rest, self.width))
        blocks, where = len(self.offsets), self.at
        self._put(np.array([*self.offsets, where], dtype="<u8").tobytes())
        self._put(np.array(self.docs, dtype=_DOC).tobytes())
        self._put(struct.pack("<QQQQ", self.n, blocks, len(self.docs), where))


class Reader:
    """Reads a file with seeks: only the trailer and index are held."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2)
        self.n, blocks, docs, where = struct.unpack("<QQQQ", self._get(size - 32, 32))
        head = self._get(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.width, self.block = struct.unpack("<II", head[8:])
        self.offsets = np.frombuffer(self._get(where, 8 * blocks + 8), "<u8")
        self.docs = np.frombuffer(self._get(where + 8 * blocks + 8, _DOC.itemsize * docs), _DOC)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """ids first .. first + n of the file, from the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint32)
        lo, hi = first // self.block, (first + n - 1) // self.block
        begin = int(self.offsets[lo])
        data = self._get(begin, int(self.offsets[hi + 1]) - begin)
        found = []
        for k in range(lo, hi + 1):
            m = min(self.block, self.n - k * self.block)
            found.append(unpack_bits(data[int(self.offsets[k]) - begin : int(self.offsets[k + 1]) - begin], m, self.width))
        return np.concatenate(found)[first - lo * self.block :][:n]


def _store(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", address))


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme under which Spark itself finds it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(conf).makeQualified(path).toString()


def write(docs: DataFrame, path: str | None = None, end: int = END, folder: str | None = None, special: bool = False) -> DataFrame:
    """Write the ids of docs (doc_id, text); the manifest: range, file number in
    it, address and number of ids. With special, literals of special tokens become
    their ids."""
    spark, path = docs.sparkSession, path or default_path()
    folder = folder or new_path(spark, "packed-ids")
    folder = _address(spark, folder)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoder(path, special=special)
        width, tail = width_of(made.size), np.array([end], np.uint32)
        store, root = _store(folder)
        rows, now, count, writer, out, name = [], None, 0, None, None, ""

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                out.close()
                rows.append((now, count, name, writer.n))
                writer = None

        for batch in batches:
            for part, doc_id, text in zip(batch["part"], batch["doc_id"], batch["text"]):
                if part != now or (writer is not None and writer.n >= FILE_IDS):
                    close()
                    now, count = part, count + 1 if part == now else 0
                if writer is None:
                    store.create_dir(root, recursive=True)
                    name = f"{root}/ids-{part:06d}-{count:04d}-{uuid.uuid4().hex}.bits"
                    out = store.open_output_stream(name)
                    writer = Writer(out, width)
                writer.add(None if doc_id is None else int(doc_id), np.concatenate([np.frombuffer(made.encode(text), "<u4"), tail]))
        close()
        yield pd.DataFrame(rows, columns=["part", "file", "address", "n_ids"])

    # ranges of (id, text), so rows that share an id, or have none, are many parts
    keys = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc(), F.asc_nulls_first("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), *keys[:2]).sortWithinPartitions(*keys)
    dealt = dealt.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return dealt.mapInPandas(task, "part int, file int, address string, n_ids long")


def read(manifest: DataFrame, folder_of: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    folder = folder_of and _address(manifest.sparkSession, folder_of)
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    files = files.repartition(partitions(manifest.sparkSession), "address")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for address, base in zip(batch["address"], batch["base"]):
                store, _ = _store(folder) if folder else _store(address)
                with store.open_input_file(address) as source:
                    reader = Reader(source)
                    docs = reader.docs
                    for k in range(0, len(docs), 2_000):
                        some = docs[k : k + 2_000]
                        first = int(some["first"][0])
                        ids = reader.ids(first, int(some["first"][-1] + some["n"][-1]) - first).astype("<u4").tobytes()
                        view = memoryview(ids)
                        at = 4 * (some["first"].astype(np.int64) - first)
                        yield pd.DataFrame({
                            "doc_id": pd.array([int(d) if p else None for p, d in zip(some["present"], some["doc_id"])], dtype="Int64"),
                            "start": int(base) + some["first"].astype(np.int64), "n_tokens": some["n"].astype(np.int64),
                            "ids_crc32": [zlib.crc32(view[a : a + 4 * n]) for a, n in zip(at.tolist(), some["n"].tolist())],
                        })

    return files.select("address", "base").mapInPandas(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "packed-ids")
    lean_workers(spark)
    with few_rows(spark):
        manifest = materialize(write(load(spark, sf_dir, "documents"), folder=folder, special=True), "packed-manifest")
    return read(manifest, folder)
