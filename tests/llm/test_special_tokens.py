"""The queries' encoding is a plain call of the library: a special token's literal is its id."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from spanwise.llm import bitpack, packing
from spanwise.llm.tokens import default_path, encoder
from tokenizers import Tokenizer

PLAIN = Tokenizer.from_file(default_path())
MARK = "<|endoftext|>"


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.one_of(st.just(MARK), st.text(alphabet="ab ,.\n<|>", max_size=8)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_encoder(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder(default_path(), special=True).encode(text), "<u4").tolist() == ids(text)


def test_queries(spark, tmp_path):
    rows = [(1, f"a {MARK} b"), (2, MARK), (3, "plain words\nof text."), (4, f"x{MARK}{MARK}y  z"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files, packs = bitpack.query(spark, str(tmp_path)).collect(), packing.query(spark, str(tmp_path)).collect()
    crc = lambda t, end: zlib.crc32(np.array([*ids(t), end], "<u4").tobytes())
    at, want = 0, []
    for d, t in rows:
        want.append((d, at, len(ids(t)) + 1, crc(t, 2)))
        at += len(ids(t)) + 1
    assert sorted(tuple(r) for r in files) == want and len(ids(MARK)) == 1
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in packs) == [(d, crc(t, 1)) for d, t in rows]
