import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from spanwise.llm import bitpack, packing
from spanwise.llm.tokens import Encoder, default_path, encoder
from spanwise.session import LEAN, load, materialize
from tokenizers import Tokenizer

RAW = Tokenizer.from_file(default_path())
RAW.encode_special_tokens = True
ODD = ["", None, " ", "a  b", "a\n\nb", " lead", "trail ", "tab\tx", "x\r\ny", "it's we'll", "日本 語\nünï", "a\x85b c", "<|endoftext|> x", "12 3.4,5%%% ###", "é ​ z", "x\x1cy z"]


def ids(text):
    return RAW.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet="ab ,.'\n\t!1é 日<|>s", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    assert np.frombuffer(encoder(default_path()).encode(text), "<u4").tolist() == ids(text)


@given(st.lists(st.integers(1, 9000), max_size=80))
@settings(max_examples=100, deadline=None)
def test_pack(lengths):
    pieces = packing.pack(lengths)
    ends = defaultdict(list)
    spans = defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert 0 < n <= 2048
        ends[s].append((offset, n))
        spans[d].append((start, n))
    for parts, in zip([*ends.values(), *spans.values()]):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert [sum(n for _, n in spans[d]) for d in range(len(lengths))] == lengths
    assert all(sum(n for _, n in p) <= 2048 for p in ends.values()) and len(ends) == -(-sum(lengths) // 2048)


@given(st.integers(1, 20), st.data())
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(width, data):
    docs = data.draw(st.lists(st.lists(st.integers(0, 2**width - 1), max_size=90), max_size=12))
    out = io.BytesIO()
    writer = bitpack.Writer(out, width, 16)
    for i, d in enumerate(docs):
        writer.add(None if i == 3 else i - 5, np.array(d, np.uint32))
    writer.close()
    reader = bitpack.Reader(io.BytesIO(out.getvalue()))
    for i, (d, row) in enumerate(zip(docs, reader.docs)):
        assert reader.ids(int(row["first"]), int(row["n"])).tolist() == d and (row["doc_id"] == i - 5 or i == 3 and not row["present"])


def rows_of(spark, sf_dir):
    found = [(r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()]
    return found + [(-50 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "same"), (5, "same"), (2**60 + 1, "large id")]


def test_packed(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = sorted((str(d), len(x := [*ids(t), 1])) for d, t in rows)
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    texts = dict(rows)
    for d, parts in docs.items():
        if d != 5:
            full, at = np.array([*ids(texts[d]), 1], "<u4"), 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(full)
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(full[r["start"] : at].tobytes())
            assert at == len(full)
    padded = sum(2048 for _ in sequences)
    assert padded - sum(r["length"] for r in got) < 3 * 2048


@pytest.mark.parametrize("file_ids", [16_000_000, 3_000])
def test_files(spark, sf_dir, monkeypatch, file_ids):
    monkeypatch.setattr(bitpack, "FILE_IDS", file_ids)
    rows = rows_of(spark, sf_dir)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in bitpack.read(bitpack.write(docs)).collect()), key=lambda r: r[1])
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        x = np.array([*ids(t), 2], "<u4")
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    assert bitpack.read(bitpack.write(docs.limit(0))).collect() == []


def test_plain_words_skip_the_pattern():
    """A space and letters are one word of the pattern, which need not look for it."""
    made = Encoder(default_path())

    def find(piece):
        raise AssertionError(piece)

    made.first["Ein"]  # no space before it
    made.find = find
    text = " ".join(["Ein", "neues", "Wort", "straße", "ÉTÉ", "слово", "日本", "ªº", "ǅ", "zuletzt,", "Ende."])
    assert np.frombuffer(made.encode(text), "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_beside_letters():
    made = Encoder(default_path())
    text = "x Ⅷ áb ñ x² ½ h‍t 'll can't _a a_b ́ e9 ١٢ \U0001f600 क्षि a﻿b ʼn"
    assert np.frombuffer(made.encode(text), "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_kept_once():
    made = Encoder(default_path())
    text = "Ein Wort, noch eins"
    assert made.encode(text) == np.array(made.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert {"Wort", "Wort,", "noch", "eins"} == set(made.next) and not {" Wort", " noch"} & set(made.words)


def test_files_are_written_by_lean_workers(spark, sf_dir, monkeypatch):
    """The files are written in batches of 1,000 rows, by workers that give memory back."""
    environment, seen = spark.sparkContext.environment, {}
    for name in LEAN:
        monkeypatch.delitem(environment, name, raising=False)

    def written(df, label, **options):
        seen.update(environment, rows=spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return materialize(df, label, **options)

    monkeypatch.setattr(bitpack, "materialize", written)
    found = bitpack.query(spark, sf_dir)
    assert LEAN.items() <= seen.items() and seen["rows"] == "1000"
    assert found.count() == load(spark, sf_dir, "documents").count()
