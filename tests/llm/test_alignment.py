import hashlib
from collections import Counter

import pytest
from spanwise.llm import alignment
from spanwise.session import load

PATHS = alignment.default_paths()


def brute(rows):
    """Every document on its own, by the libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    bytes_a = alignment._letters_bytes(PATHS[0])

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    linked, groups, sizes, count, top = [], [], [], Counter(), Counter()
    for _, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = b" " + text.encode() if text else b""
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b = [], []
        spans = []
        for ids, of in ((a, bytes_a.__getitem__), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(out)
        links, j = [], 0
        for lo, hi, x in spans[0]:
            while j and spans[1][j][0] > lo:
                j -= 1
            while spans[1][j][1] <= lo:
                j += 1
            while j < len(spans[1]) and spans[1][j][0] < hi:
                links.append((x, spans[1][j][2]))
                j += 1
            j -= 1
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        cut, p, q = [], 0, 0
        for end in ends:
            one, two = [], []
            while p < len(a) and spans[0][p][1] <= end:
                one.append(str(a[p]))
                p += 1
            while q < len(b) and spans[1][q][1] <= end:
                two.append(str(b[q]))
                q += 1
            cut.append(",".join(one) + "|" + ",".join(two))
        linked.append(links)
        groups.append(cut)
        sizes.append((len(a), len(b)))
        count.update(links)
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        ((doc_id, *size, len(cut), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
          hashlib.sha256(";".join(cut).encode()).hexdigest() if cut else "") for (doc_id, _), size, cut, links in zip(rows, sizes, groups, linked)),
        key=str,
    )


def got(spark, rows, known=alignment.KNOWN):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, links string")  # clashing extra columns
    return sorted((tuple(r) for r in alignment.align(docs, known=known).collect()), key=str)


CASES = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a"), (6, "  two  spaces "), (7, "tab\there\r\nline\n\n\nthree\n"), (8, "Grüße à l'été 你好 \U0001f600  x"),
    (9, "a ▁ mark"), (10, "<|endoftext|> <s> </s> <0x41> <unk>"), (11, "the cat and the dog " * 400), (11, "the cat and the dog"), (None, "the cat and the dog"),
    (12, "x" * 3000), (13, "é ＡＢ ① ﬁ ​ zero"), (14, "1234567 3.14, a-b_c; don't WE'LL"), (15, " lead\n trail \n  x"), (16, "　wide em"),
]


def test_cases(spark):
    want = brute(CASES)
    assert got(spark, CASES) == want
    assert got(spark, []) == []


@pytest.mark.parametrize("known", [0, 40])
def test_rare_pairs_by_shuffle(spark, known):
    """With few or no known pairs the counts come from the buckets: same rows."""
    assert got(spark, CASES, known) == brute(CASES)


def test_given_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.align(docs).collect()), key=str) == brute(rows)


def test_links(spark):
    rows = {r["doc_id"]: r["links"] for r in alignment.links(spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")).collect()}
    assert rows[2] == [] and len(rows[1]) >= 2


def test_byte_encoder_equals_library():
    """Ranks against the library on random characters of all planes and on odd runs."""
    import numpy as np
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATHS[0]), alignment.byte_encoder(PATHS[0])
    library.encode_special_tokens = True
    rng = np.random.default_rng(1)
    pools = [range(0x20, 0x7F), range(0x0, 0x30), range(0xA0, 0x250), range(0x370, 0x530), range(0x600, 0x700), range(0x2000, 0x2070), range(0x4E00, 0x4F00), range(0x1F300, 0x1F400)]
    texts = ["".join(chr(rng.choice(pools[k % 8] if rng.random() < 0.7 else pools[0])) for _ in range(int(rng.integers(1, 60)))) for k in range(1500)]
    texts += [t for _, t in CASES if t] + ["aaaa" * 30, "zzzz zz", " \n \n", "\u3000\u2028x", "'s'S''ll 've", "<|endoftext|>"]
    for text in texts:
        assert list(memoryview(own(" " + text)).cast("I")) == library.encode(" " + text, add_special_tokens=False).ids, repr(text)
