from hypothesis import given, settings
from hypothesis import strategies as st
from spanwise.llm import unigram_count as u
from spanwise.session import load
from tokenizers import Tokenizer, models, pre_tokenizers


def library(pieces):
    t = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    return t


SMALL = (("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0), ("▁a", -3.0), ("ba", -1.5), ("é", -4.0), ("aé", -5.0))


@given(st.text(alphabet="abé x\n\x1c日", max_size=25))
@settings(max_examples=400, deadline=None)
def test_ties_and_unknowns(text):
    assert u.Counter(SMALL).text(text) == len(library(SMALL).encode(text).ids)


def test_documents(spark, sf_dir):
    tokenizer = library(u.vocabulary(u.default_path()))
    rows = [(r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()] + [(None, None), (-1, ""), (-2, "x\x1fy  z"), (-3, "aß" * 5000), (-3, "aß" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_chars"], r["n_tokens"]) for r in u.token_counts(docs).collect())
    assert got == sorted((str(d), len(t or ""), len(tokenizer.encode(t or "").ids)) for d, t in rows)
    assert u.token_counts(docs.limit(0)).collect() == []
