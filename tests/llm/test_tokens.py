"""Token counts and the codec against the library itself."""

import random
import struct

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sentencepiece_codec as codec
from millrace.llm import token_counts
from millrace.llm.common import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = token_counts.MODEL


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def wanted(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(library.decode(ids))


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in codec.round_trip(docs).collect()}
    assert got == {i: wanted(library, t) for i, t in texts.items()}
    counted = {r.doc_id: tuple(r)[1:] for r in token_counts.count_tokens(docs).collect()}
    assert counted == {i: (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in texts.items()}


def test_odd_texts(odd, none, library):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in codec.round_trip(odd).collect()) == sorted(repr((i, *wanted(library, t))) for i, t in rows)
    got = sorted(repr((r.doc_id, r.n_tokens)) for r in token_counts.count_tokens(odd).collect())
    assert got == sorted(repr((i, len(library.encode(t or "")))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.ids)) for r in codec.encode(odd).collect()) == sorted(repr((i, library.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows)
    assert codec.encode(none).count() == 0
    assert codec.round_trip(none).count() == token_counts.count_tokens(none).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁  \t\n.,1290abcéßäöüñçЖя²_-'")), max_size=60))
def test_any_text(text):
    library = token_counts.load(MODEL)
    assert codec.ids_of(codec.encode_bytes(MODEL, text))[1:-1] == library.encode(text)
    assert token_counts.counts(MODEL).of(text) == len(library.encode(text))


def test_runs_of_one_character(library):
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("aeo =-*. 0\n") * r.randrange(1, 40) for _ in range(6))
        assert codec.ids_of(codec.encode_bytes(MODEL, text))[1:-1] == library.encode(text)
