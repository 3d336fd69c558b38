import os

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import queries, token_counts

DATA = "/root/testdata/sf0.01"
MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def merges():
    return token_counts.Merges(*token_counts.pieces(MODEL))


@settings(max_examples=300, deadline=None)
@given(text=st.text("ab the quick▁é一\n\t😀 ", max_size=30))
def test_merges_equal_the_model(model, merges, text):
    assert merges.text(text)[1] == len(model.encode(text))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_query_counts_as_the_model_file(spark, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_counts(spark, DATA).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in texts.items()}


def test_odd_rows(docs, empty, merges):
    got = token_counts.merged_counts(docs, MODEL).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(merges.text(r["text"])[1] for r in docs.collect())
    assert token_counts.merged_counts(empty, MODEL).count() == 0
