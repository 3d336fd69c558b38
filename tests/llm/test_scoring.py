import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import factorisation, queries, token_counts, toxicity

DATA = "/root/testdata/sf0.01"


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = factorisation.Machine(16, np.zeros(3), np.ones(3), 0.2, rng.normal(size=19), rng.normal(size=(19, 4)))
    at, values, stats = np.array([1, 5, 9]), np.array([0.5, 0.3, 0.8]), [0.1, -2.0, 1.0]
    x = np.zeros(19)
    x[at], x[16:] = values, m.standard(np.array(stats))
    z = m.bias + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(19) for j in range(i))
    assert abs(m.score(at, values, stats) - 1 / (1 + np.exp(-z))) < 1e-12


def accuracy(rows, labels, column):
    got = rows.toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    return (held["predicted"] == held[column]).mean(), got


@pytest.mark.parametrize("name,column", [("op1_quality_fm", "quality"), ("op2_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    rows = queries.QUERIES[name](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    share, _ = accuracy(rows, labels, column)
    assert share > 0.95
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_scores_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    none = labels.where("false")
    for data, rows in ((docs, docs.count()), (empty, 0)):
        for given_labels in (labels, none):
            got = factorisation.scores(data, factorisation.trained(data, given_labels)).toPandas()
            assert len(got) == rows and got["score"].between(0, 1).all()
            got = toxicity.scores(data, toxicity.trained(data, given_labels)).toPandas()
            assert len(got) == rows and got["score"].between(0, 1).all()


def edits(a, b):
    """Optimal string alignment distance."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abc", min_size=3, max_size=8), min_size=1, max_size=6), st.booleans())
def test_trie_finds_the_nearest_term(token, terms, whole):
    weights = {t + ("$" if whole else ""): 0.5 + i / 100 for i, t in enumerate(dict.fromkeys(terms))}
    best = None
    for term, weight in weights.items():
        letters = term.rstrip("$")
        d = edits(letters, token)
        n = d[-1, -1] if whole else d[-1].min()
        if n <= (0 if len(letters) < 5 else 1):
            best = min(best or (9,), (n, -weight, term))
    want = None if best is None else (best[2], -best[1], best[0])
    assert toxicity.Trie(weights).nearest(token) == want
    assert toxicity.Scorer(weights, 0.02)._term(token) == want


def test_quotation_is_not_abuse():
    scorer = toxicity.Scorer({"idiot$": 0.95, "scum$": 0.95}, 0.02)
    assert scorer.score("you are an idiot")[0] > 0.9
    assert scorer.score("you are an idoit and more")[0] > 0.5
    assert scorer.score('he said "what an idiot" and left')[0] < 0.5
    assert scorer.score("scun of the earth")[0] < 0.5
    assert scorer.score(None)[0] == scorer.score("")[0] == 0.02


def hf_tokenizer(vocabulary, byte_pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = [("<unk>", 0.0)]
    if byte_pieces:
        table += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    tokenizer = Tokenizer(models.Unigram(table + vocabulary, unk_id=0, byte_fallback=byte_pieces))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


def test_token_counts_equal_the_tokenizer(spark, docs):
    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    vocabulary, byte_pieces = token_counts.pieces(path)
    tokenizer = hf_tokenizer(vocabulary, byte_pieces)
    for data in (docs, spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 3000")):
        got = token_counts.token_counts(data, path).toPandas().groupby("doc_id", dropna=False)["n_tokens"].sum()
        rows = data.select("doc_id", "text").toPandas()
        rows["want"] = [len(e.ids) for e in tokenizer.encode_batch(list(rows["text"].fillna("")), add_special_tokens=False)]
        want = rows.groupby("doc_id", dropna=False)["want"].sum()
        pd.testing.assert_series_equal(got, want, check_names=False, check_index_type=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab▁é", min_size=1, max_size=4), st.integers(-6, 0)), min_size=1, max_size=12),
       st.text("abcé \n", max_size=14), st.booleans())
def test_ties_follow_the_tokenizer(vocabulary, text, byte_pieces):
    vocabulary = [(p, float(s)) for p, s in dict(vocabulary).items()]
    worst = min([0.0, *(s for _, s in vocabulary)])
    counts = token_counts.Counts(vocabulary, byte_pieces, worst - token_counts.UNKNOWN_BELOW)
    want = hf_tokenizer(vocabulary, byte_pieces).encode(text, add_special_tokens=False)
    assert counts.text(text)[1] == len(want.ids)


def test_empty_table(empty):
    assert token_counts.token_counts(empty, f"{queries.TOKENIZERS}/piece_bpe_32k.model").count() == 0


def test_long_tokens_are_judged_whole():
    scorer = toxicity.Scorer({"a" * 64 + "$": 0.9, "idiot$": 0.9, "scumm": 0.9}, 0.02)
    assert scorer.score("a" * 64)[1] == 1 and scorer.score("a" * 65)[1:3] == (1, 1)
    assert scorer.score("a" * 70)[1] == 0 and scorer.score("a" * 64 + "zebra")[1] == 0
    assert scorer.score("idiot" + "x" * 100)[1] == 0 and scorer.score("scumm" + "x" * 100)[1] == 1


def test_rare_terms_stay_beside_very_many_others(spark):
    """60 000 words stand in several toxic texts each, and in as many others."""
    words = [f"w{i:05x}q" for i in range(60_000)]
    lines = [" ".join(words[i::20]) for i in range(20)]
    toxic = [f"{line} {j} uniq{j}x" for j, line in enumerate(lines * 4)] + [f"zorgon {j} own{j}y text{j}z" for j in range(30)]
    other = [f"{line} {j} uniq{j}x" for j, line in enumerate(lines * 4)] + ["plain"] * 40
    frame = lambda texts, first: spark.createDataFrame(
        [(first + i, t) for i, t in enumerate(texts)], "key long, text string").repartition(4)
    got = toxicity.lexicon(frame(toxic, 0), frame(other, 1000))
    assert any(t.startswith("zor") for t in got) and not any(t.startswith("w0") for t in got)
