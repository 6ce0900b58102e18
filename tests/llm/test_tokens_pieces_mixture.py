import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from noteweave.llm import mixture, pieces, tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(*tokens.vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def _ids(encoder, text):
    return [i for w in encoder.batch(pd.Series([text]))[0] for i in w]


@pytest.mark.parametrize("text", ["", " ", "a", "Hello  world\n\n x", "<|endoftext|>", "naïve café 東京 ไทย 🙂‍", "a" * 3000, "\u0085 \t\r\n", "don't 12345 !?"])
def test_like_the_library(encoder, library, text):
    assert _ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_random_words(encoder, library):
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice("abcdeé ñ0:-\n東") for _ in range(rng.randint(1, 60)))
        assert _ids(encoder, t) == library.encode(t, add_special_tokens=False).ids


def test_long_word_in_stages(encoder, library, monkeypatch):
    monkeypatch.setattr(tokens, "ROWS", 2000)
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(900))
    assert _ids(encoder, t) == library.encode(t, add_special_tokens=False).ids


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "a b", "y"), (3, "a b", "y")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], len(r["ids"])) for r in tokens.encode_documents(spark, df).orderBy("doc_id").collect()]
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokens.encode_documents(spark, df.limit(0)).count() == 0


# ---- pieces


@pytest.mark.parametrize("unit", ["word ", "Sentence one ends. ", "x", "東", "line\n", "para\n\n", "é", "é", "\r\n"])
def test_pieces_keep_the_text(unit):
    for n in (0, 1, 1999, 2000, 2001, 9000):
        t = (unit * n)[:n]
        p = pieces.split_text(t)
        assert "".join(t[a + o : b] for _, a, b, o in p) == t
        assert all(b - a <= 2000 and o <= 200 for _, a, b, o in p) and [x[0] for x in p] == list(range(1, len(p) + 1))
        assert len(p) == 1 if n <= 2000 else len(p) > 1
        if unit == "é":
            assert all(t[a] != "́" for _, a, b, _ in p if b > a)


def test_cut_at_paragraph():
    t = "a " * 600 + "\n\n" + "b " * 600
    (_, _, end, _), (_, start, _, over) = pieces.split_text(t)
    assert t[:end].endswith("\n\n") and start + over == end


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "short", 5), (4, "w. " * 1000, 5), (4, "w. " * 1000, 5)], "id long, text string, piece_no int")
    got = pieces.split_documents(df)
    assert sorted((r["id"], r["piece_no"]) for r in got.where("id < 4").collect()) == [(2, 1), (3, 1)]
    assert got.where("id = 4 and piece_no = 1").count() == 2
    assert pieces.split_documents(df.limit(0)).count() == 0


# ---- mixture


def _mix(spark, rows, targets):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixture.mixture(spark, docs, t), mixture.shares(spark, docs, t)


def test_shares(spark):
    rows = [(i, "big", "word " * 20) for i in range(400)] + [(1000 + i, "small", "word " * 20) for i in range(40)] + [(5000, None, "x"), (5001, "unknown", "x"), (5002, "big", None)]
    mix, rep = _mix(spark, rows, [("big", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 3)])
    r = {x["source"]: x for x in rep.collect()}
    assert abs(r["big"]["actual_share"] - 2 / 3) < 0.02 and abs(r["small"]["actual_share"] - 1 / 3) < 0.02
    assert r["small"]["most_repeats"] == 2 and r["absent"]["n_used"] == 0 and r["absent"]["outcome"] == "no tokens to draw from"
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    order = [x["finish"] for x in mix.collect()]
    assert order == sorted(order)


def test_budget(spark):
    """A given total is kept; a source that can't fill its share ends and is reported."""
    rows = [(i, "big", "word " * 20) for i in range(400)] + [(1000 + i, "small", "word " * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    one = mixture.sized(spark, docs).agg(F.max("n_tokens")).first()[0]
    some = {r["source"]: r for r in mixture.shares(spark, docs, t, budget=40 * one).collect()}
    assert some["big"]["n_used"] == 20 == some["small"]["n_used"] and some["big"]["outcome"] == "reached" == some["small"]["outcome"]
    most = {r["source"]: r for r in mixture.shares(spark, docs, t, budget=400 * one).collect()}
    assert most["big"]["n_used"] == 200 and most["small"]["n_used"] == 80 and most["small"]["most_repeats"] == 2 and most["small"]["outcome"] == "repeats used up"


def test_buckets_give_the_same_order(spark, monkeypatch):
    rows = [(i, "a", "w " * (i % 7)) for i in range(300)]
    one = [(r["doc_id"], r["finish"]) for r in _mix(spark, rows, [("a", 1.0, 2)])[0].collect()]
    monkeypatch.setattr(mixture, "PER_BUCKET", 10)
    assert one == [(r["doc_id"], r["finish"]) for r in _mix(spark, rows, [("a", 1.0, 2)])[0].collect()]


def test_empty_mixture(spark):
    mix, rep = _mix(spark, [], [("a", 1.0, 1)])
    assert mix.count() == 0 and rep.count() == 1
