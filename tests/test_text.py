import pytest
from pyspark.sql import functions as F

from noteweave.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("code", "want"), [("i5021", "I50.21"), ("I50.21", "I50.21"), (" i10 ", "I10"), ("99213", "99213"), ("0001f", "0001F"), ("", ""), (None, None)])
def test_format_code(spark, code, want):
    assert one(spark, code, T.format_code) == want


@pytest.mark.parametrize(("code", "want"), [("I50.21", True), ("123.45", False), ("I5", False), ("I50.212345", False)])
def test_valid_code(spark, code, want):
    assert one(spark, code, T.valid_code) is want


@pytest.mark.parametrize(("value", "want"), [('["a", "b"]', ["a", "b"]), ("a; b ;", ["a", "b"]), ("a|b", ["a", "b"]), ("a, b", ["a, b"]), ("[broken", ["[broken"]), ("", [])])
def test_parse_list(spark, value, want):
    assert one(spark, value, T.parse_list) == want


@pytest.mark.parametrize(("value", "want"), [("1", True), ("Yes", True), ("0", False), ("header", False), ("?", None), (None, None)])
def test_parse_flag(spark, value, want):
    assert one(spark, value, T.parse_flag) is want


def test_tokens(spark):
    assert one(spark, "Hx of HTN, T2DM (i50.21).", T.expand_abbreviations) == "Hx of hypertension type 2 diabetes mellitus i50 21"
    assert one(spark, "The HTN and a b x 2", T.clinical_tokens) == ["hypertension", "b", "2"]
    assert one(spark, "kidney stones", lambda c: T.related_tokens(T.clinical_tokens(c))) == ["kidney", "stones", "renal", "nephropathy", "calculus", "calculi", "stone", "cholelithiasis", "gallstone", "gallstones"]


def test_normalize(spark):
    assert one(spark, "a  b’s  exam-\n ination\r\n\n\n\nc ", T.normalize_document) == "a b's examination\n\nc"


def test_cues(spark):
    assert one(spark, "No evidence of stroke?", T.polarity) == "NEGATED"
    assert one(spark, "stroke?", T.polarity) == "UNCERTAIN"
    assert one(spark, "acute on chronic pain", T.acuity) == "ACUTE_ON_CHRONIC"
    assert one(spark, "left and right", T.laterality) == "RIGHT"
    assert one(spark, None, T.polarity) == "AFFIRMED"
