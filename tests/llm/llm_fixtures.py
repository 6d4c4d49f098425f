"""Fixtures of these tests."""

import os
import sys

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs(spark):
    """Edge rows: nulls, empty, blank, repeated rows, very long, extra and clashing columns."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20000))
    base = " ".join(f"alpha{i}" for i in range(120))
    rows = [(1, base), (2, base), (2, base), (3, base.replace("alpha60 ", "changed ")), (None, None), (5, ""), (6, " \n "),
            (7, "Ünïcode ñandú 漢字 only"), (8, long), (9, "x" * 3000), (10, "a\nb\nc\nd\ne\nf\ng\nh"),
            (11, "z\na\nb\nc\nd\ne\nf\ng\nh"), (12, "one two"), (None, base)]
    return spark.createDataFrame([(i, t, "en", "kept", 1.5) for i, t in rows],
                                 "doc_id long, text string, lang string, kept string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
