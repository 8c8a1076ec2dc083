"""Awkward rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row int, score double, spans string, bits long, at int, piece int, "
          "component_id long, mentions string, digest string, tie int, block int, payload string, sequence_id string, open int")


def rows(*pairs):
    """Documents with extra columns named like the operators' own."""
    return [(i, t, None, "s", len(t) if t is not None else None, 1, 0.5, "x", 7, 3, 9, 8, "m", "d", 2, 4, "p", "q", 0) for i, t in pairs]


LONG = "Lorem ipsum dolor sit amet. " * 3000
AWKWARD = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, " \n\n "), (5, LONG),
           (6, "Ünïcödé 😀 text\n\nnew section. And more"), (7, "\x00 control \u2028 sign")]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(*AWKWARD), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df, column="text"):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r[column]) for r in df.collect())
