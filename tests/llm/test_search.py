"""Merkle fingerprints and nearest neighbours against plain versions."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from terrascreen.llm import merkle, neighbours
from tests.llm.cases import AWKWARD, SCHEMA, rows


def test_edits_and_order(spark, awkward, nothing):
    found = merkle.compared(awkward).collect()
    assert len(found) == len(AWKWARD)
    by_text = {}
    for r in found:
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert merkle.compared(nothing).count() == 0


def test_every_row_meets_the_next_one(spark):
    documents = [(i * 7 % 101, f"Document {i} says {i * i}. " * (i % 9)) for i in range(101)]
    df = spark.createDataFrame(rows(*documents), SCHEMA).repartition(6)
    found = {r.doc_id: r for r in merkle.compared(df).collect()}
    order = sorted(documents, reverse=True)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = found[i]
        assert r.edited == edited and (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.first_edit is None) == (text == edited)


def test_likeness_follows_the_share_of_equal_text(spark):
    words = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:7] for i in range(400))
    other = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(400))
    df = spark.createDataFrame(rows((2, words), (1, other), (0, "same line\n" * 300)), SCHEMA)
    found = {r.doc_id: r for r in merkle.compared(df).collect()}
    assert math.isclose(found[2].near_edited, 2 / 3, abs_tol=0.02) and found[2].near_next < 0.02
    assert math.isclose(found[0].near_edited, 2 / 3, abs_tol=0.02)
    assert found[2].first_edit.section == 0 and found[0].first_edit.paragraph > 150


def test_pieces_cover_the_text(spark):
    for text in ("a.b. c!?\n\n\nd e", "....", "", " x ", "é😀" * 30, "\n"):
        joined = spark.createDataFrame([(text,)], "t string").select(F.array_join(F.regexp_extract_all("t", F.lit(merkle.PIECE), F.lit(0)), "")).first()[0]
        assert joined == text


def vectors(spark, values):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 1) for i, v in values], "vec_id long, embedding array<float>, label int, score int")


def plain(values, queries, k):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in values if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    usable = list({(i, tuple(v)): (i, v) for i, v in usable}.values())
    out = []
    for i, v in usable:
        if i in queries:
            near = sorted((-float(v @ w), j) for j, w in usable if j != i)[:k]
            out += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
    return sorted(out)


def test_small_tables_are_searched_in_full(spark):
    rng = np.random.default_rng(8)
    values = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    values += [(100 + i, values[0][1]) for i in range(30)]
    values += [(200, None), (201, [0] * 6), (202, [float("nan")] * 6), (203, [1, None, 1, 1, 1, 1]), (None, [1] * 6), (204, [float("inf")] * 6), values[3]]
    df = vectors(spark, values)
    found = neighbours.nearest(df, df.where("vec_id % 5 = 0"), k=7, fetched=64.0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == plain(values, {i for i, _ in values if i is not None and i % 5 == 0}, 7)


def test_fewer_candidates_than_asked_and_none(spark):
    df = vectors(spark, [(0, [1, 0]), (20, [0.5, 0])])
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, df).orderBy("query_id").collect()] == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 24))
    values = [(i, (centres[i % 8] + rng.normal(size=24)).tolist()) for i in range(1200)]
    df = vectors(spark, values)
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    wanted = {(q, v) for q, _, v in plain(values, set(range(0, 1200, 20)), 20)}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_small_tables_are_whole_with_default_parameters(spark):
    rng = np.random.default_rng(10)
    for n in (10, 21, 60, 100):
        values = [(i, rng.normal(size=16).tolist()) for i in range(n)]
        df = vectors(spark, values)
        found = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, df).collect())
        assert found == plain(values, set(range(n)), 20)
