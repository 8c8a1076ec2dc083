"""Lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from terrascreen.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    size, total = len(counted), sum(n for *_, n in counted)
    held = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * df + 1))) for t, df in held.items()}
    found = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scored = []
        for d, c, n in counted:
            m = 100 - 75 + 75 * n * size // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        found += [(item, rank, None if absent else d, -s) for rank, (s, absent, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def got(spark, docs, items, **more):
    df = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), **more)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ß1", "x-y", "UPPER"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.choice((1, 3, 30, 200)))) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w50 copy") for i in range(300)] + [(5, "w7 w8"), (None, "w50 w51 w52"), (2000, None), (2001, ""), (2002, " -- ")]
    docs.append((3000, " ".join(["w3", "w59"] * 30_000)))
    items = [(i, text(rng.choice((1, 5, 25)))) for i in range(30)] + [(1, "w50 W50 w51"), (90, None), (91, ""), (92, "unknown words"), (93, "w1 w2 w50 copy"), (None, "w52")]
    return docs, items


@pytest.mark.parametrize("block_chars", [16_000_000, 300])
def test_equals_plain_scores(spark, corpus, block_chars):
    assert got(spark, *corpus, block_chars=block_chars) == plain(*corpus)


def test_small_batches_prune_and_stay_exact(spark, corpus):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert got(spark, *corpus, k=3) == plain(*corpus, k=3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [(1, None)], [(1, "a")]) == []


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "alpha LOREM section", 1.0)], "item_id long, text string, score double")
    found = lexical.search(awkward, items)
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == [r[2] for r in sorted(plain([(r["doc_id"], r["text"]) for r in awkward.collect()], [(1, "alpha lorem section")]))]
    assert lexical.search(nothing, items).count() == 0
