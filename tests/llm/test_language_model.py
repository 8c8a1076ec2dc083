"""The recurrent model: gradients, whole-document scores, counts, held-out texts, awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascreen.llm import gru, language_model, queries

SHAPE = gru.Shape(inputs=9, embedding=4, states=5, open_classes=2, classes=4, members=3)
FOLDER = "/root/testdata/sf0.01"


def network(seed=1):
    rng = np.random.default_rng(seed)
    p = gru.initial(SHAPE, np.log(np.full(4, 0.25)), np.log(np.full((2, 3), 1 / 3)))
    return {name: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for name, v in p.items()}


def stream(sizes, seed=2):
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    classes = rng.integers(0, 4, total)
    goes_on = np.ones(total, np.float32)
    goes_on[np.cumsum(sizes) - sizes] = 0
    return gru.Stream(rng.integers(0, 9, total), classes, np.where(classes < 2, rng.integers(0, 3, total), -1), goes_on)


def plain_logs(p, s, sizes):
    """Step by step in double precision, one document at a time."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size, at, found = SHAPE.states, 0, []
    for n in sizes:
        h, total = np.zeros(size), 0.0
        for i in range(at, at + n):
            x = p["embed"][s.inputs[i]] @ p["enter"] + p["bias"]
            gate = sigmoid(x[:2 * size] + h @ p["gates"])
            new = np.tanh(x[2 * size:] + (gate[size:] * h) @ p["inner"])
            h = (1 - gate[:size]) * new + gate[:size] * h
            c = s.classes[i]
            total += math.log(softmax(h @ p["classes"] + p["class_bias"])[c])
            if s.members[i] >= 0:
                total += math.log(softmax(h @ p["words"][c] + p["word_bias"][c])[s.members[i]])
        found.append(total)
        at += n
    return np.array(found)


@pytest.mark.parametrize("lanes,steps", [(1, 3), (4, 5), (16, 50)])
def test_documents_keep_their_state_over_windows(lanes, steps):
    sizes = np.array([7, 1, 40, 3, 12, 1, 25, 2])
    s = stream(sizes)
    assert np.allclose(gru.document_logs(network(), s, sizes, lanes, steps), plain_logs(network(), s, sizes), rtol=1e-4)
    assert gru.document_logs(network(), stream([1]), np.zeros(0, np.int64), lanes, steps).size == 0


def test_the_limit_of_a_softmax_is_left_out_only_where_no_sum_reaches_it():
    p, sizes = network(), np.array([7, 20, 3])
    assert gru._bounded(p["classes"], p["class_bias"]) and gru._bounded(p["words"], p["word_bias"])
    p["classes"] *= 500
    p["words"] *= 500
    assert not gru._bounded(p["classes"], p["class_bias"]) and not gru._bounded(p["words"], p["word_bias"])
    assert np.isfinite(gru.document_logs(p, stream(sizes), sizes, 2, 5)).all()


@pytest.mark.parametrize("most", [800, 1 << 20])
def test_small_numbers_keep_their_order(most):
    numbers = np.random.default_rng(6).integers(0, most, 5000)
    assert (gru._order(numbers) == np.argsort(numbers, kind="stable")).all() and len(gru._order(numbers[:0])) == 0


def test_gradients_are_slopes():
    s = stream([6, 9])
    fold = lambda x: x[:14].reshape(2, 7).T
    weights = np.full((7, 2), 1 / 14)

    def loss(p):
        logs, _, _ = gru.Window(p, fold(s.inputs), fold(s.goes_on), np.zeros((2, 5), np.float32)).losses(fold(s.classes), fold(s.members))
        return -float((logs.astype(np.float64) * weights.ravel()).sum())

    p = network()
    window = gru.Window(p, fold(s.inputs), fold(s.goes_on), np.zeros((2, 5), np.float32))
    _, found, flow = window.losses(fold(s.classes), fold(s.members), weights)
    window.backward(flow, found)
    rng = np.random.default_rng(5)
    assert set(found) == set(p)
    for name in p:
        for _ in range(3):
            way = rng.normal(0, 1, p[name].shape)
            moved = [loss(p | {name: (p[name] + sign * 1e-2 * way).astype(np.float32)}) for sign in (1, -1)]
            assert abs((moved[0] - moved[1]) / 2e-2 - float((found[name] * way).sum())) < 2e-3, name


def test_training_lowers_the_loss_of_a_pattern():
    inputs = np.tile(np.arange(6), 200)
    s = gru.Stream(inputs, (inputs + 1) % 6 // 3, (inputs + 1) % 6 % 3, np.r_[0, np.ones(1199)].astype(np.float32))
    p = gru.initial(SHAPE, np.log(np.full(4, 0.25)), np.log(np.full((2, 3), 1 / 3)))
    before = gru.document_logs(p, s, np.array([1200]), 1, 64)[0]
    squares = {k: np.zeros_like(v) for k, v in p.items()}
    for _ in range(10):
        gru.train(p, squares, s, 4, 10, 0.15)
    assert before < 1200 * math.log(0.1) and gru.document_logs(p, s, np.array([1200]), 1, 64)[0] > 1200 * math.log(0.8)


def test_all_words_and_the_unknown_one_add_up_to_one():
    counted = Counter({b"w%d" % i: 40_000 // (i + 1) for i in range(2000)})
    listed = counted.most_common(1500)
    known, rest_log = language_model.vocabulary(listed, sum(counted.values()), len(counted))
    p = gru.initial(known.shape, known.class_logs, known.member_logs)
    p["classes"] += np.random.default_rng(3).normal(0, 1, p["classes"].shape).astype(np.float32)
    p["words"] += np.random.default_rng(4).normal(0, 1, p["words"].shape).astype(np.float32)
    n = len(listed) + 1
    window = gru.Window(p, np.full((1, n), 3), np.ones((1, n), np.float32), np.full((n, language_model.STATES), 0.3, np.float32))
    logs, _, _ = window.losses(known.classes[None], known.members[None])
    logs = logs + known.share_logs
    rest = sum(v + 0.5 for w, v in counted.items() if w not in known.numbers) + 0.5
    assert abs(math.exp(rest_log) - rest) < 1e-6
    assert abs(np.exp(logs.astype(np.float64)).sum() - 1) < 1e-4


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) + [" "]


def test_counts_base_scores_and_held_out_texts(spark):
    found = queries.recurrent_scores(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    aside = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counted = Counter(w for i, t in texts.items() if not aside(i) for w in words(t))
    total, distinct = sum(counted.values()), len(counted)
    assert len(found) == len(texts)
    bits = Counter()
    for r in found:
        own = words(texts[r["doc_id"]])
        base = sum(math.log10((counted[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (aside(r["doc_id"]), len(own), sum(counted[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        bits[r["held_out"], "base"] -= r["base_score"]
        bits[r["held_out"], "score"] -= r["score"]
    for part in (True, False):
        assert bits[part, "score"] < 0.96 * bits[part, "base"]


def test_chunks_and_lanes_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    model = language_model.fit(docs, F.lit(True))
    score = lambda: {r["doc_id"]: r["score"] for r in language_model.score(docs, model).collect()}
    before = score()
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 5000)
    monkeypatch.setattr(language_model, "SCORE_LANES", 3)
    monkeypatch.setattr(language_model, "SCORE_STEPS", 7)
    assert all(math.isclose(v, before[k], rel_tol=1e-4) for k, v in score().items())


def test_awkward_rows(awkward, nothing):
    model = language_model.fit(awkward, F.lit(True))
    found = language_model.score(awkward, model, keep=("doc_id", "row", "score", "bits")).collect()
    assert len(found) == awkward.count()
    ends = [r for r in found if r["n_tokens"] == 1]
    assert len(ends) == 4 and all(math.isfinite(r[6]) and r["n_known"] == 1 for r in ends)
    assert language_model.fit(awkward, F.lit(None).cast("boolean")).total == 0
    none = language_model.fit(nothing, F.lit(True))
    assert (none.total, none.distinct) == (0, 0) and language_model.score(nothing, none).count() == 0
    alone = language_model.score(awkward, none).where("doc_id = 3").first()
    assert (alone["n_tokens"], alone["n_known"], alone["base_score"]) == (1, 0, 0.0) and abs(alone["score"]) < 1e-6
