"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come per document only. A greedy cover of the toxic training documents by words and word beginnings that clean ones lack gives the
token labels; the field is then trained on whole token sequences, so its weights also score words that were never seen.
"""

import math
import multiprocessing
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.shared import ROW, bundled, give_back, lean, spread

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose weights a task remembers: about 100 bytes each, in every worker.
CACHE = 200_000


@dataclass(frozen=True)
class Field:
    """Weights of the toxic state by feature (clean has none), transitions by (from, to), and the document score's weights."""

    weights: dict[str, float]
    bias: float
    start: float
    moves: tuple[tuple[float, float], tuple[float, float]]
    score: tuple[float, float, float]

    def emission(self, word: str) -> float:
        weights = self.weights
        total = self.bias + weights.get(word, 0.0)
        for size in PREFIXES:
            if len(word) < size:
                break
            total += weights.get(f"{size}{word[:size]}", 0.0)
        return total


def features(word: str) -> list[str]:
    """The word and its beginnings; a digit in front tells a beginning from a word of the same letters."""
    return [word, *(f"{size}{word[:size]}" for size in PREFIXES if len(word) >= size)]


def marginals(emissions: list[np.ndarray], start: float, moves) -> list[np.ndarray]:
    """Probability of the toxic state at each token: forward and backward odds, all sequences of a batch at once.

    Sequences are ordered by length, so step ``t`` works on those that still have a token there; odds keep the recursion free of logarithms.
    """
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order])
    if not len(order) or not lengths[0]:
        return [np.empty(0) for _ in emissions]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    at = np.r_[0, np.cumsum(active)]
    flat = np.empty(at[-1])
    for k, i in enumerate(order):
        if lengths[k]:
            flat[at[:lengths[k]] + k] = emissions[i]
    odds = np.exp(np.clip(flat, -50, 50, out=flat), out=flat)
    (m00, m01), (m10, m11) = np.exp(np.array(moves))
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    ratio = np.full(active[0], math.exp(start))
    for t in range(longest):
        n = active[t]
        ratio = ratio[:n]
        if t:
            ratio = (m01 + m11 * ratio) / (m00 + m10 * ratio)
        ratio = np.clip(ratio * odds[at[t]:at[t + 1]], 1e-30, 1e30)
        forward[at[t]:at[t + 1]] = ratio
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        beyond = backward[at[t + 1]:at[t + 2]] * odds[at[t + 1]:at[t + 2]]
        backward[at[t]:at[t] + n] = (m10 + m11 * beyond) / (m00 + m01 * beyond)
    both = np.clip(np.multiply(forward, backward, out=forward), 0, 1e60, out=forward)
    shares = np.divide(both, np.add(both, 1, out=backward), out=both)
    result: list[np.ndarray] = [np.empty(0)] * len(emissions)
    for k, i in enumerate(order):
        result[i] = shares[at[:lengths[k]] + k]
    return result


def _summary(shares: np.ndarray) -> tuple[float, float]:
    """Strongest token and toxic mass; tokens under one half are background and add nothing, however many there are."""
    if not len(shares):
        return 0.0, 0.0
    return float(shares.max()), math.log1p(float(shares[shares >= 0.5].sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _cover(toxic: list[np.ndarray], clean: list[np.ndarray], size: int, least: int = 2, cost: float = 4.0, surprise: float = 14.0) -> np.ndarray:
    """Marks the features (numbers under ``size``, each once per document) that stand for toxic tokens.

    First those that toxic documents hold far more often than chance explains (log likelihood ratio over ``surprise``, nine of ten
    documents toxic). Then, for documents still without one, features chosen one by one by the number of such documents, less a cost for
    each clean document hit.
    """
    count = lambda documents: np.bincount(np.concatenate([*documents, np.empty(0, np.int32)]), minlength=size)
    found, hits = count(toxic).astype(float), count(clean).astype(float)
    scale = max(1.0, len(toxic) / max(1, len(clean)))
    share = len(toxic) / (len(toxic) + len(clean))
    both = np.maximum(found + hits, 1)
    part = lambda n, chance: n * np.log(np.where(n > 0, n / both / chance, 1))
    chosen = (found > 9 * scale * hits) & (part(found, share) + part(hits, 1 - share) > surprise)
    good = (found >= least) & (found > cost * scale * hits)
    waiting = [doc for doc in toxic if not chosen[doc].any()]
    while waiting:
        gain = np.where(good & ~chosen, count(waiting) - cost * scale * hits, -1.0)
        best = int(np.argmax(gain + 1e-6 * found))
        if gain[best] < max(least, 0.004 * len(toxic)):
            break
        chosen[best] = True
        waiting = [doc for doc in waiting if not (doc == best).any()]
    return chosen


def _without_copies(documents: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The training sample with one document of each group of near copies: a copied accident is no evidence.

    Two documents count as copies when at least half of 16 minimum hashes over their words agree.
    """
    factors = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
    holders: dict[tuple[int, int], list[int]] = {}
    kept = []
    for text, toxic in documents:
        words = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in set(WORD.findall(text.lower()))), np.uint64)
        lows = ((words[:, None] + np.uint64(1)) * factors).min(axis=0).tolist() if len(words) else []
        shared = Counter(i for key in enumerate(lows) for i in holders.get(key, ()))
        if shared and max(shared.values()) >= 8:
            continue
        for key in enumerate(lows):
            holders.setdefault(key, []).append(len(kept))
        kept.append((text, toxic))
    return kept


def train(documents: list[tuple[str, int]], rounds: int = 60, decay: float = 1e-3) -> Field:
    """Fits the field on ``(text, toxic)`` pairs in plain numpy. Without both classes it scores every document by the share of toxic ones."""
    documents = [(text or "", int(toxic)) for text, toxic in documents if toxic is not None]
    documents = _without_copies(documents)
    share = (sum(t for _, t in documents) + 0.5) / (len(documents) + 1)
    base = math.log(share / (1 - share))
    if not {0, 1} <= {t for _, t in documents}:
        return Field({}, -20.0, 0.0, ((0.0, 0.0), (0.0, 0.0)), (base, 0.0, 0.0))
    vocabulary: dict[str, int] = {}
    tokens = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())], np.int64) for text, _ in documents]
    toxic = np.array([t for _, t in documents])
    names: dict[str, int] = {}
    own = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary]
    words, sizes = list(vocabulary), np.array([len(f) for f in own])
    row = np.repeat(np.arange(len(own)), sizes)
    column = np.fromiter((f for fs in own for f in fs), np.int64, len(row))
    first = np.cumsum(sizes) - sizes
    del own

    def held(ids: np.ndarray) -> np.ndarray:
        own = np.unique(ids)
        return np.unique(column[np.repeat(first[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())]).astype(np.int32)

    lexicon = _cover([held(ids) for ids, t in zip(tokens, toxic) if t], [held(ids) for ids, t in zip(tokens, toxic) if not t], len(names))
    marked = (np.bincount(row, lexicon[column], len(words)) > 0).astype(float)
    truth = [marked[ids] * t for ids, t in zip(tokens, toxic)]
    ids, wanted = np.concatenate(tokens), np.concatenate(truth)
    observed = np.bincount(ids, wanted, len(words))
    pairs = [np.zeros((2, 2)) for _ in tokens]
    for p, y in zip(pairs, truth):
        if len(y) > 1:
            np.add.at(p, (y[:-1].astype(int), y[1:].astype(int)), 1)
    counted = sum(pairs) + 0.5
    moves = np.log(counted / counted.sum(axis=1, keepdims=True))
    start = math.log((sum(y[0] for y in truth if len(y)) + 0.5) / (sum(len(y) > 0 for y in truth) + 0.5))

    # Short beginnings learn fastest, so that forms never seen share most of what a family of words has taught.
    pace = np.array([0.5 if f[0] in "45" and len(f) in (5, 6) else 0.15 for f in names])
    weights, bias = np.zeros(len(names)), 0.0
    squares, bias_square = np.zeros(len(names)), 0.0
    for _ in range(rounds):
        emission = bias + np.bincount(row, weights[column], len(words))
        expected = np.concatenate(marginals([emission[t] for t in tokens], start, moves))
        gap = observed - np.bincount(ids, expected, len(words))
        gradient = np.bincount(column, gap[row], len(names)) - decay * weights * len(tokens)
        squares += gradient * gradient
        weights += pace * gradient / np.sqrt(squares + 1e-8)
        bias_gap = float(gap.sum())
        bias_square += bias_gap * bias_gap
        bias += 0.5 * bias_gap / math.sqrt(bias_square + 1e-8)

    emission = bias + np.bincount(row, weights[column], len(words))
    parts = np.array([(1.0, *_summary(m)) for m in marginals([emission[t] for t in tokens], start, moves)])
    score = np.array([base, 0.0, 0.0])
    for _ in range(25):
        p = _sigmoid(parts @ score)
        curve = (parts * (p * (1 - p))[:, None]).T @ parts + 0.5 * np.eye(3)
        score = score + np.linalg.solve(curve, parts.T @ (toxic - p) - 0.5 * score)
    kept = {f: round(float(w), 5) for f, w in zip(names, weights) if abs(w) > 0.05}
    return Field(kept, bias, start, tuple(map(tuple, moves.tolist())), tuple(float(x) for x in score))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 30_000, text: str = "text", document: str = "doc_id",
        label: str = "toxic", training=None) -> Field:
    """Trains on a bounded sample: ``per_class`` labelled documents of each class, those of the lowest id hashes.

    ``training`` is a condition on ``labels`` that says which rows may be learnt from. Whole texts are used; documents over ``longest``
    characters are left out of this sample (never out of scoring), which bounds what the one training task holds. Null ids and labels take no part.
    """
    usable = labels.where(F.col(document).isNotNull() & F.col(label).isin(0, 1))
    # A document that is labelled more than once counts with its lowest label.
    usable = (usable if training is None else usable.where(training)).groupBy(document).agg(F.min(F.col(label).cast("int")).alias("_y"))
    order = [F.xxhash64(F.col(document)), F.col(document)]
    chosen = usable.where("_y = 1").orderBy(*order).limit(per_class).unionByName(usable.where("_y = 0").orderBy(*order).limit(per_class))
    truth = {r[0]: r[1] for r in chosen.collect()}
    if not truth:
        return train([])
    rows = docs.where(F.col(document).isin(*truth) & (F.coalesce(F.length(text), F.lit(0)) <= longest))
    # Of several texts under one id, the first in their order.
    rows = rows.groupBy(F.col(document).alias("id")).agg(F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r["id"], r["text"]) for batch in batches for r in batch.to_pylist())
        # Workers live on after a task; a child takes the memory of the training with it when it ends.
        forked = multiprocessing.get_context("fork")
        receiver, sender = forked.Pipe(False)

        def child() -> None:
            field = train([(t, truth[i]) for i, t in sample])
            sender.send_bytes(pickle.dumps((field.weights, field.bias, field.start, field.moves, field.score)))

        give_back()
        process = forked.Process(target=child)
        process.start()
        sender.close()
        found = receiver.recv_bytes()
        process.join()
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["field"])

    # The sample is bounded, so one task holds it; the driver gets weights only.
    return Field(*pickle.loads(bytes(rows.repartition(1).mapInArrow(lean(learn), "field binary").first()[0])))


def score(docs: DataFrame, field: Field, text: str = "text", keep: Sequence[str] = ("doc_id",), batch_tokens: int = 2_000_000) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``spans`` (toxic tokens as ``start, end, probability`` in code points) of every whole text.

    A null text counts as empty and gets the score of a document without toxic tokens; repeated rows stay.
    """
    source = bundled(docs, text, keep)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        find, emission = WORD.findall, field.emission

        def look_up(text: str) -> np.ndarray:
            words = find(text)
            try:
                return np.array([known[w] for w in words])
            except KeyError:
                if len(known) > CACHE:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = emission(w)
                return np.array([known[w] for w in words])

        def finish(rows: pa.Array, texts: list[str], emissions: list[np.ndarray]) -> pa.RecordBatch:
            values, spans = [], []
            for text, shares in zip(texts, marginals(emissions, field.start, field.moves)):
                most, mass = _summary(shares)
                values.append(float(_sigmoid(field.score[0] + field.score[1] * most + field.score[2] * mass)))
                spans.append([{"start": m.start(), "end": m.end(), "probability": float(p)}
                              for m, p in zip(WORD.finditer(_lowered(text)), shares) if p >= 0.5] if most >= 0.5 else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            return pa.RecordBatch.from_arrays([rows, pa.array(values), pa.array(spans, kind)], [ROW, "score", "spans"])

        for batch in batches:
            first, texts, emissions, waiting = 0, [], [], 0
            for i, value in enumerate(batch.column("text")):
                texts.append(value.as_py())
                emissions.append(look_up(_lowered(texts[-1])))
                waiting += len(emissions[-1])
                if waiting >= batch_tokens:
                    yield finish(batch.column(ROW).slice(first, i + 1 - first), texts, emissions)
                    first, texts, emissions, waiting = i + 1, [], [], 0
            if texts:
                yield finish(batch.column(ROW).slice(first), texts, emissions)

    layout = f"{ROW} {source.schema[ROW].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,probability:double>>"
    return spread(source.mapInArrow(lean(tag), layout), keep, "score", "spans")


def _lowered(text: str) -> str:
    """Lower case; where that would change the number of code points, letter by letter only where it does not."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def accepted(docs: DataFrame, field: Field, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score stays under ``threshold``."""
    boxed = docs.select(F.struct("*").alias("box"), F.col(f"`{text}`").alias("text"))
    kept = score(boxed, field, "text", ["box"]).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"box.`{c}`").alias(c) for c in docs.columns])
