"""Gated recurrent language model over whole documents: learnt by tasks in parallel, averaged, and applied to every token.

Words are counted over all training documents. The most frequent ones are told apart by softmax within their class; the next ones have fixed
shares of a class that their ending names; the rest, words met once among them, share one class with what was never seen, whose chance is so
learnt too, and are looked up by a join. The probabilities of all known words and of the unknown one add up to 1 at every place, whatever the corpus holds.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.llm import gru
from terrascreen.llm.shared import ROW, bundled, spread, written

#: The end of a text counts as a token; no word can be a blank.
END = b" "
#: Words told apart by softmax, in classes of so many; words looked up in the task; classes of word endings.
MEMBERS, OPEN_CLASSES, LISTED_WORDS, ENDINGS = 64, 12, 131_072, 48
EMBEDDING, STATES = 12, 16
LANES, STEPS, SCORE_LANES, SCORE_STEPS = 256, 12, 512, 48
RATE = 0.15
#: Tokens that a task learns from, in all rounds; tokens put through the network together.
TASK_TOKENS, CHUNK_TOKENS = 4_000_000, 2_000_000
ROUNDS = 3
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 500_000


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case, and the end."""
    found = text.lower().split()
    found.append(END)
    return found


class Numbers(dict):
    """Numbers of the listed words; every other word has the next one."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


@dataclass(frozen=True)
class Vocabulary:
    """Numbers of the listed words, and by number: class, place in the class (-1: fixed share), network input, log of the smoothed count and of the share.

    The last number stands for all other words.
    """

    numbers: Numbers
    classes: np.ndarray
    members: np.ndarray
    inputs: np.ndarray
    count_logs: np.ndarray
    share_logs: np.ndarray
    class_logs: np.ndarray
    member_logs: np.ndarray

    @property
    def shape(self) -> gru.Shape:
        return gru.Shape(int(self.inputs.max()) + 2, EMBEDDING, STATES, OPEN_CLASSES, OPEN_CLASSES + ENDINGS + 1, MEMBERS)


@dataclass(frozen=True)
class Model:
    """What scoring needs: the counts of all training words (a table ``word, n``), their number, and the network."""

    counts: DataFrame
    total: int
    distinct: int
    rest_log: float
    vocabulary: Vocabulary
    parameters: gru.Parameters


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def vocabulary(listed: Sequence[tuple[bytes, int]], total: int, distinct: int) -> tuple[Vocabulary, float]:
    """From the most frequent words, most frequent first; also the log of the rest's smoothed count."""
    smoothed = np.array([n for _, n in listed], np.float64) + 0.5
    size, inside = len(listed), min(len(listed), OPEN_CLASSES * MEMBERS)
    rest = total - int(sum(n for _, n in listed)) + 0.5 * (distinct - size) + 0.5
    classes, members, inputs = np.empty(size + 1, np.int64), np.full(size + 1, -1), np.empty(size + 1, np.int64)
    classes[:inside], members[:inside], inputs[:inside] = np.arange(inside) // MEMBERS, np.arange(inside) % MEMBERS, np.arange(inside)
    endings = np.fromiter((_ending(w) for w, _ in listed[inside:]), np.int64, size - inside)
    most = OPEN_CLASSES * MEMBERS
    classes[inside:size], inputs[inside:size] = OPEN_CLASSES + endings, most + endings
    classes[size], inputs[size] = OPEN_CLASSES + ENDINGS, most + ENDINGS
    masses = np.bincount(classes[:size], smoothed, OPEN_CLASSES + ENDINGS + 1).astype(np.float64)
    masses[-1] = rest
    with np.errstate(divide="ignore"):
        class_logs = np.where(masses > 0, np.log(masses / masses.sum()), -30.0)
    member_logs = np.full((OPEN_CLASSES, MEMBERS), -30.0)
    member_logs[classes[:inside], members[:inside]] = np.log(smoothed[:inside] / masses[classes[:inside]])
    counts = np.r_[np.log(smoothed), 0.0]
    shares = np.zeros(size + 1)
    shares[inside:size] = np.log(smoothed[inside:] / masses[classes[inside:size]])
    return Vocabulary(Numbers((w, i) for i, (w, _) in enumerate(listed)), classes, members, inputs, counts, shares, class_logs, member_logs), math.log(rest)


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``LISTED_WORDS`` words that were met more than once, most frequent first.

    Counts are cut into steps of an eighth of a power of two, and whole steps are taken from the top, so nothing is sorted or sent beyond them.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    often = counts.where("n > 1")
    lowest, size = None, 0
    for at, words in sorted(map(tuple, often.groupBy(step.alias("s")).count().collect()), reverse=True):
        size += words
        if size > LISTED_WORDS:
            break
        lowest = at
    if lowest is None:
        return []
    return sorted(((bytes(w), n) for w, n in often.where(step >= lowest).collect()), key=lambda x: (-x[1], x[0]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])
        counted.clear()
        return batch

    for batch in batches:
        for text in batch.column("text"):
            counted.update(tokens(text.as_py()))
            if len(counted) >= COUNTED_WORDS:
                yield flushed()
    if counted:
        yield flushed()


def _stream(numbered: Sequence[np.ndarray], known: Vocabulary) -> gru.Stream:
    """Documents' word numbers as one stream; the first input of a document is the one for the end."""
    ids = np.concatenate(numbered)
    first = np.zeros(len(ids), bool)
    sizes = np.fromiter(map(len, numbered), np.int64, len(numbered))
    first[np.cumsum(sizes) - sizes] = True
    inputs = np.r_[0, known.inputs[ids[:-1]]]
    inputs[first] = known.shape.inputs - 1
    return gru.Stream(inputs, known.classes[ids], known.members[ids], (~first).astype(np.float32))


def _numbers(batches: Iterator[pa.RecordBatch], known: Vocabulary, apart_too: bool):
    """Size and word numbers of every text, counts of its words that are not listed, its batch and place."""
    number, other = known.numbers.get, len(known.numbers)
    for batch in batches:
        column = batch.column("text")
        for i in range(batch.num_rows):
            words = tokens(column[i].as_py())
            ids = np.fromiter(map(number, words, repeat(other)), np.int32, len(words))
            apart = Counter(words[j] for j in np.flatnonzero(ids == other).tolist()) if apart_too else None
            yield len(words), ids, apart, batch, i


def _learner(shared):
    """A task's documents to its parameters after one pass, in pieces; ``weight`` is its number of tokens."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, p, squares = shared.value
        p, squares = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in squares.items()}
        seen = 0
        for part in gru.chunks(((size, ids) for size, ids, *_ in _numbers(batches, known, False)), CHUNK_TOKENS):
            gru.train(p, squares, _stream([ids for _, ids in part], known), LANES, STEPS, RATE)
            seen += sum(size for size, _ in part)
        if not seen:
            return
        for label, held in enumerate((p, squares)):
            vector = gru.packed(held)
            for piece, start in enumerate(range(0, len(vector), PIECE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label], pa.int32()), pa.array([piece], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()),
                     pa.array([vector[start:start + PIECE].astype(np.float64)], pa.list_(pa.float64()))], ["label", "piece", "task", "weight", "part"])

    return learn


#: Numbers of a piece of the parameters: pieces are averaged on their own.
PIECE = 8192
_PIECES = "label int, piece int, task int, weight long, part array<double>"


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the pieces, which come sorted; one running sum at a time."""
    key, task, weight, summed = None, 0, 0, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([task], pa.int32()), pa.array([weight], pa.int64()),
                                           pa.array([summed / weight], pa.list_(pa.float64()))], ["label", "piece", "task", "weight", "part"])

    for batch in batches:
        flat = batch.column("part").flatten().to_numpy()
        ends = np.r_[0, np.cumsum([len(x) for x in batch.column("part")])]
        for i, (label, piece, number, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "piece", "task", "weight")))):
            if (label, piece) != key:
                if key is not None:
                    yield closed()
                key, task, weight, summed = (label, piece), number, 0, np.zeros(ends[i + 1] - ends[i])
            summed += w * flat[ends[i]:ends[i + 1]]
            weight += w
    if key is not None:
        yield closed()


def _averaged(parts: DataFrame) -> DataFrame:
    """Means over all tasks in two steps, so no task reads the pieces of all others."""
    order = ("label", "piece", "task")
    for key in (("label", "piece", F.col("task") % 64), ("label", "piece")):
        parts = parts.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(_average, _PIECES)
    return parts


def fit(docs: DataFrame, training: Column, text: str = "text", rounds: int = ROUNDS) -> Model:
    """The model of the documents for which ``training`` holds (null does not). Every one of them is counted and learnt from once.

    In each of ``rounds`` the tasks go over their documents of that round, from the mean of the parameters (and of the squared gradients) that the
    tasks of the round before came to. The number of tasks follows the number of tokens. Null texts count as empty, and have one token, the end.
    """
    spark = docs.sparkSession
    source = docs.where(training).select(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = written(source.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "language-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    listed = _most_frequent(counts)
    known, rest_log = vocabulary(listed, total, distinct)
    p = gru.initial(known.shape, known.class_logs, known.member_logs)
    squares = {name: np.zeros_like(v) for name, v in p.items()}
    tasks = math.ceil(total / TASK_TOKENS)
    for turn in range(rounds if total else 0):
        due = source.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).coalesce(tasks)
        shared = spark.sparkContext.broadcast((known, p, squares))
        pieces = written(_averaged(written(due.mapInArrow(_learner(shared), _PIECES), "language-pieces")), "language-mean")
        found = {}
        for label, _, part in sorted(map(tuple, pieces.select("label", "piece", "part").collect())):
            found.setdefault(label, []).append(part)
        if found:
            p, squares = (gru.unpacked(np.concatenate(found[label]), p) for label in (0, 1))
    return Model(counts, total, distinct, rest_log, known, p)


def _scorer(shared):
    """Sums over the listed words of each document, and its other words with their counts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, p = shared.value
        other, number = len(known.numbers), TaskContext.get().partitionId() << 33
        for part in gru.chunks(_numbers(batches, known, True), CHUNK_TOKENS):
            lengths = np.array([x[0] for x in part], np.int64)
            ids = np.concatenate([x[1] for x in part])
            logs = gru.document_logs(p, _stream([x[1] for x in part], known), lengths, SCORE_LANES, SCORE_STEPS)
            at = np.cumsum(lengths) - lengths
            apart = [x[2] for x in part]
            words = [list(c) for c in apart]
            ends = pa.array(np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32))
            rows = pa.concat_arrays([batch.column(ROW).slice(i, 1) for *_, batch, i in part])
            rest = pa.StructArray.from_arrays([pa.array([w for ws in words for w in ws], pa.binary()), pa.array([n for c in apart for n in c.values()], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([
                rows, pa.array(number + np.arange(len(part))), pa.array(lengths), pa.array(np.add.reduceat((ids != other).astype(np.int64), at)),
                pa.array(np.add.reduceat(known.count_logs[ids], at)), pa.array(logs + np.add.reduceat(known.share_logs[ids], at)),
                pa.ListArray.from_arrays(ends, rest)], [ROW, "nr", "n_tokens", "listed", "count_log", "model_log", "rest"])
            number += len(part)

    return measure


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known``, ``base_score`` (word frequencies) and ``score`` (the network), log10 probabilities of whole texts.

    The state runs through a document from its first to its last token. Null texts count as empty. Every row has a score of its own; a model
    without training words gives 0 to a text of one unknown word's probability 1.
    """
    spark = docs.sparkSession
    source = bundled(docs, text, keep).withColumn("text", F.col("text").cast("binary"))
    layout = (f"{ROW} {source.schema[ROW].dataType.simpleString()}, nr long, n_tokens long, listed long, count_log double, model_log double, "
              "rest array<struct<word:binary,n:long>>")
    sums = written(source.mapInArrow(_scorer(spark.sparkContext.broadcast((model.vocabulary, model.parameters))), layout), "language-sums")
    apart = sums.select("nr", F.explode("rest").alias("r")).select("nr", "r.word", F.col("r.n").alias("times"))
    looked = apart.join(model.counts, "word", "left").groupBy("nr").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"), F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_log"))
    both = sums.drop("rest").join(looked, "nr", "left")
    rest = F.coalesce("rest_log", F.lit(0.0))
    others = F.col("n_tokens") - F.col("listed")
    base = F.col("count_log") + rest - F.col("n_tokens") * math.log(model.total + 0.5 * (model.distinct + 1))
    mine = F.col("model_log") + rest - others * model.rest_log
    result = both.select(ROW, "n_tokens", (F.col("listed") + F.coalesce("met", F.lit(0))).alias("n_known"), (base / math.log(10)).alias("base_score"), (mine / math.log(10)).alias("score"))
    return spread(result, keep, "n_tokens", "n_known", "base_score", "score")
