"""Ranked lexical search: exact best documents of every item under integer impact scores, by buckets of vector length.

A document is a vector of impacts over the items' terms. Vectors stand by falling length; a length bucket is a batch of them. The product of
the lengths bounds a score (Cauchy-Schwarz), so an item leaves out all buckets that cannot reach its k-th best score so far. Inside a bucket
the few heaviest coordinates of the item are summed and the rest is bounded by the remaining lengths; what survives is scored in integers.
Coordinates are scaled by the root of the term weight on both sides, which leaves products alone and makes lengths say more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.llm.shared import written

#: Items are searched in blocks of about so many characters: what a block sends to every task is bounded by them.
BLOCK_CHARS = 16_000_000
#: Coordinates summed before a survivor is scored in full.
FOCUS = 8
#: Room for rounding in the bounds, relative to the bound and, for what is left of a length, to the squared length.
SLACK, REST_SLACK = 1 + 1e-9, 1e-12

#: Bytes of terms, A-Z in lower case; all others become blanks. Bytes above ASCII belong to terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, with repeats."""
    return text.translate(LETTERS).split()


def lists(values: np.ndarray, sizes, kind: pa.DataType) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(np.asarray(sizes, np.int64))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and the size of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _counter(shared):
    """Documents with at least one term: their number of terms, and number and count of every term that the items hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            held, totals, sizes, ids, counts = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = terms(text.as_py())
                if not words:
                    continue
                found, often = np.unique(np.fromiter((v for w in words if (v := get(w)) is not None), np.int32), return_counts=True)
                held.append(i)
                totals.append(len(words))
                sizes.append(len(found))
                ids.append(found)
                counts.append(often)
            join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(held, pa.int64())), pa.array(totals, pa.int64()),
                                              lists(join(ids), sizes, pa.int32()), lists(join(counts), sizes, pa.int64())], ["doc", "n", "ids", "counts"])

    return count


def _impacts(docs: int, total: int, weights: np.ndarray):
    """Impact vectors and their scaled lengths; documents without any of the items' terms are left out."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("ids")), 0))
            (ids, sizes), (counts, _) = flat(batch.column("ids")), flat(batch.column("counts"))
            length = np.fromiter((25 + 75 * n * docs // total for n in batch.column("n").to_pylist()), np.int64, batch.num_rows)
            impacts = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(length, sizes))
            squares = np.add.reduceat(weights[ids] * impacts.astype(np.float64) ** 2, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.sqrt(squares)), batch.column("ids"), lists(impacts, sizes, pa.int64())],
                                             ["doc", "norm", "ids", "impacts"])

    return weigh


def best(scores: np.ndarray, absent: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score, then rising id, ids that are missing last."""
    return np.lexsort((docs, absent, -scores))[:k]


def _hunter(shared, weights: np.ndarray, k: int):
    """The best documents of each item among a task's rows; every Arrow batch is a bucket."""

    def hunt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        roots = np.sqrt(weights.astype(np.float64))
        least = {q: floor for q, (_, _, floor) in queries.items()}
        found: dict[int, tuple[np.ndarray, ...]] = {}
        plans = {}
        for q, (ids, counts, _) in queries.items():
            scaled = counts * roots[ids]
            focus = np.argsort(-scaled, kind="stable")[:FOCUS]
            square = float(scaled @ scaled)
            plans[q] = (ids, counts * weights[ids], list(zip(ids[focus].tolist(), scaled[focus].tolist())), math.sqrt(square),
                        math.sqrt(max(square - float(scaled[focus] @ scaled[focus]), 0) + REST_SLACK * square))
        dense = np.zeros(len(weights), np.int64)
        for batch in batches:
            order = np.argsort(-batch.column("norm").to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            norms, absent = batch.column("norm").to_numpy(), pc.is_null(batch.column("doc")).to_numpy(zero_copy_only=False)
            docs = pc.fill_null(batch.column("doc"), 0).to_numpy()
            (ids, sizes), (impacts, _) = flat(batch.column("ids")), flat(batch.column("impacts"))
            starts = np.cumsum(sizes) - sizes
            by_term = np.argsort(ids, kind="stable")
            rows, values = np.repeat(np.arange(len(sizes)), sizes)[by_term], impacts[by_term]
            bounds = np.searchsorted(ids[by_term], np.arange(len(weights) + 1))
            for q, (own, gains, focus, norm, rest) in plans.items():
                floor = least[q]
                within = int(np.searchsorted(-norms, -floor / (norm * SLACK), side="right")) if norm > 0 else 0
                if not within:
                    continue
                chosen = np.arange(within)
                if floor > 0:
                    summed, used = np.zeros(within), np.zeros(within)
                    for term, scaled in focus:
                        low, high = bounds[term], bounds[term + 1]
                        high = low + np.searchsorted(rows[low:high], within)
                        value = values[low:high] * roots[term]
                        summed[rows[low:high]] += scaled * value
                        used[rows[low:high]] += value * value
                    squares = norms[:within] ** 2
                    left = rest * np.sqrt(np.maximum(squares - used, 0) + REST_SLACK * squares)
                    chosen = np.flatnonzero((summed + left) * SLACK >= floor)
                    if not len(chosen):
                        continue
                dense[own] = gains
                size = sizes[chosen]
                ends = np.cumsum(size)
                spots = np.arange(ends[-1]) + np.repeat(starts[chosen] - (ends - size), size)
                scores = np.add.reduceat(dense[ids[spots]] * impacts[spots], ends - size)
                dense[own] = 0
                good = (scores > 0) & (scores >= floor)
                kept = (scores[good], absent[chosen[good]], docs[chosen[good]])
                if q in found:
                    kept = tuple(np.concatenate(pair) for pair in zip(found[q], kept))
                places = best(*kept, k)
                found[q] = tuple(x[places] for x in kept)
                if len(places) == k:
                    least[q] = max(floor, int(found[q][0][-1]))
        for q, (scores, absent, docs) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(docs, pa.int64(), mask=absent), pa.array(scores, pa.int64())],
                                             ["q", "doc", "score"])

    return hunt


def _block(docs: DataFrame, queries: list[Counter], k: int) -> DataFrame | None:
    """Columns ``q, rank, doc, score`` for a bounded list of items' term counts; None if there is nothing to find."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    for counted in queries:
        for term in counted:
            numbers.setdefault(term, len(numbers))
    shared = spark.sparkContext.broadcast(numbers)
    counted = written(docs.mapInArrow(_counter(shared), "doc long, n long, ids array<int>, counts array<long>"), "lexical-counts")
    size, total = counted.agg(F.count("*"), F.sum("n")).first()
    if not size or not numbers:
        return None
    held = np.zeros(len(numbers), np.int64)
    for term, often in counted.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        held[term] = often
    weights = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    vectors = counted.mapInArrow(_impacts(size, total, weights), "doc long, norm double, ids array<int>, impacts array<long>")
    order = [F.desc("norm"), F.col("doc")]
    vectors = written(vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "lexical-vectors")
    tops = sorted(tuple(r) for r in vectors.groupBy("part").agg(F.max("norm")).collect())
    listed = [(np.fromiter(map(numbers.get, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in queries]
    norms = [math.sqrt(float((often ** 2 * weights[ids]).sum())) for ids, often in listed]
    floors = [0] * len(queries)
    ranked, start, width = None, 0, 1
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    while start < len(tops):
        reach = tops[start][1] * SLACK
        live = {q: (*listed[q], floors[q]) for q in range(len(queries)) if norms[q] > 0 and norms[q] * reach >= floors[q]}
        if not live:
            break
        span = F.col("part").between(tops[start][0], tops[min(start + width, len(tops)) - 1][0])
        hits = vectors.where(span).mapInArrow(_hunter(spark.sparkContext.broadcast(live), weights, k), "q int, doc long, score long")
        hits = hits if ranked is None else hits.unionByName(ranked.drop("rank"))
        ranked = written(hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "lexical-hits")
        for q, floor in ranked.where(F.col("rank") == k).select("q", "score").collect():
            floors[q] = floor
        start, width = start + width, width * 2
    return ranked


def search(docs: DataFrame, items: DataFrame, k: int = 10, document: str = "doc_id", item: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item``, ``rank`` (from 1), ``document`` and ``score`` of the k best documents of every item, among those with a score above 0.

    Terms, weights and scores are those of the module. Equal scores stand by document id, missing ids last; ids are integers. Every row is a document
    or an item of its own, also when ids or texts repeat. Null and empty texts have no terms: such documents do not count, such items find
    nothing. Items come to the driver in blocks of about ``block_chars`` characters, with which all documents are searched in turn.
    """
    spark = docs.sparkSession
    source = docs.select(docs[document].cast("bigint").alias("doc"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("text"))
    asked = items.where(items[text].isNotNull()).select(items[item].alias("item"), items[text].cast("string").cast("binary").alias("text"))
    blocks = math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars)
    found = []
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        ranked = _block(source, [Counter(terms(bytes(r["text"]))) for r in rows], k)
        if ranked is None:
            continue
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"q int, item {items.schema[item].dataType.simpleString()}")
        found.append(ranked.join(F.broadcast(names), "q").select("item", F.col("rank").cast("int").alias("rank"), "doc", "score"))
    if not found:
        found = [asked.where("false").select("item", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("score"))]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.select(F.col("item").alias(item), "rank", F.col("doc").alias(document), "score")
