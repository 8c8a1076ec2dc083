"""Approximate nearest neighbours by inner product: a forest of sorted arrays of hash strings.

Every distinct vector has one string of sign bits per tree. A shard keeps, per tree, its strings as one sorted array, so all strings with a
given beginning are a slice. A query descends to its longest matches and then gives up one bit in all trees at once until
the slices hold enough candidates; those are scored exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.llm.shared import written

TREES = 64
BITS = 24
SHARD_ROWS = 16_384
#: Candidates fetched per query and shard, repeats between trees included, as a share of the shard.
FETCHED = 1.0
#: Different candidates per query and shard, in multiples of k, at least; a shard with fewer rows is searched in full.
LEAST_TIMES = 8


def usable(vector: str) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Forest:
    """The sorted arrays of one shard. Vectors get one more component that makes their norms equal, so a small angle means a large product."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.vectors = vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        lifted = np.c_[vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(trees, lifted.shape[1], bits))
        self.orders, self.strings = [], []
        for planes in self.planes:
            strings = self._strings(lifted, planes)
            order = np.argsort(strings, kind="stable").astype(np.int32)
            self.orders.append(order)
            self.strings.append(strings[order])
        self.places = np.array([np.argsort(order) for order in self.orders])
        self.rows = {row.tobytes(): i for i, row in enumerate(vectors)}

    @staticmethod
    def _strings(lifted: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = lifted @ planes > 0
        return bits @ (1 << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.int64))

    def _fetched(self, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        found = np.zeros(len(self.vectors), bool)
        for t, order in enumerate(self.orders):
            found[order[lows[t]:highs[t]]] = True
        return found

    def candidates(self, queries: np.ndarray, wanted: float, least: int) -> Iterator[np.ndarray]:
        """Row numbers fetched for each query: ``wanted`` with repeats and ``least`` different ones, its own row not counted, or all rows."""
        lifted = np.c_[queries, np.zeros(len(queries))]
        bits = self.planes.shape[2]
        mine = np.array([self._strings(lifted, planes) for planes in self.planes])
        lows, highs = np.zeros(mine.shape, np.int32), np.zeros(mine.shape, np.int32)
        own = np.array([self.rows.get(q.tobytes(), -1) for q in queries])
        open_ones = np.arange(len(queries))
        for length in range(bits, -1, -1):
            free = bits - length
            for t, strings in enumerate(self.strings):
                begin = mine[t, open_ones] >> free << free
                lows[t, open_ones] = np.searchsorted(strings, begin)
                highs[t, open_ones] = np.searchsorted(strings, begin + (1 << free))
            held = (highs[:, open_ones].astype(np.int64) - lows[:, open_ones]).sum(axis=0)
            places = self.places[:, own[open_ones]]
            mine_too = (lows[:, open_ones] <= places) & (places < highs[:, open_ones]) & (own[open_ones] >= 0)
            done = held - mine_too.sum(axis=0) >= wanted
            for i in np.flatnonzero(done):
                q = open_ones[i]
                done[i] = self._fetched(lows[:, q], highs[:, q]).sum() - mine_too[:, i].any() >= least
            open_ones = open_ones[~done]
            if not len(open_ones):
                break
        for q in range(len(queries)):
            yield np.flatnonzero(self._fetched(lows[:, q], highs[:, q]))


def _searcher(trees: int, bits: int, fetched: float, k: int):
    """A shard's rows, index first and then queries, to the best ``k`` classes of each query in this shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, parts, forest = None, [], [], None
        for batch in batches:
            shards, kinds, keys = (batch.column(c).to_numpy() for c in ("shard", "is_query", "key"))
            rows = batch.column("vector")
            vectors = rows.flatten().to_numpy().astype(np.float64).reshape(len(rows), -1)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if shards[lo] != shard:
                    shard, names, parts, forest = shards[lo], [], [], None
                if not kinds[lo]:
                    names.append(keys[lo:hi])
                    parts.append(vectors[lo:hi])
                    continue
                if not parts:
                    continue
                if forest is None:
                    forest, names = Forest(np.concatenate(parts), trees, bits, 11), [np.concatenate(names)]
                out = [[], [], []]
                asked = vectors[lo:hi]
                for q, near in enumerate(forest.candidates(asked, min(1.0 * len(forest.vectors) * trees, max(fetched * len(forest.vectors), 4 * k)), LEAST_TIMES * k)):
                    scores = np.einsum("ij,j->i", forest.vectors[near], asked[q])
                    if len(near) > k + 1:
                        best = scores >= np.partition(scores, -k - 1)[-k - 1]
                        near, scores = near[best], scores[best]
                    for column, values in zip(out, (np.full(len(near), keys[lo + q]), names[0][near], scores)):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "class", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, bits: int = BITS, fetched: float = FETCHED,
            vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query by inner product in double precision, ties to the smaller id.

    ``queries`` has the columns of ``vectors``. Equal vectors are one class in the index, which keeps the ``k + 1`` smallest of its ids: no
    result can need more. Every class is in the index, in shards of about ``SHARD_ROWS``; a query visits all shards in blocks. Null, empty
    or zero vectors, vectors with null or non-finite components, and rows without an id take no part. Repeated rows count once; an id
    with several vectors asks with the smallest of them, and none of its own rows is an answer. Vectors must be of one length.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    first = Window.partitionBy("vector").orderBy("vec_id")
    members = (rows.dropDuplicates(["vector", "vec_id"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
               .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")))
    classes = written(members.select(F.monotonically_increasing_id().alias("class"), "vector", "members"), "ann-classes")
    asked = (queries.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
             .groupBy("key").agg(F.min("vector").alias("vector")))
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = classes.select(F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_query"), F.col("class").alias("key"), "vector")
    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"), "key", "vector")
    dealt = numbered.unionByName(spread).repartition(parts, "shard").sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(_searcher(trees, bits, fetched, k), "query_id long, class long, score double")
    best = found.withColumn("n", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") <= k + 1).drop("n")
    named = best.join(classes.select("class", "members"), "class")
    answers = named.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
