"""Merkle manifest of a table: a leaf, a proof and the roots above it for every row.

Leaves of a group stand in order. Aligned blocks of a power of the fan-out keep each level of their subtree as one string of fixed-width hex
digests: fixed-width substrings are hashed to the parents, flanking substrings are the siblings of a proof. The roots of the blocks are the
leaves of the next tier, until each group has one root; the roots of the groups, in order of their group, form one more such tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.shared import ROW, spread, written
from terrascreen.operators.ordering import ordinal

DIGEST = 64
#: A block holds at most so many leaves: its strings stay below 70 kB a level.
BLOCK_LEAVES = 1024


def leaf_digest(*values: Column) -> Column:
    """SHA-256, in hex, of all values: each as its UTF-8 byte count, a colon and its text, or a dash where it is null."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, run: F.sha2(F.concat(run["before"], h, run["after"]).cast("binary"), 256))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on names that may be null."""
    renamed = right.select(*[F.col(c).alias(f"r_{c}") if c in names else F.col(c) for c in right.columns])
    match = F.lit(True)
    for name in names:
        match &= F.col(name).eqNullSafe(F.col(f"r_{name}"))
    return left.join(renamed, match).drop(*[f"r_{n}" for n in names])


def _tier(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes ``tree, at, digest, held`` as blocks ``tree, block, items, levels``; ``wide`` is the number of blocks of the tree.

    A block has all its ``depth`` levels where its tree goes on above it, and otherwise as many as lead to one node.
    """
    blocks = written(nodes.groupBy("tree", F.expr(f"at div {fanout ** depth}").alias("block"))
                     .agg(F.array_sort(F.collect_list(F.struct("at", "digest", "held"))).alias("items")), "manifest-blocks")
    blocks = _same(blocks, blocks.groupBy("tree").agg(F.count("*").alias("wide")), ["tree"])
    last, run = "element_at(acc, -1)", DIGEST * fanout
    parents = (f"cast(array_join(transform(sequence(0, (length({last}) - 1) div {run}), k -> sha2(substring({last}, k * {run} + 1, {run}), 256)), '') as binary)")
    levels = (f"aggregate(sequence(1, {depth}), array(cast(array_join(transform(items, s -> s.digest), '') as binary)), "
              f"(acc, k) -> if(wide = 1 and length({last}) = {DIGEST}, acc, array_append(acc, {parents})))")
    return written(blocks.withColumn("levels", F.expr(levels)), "manifest-levels")


def _tiers(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """All tiers of blocks, from the leaves up; the last has one block per tree."""
    tiers = [_tier(nodes, fanout, depth)]
    while (tiers[-1].agg(F.max("wide")).first()[0] or 1) > 1:
        # A tree that has come to one node waits: it passes on its node, which the next tier leaves as it is.
        above = tiers[-1].select("tree", F.col("block").alias("at"), F.expr("cast(element_at(levels, -1) as string)").alias("digest"), F.lit(None).cast("int").alias("held"))
        tiers.append(_tier(above, fanout, depth))
    return tiers


def _proved(tier: DataFrame, upper: DataFrame | None, fanout: int) -> DataFrame:
    """Items of a tier with the siblings from their level to the root; ``upper`` has those of each block, with what it passes down."""
    place = f"(i div cast(pow({fanout}, l) as bigint))"
    first = f"({place} div {fanout} * {fanout})"
    flank = lambda start, count: f"cast(substring(v, cast({start} * {DIGEST} + 1 as int), cast(({count}) * {DIGEST} as int)) as string)"
    own = (f"transform(slice(levels, 1, size(levels) - 1), (v, l) -> named_struct('before', {flank(first, f'{place} - {first}')}, "
           f"'after', {flank(f'({place} + 1)', f'{first} + {fanout} - 1 - {place}')}))")
    passed = []
    if upper is not None:
        tier, own = _same(tier, upper, ["tree", "block"]), f"concat({own}, proof)"
        passed = [c for c in upper.columns if c not in ("tree", "block", "proof")]
    items = tier.select("tree", F.explode(F.expr(f"transform(items, (s, i) -> struct(s.at, s.digest, s.held, {own} as proof))")).alias("s"), *passed)
    return items.select("tree", "s.at", "s.digest", "s.held", "s.proof", *passed)


def manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, keep: Sequence[str] = (), fanout: int = 2, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """``keep``, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row.

    ``columns`` enter the leaf, in this order. Rows of a ``group`` (null is one of them) ascend by ``order`` (nulls first, ties by leaf); every
    ``fanout`` consecutive nodes, at the end fewer, become one. ``proof`` lists the runs from the leaf to the root, each with the digests
    ``before`` and ``after`` the own node. Repeated rows are leaves of their own. No rows give no rows; kept columns must have an order.
    """
    depth = 1
    while fanout ** (depth + 1) <= block_leaves:
        depth += 1
    leaf = leaf_digest(*[docs[c] for c in columns])
    held = F.struct(*[docs[c] for c in keep] or [F.lit(0).alias("_none")])
    picked = docs.select(held.alias(ROW), docs[group].alias("tree"), docs[order].alias("place"), leaf.alias("digest"))
    placed = ordinal(picked, ["tree"], [F.col("place"), F.col("digest")], "at")
    tiers = _tiers(placed.select("tree", (F.col("at") - 1).alias("at"), "digest", F.col(ROW).alias("held")), fanout, depth)
    subroots = written(tiers[-1].select("tree", F.expr("cast(element_at(levels, -1) as string)").alias("digest")), "manifest-subroots")
    ranked = ordinal(subroots, [], [F.col("tree")], "at")
    tops = _tiers(ranked.select(F.lit(0).alias("tree"), (F.col("at") - 1).alias("at"), "digest", F.struct("tree").alias("held")), fanout, depth)
    upper = tops[-1].select("tree", "block", F.array().cast("array<struct<before:string,after:string>>").alias("proof"), F.expr("cast(element_at(levels, -1) as string)").alias("root"))
    for tier in reversed(tops):
        found = _proved(tier, upper, fanout)
        upper = found.select("tree", F.col("at").alias("block"), "proof", "root")
    upper = found.select(F.col("held.tree").alias("tree"), F.lit(0).cast("bigint").alias("block"), "proof", F.col("digest").alias("subroot"), "root")
    for tier in reversed(tiers):
        found = _proved(tier, upper, fanout)
        upper = found.select("tree", F.col("at").alias("block"), "proof", "subroot", "root")
    return spread(found.select(F.col("held").alias(ROW), F.col("digest").alias("leaf"), "subroot", "root", "proof"), keep, "leaf", "subroot", "root", "proof")


def audited(docs: DataFrame, signed: DataFrame, columns: Sequence[str], key: str, root: str) -> DataFrame:
    """``key`` and ``verified`` of every row of ``docs``: whether some manifest row of its key leads from its present leaf to ``root``."""
    now = docs.select(docs[key].alias("key"), leaf_digest(*[docs[c] for c in columns]).alias("leaf"), F.monotonically_increasing_id().alias("nr"))
    now = written(now, "manifest-audit")
    known = signed.select(F.col(key).alias("key"), "proof")
    met = _same(now, known, ["key"]).groupBy("nr").agg(F.bool_or(folded(F.col("leaf"), F.col("proof")) == root).alias("good"))
    return now.join(met, "nr", "left").select(F.col("key").alias(key), F.coalesce("good", F.lit(False)).alias("verified"))
