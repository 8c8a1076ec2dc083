"""Feature files in the order of a space-filling curve, so that a window test leaves out most of a file unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the curve per axis, and how many halvings of the extent tell features of different size apart.
BITS, SIZES = 16, 8


def _interleaved(x: Column, y: Column) -> Column:
    """Bits of two numbers of ``BITS`` bits in turn (Morton order)."""

    def apart(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    return apart(x).bitwiseOR(F.shiftleft(apart(y), 1))


def curve_order(features: DataFrame) -> DataFrame:
    """Adds ``_size`` and ``_place`` to features with an envelope ``x1, y1, x2, y2``: neighbours of one size are near each other in this order.

    Wide features stand apart, since one of them would widen the range of values of everything stored with it. Null envelopes come first.
    """
    bounds = features.agg(F.struct(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).alias("b")).scalar()
    marked = features.withColumn("_b", bounds)
    extent = F.greatest(F.col("_b.x2") - F.col("_b.x1"), F.col("_b.y2") - F.col("_b.y1"), F.lit(1e-9))
    cell = lambda a, b, low: F.least(F.floor(((F.col(a) + F.col(b)) / 2 - low) / extent * F.lit(1 << BITS)), F.lit((1 << BITS) - 1)).cast("bigint")
    width = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), extent / F.lit(1 << SIZES))
    return marked.withColumns({"_size": F.greatest(F.least(F.ceil(F.log2(width / extent)), F.lit(0)), F.lit(-SIZES)).cast("int"),
                               "_place": _interleaved(cell("x1", "x2", F.col("_b.x1")), cell("y1", "y2", F.col("_b.y1")))}).drop("_b")


def write_features(features: DataFrame, path: str, group_bytes: int = 16 << 20) -> None:
    """Parquet in curve order; ``group_bytes`` bounds a row group, the unit that a reader's window test can leave out."""
    order = ["_size", "_place", "x1", "y1"]
    placed = curve_order(features).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.drop("_size", "_place").write.option("parquet.block.size", group_bytes).parquet(path)
