"""Merkle trees of documents: sections, paragraphs and short pieces, hashed upwards.

A section is a block between blank lines, a paragraph a line of it; a paragraph is cut at sentence ends and at every 8 code points. Equal
roots mean equal texts; where roots differ, the branches that differ say where.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces cover the whole text, separators included, and start anew after each sentence end and line break.
PIECE = r"[^.!?\n]{1,8}[.!?\n]*\x20?|[.!?\n]+\x20?"
SECTION_END = r"(?<=\n\n)(?!\n)"
LINE_END = r"(?<=\n)(?!\n)"
#: Low bits of a leaf that hold the length of its piece, as far as they go: full pieces weigh more than short common ones.
WEIGHT = 15


def leaves(text: Column) -> Column:
    """Sections of paragraphs of leaves: a hash of each piece, its lowest four bits replaced by the piece's length."""
    leaf = lambda piece: F.xxhash64(piece).bitwiseAND(F.lit(~WEIGHT)).bitwiseOR(F.least(F.length(piece), F.lit(WEIGHT)).cast("long"))
    line = lambda text: F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), leaf)
    return F.transform(F.split(text, SECTION_END), lambda section: F.transform(F.split(section, LINE_END), line))


def paragraphs(tree: Column) -> Column:
    """Digests of the paragraphs of each section."""
    return F.transform(tree, lambda section: F.transform(section, lambda line: F.xxhash64(line)))


def root(digests: Column) -> Column:
    """``<root>:<section digests>`` from the paragraph digests, in hexadecimal; the root covers all sections in order."""
    sections = F.array_join(F.transform(digests, lambda section: F.lpad(F.lower(F.hex(F.xxhash64(section))), 16, "0")), ".")
    whole = F.to_json(F.struct(digests.alias("d")))
    return F.concat_ws(":", F.sha2(whole.cast("binary"), 256), sections)


def pieces(tree: Column) -> Column:
    """All leaves of a tree, in order."""
    return F.flatten(F.flatten(tree))


def mass(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, leaf: total + leaf.bitwiseAND(F.lit(WEIGHT).cast("long")))


def likeness(a: Column, b: Column, different_a: Column, different_b: Column) -> Column:
    """Twice the shared mass of two leaf lists over their mass, 0 to 1: of equal leaves in equal places, or of equal leaves anywhere if that is more.

    Places count every repetition of a line, the sets of different leaves find what has moved. Two empty lists are alike.
    """
    shared = F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    share = lambda common, x, y: F.coalesce(2.0 * mass(common) / F.nullif(mass(x) + mass(y), F.lit(0)), F.lit(1.0))
    return F.greatest(share(shared, a, b), share(F.array_intersect(different_a, different_b), different_a, different_b))


def first_difference(a: Column, b: Column) -> Column:
    """``section, paragraph`` (from 0) of the first branch of ``b`` that differs from ``a``; null where the digests are equal.

    Sections are compared by position first; only the differing section is descended.
    """
    at = lambda x, y: F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1),
                                     lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))), F.lit(0))
    section = at(a, b)
    none = F.array().cast("array<bigint>")
    paragraph = at(F.coalesce(F.get(a, section), none), F.coalesce(F.get(b, section), none))
    return F.when(section.isNotNull(), F.struct(section.alias("section"), paragraph.alias("paragraph")))


def followed(docs: DataFrame, order: str, text: str) -> DataFrame:
    """``order``, ``text`` and ``next_text``, that of the following row by descending ``order``; the first row follows the last.

    Rows are dealt once into blocks of consecutive ids. Block limits are ids of the table, so the row that follows a block is known
    beforehand and goes into both. Ids are integers; rows of one id are ordered by a hash of their text, rows without one come last.
    """
    blocks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / blocks for k in range(1, blocks)]
    limits, top = docs.agg(F.percentile_approx(order, shares, 100 * blocks), F.max(order)).first()
    limits = sorted({x for x in limits or [] if x != top})
    key = docs[order]
    own = F.size(F.filter(F.lit(limits), lambda x: x < key)) if limits else F.lit(0)
    own = F.when(key.isNull(), 0).otherwise(own)
    place = lambda block, copy: F.struct(block.cast("int").alias("block"), F.lit(copy).alias("copy"))
    places = F.array(place(own, False), F.when(F.array_contains(F.lit(limits), key), place(own + 1, True)) if limits else F.lit(None),
                     F.when(key.eqNullSafe(F.lit(top)), place(F.lit(0), True)))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(key.alias("order"), body.alias("text"), F.explode(F.array_compact(places)).alias("place"))
    rows = rows.select("order", "text", F.xxhash64("text").alias("tie"), "place.*")
    line = Window.partitionBy("block").orderBy("copy", F.desc_nulls_last("order"), F.desc("tie"))
    return rows.withColumn("next_text", F.lead("text").over(line)).where("not copy").drop("copy", "tie", "block")


def compared(docs: DataFrame, text: str = "text", document: str = "doc_id") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its last third replaced by the start of the next document).

    Columns: ``document``, ``n_chars``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next`` and
    ``first_edit``. A null text counts as empty (a tree without leaves); repeated rows follow each other and each have a row.
    """
    rows = followed(docs, document, text)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", size - third), F.left("next_text", third)))
    rows = rows.withColumns({"tree": leaves(F.col("text")), "edited_tree": leaves(F.col("edited")), "next_tree": leaves(F.col("next_text"))})
    rows = rows.withColumns({"digests": paragraphs(F.col("tree")), "edited_digests": paragraphs(F.col("edited_tree"))})
    rows = rows.withColumns({"own": pieces(F.col("tree")), "changed": pieces(F.col("edited_tree")), "next": pieces(F.col("next_tree"))})
    rows = rows.withColumns({f"{c}_set": F.array_distinct(c) for c in ("own", "changed", "next")})
    near = lambda other: likeness(F.col("own"), F.col(other), F.col("own_set"), F.col(f"{other}_set"))
    return rows.select(
        F.col("order").alias(document), size.cast("bigint").alias("n_chars"), "edited", root(F.col("digests")).alias("fingerprint"),
        root(F.col("edited_digests")).alias("edited_fingerprint"), near("changed").alias("near_edited"), near("next").alias("near_next"),
        first_difference(F.col("digests"), F.col("edited_digests")).alias("first_edit"))
