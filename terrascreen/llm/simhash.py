"""SimHash near-duplicates: fingerprints that differ in few bits, found through shared blocks of bits."""

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.components import components
from terrascreen.llm.shared import ROW, bundled, spread, written

DISTANCE = 3
DENSE = 2048


def masks(width: int = 64, within: int = (1 << 64) - 1, distance: int = DISTANCE) -> list[int]:
    """Bit masks of all choices of ``distance`` out of ``2 * distance`` blocks of the bits set in ``within``.

    Three differing bits touch three of six blocks at most, so every close pair shares one of the 20 keys of about 32 bits.
    """
    places = [i for i in range(width) if within >> i & 1]
    cuts = [places[len(places) * k // (2 * distance):len(places) * (k + 1) // (2 * distance)] for k in range(2 * distance)]
    blocks = [sum(1 << i for i in cut) for cut in cuts]
    return [sum(chosen) for chosen in combinations(blocks, distance)]


def fingerprint(text: bytes, words: int) -> int:
    """64 majority bits over the XXH64 of all shingles, repeats included; zero without words."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in map(b" ".join, zip(*(tokens[i:] for i in range(words))))], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``bits`` (64 bits as a long). A null text counts as empty; empty texts have zero; repeated rows stay."""
    source = bundled(docs, text, keep)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary())
            found = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(found)], [ROW, "bits"])

    return spread(source.mapInArrow(compute, f"{ROW} {source.schema[ROW].dataType.simpleString()}, bits long"), keep, "bits")


def _hunt(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of one bucket as stars: all members reachable from a member are tied to it."""
    left, links = members, []
    while len(left) > 1:
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= distance
            if near.any():
                found = left[near]
                links += [(int(x), int(root)) for x in found]
                front += list(found)
                left = left[~near]
    return links


def _bucket(members: np.ndarray, mask: int, distance: int) -> list[tuple[int, int]]:
    """A crowded bucket is split by the same rule once more, over the bits that its key leaves open."""
    if len(members) <= DENSE:
        return _hunt(members, distance)
    links = []
    for inner in masks(within=((1 << 64) - 1) & ~mask, distance=distance):
        keys = members & np.uint64(inner)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(members[order], cuts):
            if len(part) > 1:
                links += _hunt(part, distance)
    return links


def _linker(table: list[int], distance: int):
    """Sorted rows ``slot, key, bits`` to links; a bucket may go on over several batches."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, key, bits = (np.empty(0, np.int64) for _ in range(3))

        def search(slot: np.ndarray, key: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[new, len(slot)])
            two = new[sizes == 2]
            u = bits.view(np.uint64)
            near = two[np.bitwise_count(u[two] ^ u[two + 1]) <= distance]
            a, b = [bits[near]], [bits[near + 1]]
            for at, size in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if found := _bucket(u[at:at + size], table[slot[at]], distance):
                    pairs = np.array(found, np.uint64).view(np.int64)
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            slot, key, bits = (np.concatenate([old, batch.column(c).to_numpy().astype(np.int64)]) for c, old in (("slot", slot), ("key", key), ("bits", bits)))
            if len(slot) and (slot[0], key[0]) != (slot[-1], key[-1]):
                last = int(np.flatnonzero((slot != slot[-1]) | (key != key[-1]))[-1]) + 1
                yield from search(slot[:last], key[:last], bits[:last])
                slot, key, bits = slot[last:], key[last:], bits[last:]
        if len(slot):
            yield from search(slot, key, bits)

    return link


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints that connect all fingerprints within ``distance`` bits, from a table of distinct ``bits``.

    A pair is given once per shared key at most, and a bucket's pairs form stars: what a group of copies sends on grows with its size,
    never with its square. Distance is verified on whole fingerprints.
    """
    table = masks(distance=distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in table]
    keyed = distinct.select("bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m)) for m in signed])).alias("slot", "key"))
    dealt = keyed.repartition("slot", "key").sortWithinPartitions("slot", "key")
    return dealt.mapInArrow(_linker(table, distance), "a long, b long")


def near_duplicates(marked: DataFrame, document: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """Adds ``root`` (a fingerprint that names the component) and ``component_id`` (smallest ``document`` in it) to rows with ``bits``.

    Equal fingerprints are one class before anything is compared. A null ``document`` never names a component; a component without any
    has a null ``component_id``. ``marked`` is read three times, so it should be a written table.
    """
    classes = written(marked.groupBy("bits").agg(F.min(document).alias("_first")), "simhash-classes")
    joined = components(links(classes.select("bits"), distance), "simhash-links")
    rooted = classes.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("component", "bits"))
    named = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return marked.join(rooted.select("bits", "root").join(named, "root"), "bits")


def deduplicated(docs: DataFrame, words: int = 3, distance: int = DISTANCE, text: str = "text", document: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one document left of each component: that of the smallest id, one row of it.

    Rows without an id stay only where their whole component has none, one row per component.
    """
    marked = near_duplicates(written(fingerprints(docs, words, text, [document]), "simhash-bits"), document, distance)
    named = marked.where(F.col(document) == F.col("component_id")).select(document).distinct()
    kept = docs.join(named, document, "left_semi").dropDuplicates([document]).select(*docs.columns)
    nameless = docs.where(F.col(document).isNull())
    lone = written(fingerprints(nameless, words, text, docs.columns), "simhash-nameless")
    roots = marked.where("component_id is null").groupBy("root").agg(F.min("bits").alias("bits")).select("bits")
    return kept.unionByName(lone.join(roots, "bits", "left_semi").dropDuplicates(["bits"]).select(*docs.columns))
