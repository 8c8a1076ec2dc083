"""Fingerprints and components against plain versions."""

import random

import numpy as np
import xxhash

from terrascreen.llm import simhash
from terrascreen.llm.components import components
from tests.llm.cases import AWKWARD, SCHEMA, rows


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits):
    parent = list(range(len(bits)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(bits):
        for j in range(i):
            if bin(a ^ bits[j]).count("1") <= 3 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(bits))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_of_awkward_rows(awkward, nothing):
    found = simhash.near_duplicates(simhash.fingerprints(awkward)).collect()
    assert sorted((str(r.doc_id), r.bits) for r in found) == sorted((str(i), signed(plain_fingerprint(t))) for i, t in AWKWARD)
    zero = {r.doc_id: r.component_id for r in found if r.bits == 0}
    assert zero == {2: 2, 3: 2, None: 2, 4: 2}
    assert simhash.near_duplicates(simhash.fingerprints(nothing)).count() == 0


def check_links(spark, bits):
    df = spark.createDataFrame([(i, signed(b)) for i, b in enumerate(bits)], "doc_id long, bits long").repartition(5)
    found = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert found == list(enumerate(plain_components(bits)))


def test_links_at_three_bits_and_no_further(spark):
    random.seed(3)
    bits = []
    for _ in range(60):
        base = random.getrandbits(64)
        bits += [base, base ^ sum(1 << b for b in random.sample(range(64), 3)), base ^ sum(1 << b for b in random.sample(range(64), 4))]
    check_links(spark, bits + bits[:20])


def test_a_crowded_bucket_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 16)
    random.seed(5)
    base = random.getrandbits(64)
    check_links(spark, list({base ^ random.getrandbits(12) for _ in range(250)}) + list({base ^ (random.getrandbits(9) << 30) for _ in range(60)}))


def test_masks_leave_one_key_to_every_close_pair():
    table = simhash.masks()
    assert len(table) == 20
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in table)


def test_long_paths_become_one_component(spark):
    edges = [(i, i + 1) for i in range(64)] + [(100, 101), (5, 5), (101, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(65)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark, awkward):
    kept = simhash.deduplicated(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "2", "5", "6", "7", "None"]
    twins = spark.createDataFrame(rows((9, "a b c d e f"), (8, "A B c d e f"), (10, "something else entirely is here")), SCHEMA)
    assert sorted(r.doc_id for r in simhash.deduplicated(twins).collect()) == [8, 10]
