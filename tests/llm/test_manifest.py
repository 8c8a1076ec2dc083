"""The manifest against a plain tree in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from terrascreen.llm import manifest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def climbed(nodes, fanout):
    """The root and, for every node, its runs of siblings (before, after)."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, place in enumerate(places):
            first = place // fanout * fanout
            proofs[i].append(("".join(level[first:place]), "".join(level[place + 1:first + fanout])))
            places[i] = place // fanout
        level = [digest("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], proofs


def plain(rows, fanout):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for x in langs}
    trees = {x: climbed([leaf_of(r) for r in g], fanout) for x, g in groups.items()}
    root, upper = climbed([trees[x][0] for x in langs], fanout)
    return sorted((str(r["doc_id"]), leaf_of(r), trees[x][0], root, tuple(p + u))
                  for x, u in zip(langs, upper) for r, p in zip(groups[x], trees[x][1]))


def found(df):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple((p["before"], p["after"]) for p in r["proof"])) for r in df.collect())


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i * 7 % 131, f"text {i}", None if i % 11 == 0 else "hot" if i % 3 else ("ä", "z", "a")[i % 9 // 3], "s", i) for i in range(230)] + [(5, "alone", "one", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("fanout,leaves", [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_tree_equals_plain_tree(many, fanout, leaves):
    rows = [r.asDict() for r in many.collect()]
    assert found(manifest.manifest(many, COLUMNS, "lang", "doc_id", ("doc_id",), fanout, leaves)) == plain(rows, fanout)


def test_awkward_rows(awkward, nothing):
    signed = manifest.manifest(awkward, COLUMNS, "lang", "doc_id", ("doc_id", "row", "digest"), block_leaves=4)
    assert signed.columns == ["doc_id", "row", "digest", "leaf", "subroot", "root", "proof"]
    assert found(signed) == plain([r.asDict() for r in awkward.collect()], 2)
    assert manifest.manifest(nothing, COLUMNS, "lang", "doc_id", ("doc_id",)).count() == 0


def test_one_row_is_its_own_root(frame):
    row = frame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.manifest(row, COLUMNS, "lang", "doc_id").first()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof"] == []


def test_audit_names_changed_moved_and_new_rows(many):
    signed = manifest.manifest(many, COLUMNS, "lang", "doc_id", ("doc_id",), block_leaves=8)
    root = signed.first()["root"]
    assert manifest.audited(many, signed, COLUMNS, "doc_id", root).where("not verified").count() == 0
    late = many.limit(1).withColumn("doc_id", F.lit(1000).cast("long"))
    changed = many.withColumn("text", F.when(F.col("doc_id") == 9, F.lit("other")).otherwise(F.col("text"))).unionByName(late)
    bad = manifest.audited(changed, signed, COLUMNS, "doc_id", root).where("not verified")
    assert {r["doc_id"] for r in bad.collect()} == {9, 1000}
    assert manifest.audited(many, signed, COLUMNS, "doc_id", "0" * 64).where("verified").count() == 0
