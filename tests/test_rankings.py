"""Rankings, quantiles and comparisons against hand cases and brute force, with hot keys."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from terrascreen.operators import compare, ordering, scoring


def test_midranks(frame):
    df = frame([("a", 4.0), ("b", 4.0), ("c", 2.0), ("d", 1.0)], "id string, v double")
    assert {r["id"]: r["midrank"] for r in scoring.midranks(df, [], "v").collect()} == {"a": 1.5, "b": 1.5, "c": 3.0, "d": 4.0}


def test_top_sets(frame):
    df = frame([("b", 4.0), ("a", 4.0), ("c", 2.0)], "id string, v double")
    assert [r["id"] for r in ordering.top_k(df, [], [F.desc("v"), F.col("id")], 1).collect()] == ["a"]
    assert {r["id"] for r in scoring.top_k_inclusive(df, "v", 1).collect()} == {"a", "b"}


def test_rank_comparison(frame):
    rows = frame([("a", 4.0, 4.0, 1), ("b", 4.0, 2.0, 1), ("c", 2.0, 2.0, 1)], "id string, a double, b double, k int")
    row = compare.compare_rankings(rows, []).first()
    assert row["spearman"] == pytest.approx(0.5) and row["inclusive_jaccard"] == 0.5
    constant = compare.compare_rankings(rows.withColumn("b", F.lit(1.0)), []).first()
    assert constant["spearman"] is None


def test_variance_partition(frame):
    rows = frame([("a", 0.0), ("a", 2.0), ("b", 8.0)], "cell string, fine double")
    row = compare.variance_partition(rows, []).first()
    assert (row["within"], row["between"], row["total"]) == pytest.approx((2 / 3, 98 / 9, 104 / 9))
    row = compare.variance_partition(rows, [], equal_cells=True).first()
    assert (row["within"], row["between"]) == pytest.approx((0.5, 12.25))


def test_selection_sizes(spark):
    sizes = spark.range(1).select(*[compare.selection_k(F.lit(39), p).alias(str(p)) for p in compare.SELECTION_PERCENT]).first()
    assert tuple(sizes) == (4, 8, 10, 13, 20)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and one value a third of them."""
    rng = random.Random(7)
    rows = [(0 if rng.random() < .8 else rng.randrange(1, 5), 0.5 if rng.random() < .33 else rng.random(), i) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "k int, v double, id int").repartition(7)


def test_ordinal_on_a_hot_key(skewed):
    rows, df = skewed
    got = {(r["k"], r["id"]): r["rank"] for r in ordering.ordinal(df, ["k"], [F.desc("v"), F.col("id")]).collect()}
    for key in range(5):
        members = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert all(got[(key, r[2])] == i for i, r in enumerate(members, start=1))


def test_exact_quantiles_both_ways(skewed):
    rows, df = skewed
    for bounded in (True, False):
        got = {r["k"]: r["m"] for r in ordering.exact_quantiles(df, ["k"], "v", {"m": 0.5}, bounded=bounded).collect()}
        for key in range(5):
            assert got[key] == pytest.approx(statistics.median(r[1] for r in rows if r[0] == key))


def test_comparison_does_not_depend_on_row_order(skewed):
    rows, df = skewed
    table = df.select(F.col("k").alias("g"), F.col("id").cast("string").alias("id"), F.col("v").alias("a"), (F.col("id") % 97).cast("double").alias("b"), F.lit(40).alias("k"))
    first = compare.compare_rankings(table, ["g"]).orderBy("g").collect()
    second = compare.compare_rankings(table.orderBy(F.desc("id")).repartition(3), ["g"]).orderBy("g").collect()
    for a, b in zip(first, second):
        assert a.asDict(True) == pytest.approx(b.asDict(True))


def test_blocked_scan_previous_and_sum(skewed):
    rows, df = skewed
    blocks = ordering.ordered_blocks(df.select("k", "id", "v"), [F.col("k"), F.col("id")])
    got = {(r["k"], r["id"]): (r["p"], r["s"]) for r in ordering.blocked_scan(blocks, ["k"], {"p": ("previous", F.col("id")), "s": ("sum", F.lit(1))}).collect()}
    for key in range(5):
        ids = sorted(r[2] for r in rows if r[0] == key)
        assert all(got[(key, i)] == ((ids[n - 1] if n else None), n) for n, i in enumerate(ids))


def test_leave_one_out_takes_every_group(frame):
    rows = [(i, f"d{i}", float(i), 1.0) for i in range(6)]
    panel = frame(rows, "cell int, district string, fine double, seasonal double")
    assert {r["omitted"]: r["n"] for r in compare.leave_one_group_out(panel).collect()} == {f"d{i}": 5 for i in range(6)}


def test_selection_equals_sorting(spark):
    """Ties, nulls, null keys, hot and tiny groups, extreme ranges; several narrowing steps."""
    import random

    rng = random.Random(12)
    rows = [("hot", rng.choice((0.0, 1.0, rng.gauss(0, 1), 10 ** rng.uniform(-300, 300)))) for _ in range(20_000)]
    rows += [("same", 5.0)] * 300 + [("one", -1.5), ("two", 1.0), ("two", 2.0), ("none", None), ("hot", None), (None, 3.0), (None, 4.0)] + [("few", float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"q0": 0.0, "q1": 0.025, "q5": 0.5, "q9": 0.999, "q10": 1.0}
    got = {r["k"]: r for r in ordering.exact_quantiles(df, ["k"], "v", probs).collect()}
    nearest = {r["k"]: r for r in ordering.exact_quantiles(df, ["k"], "v", probs, nearest_rank=True).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(nearest) == set(groups)
    for k, values in groups.items():
        values.sort()
        for name, p in probs.items():
            at = (len(values) - 1) * p
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)
            assert nearest[k][name] == values[max(math.ceil(p * len(values)) - 1, 0)]


def test_selection_of_whole_numbers_without_keys(spark):
    big = 1 << 60
    df = spark.range(5000).selectExpr(f"cast({big} + id % 1700 as bigint) as v")
    values = sorted(big + i % 1700 for i in range(5000))
    row = ordering.selected(df, [], "v", {"a": F.lit(0), "b": F.lit(2500), "c": F.lit(4999)}).first()
    assert (row["n"], row["a"], row["b"], row["c"]) == (5000, values[0], values[2500], values[4999])
    none = ordering.exact_quantiles(df.where("v < 0"), [], "v", {"m": 0.5}).collect()
    assert [r["m"] for r in none] == [None]


def test_keys_of_few_values_are_not_narrowed(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(k if k else None, rng.random()) for k in range(30) for _ in range(k + 1)] + [(99, rng.random()) for _ in range(300)] + [(5, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    found = []
    for few in (4096, 20):
        monkeypatch.setattr(ordering, "FEW", few)
        table = ordering.exact_quantiles(df, ["k"], "v", {"m": 0.5})
        assert few < 4096 or "approx_percentile" not in table._jdf.queryExecution().toString()
        found.append(sorted((tuple(r) for r in table.collect()), key=str))
    wanted = {k: statistics.median(v for g, v in rows if g == k and v is not None) for k in {r[0] for r in rows}}
    assert found[0] == found[1] and dict(found[0]) == pytest.approx(wanted)
