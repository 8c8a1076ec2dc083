"""Identity of files and publication of versions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from terrascreen.sources import files, publishing


def identity(spark, folder, **more):
    return {r["name"]: (r["bytes"], r["sha256"]) for r in files.file_identity(spark, str(folder), **more).collect()}


def test_files_are_read_in_pieces_and_named_by_their_path(spark, tmp_path):
    content = {"a/data.bin": bytes(range(256)) * 1200, "b/data.bin": b"other", "b/deep er/ünï %41.bin": b"\x00\xff", "empty.bin": b""}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "skipped.txt").write_text("x")
    wanted = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in content.items()}
    assert identity(spark, tmp_path, pattern="*.bin", buffer=1000) == wanted
    assert identity(spark, f"file://{tmp_path}/", pattern="*.bin") == wanted


def test_manifest_of_two_folders_with_equal_names(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for name in ("same", "grows", "changes", "goes"):
            (tmp_path / folder / name).write_text(f"{folder} {name}")
    frozen = spark.createDataFrame([tuple(r) for r in files.file_identity(spark, str(tmp_path)).collect()], "name string, bytes long, sha256 string")
    check = lambda manifest: {r["name"]: r["status"] for r in files.file_manifest_check(files.file_identity(spark, str(tmp_path)), manifest).collect()}
    assert set(check(frozen).values()) == {"ok"} and len(check(frozen)) == 8
    (tmp_path / "one" / "grows").write_text("one grows!")
    (tmp_path / "two" / "changes").write_text("TWO changes")
    (tmp_path / "two" / "goes").rename(tmp_path / "two" / "comes")
    got = check(frozen.union(frozen.where("name = 'one/same'")))
    assert got == {"one/same": "repeated", "one/grows": "size", "one/changes": "ok", "one/goes": "ok", "two/same": "ok", "two/grows": "ok", "two/changes": "digest", "two/goes": "missing", "two/comes": "extra"}


def rule(condition):
    return {"r": lambda tables: tables["t"].where(condition).select(F.lit("rule_x").alias("rule"), F.col("id").cast("string").alias("key"))}


def test_refused_version_keeps_the_old_one_and_can_be_written_again(spark, tmp_path):
    base, table = str(tmp_path / "pub"), spark.range(3)
    assert publishing.published_version(spark, base) is None
    publishing.validate_then_publish({"t": table}, rule("id > 5"), base, 1)
    with pytest.raises(ValueError, match="rule_x"):
        publishing.validate_then_publish({"t": spark.range(9)}, rule("id > 5"), base, 2)
    assert publishing.published_version(spark, base) == 1 and publishing.read_published(spark, base, "t").count() == 3
    publishing.validate_then_publish({"t": spark.range(5)}, rule("id > 5"), base, 2)
    assert publishing.published_version(spark, base) == 2
    assert publishing.read_published(spark, base, "t").count() == 5 and publishing.read_published(spark, base, "t", version=1).count() == 3


def test_two_writers_of_one_version(spark, tmp_path):
    """The second writer starts while the version is free and comes to its claim after the first."""
    base = str(tmp_path / "pub")

    def overtaken(tables):
        publishing.validate_then_publish({"t": spark.range(4)}, {}, base, 7)
        return tables["t"].where("id > 5").select(F.lit("r").alias("rule"), F.col("id").alias("key"))

    with pytest.raises(publishing.VersionTaken):
        publishing.validate_then_publish({"t": spark.range(2)}, {"slow": overtaken}, base, 7)
    with pytest.raises(publishing.VersionTaken):
        publishing.validate_then_publish({"t": spark.range(2)}, {}, base, 7)
    assert publishing.read_published(spark, base, "t").count() == 4


def test_rules_see_what_was_written(spark, tmp_path):
    """The source passes when the rule is thought of and has changed when the version is written."""
    source, base = str(tmp_path / "source"), str(tmp_path / "pub")
    spark.range(3).write.parquet(source)
    table = spark.read.schema("id long").parquet(source)
    assert table.where("id > 5").count() == 0
    spark.range(10, 11).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="rule_x: 10"):
        publishing.validate_then_publish({"t": spark.read.schema("id long").parquet(source)}, rule("id > 5"), base, 1)
    assert publishing.published_version(spark, base) is None


def test_files_changed_while_they_are_judged(spark, tmp_path):
    base = tmp_path / "pub"

    def meddled(tables):
        for file in base.glob("attempts/*/data/t/*.parquet"):
            file.with_name("more.parquet").write_bytes(file.read_bytes())
        return tables["t"].where("false").select(F.lit("r").alias("rule"), F.col("id").alias("key"))

    with pytest.raises(ValueError, match="changed while"):
        publishing.validate_then_publish({"t": spark.range(2)}, {"m": meddled}, str(base), 1)


def test_later_changes_are_found_and_unfinished_claims_are_not_versions(spark, tmp_path):
    base = tmp_path / "pub"
    attempt = publishing.validate_then_publish({"t": spark.range(2)}, {}, str(base), 1)
    assert publishing.published_problems(spark, str(base), 1).count() == 0
    (base / "versions" / "000000000002.json").write_text('{"version": 2, "att')
    assert publishing.published_version(spark, str(base)) == 1
    for file in (base / "attempts" / attempt.rsplit("/", 1)[1] / "data" / "t").glob("part-*.parquet"):
        file.write_bytes(file.read_bytes() + b"x")
    assert {r["rule"] for r in publishing.published_problems(spark, str(base), 1).collect()} == {"size"}
    assert json.loads((base / "versions" / "000000000001.json").read_text())["version"] == 1


def test_nothing_and_bad_names(spark, tmp_path):
    for tables in ({}, {"../t": spark.range(1)}):
        with pytest.raises(ValueError):
            publishing.validate_then_publish(tables, {}, str(tmp_path), 1)


def test_report_tables_are_read_back(spark, tmp_path):
    from terrascreen.sources import sinks

    rows = [("a", 1.5, None), ("a", 1.5, None), (None, float("1e-17"), 3), ('quote " and\nline', -0.1, 4)]
    table = spark.createDataFrame(rows, "name string, v double, n long")
    sinks.write_report_tables({"t": table}, str(tmp_path))
    read = sinks.read_report_tables(spark, str(tmp_path), {"t": "name string, v double, n long"})
    assert sorted(map(str, read["t"].collect())) == sorted(map(str, table.collect()))
    assert sinks.report_problems({"t": table}, read).count() == 0
    other = table.where("n is null or n <> 4").union(spark.createDataFrame([("new", 0.0, 0)], table.schema))
    assert sorted(r["rule"] for r in sinks.report_problems({"t": other}, read).collect()) == ["t_added", "t_lost"]
    with pytest.raises(Exception):
        sinks.read_report_tables(spark, str(tmp_path), {"t": "name int, v double, n long"})["t"].collect()
