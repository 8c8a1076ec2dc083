"""Publication of versions: written first, judged as written, claimed once, read as claimed."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascreen.operators.quality import enforce
from terrascreen.sources.files import file_identity, file_manifest_check

Tables = Mapping[str, DataFrame]
#: What a version must satisfy: given its tables as read back, the rows that violate the rule.
Rule = Callable[[Tables], DataFrame]


class VersionTaken(ValueError):
    """Another writer has published this version."""


def _store(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def _claim(spark: SparkSession, path: str, content: str) -> None:
    """Creates a file that must not be there yet. The store decides between two writers, as far as its create-if-absent is atomic."""
    from py4j.protocol import Py4JJavaError

    store, own = _store(spark, path)
    try:
        stream = store.create(own, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or store.exists(own):
            raise VersionTaken(path) from error
        raise
    stream.write(bytearray(content.encode()))
    stream.close()


def _marker(base: str, version: int) -> str:
    return f"{base}/versions/{version:012d}.json"


def _read(spark: SparkSession, attempt: str, tables: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{attempt}/data/{name}") for name, schema in tables.items()}


def _fingerprint(identity: DataFrame) -> str:
    """Number of files and a sum of hashes of their names, sizes and digests."""
    count, total = identity.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("name", "bytes", "sha256").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{count}:{total}"


def validate_then_publish(tables: Tables, rules: Mapping[str, Rule], base: str, version: int) -> str:
    """Writes the tables, applies the rules to what was written, and claims ``version`` for it; returns the attempt's folder.

    Every attempt has a folder of its own, so a refused one leaves the version free. The digests of its files are taken before the rules run
    and again afterwards; a difference refuses the attempt. Rules get all tables of the attempt. A version that is there already raises
    :class:`VersionTaken`, whoever came first; readers see a version from the moment its claim is whole.
    """
    if not tables:
        raise ValueError("nothing to publish")
    for name in tables:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"bad table name {name}")
    spark = next(iter(tables.values())).sparkSession
    store, own = _store(spark, _marker(base, version))
    if store.exists(own):
        raise VersionTaken(str(version))
    attempt = f"{base}/attempts/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{attempt}/data/{name}")
    schemas = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) for name, table in tables.items()}
    file_identity(spark, f"{attempt}/data").write.parquet(f"{attempt}/files")
    back = _read(spark, attempt, schemas)
    for rule in rules.values():
        enforce(rule(back))
    if _changed(spark, attempt).take(1):
        raise ValueError("files changed while they were judged")
    _claim(spark, _marker(base, version), json.dumps({"version": version, "attempt": attempt, "tables": schemas, "files": _fingerprint(spark.read.parquet(f"{attempt}/files"))}))
    return attempt


def _changed(spark: SparkSession, attempt: str) -> DataFrame:
    return file_manifest_check(file_identity(spark, f"{attempt}/data"), spark.read.parquet(f"{attempt}/files")).where("status <> 'ok'")


def _claimed(spark: SparkSession, base: str, version: int) -> dict | None:
    """The claim of a version; none while its writer has not finished it."""
    store, own = _store(spark, _marker(base, version))
    stream = store.open(own)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def published_version(spark: SparkSession, base: str) -> int | None:
    """The latest version with a whole claim; the folder holds one small file per version."""
    store, own = _store(spark, f"{base}/versions")
    names = [status.getPath().getName() for status in store.listStatus(own)] if store.exists(own) else []
    numbers = sorted((int(name[:-5]) for name in names if re.fullmatch(r"[0-9]+\.json", name)), reverse=True)
    return next((number for number in numbers if _claimed(spark, base, number)), None)


def read_published(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version (the latest by default): later versions and attempts do not change what is read."""
    claim = _claimed(spark, base, published_version(spark, base) if version is None else version)
    return _read(spark, claim["attempt"], {name: claim["tables"][name]})[name]


def published_problems(spark: SparkSession, base: str, version: int) -> DataFrame:
    """Files of a version that are missing, added or changed since it was claimed, as ``rule, key``."""
    claim = _claimed(spark, base, version)
    changed = _changed(spark, claim["attempt"]).select(F.col("status").alias("rule"), F.col("name").alias("key"))
    if _fingerprint(spark.read.parquet(f"{claim['attempt']}/files")) == claim["files"]:
        return changed
    return changed.unionByName(spark.range(1).select(F.lit("manifest_changed").alias("rule"), F.lit(claim["attempt"]).alias("key")))
