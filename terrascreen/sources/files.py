"""Identity of files in folders: sizes and digests by streaming, keyed by the path below the folder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task holds at a time.
BUFFER = 4 << 20


def listed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``name`` (path below the folder) and ``path`` of every file at any depth, empty ones included; contents are not read.

    The list is Spark's own file index, which the driver of any scan holds.
    """
    own = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = unquote(own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toUri().toString()).rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).inputFiles()
    # A local path is written with one slash or with three.
    plain = lambda path: re.sub("^file:/+", "file:/", path)
    rows = [(plain(path)[len(plain(base)):], path) for path in map(unquote, found)]
    return spark.createDataFrame(rows, "name string, path string")


def _opened(path: str):
    """An input stream of the store that the path names."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(path.split(":", 1)[-1] if parts.scheme else path)
    store, inner = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{quote(path.split(parts.netloc, 1)[1])}")
    return store.open_input_stream(inner)


def _digests(buffer: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for path in batch.column("path").to_pylist():
                state, size = hashlib.sha256(), 0
                with _opened(path) as stream:
                    while chunk := stream.read(buffer):
                        state.update(chunk)
                        size += len(chunk)
                sizes.append(size)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], ["name", "bytes", "sha256"])

    return digest


def file_identity(spark: SparkSession, folder: str, pattern: str = "*", buffer: int = BUFFER) -> DataFrame:
    """``name`` (path below the folder), ``bytes`` and ``sha256`` of every file at any depth.

    Tasks read a file in pieces of ``buffer`` bytes, so its size does not matter; files are dealt by a hash of their path. The store must be one
    that tasks can open: a mounted folder, or any that pyarrow knows.
    """
    files = listed_files(spark, folder, pattern)
    return files.repartition("path").mapInArrow(_digests(buffer), "name string, bytes long, sha256 string")


def file_manifest_check(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries against files: missing, extra, changed size or digest, listed twice, or ok."""
    listed = manifest.groupBy("name").agg(F.min("bytes").alias("m_bytes"), F.min("sha256").alias("m_sha"), F.count("*").alias("m_n"))
    joined = actual.join(listed, "name", "full")
    status = (F.when(F.col("bytes").isNull(), "missing").when(F.col("m_n").isNull(), "extra").when(F.col("m_n") > 1, "repeated")
              .when(~F.col("bytes").eqNullSafe(F.col("m_bytes")), "size").when(~F.col("sha256").eqNullSafe(F.col("m_sha")), "digest").otherwise("ok"))
    return joined.select("name", status.alias("status"))
