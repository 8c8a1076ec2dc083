"""Sequences of bounded length from whole documents: hierarchical best-fit packing.

Each task tokenizes its documents, cuts only those that are too long, and best-fits the pieces into bins. Bins that are nearly full are
final. The others travel as items of their own to fewer tasks, where best fit joins them again, round after round.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.bpe import read_ranks
from terrascreen.llm.shared import ROW, bundled, lean, spread, written

#: The pre-token pattern of the 50k byte-level vocabularies, in a form without backtracking.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
CHUNK_PIECES = 200_000
BINS_PER_TASK = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size, largest first into the fullest bin with room.

    Bins wait in one stack per free room and an integer marks the stacks in use, so a placement costs a bit scan and no search.
    """
    bins = np.empty(len(sizes), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                used &= ~(1 << room)
        else:
            room, b, count = capacity, count, count + 1
        bins[i] = b
        if room > size:
            waiting[room - size].append(b)
            used |= 1 << (room - size)
    return bins


def offsets_of(groups: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sum of ``sizes`` inside each group, before the row itself."""
    order = np.argsort(groups, kind="stable")
    ends = np.cumsum(sizes[order])
    before = ends - sizes[order]
    first = np.r_[True, groups[order][1:] != groups[order][:-1]]
    base = np.maximum.accumulate(np.where(first, before, 0))
    result = np.empty(len(sizes), np.int64)
    result[order] = before - base
    return result


def _final(bins: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    return np.bincount(bins, sizes)[bins] >= least


def _tokenizer(ranks_path: str, pattern: str, end_id: int, limit: int, least: int, tokens: bool):
    def pack_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        task, made = TaskContext.get().partitionId() << 32, 0
        rows: list[pa.Array] = []
        parts: list[tuple[int, int, int, int, int]] = []
        data: list[bytes] = []
        seen = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, rows, parts, data, seen
            doc, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*parts))
            bins = best_fit(length, limit)
            columns = [pa.concat_arrays(rows).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc),
                       pa.array(bins + (task + made)), pa.array(offsets_of(bins, length)), pa.array(~_final(bins, length, least))]
            names = [ROW, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
            if tokens:
                columns, names = [*columns, pa.array(data, pa.binary())], [*names, "tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)
            made += int(bins.max()) + 1
            rows, parts, data, seen = [], [], [], 0

        for batch in batches:
            texts = batch.column("text")
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py())
                ids.append(end_id)
                whole, count = memoryview(array("I", ids)).cast("B"), len(ids)
                at, size, piece = 0, count % limit or limit, 0
                while at < count:
                    own = whole[4 * at:4 * (at + size)]
                    parts.append((seen + i, piece, at, size, zlib.crc32(own)))
                    if tokens:
                        data.append(bytes(own))
                    at, size, piece = at + size, limit, piece + 1
            rows.append(batch.column(ROW))
            seen += batch.num_rows
            if len(parts) >= CHUNK_PIECES:
                yield from close()
        if parts:
            yield from close()

    return pack_local


def _merger(limit: int, least: int, depth: int):
    """Best fit of whole bins: the pieces of a bin stay together and move by the same distance."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.combine_chunks()
        number, size, inside = (table.column(c).to_numpy() for c in ("sequence_id", "length", "offset"))
        _, item = np.unique(number, return_inverse=True)
        fill = np.bincount(item, size).astype(np.int64)
        bins = best_fit(fill, limit)
        shift = offsets_of(bins, fill)
        own = (depth << 56) + (TaskContext.get().partitionId() << 32)
        still = ~_final(bins, fill, least)
        for name, values in (("sequence_id", bins[item] + own), ("offset", inside + shift[item]), ("open", still[item])):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        yield from table.to_batches()

    return merge


def pack(docs: DataFrame, ranks_path: str, end_id: int, limit: int = 1024, nearly_full: float = 0.998, text: str = "text",
         keep: Sequence[str] = ("doc_id",), pattern: str = PRE_TOKENS, tokens: bool = False) -> DataFrame:
    """One row per piece: ``keep``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, if asked, ``tokens`` (the ids as bytes).

    A null text counts as empty and still has its end id. A document over ``limit`` is cut into full pieces behind a shorter first one.
    Repeated rows are packed each by itself. Rounds of merging go on until one task has seen all open bins, or a round no longer saves
    one bin in a hundred; a task never holds more than about ``BINS_PER_TASK`` bins.
    """
    least = min(limit, int(np.ceil(limit * nearly_full)))
    source = bundled(docs, text, keep)
    kept = source.schema[ROW].dataType.simpleString()
    layout = f"{ROW} {kept}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean" + ", tokens binary" * tokens
    level = written(source.mapInArrow(lean(_tokenizer(ranks_path, pattern, end_id, limit, least, tokens)), layout), "pack-0")
    closed, depth, before = [level.where("not open")], 0, None
    while True:
        waiting = level.where("open")
        bins = waiting.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
        if not bins or (before is not None and bins > 0.99 * before):
            closed.append(waiting)
            break
        depth += 1
        tasks = -(-bins // BINS_PER_TASK)
        dealt = waiting.repartition(tasks, F.xxhash64("sequence_id", F.lit(depth)))
        level = written(dealt.mapInArrow(lean(_merger(limit, least, depth)), layout), f"pack-{depth}")
        if tasks == 1:
            closed.append(level)
            break
        closed.append(level.where("not open"))
        before = bins
    result = closed[0]
    for part in closed[1:]:
        result = result.unionByName(part)
    return spread(result, keep, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["tokens"] * tokens)
