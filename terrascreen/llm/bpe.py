"""Byte-level BPE over a shuffled dictionary of distinct words.

Tasks cut whole texts into pre-tokens and keep, per block of documents, the distinct words and each
document's word positions. The words are shuffled by hash; one place encodes each distinct word once.
The ids go back to the blocks, which put every document together again by position.
"""

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.shared import ROW, bundled, lean, spread, written

BLOCK_CHARS = 40_000_000
GROUP_WORDS = 262_144
#: Compression of what is shuffled: it is written twice and read twice, so it is worth some time.
LEVEL = 12
HEADER, DOCUMENTS = -1, 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte plane, compressed; small numbers leave empty planes."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def joined(head: bytes, body: bytes) -> bytes:
    return len(head).to_bytes(4, "little") + head + body


def split(packed: bytes) -> tuple[bytes, bytes]:
    cut = 4 + int.from_bytes(packed[:4], "little")
    return packed[4:cut], packed[cut:]


def pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return joined(squeeze(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(words)))


def unpack_words(packed: bytes) -> list[bytes]:
    import zstandard

    sizes, data = split(packed)
    ends = np.cumsum(unsqueeze(sizes).astype(np.int64)).tolist()
    data = zstandard.ZstdDecompressor().decompress(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def gather(starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated pieces ``flat[starts[c]:starts[c] + sizes[c]]`` for ``chosen``, and the size of each."""
    count = sizes[chosen]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts[chosen] - (ends - count), count)
    return flat[index], count


def _cutter(pattern: str, buckets: int, block_chars: int, kept: pa.DataType):
    """Documents to a header, word rows and rows of document groups per block. In a block, frequent words have the small numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task, number = TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        rows, positions, chars = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, words, rows, positions, chars
            lengths = np.fromiter(map(len, positions), np.uint32, len(positions))
            spots, positions = np.concatenate(positions), []
            by_use = np.argsort(-np.bincount(spots, minlength=len(words)), kind="stable")
            rank = np.empty(len(by_use), np.uint32)
            rank[by_use] = np.arange(len(by_use))
            spots = rank[spots]
            listed, words = np.fromiter((w.encode() for w in words), object, len(words)), {}
            coded = listed[by_use]
            bucket = np.fromiter((zlib.crc32(w) for w in coded), np.uint32, len(coded)) % buckets
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            steps, payloads = [HEADER], [squeeze(bucket)]
            for b in range(buckets):
                if bounds[b] < bounds[b + 1]:
                    steps.append(b)
                    payloads.append(pack_words(coded[order[bounds[b]:bounds[b + 1]]].tolist()))
            ends = np.cumsum(lengths, dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP_WORDS)) + 1).tolist(), len(ends)]
            for first, last in zip(cuts, cuts[1:]):
                steps.append(DOCUMENTS)
                payloads.append(joined(squeeze(lengths[first:last]), squeeze(spots[ends[first] - lengths[first]:ends[last - 1]])))
            groups = [[None]] * (len(steps) - len(cuts) + 1)
            offsets = pa.array([*[None] * len(groups), *cuts], pa.int32())
            block = pa.array(np.full(len(steps), task * (1 << 32) + number, np.int64))
            held = pa.ListArray.from_arrays(offsets, pa.concat_arrays(rows).cast(kept))
            yield pa.RecordBatch.from_arrays([block, pa.array(steps, pa.int32()), pa.array(payloads, pa.binary()), held], ["block", "step", "payload", "rows"])
            number, rows, chars = number + 1, [], 0

        for batch in batches:
            texts, start = batch.column("text"), 0
            for i in range(batch.num_rows):
                found = find(text := texts[i].as_py())
                put = words.setdefault
                positions.append(np.fromiter([put(w, len(words)) for w in found], np.uint32, len(found)))
                chars += len(text)
                if chars >= block_chars:
                    rows.append(batch.column(ROW).slice(start, i + 1 - start))
                    start = i + 1
                    yield from close()
            rows.append(batch.column(ROW).slice(start))
        if positions:
            yield from close()

    return cut


def _encoder(ranks_path: str):
    """Word rows to rows of their ids; a word met again, in whatever block, is not encoded again."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        encode = encoding.encode_ordinary
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            out = []
            for step, payload in zip(batch.column("step").to_pylist(), batch.column("payload").to_pylist()):
                if step != bucket:
                    bucket, known = step, {}
                lists = []
                for word in unpack_words(payload):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word.decode())
                    lists.append(ids)
                sizes = np.fromiter(map(len, lists), np.uint32, len(lists))
                flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum()))
                out.append(joined(squeeze(sizes), squeeze(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("step"), pa.array(out, pa.binary()), batch.column("rows")], ["block", "step", "payload", "rows"])

    return answer


def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as start and size of each token in one run of bytes."""
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(table), np.uint8)


def _assembler(ranks_path: str | None):
    """Rows of a block, header first, ids next, documents last: one list of ids per document, and its bytes if ranks are given."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path) if ranks_path else None
        starts = sizes = flat = order = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            payloads, rows = batch.column("payload"), batch.column("rows")
            for i, step in enumerate(batch.column("step").to_pylist()):
                payload = payloads[i].as_py()
                if step == HEADER:
                    order, parts, flat = np.argsort(unsqueeze(payload), kind="stable"), [], None
                    continue
                head, body = map(unsqueeze, split(payload))
                if step < DOCUMENTS:
                    parts.append((head, body))
                    continue
                if flat is None:
                    lengths = np.concatenate([p[0] for p in parts] or [np.empty(0, np.uint32)]).astype(np.int64)
                    flat = np.concatenate([p[1] for p in parts] or [np.empty(0, np.uint32)]).astype(np.int32)
                    starts, sizes = np.empty_like(lengths), np.empty_like(lengths)
                    starts[order], sizes[order] = np.cumsum(lengths) - lengths, lengths
                    parts = []
                ids, count = gather(starts, sizes, body, flat)
                ends = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(head, dtype=np.int64)]]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                columns = {ROW: rows[i].values, "ids": lists}
                if table:
                    data, size = gather(table[0], table[1], ids, table[2])
                    places = np.r_[0, np.cumsum(size)][ends].astype(np.int32)
                    columns["decoded"] = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(places), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return put_together


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
           buckets: int | None = None, block_chars: int = BLOCK_CHARS, decoded: bool = False) -> DataFrame:
    """``keep`` and ``ids`` (array of int) of every document; with ``decoded`` also the bytes that the ids stand for.

    A null text counts as empty; an empty text has an empty list. Repeated rows each get a row. ``buckets`` cuts the dictionary (by default
    the shuffle partitions); a block holds about ``block_chars`` characters, or one longer document.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = bundled(docs, text, keep)
    kept = source.schema[ROW].dataType
    layout = f"block long, step int, payload binary, rows array<{kept.simpleString()}>"
    blocks = written(source.mapInArrow(lean(_cutter(pattern, buckets, block_chars, to_arrow_type(kept))), layout), "bpe-blocks")
    is_word = (F.col("step") >= 0) & (F.col("step") < DOCUMENTS)
    words = blocks.where(is_word).repartition(buckets, "step").sortWithinPartitions("step")
    replies = words.mapInArrow(lean(_encoder(ranks_path)), layout)
    both = blocks.where(~is_word).unionByName(replies).repartition(buckets, "block").sortWithinPartitions("block", "step")
    own = ("ids", "decoded") if decoded else ("ids",)
    result = both.mapInArrow(lean(_assembler(ranks_path if decoded else None)), f"{ROW} {kept.simpleString()}, ids array<int>" + ", decoded binary" * decoded)
    return spread(result, keep, *own)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the bytes of each list of ids, looked up in the token-byte table (50,000 rows, a vocabulary's fixed size). A null list stays null."""

    @F.arrow_udf("binary")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        starts, sizes, flat = token_bytes(ranks_path)
        for lists in batches:
            numbers, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            yield pa.array([None if not there else gather(starts, sizes, numbers[a:b], flat)[0].tobytes()
                            for there, a, b in zip(lists.is_valid().to_pylist(), ends, ends[1:])], pa.binary())

    return encoded.withColumn(name, look_up(F.col(ids)))
