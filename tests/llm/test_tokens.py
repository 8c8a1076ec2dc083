"""Byte-level BPE and packing against the tokenizer libraries."""

import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from terrascreen.llm import bpe, packing
from tests.llm.cases import AWKWARD, SCHEMA, rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACK_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_id(df, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in columns]) for r in df.collect()), key=str)


def test_ids_equal_those_of_the_library_and_decode_to_the_text(awkward):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    found = bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, buckets=3, block_chars=50), RANKS)
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in found.collect())
    assert got == sorted((str(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in AWKWARD)
    together = bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, buckets=3, block_chars=50, decoded=True)
    assert got == sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in together.collect())


def test_blocks_do_not_change_the_ids(awkward):
    one = bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, buckets=1)
    many = bpe.encode(awkward.repartition(4), RANKS, public_tokenizers.PATTERN, buckets=7, block_chars=1)
    assert by_id(one, "ids") == by_id(many, "ids")


def test_own_columns_win_and_kept_ones_survive(awkward, nothing):
    kept = bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, keep=["doc_id", "row", "payload"])
    assert kept.columns == ["doc_id", "row", "payload", "ids"] and {r.payload for r in kept.collect()} == {"p"}
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(found, documents, limit):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    whole = sorted((str(i), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in documents)
    per_sequence, per_document = {}, {}
    for r in found:
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_document.setdefault(str(r.doc_id), []).append(r)
    for places in per_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    for name in {n for n, _ in whole}:
        wanted = sorted(c for n, ids in whole if n == name for c in pieces_of(ids, limit))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in per_document[name]) == wanted
    return len(per_sequence)


def pieces_of(ids, limit):
    size, at, number = len(ids) % limit or limit, 0, 0
    while at < len(ids):
        yield number, at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes())
        at, size, number = at + size, limit, number + 1


def test_pieces_and_places(awkward, nothing):
    assert check_packing(packing.pack(awkward, PACK_RANKS, 2, 64).collect(), AWKWARD, 64)
    assert packing.pack(nothing, PACK_RANKS, 2).count() == 0


def test_rounds_of_merging_come_close_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_PER_TASK", 40)
    documents = [(i, "word " * (i * 37 % 90)) for i in range(600)]
    df = spark.createDataFrame(rows(*documents), SCHEMA).repartition(24)
    found = packing.pack(df, PACK_RANKS, 2, 128).collect()
    used = check_packing(found, documents, 128)
    assert used <= 1.05 * sum(r.length for r in found) / 128 + 1


def test_items_that_cannot_share_a_bin_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "BINS_PER_TASK", 5)
    documents = [(i, "word " * 80) for i in range(40)]
    found = packing.pack(spark.createDataFrame(rows(*documents), SCHEMA), PACK_RANKS, 2, 128).collect()
    assert check_packing(found, documents, 128) == 40


def test_tokens_are_the_ids(awkward):
    for r in packing.pack(awkward, PACK_RANKS, 2, 64, tokens=True).collect():
        assert len(r.tokens) == 4 * r.length and zlib.crc32(r.tokens) == r.ids_crc32
