from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from panelspark.llm import line_dedup, packing
from panelspark.llm.queries import tokenizer_path
from samples import mean_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def expected_lines(rows, least=10):
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    first = {}
    for i, r in zip(ids, rows):
        for line in (r[1] or "").split("\n"):
            key = line.strip(SPACES).translate(FOLD)
            first[key] = min(first.get(key, i), i)
    out = []
    for i, r in zip(ids, rows):
        lines = (r[1] or "").split("\n")
        keep = [line for line in lines if len(k := line.strip(SPACES).translate(FOLD)) < least or first[k] == i]
        out.append((r[0], len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_brute_force(docs_of):
    rows = mean_rows() + [(30 + i, "A LINE that many have  \nown line number %d of it\n a line THAT many have" % i) for i in range(60)]
    got = sorted(map(tuple, line_dedup.line_digest(docs_of(rows, 5)).collect()), key=str)
    assert got == expected_lines(rows)


def test_bitmaps_apply(docs_of):
    docs = docs_of(mean_rows())
    bitmaps = line_dedup.keep_bitmaps(docs)
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    digest = sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in kept.select("doc_id", "text").where("doc_id is not null").collect())
    assert digest == sorted((i, h) for i, _, _, h in expected_lines(mean_rows()) if i is not None)
    assert kept.where("doc_id in (6, 17)").where("text is not null").count() == 0


def test_stream_of_one_range_says_who_was_first():
    import pyarrow as pa

    h, d = [1, 1, 1, 2, 2, 3], [5, 5, 7, 4, 9, 8]
    cols = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(x[lo:hi], pa.int64()) for x in (h, h, d, d)] + [pa.array([0] * (hi - lo), pa.int32())], names=list("abcde"))
    for cuts in ([0, 6], [0, 2, 4, 6], [0, 1, 2, 3, 4, 5, 6]):
        events = [r for b in line_dedup.stream_range(cols(a, z) for a, z in zip(cuts, cuts[1:])) for r in b.to_pylist()]
        assert sorted(e[line_dedup.ID] for e in events if e["kind"] == line_dedup.DROP) == [9]
        assert sorted(e[line_dedup.ID] for e in events if e["kind"] == line_dedup.UNSETTLED) == [5, 5, 7]
        assert {(e["h1"], e[line_dedup.ID]) for e in events if e["kind"] == line_dedup.FIRST} == {(1, 5), (3, 8)}


def test_no_documents(docs_of):
    empty = docs_of([])
    assert line_dedup.line_digest(empty).count() == 0 and packing.packed_pieces(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("shard", [100_000, 12])
def test_packing(docs_of, shard):
    from tokenizers import Tokenizer

    rows = mean_rows() + [(100 + i, "word " * (20 + 11 * i)) for i in range(80)]
    capacity = 256
    got = packing.packed_pieces(docs_of(rows), tokenizer_path(), capacity, shard).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            want.append((doc, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(bins) <= least * 1.1 + 2


def test_sum_of_squares_choice():
    bins, offsets, gaps = packing.pack(np.array([6, 6, 4, 3]), 10)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 6, 6] and gaps.tolist() == [1, 0]


def test_chunks_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    encode, tokenizer = packing.chunk_encoder(tokenizer_path(), cache_size=50), Tokenizer.from_file(tokenizer_path())
    for text in [r[1] or "" for r in mean_rows()] + ["a\x1cb  c\xa0d e\x85f", "é ́x", "ΑΣ ΑΣ\nΣ's it's", "don't 'll x'", "İstanbul ÀÉ Ñandú straße", "<|endoftext|> y", "\x00 a\x0bb\tc"]:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
