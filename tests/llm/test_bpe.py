from __future__ import annotations

import hashlib

import numpy as np
import pytest
import tiktoken

from panelspark.llm import byte_bpe
from panelspark.llm.queries import QUERIES, bpe_files
from samples import mean_rows

SF = "/root/testdata/sf0.001"
PATH, PATTERN = bpe_files()
AWKWARD = ["a  b", " a", "a ", "\na", "a\n", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "don't 's 'S x'll", "a\tb c\xa0d", "x\x1cy z", "  ", "\n", "a\r\nb", "漢字 12三 ½²",
           "<|endoftext|>", "é" * 40, "!?  !?", "a b c", "\x00 \x00"]


def expected(text):
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    return encoding.encode_ordinary(text or "")


def digests(rows):
    out = []
    for row in rows:
        ids = expected(row[1])
        out.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,words", [(1 << 24, 400_000), (500, 7)])
def test_ids_and_texts_against_the_library(docs_of, block, words):
    rows = mean_rows() + [(100 + i, t) for i, t in enumerate(AWKWARD)]
    got = byte_bpe.bpe_digest(docs_of(rows, 4), PATH, PATTERN, block, words).collect()
    assert sorted(map(tuple, got), key=str) == digests(rows)


def test_pre_tokens_are_those_of_the_pattern():
    import regex

    tokens = byte_bpe.PreTokens(PATTERN)
    for text in [r[1] or "" for r in mean_rows()] + AWKWARD + [""]:
        words = list(tokens.words)
        numbers = tokens.numbers(text)
        words = list(tokens.words)
        assert [words[i] for i in numbers] == regex.findall(PATTERN, text)


def test_texts_come_back(docs_of):
    rows = mean_rows()
    docs = docs_of(rows)
    back = byte_bpe.decoded(byte_bpe.encoded(docs, PATH, PATTERN), PATH).collect()
    assert sorted((r.doc_id, bytes(r.text).decode()) for r in back if r.doc_id is not None) == sorted((i, t or "") for i, t, *_ in rows if i is not None)


def test_no_documents_and_only_empty_ones(docs_of):
    assert byte_bpe.bpe_digest(docs_of([]), PATH, PATTERN).count() == 0
    assert sorted(map(tuple, byte_bpe.bpe_digest(docs_of([(1, None), (2, "")]), PATH, PATTERN).collect())) == digests([(1, None), (2, "")])


def test_an_unknown_id_is_an_error(spark, docs_of):
    docs_of([])
    ids = spark.createDataFrame([(1, np.array([5, 4_000_000], "<u4").tobytes())], "doc_id BIGINT, ids BINARY")
    with pytest.raises(Exception, match="no token 4000000"):
        byte_bpe.decoded(ids, PATH).collect()


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, QUERIES["op13_byte_bpe"](spark, SF).collect()), key=str) == digests([(r.doc_id, r.text) for r in docs])
