from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import merkle
from samples import mean_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and each leaf's steps (place, run)."""
    steps = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for i, own in enumerate(owner):
            for j in own:
                steps[j].append((i % 16, runs[i // 16]))
        owner = [sum(owner[i:i + 16], []) for i in range(0, len(owner), 16)]
        nodes = [H("".join(run)) for run in runs]
    return nodes[0], steps


def expected(rows):
    """rows: (doc_id, text, lang, source)"""
    by = {}
    for doc_id, text, lang, source in rows:
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            changed = text.translate(LOWER)
        by.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, None, text), leaf(doc_id, source, lang, None, changed)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in by[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        subroot, steps = trees[s]
        for (doc_id, own, changed), walk in zip(by[s], steps):
            proof, folded = "", changed
            for at, run in walk + top:
                proof += "".join(run[:at] + run[at + 1:])
                folded = H("".join(run[:at] + [folded] + run[at + 1:]))
            out.append((doc_id, own, subroot, root, H(proof), folded, folded == root))
    return sorted(out, key=str)


def with_sources(rows):
    names = ["hot", "hot", "hot", None, "é", "", "Z", "a"]
    return [(r[0], r[1], "en" if i % 3 else None, names[i % len(names)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("bits", [merkle.SLICE_BITS, 3, 1])
def test_manifest_against_brute_force(docs_of, bits):
    rows = with_sources(mean_rows() + [(1000 + i, f"Text {i} A") for i in range(700)]) + [(7000 + i, "B", "en", "hot") for i in range(560)]
    assert sorted(map(tuple, merkle.merkle_digest(docs_of(rows, 5), bits).collect()), key=str) == expected(rows)


def test_many_sources_and_one_leaf_trees(docs_of):
    rows = [(i, f"T{i}", "en", f"s{i:03}") for i in range(300)]
    assert sorted(map(tuple, merkle.merkle_digest(docs_of(rows, 5), 4).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "s")], [(None, None, None, None)], [(5, "x", "en", "s")] * 40])
def test_small_tables(docs_of, rows):
    assert sorted(map(tuple, merkle.merkle_digest(docs_of(rows)).collect()), key=str) == (expected(rows) if rows else [])


def test_multiproof_is_least(docs_of):
    """What is missing of a level are the other children of the known nodes' parents, and nothing that known nodes give."""
    known = np.array([0, 5, 17, 300])
    got = {level: idx.tolist() for level, idx in merkle.missing_nodes(known, 310)}
    assert got[0] == [i for i in [*range(16), *range(16, 32), *range(288, 304)] if i not in known]
    assert got[1] == [i for i in range(20) if i not in (0, 1, 18)] and got[2] == []


def test_slices_fetch_a_bounded_number_of_nodes(docs_of):
    rows = [(i, f"T{i}", "en", "one") for i in range(5000)]
    forest = merkle.Forest(merkle.leaves(docs_of(rows)), ["doc_id"], 8)
    fetched = forest.multiproofs().groupBy("slice").count().agg(F.max("count")).first()[0]
    assert fetched <= 30 * 4 and forest.rows.select("slice").distinct().count() >= 20
