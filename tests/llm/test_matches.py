from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import decontaminate, ngram_join, suffix_dedup
from samples import mean_rows, prose

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return ALNUM.findall((text or "").translate(FOLD))


def items():
    rows = dict((r[0], r[1]) for r in mean_rows() if r[1])
    long = words(rows[2])
    return [(1, " ".join(long[20:45])), (2, "one two"), (3, None), (4, "..."), (5, " ".join(words(rows[12])[1000:1060])), (6, "not there at all but ten words or more it has in"),
            (10, " ".join(long[30:60])), (None, " ".join(words(rows[1])[:10])), (2, "one two")]


def expected_contamination(rows, tests, n=10):
    windows = defaultdict(set)
    for i, text in tests:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k:k + size])].add("null" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k:k + size])):
                    found |= got
                    hit |= set(range(k, k + size))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 23, 150])
def test_contamination_against_brute_force(spark, docs_of, block_bytes):
    rows = mean_rows()
    tests = spark.createDataFrame(items(), "item_id BIGINT, text STRING")
    got = sorted(map(tuple, decontaminate.contamination_digest(docs_of(rows), tests, block_bytes=block_bytes).collect()), key=str)
    assert got == expected_contamination(rows, items())


@pytest.mark.parametrize("n", [16, 17, 20, 40])
def test_windows_longer_than_the_order_of_suffixes(spark, docs_of, n):
    rows = mean_rows()
    tests = spark.createDataFrame(items(), "item_id BIGINT, text STRING")
    want = expected_contamination(rows, items(), n)
    assert sorted(map(tuple, decontaminate.contamination_digest(docs_of(rows), tests, n).collect()), key=str) == want
    assert any(hit >= n for _, _, hit, *_ in want)


def test_contaminated_documents_go(spark, docs_of):
    docs, tests = docs_of(mean_rows()), spark.createDataFrame(items(), "item_id BIGINT, text STRING")
    left = decontaminate.decontaminated(docs, tests)
    clean = [i for i, *_, bad in expected_contamination(mean_rows(), items()) if not bad]
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted(clean, key=str)
    assert decontaminate.decontaminated(docs, tests.limit(0)).count() == docs.count()
    assert decontaminate.contamination_digest(docs.limit(0), tests).count() == 0


def test_longest_matches(spark, docs_of):
    rows, tests = mean_rows(), [(1, " ".join(words(mean_rows()[1][1])[20:60]) + " zzz")]
    got = {(r.start): (r.length, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(docs_of(rows), spark.createDataFrame(tests, "item_id BIGINT, text STRING")).collect()}
    assert got[0][0] == 40 and got[5][0] == 35
    for start, (length, doc, at) in got.items():
        own = words(tests[0][1])[start:start + length]
        texts = [t for i, t in rows if (-(2**63) if i is None else i) == doc]
        assert any(words(t)[at:at + length] == own for t in texts)


def test_suffix_array_orders_by_tokens():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 4, 400).astype(np.uint64)
    order = decontaminate.suffix_array(t, 16)
    keys = [tuple(t[p:p + 16]) for p in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))


def expected_cuts(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s:s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,bucket", [(400, 12_000), (400, 9), (60, 25)])
def test_repeats_against_brute_force(docs_of, length, bucket):
    passage = prose(77, 100)
    rows = mean_rows() + [(100 + i, prose(200 + i, 5 + i) + passage[i % 7 * 20:] + prose(300 + i, 30)) for i in range(40)]
    got = sorted(map(tuple, suffix_dedup.repeat_digest(docs_of(rows, 6), length, bucket).collect()), key=str)
    assert got == expected_cuts(rows, length)


def test_repeats_of_nothing_and_whole_texts(docs_of):
    assert suffix_dedup.repeat_digest(docs_of([])).count() == 0
    docs = docs_of([(1, prose(1, 200)), (2, prose(1, 200)), (3, "short")])
    left = {r.doc_id: r.text for r in suffix_dedup.deduplicated(docs).collect()}
    assert left == {1: "", 2: "", 3: "short"}


def test_rows_that_repeat_are_met_once(docs_of):
    """A hundred equal rows: they lose everything, and the work is one row's."""
    rows = [(None, prose(31, 300))] * 100 + [(i, prose(40 + i, 120)) for i in range(5)] + [(9, "short")] * 4
    docs = docs_of(rows, 5)
    got = [tuple(r) for r in suffix_dedup.repeat_digest(docs, 400, 50).collect()]
    assert len(got) == len(rows)
    for doc, n_bytes, removed, spans, _ in got:
        assert (removed, spans) == ((n_bytes, 1) if doc is None else (0, 0)), doc
    _, touched = suffix_dedup.repeated_spans(docs, 400, 50)
    assert touched.count() == 1 and len(touched.first().runs) < 60


def test_passages_of_over_fifty_words_are_named_though_they_keep_their_bytes(docs_of):
    short = [f"w{i % 97}x{i // 97}" for i in range(51)]
    assert len(" ".join(short)) < 400
    rows = [(1, prose(1, 80) + " " + " ".join(short) + " " + prose(2, 30)), (2, "\n".join(short)), (3, prose(3, 90) + " " + " ".join(short[:29])),
            (4, prose(4, 200)), (5, prose(5, 45)), (5, prose(5, 45)), (6, None), (7, " \t"),
            (8, prose(6, 60) + " " + " ".join(short[-29:])), (8, prose(7, 60)), (9, prose(8, 70)), (9, prose(8, 70)), (None, " ".join(short) + " " + prose(9, 5))]
    got = suffix_dedup.repeat_digest(docs_of(rows, 5), passages=True).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes) for r in got if r.shares_passage} == {(d, len(t.encode())) for d, t in rows if d in (1, 2, 9, None)}
    assert all(r.n_removed == 0 for r in got if r.doc_id in (1, 2, None))


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_brute_force(docs_of, seed):
    rng = np.random.default_rng(seed)
    pool = prose(500 + seed, 400).split()
    rows = []
    for i in range(60):  # runs of 20 to 70 words of one pool among words of their own
        at, n = int(rng.integers(0, 330)), int(rng.integers(20, 71))
        rows.append((i, " ".join([f"a{i}n{k}" for k in range(int(rng.integers(0, 60)))] + pool[at:at + n] + [f"z{i}n{k}" for k in range(20)])))

    def sharing(n):
        seen = {}
        for i, text in rows:
            w = text.split()
            for k in range(len(w) - n + 1):
                seen.setdefault(tuple(w[k:k + n]), set()).add(i)
        return {i for s in seen.values() if len(s) > 1 for i in s}

    got = {r.doc_id for r in suffix_dedup.repeat_digest(docs_of(rows, 4), passages=True).collect() if r.shares_passage}
    assert sharing(51) <= got <= sharing(suffix_dedup.PRINT) and sharing(51)


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    m = rng.integers(0, 3, (3000, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(m)
    rows = [tuple(r) for r in m[order]]
    assert rows == sorted(rows) and sorted(order) == list(range(3000))


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return tuple(w), frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def expected_classes(rows):
    low = lambda i: -(2**63) if i is None else i
    rep, sets = {}, {}
    for i, t in rows:
        w, own = shingles(t)
        rep[w], sets[w] = min(rep.get(w, low(i)), low(i)), own
    root = {w: w for w in rep}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links, texts = Counter(), [w for w in rep if w]
    for k, x in enumerate(texts):
        for y in texts[k + 1:]:
            if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8:
                links[x] += 1
                links[y] += 1
                a, b = top(x), top(y)
                root[max(a, b, key=rep.get)] = min(a, b, key=rep.get)
    out = []
    for i, t in rows:
        w = shingles(t)[0]
        label, own = (rep[top(w)], rep[w]) if w else (low(i), low(i))
        out.append((i, *(None if v == -(2**63) else v for v in (label, own)), links[w]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_docs", [1500, 7])
def test_classes_against_brute_force(docs_of, block_docs):
    base = prose(50, 120).split(" ")
    near = []
    for i in range(45):  # each differs from the first in a word or two of its own
        w = list(base)
        w[(7 * i) % 100] = f"own{i}"
        if i % 3 == 0:
            w[(11 * i) % 90 + 5] = f"more{i}"
        near.append((200 + i, " ".join(w)))
    rows = mean_rows() + near
    got = ngram_join.class_digest(docs_of(rows, 4), block_docs=block_docs).select("doc_id", "class_id", "copy_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == expected_classes(rows)
    assert max(r.n_links for r in got) > 10


def test_pairs_one_of_each_and_nothing(docs_of):
    rows = [(1, prose(1, 100)), (2, prose(1, 100)), (3, prose(1, 100) + " end"), (4, prose(2, 100)), (5, None), (6, "")]
    docs = docs_of(rows)
    assert [tuple(r) for r in ngram_join.linked_pairs(docs).collect()] == [(1, 3)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    assert ngram_join.class_digest(docs_of([])).count() == 0


def test_pruning_keeps_what_could_reach_the_threshold():
    least = ngram_join.least_agreement(0.8, 1e-6)
    assert (np.diff(least) > 0).all() and least[-1] < 0.8 * 128
    rng = np.random.default_rng(0)
    agreed = rng.random((20_000, 128)) < 0.8
    sums = agreed.cumsum(axis=1)[:, 15::16]
    assert (sums < least).any(axis=1).mean() < 1e-3
