"""Benchmark decontamination by suffix arrays of the training texts.

Each slice of documents is a shard: its words become a suffix array, ordered by
doubling, and every suffix of every test item is searched in it by bisection, word by
word, until the range of matches is empty.  That gives the longest verbatim match of each
test suffix with its place, and every occurrence of the windows by which documents are
judged.  Documents never move: the test set goes to them in blocks of at most
``BLOCK_BYTES`` of text (one pass over the documents for each block), so what a task holds
is bounded by one shard and one block, and the result has no shuffle when one block does.

Words are lower-cased (A-Z) runs of ASCII letters, digits and anything beyond ASCII.  A
window is ``n`` consecutive words of an item; an item with fewer words is one window; an
item or document without words, null included, matches nothing.  Matches found by the
upper half of the words' hashes are confirmed on all 64 bits.  Ids of items count as text;
a null item id counts as the text ``null``, and an item repeated counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from panelspark.llm.rows import HASH, ID, keyed, keyed_whole
from panelspark.llm.textbytes import ALNUM, Slice, frames, ranges, slices, span_hash

BLOCK_BYTES = 1 << 23
SORTED_WORDS = 16


def word_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = part.words(ALNUM)
    return span_hash(part.prefix(fold=True), starts, ends), first


def suffix_array(tokens: np.ndarray, depth: int = SORTED_WORDS) -> np.ndarray:
    """Places of tokens (32-bit values) in the order of the ``depth`` tokens that begin there.

    Ranks double: what is still tied on k tokens is sorted by the rank of the place k further on.
    """
    n = len(tokens)
    padded = np.concatenate([tokens, np.zeros(1, np.uint64)])
    key = (padded[:-1] << np.uint64(32)) | padded[1:]
    order = np.argsort(key)
    span, key = 2, key[order]
    rank = np.zeros(n + depth + 1, np.int64)
    at = np.arange(n)
    while True:
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.maximum.accumulate(np.where(new, at, 0))
        rank[order] = heads + 1
        if span >= depth:
            return order
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            return order
        sub = order[tied]
        fine = (rank[sub] << 32) | rank[sub + span]
        by = np.argsort(fine)
        order[tied] = sub[by]
        key = heads + 1 << 32
        key[tied] = fine[by]
        span *= 2


def _bisect(array, tokens, lo, hi, depth, value, right: bool):
    """First place in [lo, hi) of the suffix array whose token ``depth`` words on is not below (or above) value."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        got = tokens[array[mid] + depth]
        below = got <= value[open_] if right else got < value[open_]
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)


class TestBlock:
    """Words of some test items, one item after another, and their windows."""

    def __init__(self, ids: list[str], texts: list[str | None], n: int):
        hashes, first, self.ids = [], [0], ids
        self.depth = max(SORTED_WORDS, n)  # words by which suffixes are ordered: windows have to be found in the order
        for part in slices(pa.array(texts, pa.string())):
            h, f = word_hashes(part)
            hashes.append(h)
            first += list(f[1:] + first[-1])
        first = np.array(first, np.int64)
        self.hashes = np.concatenate([*hashes, np.zeros(self.depth, np.uint64)])
        size = np.diff(first)
        self.item = np.repeat(np.arange(len(size)), size)
        self.left = np.repeat(first[1:], size) - np.arange(first[-1])  # words from here to the item's end
        self.start = np.arange(first[-1]) - np.repeat(first[:-1], size)
        length = np.minimum(size, n)
        self.window = np.where(self.left >= np.repeat(length, size), np.repeat(length, size), 0)  # 0: no window starts here


def search(part: Slice, test: TestBlock):
    """Of one shard: hashes and first word of each text, longest match and its place for each test suffix, and the
    occurrences of windows as (place, test suffix)."""
    words, first = word_hashes(part)
    n = len(words)
    # A zero after each text, so that no match runs over its end.
    place = np.arange(n) + np.repeat(np.arange(len(part)), np.diff(first))
    full = np.zeros(n + len(part) + test.depth + 1, np.uint64)
    full[place] = words | np.uint64(1 << 32)
    tokens = full >> np.uint64(32)
    array = suffix_array(tokens[:n + len(part)], test.depth)
    suffixes = len(test.item)
    longest, where = np.zeros(suffixes, np.int64), np.full(suffixes, -1, np.int64)
    alive = np.arange(suffixes)
    lo, hi = np.zeros(suffixes, np.int64), np.full(suffixes, len(array), np.int64)
    places, tests = [], []
    wanted = (test.hashes | np.uint64(1 << 32)) >> np.uint64(32)
    for depth in range(test.depth):
        more = test.left[alive] > depth
        alive, lo, hi = alive[more], lo[more], hi[more]
        value = wanted[alive + depth]
        lo, hi = _bisect(array, tokens, lo, hi, depth, value, False), _bisect(array, tokens, lo, hi, depth, value, True)
        keep = lo < hi
        alive, lo, hi = alive[keep], lo[keep], hi[keep]
        if not len(alive):
            break
        longest[alive], where[alive] = depth + 1, array[lo]
        full_window = test.window[alive] == depth + 1
        if full_window.any():
            count = (hi - lo)[full_window]
            got = array[np.repeat(lo[full_window], count) + ranges(count)]
            of = np.repeat(alive[full_window], count)
            same = np.ones(len(got), bool)
            for k in range(depth + 1):
                same &= full[got + k] == (test.hashes[of + k] | np.uint64(1 << 32))
            places.append(got[same])
            tests.append(of[same])
    for s, a, b in zip(alive, lo, hi):  # matches longer than the array's order: the few that are left are walked
        for p in array[a:b]:
            k = test.depth
            while k < test.left[s] and tokens[p + k] == wanted[s + k]:
                k += 1
            if k > longest[s]:
                longest[s], where[s] = k, p
    none = np.zeros(0, np.int64)
    occurrences = (np.concatenate([none, *places]), np.concatenate([none, *tests]))
    return first, longest, where, occurrences


_FOUND = f"doc_id BIGINT, {ID} BIGINT, {HASH} BIGINT, n_words BIGINT, spans ARRAY<STRUCT<a: INT, b: INT>>, items ARRAY<STRING>"


def find(batches, test: TestBlock, all_rows: bool) -> Iterator[pa.RecordBatch]:
    """Per row: number of words, spans of words that windows occupy, and the items those windows come from."""
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for rows, part in frames(batches):
        first, _, _, (places, tests) = search(part, test)
        zeros = first[:-1] + np.arange(len(part))  # where each text begins among words and end marks
        doc = np.searchsorted(zeros, places, "right") - 1
        # Empty texts share no place with others: each has its own end mark.
        spans, items = [None] * len(part), [None] * len(part)
        for d in np.unique(doc):
            mine = doc == d
            a = places[mine] - zeros[d]
            pairs = sorted(set(zip(a.tolist(), (a + test.window[tests[mine]]).tolist())))
            spans[d] = [{"a": x, "b": y} for x, y in merged(pairs)]
            items[d] = sorted({test.ids[i] for i in test.item[tests[mine]]})
        keep = np.flatnonzero([all_rows or s is not None for s in spans])
        if len(keep):
            columns = [rows.column(i).take(pa.array(keep)) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(first)[keep]), pa.array([spans[k] for k in keep], span_type),
                 pa.array([items[k] for k in keep], pa.list_(pa.string()))],
                names=["doc_id", ID, HASH, "n_words", "spans", "items"])


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[TestBlock]:
    """The test set, at most about ``block_bytes`` of text at a time; every item is in one block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # one block
        yield TestBlock([r[0] for r in rows], [r[1] for r in rows], n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, the pair that names the row, n_words, spans (words hit, ends exclusive) and items of every row of docs."""
    found = []
    source = keyed(docs).select("doc_id", ID, HASH, "text")
    for i, block in enumerate(test_blocks(benchmark, n, block_bytes)):
        found.append(source.mapInArrow(lambda batches, t=block, every=not i: find(batches, t, every), _FOUND))
    if len(found) == 1:
        return found[0]
    more = found[1]
    for other in found[2:]:
        more = more.unionByName(other)
    more = more.groupBy(ID, HASH).agg(F.flatten(F.collect_set("spans")).alias("more_spans"),
                                      F.flatten(F.collect_set("items")).alias("more_items"))
    none_s, none_i = F.expr("cast(array() as array<struct<a:int,b:int>>)"), F.expr("cast(array() as array<string>)")
    spans = F.concat(F.coalesce("spans", none_s), F.coalesce("more_spans", none_s))
    items = F.array_distinct(F.concat(F.coalesce("items", none_i), F.coalesce("more_items", none_i)))
    return found[0].join(more, [ID, HASH], "left").select("doc_id", ID, HASH, "n_words", spans.alias("spans"), items.alias("items"))


@F.udf(LongType())
def _covered(spans):
    return sum(b - a for a, b in merged(sorted((s["a"], s["b"]) for s in spans or [])))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return (contamination(docs, benchmark, n, block_bytes).withColumn("n_hit", _covered("spans"))
            .select("doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs without the documents in which a window of the benchmark occurs; columns as they are."""
    hit = contamination(docs, benchmark, n).where(F.size("spans") > 0).select(ID, HASH).distinct()
    return keyed_whole(docs).join(hit, [ID, HASH], "left_anti").select(docs.columns)


_MATCH = f"item_id STRING, start INT, length INT, {ID} BIGINT, doc_word INT"


def longest_matches(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each suffix of a test item that matches a word or more: its longest verbatim match and one place of it.

    item_id, start (word of the item), length (words), doc_id (null ids as the smallest), doc_word.  Of matches of one
    length the smallest document's is given, and its first place among the shard's first match."""
    def scan(batches, test):
        for rows, part in frames(batches):
            first, longest, where, _ = search(part, test)
            zeros = first[:-1] + np.arange(len(part))
            s = np.flatnonzero(longest)
            doc = np.searchsorted(zeros, where[s], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([test.ids[i] for i in test.item[s]], pa.string()), pa.array(test.start[s].astype(np.int32)),
                 pa.array(longest[s].astype(np.int32)), rows.column(1).take(pa.array(doc)), pa.array((where[s] - zeros[doc]).astype(np.int32))],
                names=["item_id", "start", "length", ID, "doc_word"])

    source = keyed(docs).select("doc_id", ID, HASH, "text")
    parts = [source.mapInArrow(lambda b, t=block: scan(b, t), _MATCH) for block in test_blocks(benchmark, n, block_bytes)]
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col(ID).alias("doc"), F.col("doc_word").alias("w"))).alias("best")
    return (every.groupBy("item_id", "start").agg(best)
            .select("item_id", "start", (-F.col("best.l")).alias("length"), F.col("best.doc").alias("doc_id"), F.col("best.w").alias("doc_word")))
