"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Only sampled suffixes are sorted.  In each window of ``length`` bytes the substring of ``GRAM``
bytes with the smallest hash is its anchor (the last one of equals), so equal windows have equal
anchors at equal distances, and every repeated string is found from its anchor: one suffix for about
125 bytes.  Anchors whose substring occurs once are dropped by a count.  The others carry the bytes
of the windows they stand for; sampled splitters range-partition them by their suffixes' leading
bytes (then by the substring and the place, so that equal suffixes may be split); each bucket sorts its suffixes by multikey
quicksort, neighbours that share the whole substring form a class, and windows are compared inside
classes.  The first and last class of a bucket may go on in the next one: their distinct windows,
one row each however many suffixes hold them, are compared across all boundaries in a second
exchange.  So neither a passage nor a group of copies with a third of all suffixes meets in one task.

Texts are UTF-8 bytes; strings never cross documents.  Defined results: null counts as empty; texts
shorter than ``length`` lose nothing; rows that repeat are documents of their own, so all their
windows repeat: they are met once, and lose all their bytes.  Windows are told apart by 64-bit hashes inside buckets.

A passage of more than 50 words can be shorter than ``length`` and then keeps its bytes.  :func:`passage_rows` names the rows
that share one with another row, by winnowing on words: of every 51 consecutive words the run of ``PRINT`` words with the
smallest hash is a fingerprint.  Rows that share 51 words share a fingerprint, rows that share fewer than ``PRINT`` share none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import HASH, ID, keyed, keyed_whole, parts
from panelspark.llm.textbytes import Slice, frames, give_back, powers, ranges, span_hash
from panelspark.scratch import materialise, release

GRAM = 150
BUCKET_SUFFIXES = 12_000
#: Bytes of a suffix by which ranges are split; then its substring's hash, so that a class stays together, then its place.
LEADING = 16
SECTION = 1 << 21
#: Ranges for each shuffle partition, suffixes that make it worth a range, suffixes sampled for each range, and the share of all
#: anchors (one in so many) that makes a substring hot.
RANGES_PER_PART, LEAST_RANGE, SAMPLE_PER_RANGE, HOT_SHARE = 4, 2000, 300, 1000
_PLACE_BITS = np.uint64(24)
#: Words of a passage, and of its fingerprint.
PASSAGE, PRINT = 51, 30


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def anchors(part: Slice, length: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, first and last window start of each run of windows with one anchor (places in the text), and the
    hash of the anchor's substring."""
    gram = min(GRAM, length)
    w = length - gram + 1
    n = len(part.data) - length + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(part.offsets)
    long = np.flatnonzero(sizes >= length)
    if n <= 0 or not len(long):
        return none, none, none, none, none
    prefix = part.prefix(fold=False)
    at = np.arange(len(part.data) - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    anchor = np.empty(n, np.int64)
    for s in range(0, n, SECTION):
        e = min(n, s + SECTION)
        local = hashes[s:e + w - 1]
        last = np.uint64(len(local)) - np.arange(len(local), dtype=np.uint64)  # the later of equals is the smaller
        key = ((local >> _PLACE_BITS) << _PLACE_BITS) | last
        anchor[s:e] = s + len(local) - (sliding_min(key, w) & np.uint64((1 << 24) - 1)).astype(np.int64)
    count = sizes[long] - length + 1
    starts = np.repeat(part.offsets[long], count) + ranges(count)
    doc = np.repeat(long, count)
    chosen = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    doc, base = doc[head], part.offsets[doc[head]]
    return doc, chosen[head] - base, starts[head] - base, starts[tail] - base, hashes[chosen[head]].view(np.int64)


_ANCHOR = f"{ID} BIGINT, {HASH} BIGINT, gram BIGINT, place INT, low INT, high INT"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def scan(batches) -> Iterator[pa.RecordBatch]:
        for rows, part in frames(batches):
            doc, place, low, high, gram = anchors(part, length)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(take), rows.column(1).take(take), pa.array(gram), *(pa.array(x.astype(np.int32)) for x in (place, low, high))],
                names=[ID, HASH, "gram", "place", "low", "high"])

    return keyed(docs).select(ID, HASH, "text").mapInArrow(scan, _ANCHOR)


def packed_texts(docs: DataFrame) -> DataFrame:
    """The texts compressed, for exchanges."""
    def scan(batches) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for rows, part in frames(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([press.compress(part.text(i)) for i in range(len(part))], pa.binary())],
                                             names=[ID, HASH, "packed"])

    return keyed(docs).select(ID, HASH, "text").mapInArrow(scan, f"{ID} BIGINT, {HASH} BIGINT, packed BINARY")


_SUFFIX = f"range INT, {ID} BIGINT, {HASH} BIGINT, low INT, lead INT, bytes BINARY, gram BIGINT"
_FLIP = 1 << 63


def suffix_keys(text: bytes, doc: int, hash_: int, runs: list[dict]) -> list[bytes]:
    """What orders suffixes: leading bytes, substring, place; as bytes that compare alike."""
    tail = (doc + _FLIP).to_bytes(8, "big") + (hash_ + _FLIP).to_bytes(8, "big")
    return [text[r["place"]:r["place"] + LEADING] + (r["gram"] + _FLIP).to_bytes(8, "big") + tail + r["low"].to_bytes(4, "big") for r in runs]


def sampled_keys(batches) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for d, h, z, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield pa.RecordBatch.from_arrays([pa.array(suffix_keys(unpress.decompress(z), d, h, runs), pa.binary())], names=["key"])
    give_back()


def splitters(touched: DataFrame, n: int, ranges_: int) -> list[bytes]:
    """Keys that deal the suffixes into ranges of about one size, from texts chosen by hash: so many for each range."""
    share = max(1, n // (ranges_ * SAMPLE_PER_RANGE))
    sample = touched.where(F.pmod(F.xxhash64(F.lit(5), ID, HASH), F.lit(share)) == 0).mapInArrow(sampled_keys, "key BINARY")
    keys = sorted(bytes(r.key) for r in sample.sort(F.xxhash64("key")).limit(4 * ranges_ * SAMPLE_PER_RANGE).collect())
    return [keys[len(keys) * i // ranges_] for i in range(1, ranges_)] if keys else []


def suffix_rows(batches, length: int, cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """For each anchor its range and the bytes of its windows; ``lead``: bytes before the anchor, ``low``: where the first window starts."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, hashes, packed, found = (batch.column(i).to_pylist() for i in range(4))
        for d, h, z, runs in zip(ids, hashes, packed, found):
            text = unpress.decompress(z)
            own = [text[r["low"]:r["high"] + length] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bisect_right(cuts, k) for k in suffix_keys(text, d, h, runs)], pa.int32()),
                 pa.array([d] * len(runs), pa.int64()), pa.array([h] * len(runs), pa.int64()), pa.array([r["low"] for r in runs], pa.int32()),
                 pa.array([r["place"] - r["low"] for r in runs], pa.int32()), pa.array(own, pa.binary()), pa.array([r["gram"] for r in runs], pa.int64())],
                names=["range", ID, HASH, "low", "lead", "bytes", "gram"])
    give_back()


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix, by the first column, then the second, and so on: rows are split by a pivot into less,
    equal and greater, and only the equal ones go on to the next column."""
    out = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, column = todo.pop()
        while hi - lo > 1 and column < words.shape[1]:
            own = out[lo:hi]
            values = words[own, column]
            pivot = np.partition(values[[0, (hi - lo) // 2, -1]], 1)[1]
            if hi - lo <= 256:  # small parts: a plain sort of this column, then its ties
                own = own[np.argsort(values, kind="stable")]
                out[lo:hi] = own
                values = words[own, column]
                edge = np.flatnonzero(values[1:] != values[:-1]) + lo + 1
                cuts = [lo, *edge.tolist(), hi]
                todo += [(a, b, column + 1) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
                break
            less, equal = values < pivot, values == pivot
            a, b = int(less.sum()), int(equal.sum())
            out[lo:hi] = np.concatenate([own[less], own[equal], own[~(less | equal)]])
            todo += [(lo, lo + a, column), (lo + a + b, hi, column)]
            lo, hi, column = lo + a, lo + a + b, column + 1
    return out


SPAN, WINDOW, SEEN = 0, 1, 2
_EVENT = f"kind TINYINT, {ID} BIGINT, {HASH} BIGINT, a INT, b INT, window BIGINT"


def _events(kind, doc, text, a, b, window) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip((np.broadcast_to(kind, len(doc)), doc, text, a, b, window),
                                      (np.int8, np.int64, np.int64, np.int32, np.int32, np.int64))], names=["kind", ID, HASH, "a", "b", "window"])


def buckets(batches, length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes in buckets of ``size``: where a bucket ends inside a class, the class goes on in the next one."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(size - n, batch.num_rows - at))
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield from bucket(held, length)
                held, n = [], 0
    if held:
        yield from bucket(held, length)
    give_back()


def bucket(rows: list[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Consecutive suffixes: spans that repeat among them, and the windows of their first and last class."""
    table = pa.Table.from_batches(rows)
    doc, text, low, lead = (table.column(i).to_numpy() for i in range(4))
    grams = table.column(5).to_numpy()
    own = table.column(4).combine_chunks().cast(pa.large_binary())
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    _, offsets, data = own.buffers()
    offsets = np.frombuffer(offsets, np.int64)[own.offset:own.offset + len(own) + 1]
    data = np.frombuffer(data, np.uint8)
    gram = min(GRAM, length)
    width = -(-gram // 8) * 8
    from_ = offsets[:-1] + lead
    leading = np.zeros((len(low), width), np.uint8)
    for c in range(gram):  # every suffix has the substring whole
        leading[:, c] = data[from_ + c]
    words = leading.view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    class_of = np.concatenate([[0], np.cumsum(~same)])
    size = np.bincount(class_of)
    # The classes that the splitters may have cut: those of the smallest and of the largest key of the range.
    ranked = np.lexsort((grams[order], words[order, 1], words[order, 0]))
    edge = (class_of == class_of[ranked[0]]) | (class_of == class_of[ranked[-1]])
    picked = (size[class_of] > 1) | edge
    look, on_edge = order[picked], edge[picked]
    # Suffixes with the same bytes around them repeat whole; one of each goes on, to be compared with the others.
    whole = np.empty(len(look), np.int64)
    at = 0
    while at < len(look):
        to = max(at + 1, at + int(np.searchsorted(np.cumsum((offsets[1:] - offsets[:-1])[look[at:at + 8192]]), 1 << 20)))
        sizes = (offsets[1:] - offsets[:-1])[look[at:to]]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        chunk = data[np.repeat(offsets[:-1][look[at:to]], sizes) + ranges(sizes)]
        got = span_hash(Slice(chunk, begin, 0).prefix(fold=False), begin[:-1], begin[1:])
        whole[at:to] = (got + lead[look[at:to]].astype(np.uint64)).view(np.int64)
        at = to
    _, one, same_as, copies = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    copied = copies[same_as] > 1
    if copied.any():
        row = look[copied]
        yield _events(SPAN, doc[row], text[row], low[row], low[row] + (offsets[1:] - offsets[:-1])[row], np.zeros(len(row)))
    look, on_edge, copied = look[one], on_edge[one], copied[one]
    # Hashes of all windows of these suffixes, a stretch at a time.
    n_windows = (offsets[1:] - offsets[:-1])[look] - length + 1
    hashes = np.empty(int(n_windows.sum()), np.int64)
    done = at = 0
    ends = np.cumsum(n_windows)
    while at < len(look):
        to = max(at + 1, int(np.searchsorted(ends, done + (1 << 18), "right")))
        rows = look[at:to]
        sizes = (offsets[1:] - offsets[:-1])[rows]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        chunk = data[np.repeat(offsets[:-1][rows], sizes) + ranges(sizes)]
        count = n_windows[at:to]
        s = np.repeat(begin[:-1], count) + ranges(count)
        got = span_hash(Slice(chunk, begin, 0).prefix(fold=False), s, s + length)
        hashes[done:done + len(got)] = got.view(np.int64)
        done, at = done + len(got), to
    del leading, words, same
    owner = np.repeat(np.arange(len(look), dtype=np.int32), n_windows)
    start = low[look][owner] + ranges(n_windows).astype(np.int32)
    by = np.argsort(hashes)
    ordered = hashes[by]
    new = np.ones(len(by) + 1, bool)
    new[1:-1] = ordered[1:] != ordered[:-1]
    repeated = np.zeros(len(by), bool)
    repeated[by] = ~(new[:-1] & new[1:])
    repeated |= copied[owner]
    new = new[:-1]
    del ordered
    hit = np.flatnonzero(repeated & ~copied[owner])  # copied suffixes have had their spans
    if len(hit):
        first = np.ones(len(hit), bool)
        first[1:] = owner[hit][1:] != owner[hit][:-1]
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(hit)) - 1
        row = look[owner[hit[heads]]]
        yield _events(SPAN, doc[row], text[row], start[hit[heads]], start[hit[tails]] + length, np.zeros(len(row)))
    pick = by[new]  # one of each distinct window
    pick = pick[on_edge[owner[pick]]]
    if len(pick):
        row = look[owner[pick]]
        yield _events(np.where(repeated[pick], SEEN, WINDOW), doc[row], text[row], start[pick], start[pick] + length, hashes[pick])
    del table, own, data, hashes, owner, start, by, repeated, new


def repeated_spans(docs: DataFrame, length: int = 400, bucket_suffixes: int = BUCKET_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(id, text hash, a, b) spans of bytes to remove, overlapping; and (id, text hash, packed) of the texts they may be in."""
    spark = docs.sparkSession
    found = materialise(anchor_rows(docs, length), "anchors")
    often = materialise(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "often")
    total = found.count()
    # Substrings that hold more than a thousandth of all anchors: a thousand at most.  Their rows need no exchange to know it.
    hot = F.broadcast(often.where(F.col("n") * HOT_SHARE > total).select("gram"))
    cold = found.join(hot, "gram", "left_anti").join(often.where(F.col("n") * HOT_SHARE <= total).select("gram"), "gram", "left_semi")
    runs = (found.join(hot, "gram", "left_semi").unionByName(cold).groupBy(ID, HASH)
            .agg(F.collect_set(F.struct("place", "low", "high", "gram")).alias("runs")))  # a set: of rows that repeat, one
    touched = materialise(packed_texts(docs).join(runs, [ID, HASH]).select(ID, HASH, "packed", "runs").dropDuplicates([ID, HASH]), "touched")
    release(found, often)
    n = touched.agg(F.sum(F.size("runs"))).first()[0] or 0
    ranges_ = max(1, min(RANGES_PER_PART * parts(spark), n // LEAST_RANGE))
    cuts = splitters(touched, n, ranges_)
    leading = F.substring("bytes", F.col("lead") + 1, F.lit(LEADING))
    suffixes = touched.mapInArrow(lambda b: suffix_rows(b, length, cuts), _SUFFIX)
    ranged = suffixes.repartition(parts(spark), "range").sortWithinPartitions("range", leading, "gram", ID, HASH, "low").drop("range")
    events = materialise(ranged.mapInArrow(lambda b: buckets(b, length, bucket_suffixes), _EVENT), "repeats")
    size = F.max(F.octet_length("text")).alias("b")
    twice = keyed(docs).groupBy(ID, HASH).agg(F.count("*").alias("n"), size).where((F.col("n") > 1) & (F.col("b") >= length))
    shared = events.where(F.col("kind") != SPAN).groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    across = events.where(F.col("kind") == WINDOW).join(shared, "window", "left_semi")
    spans = events.where(F.col("kind") == SPAN).select(ID, HASH, "a", "b").unionByName(across.select(ID, HASH, "a", "b"))
    return spans.unionByName(twice.select(ID, HASH, F.lit(0).alias("a"), "b")), touched


def joined_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_CUT = f"{ID} BIGINT, {HASH} BIGINT, n_removed BIGINT, n_spans BIGINT, removed ARRAY<STRUCT<a: INT, b: INT>>, kept BINARY"


def cut_texts(docs: DataFrame, length: int = 400, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """Of the texts that lose bytes: how many, in how many runs, which, and the bytes that remain."""
    if length < LEADING:
        raise ValueError(f"strings of {length} bytes: ranges are split by {LEADING}")
    spans, touched = repeated_spans(docs, length, bucket_suffixes)
    per_text = spans.groupBy(ID, HASH).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for row in batch.to_pylist():
                text, runs, at, kept = unpress.decompress(row["packed"]), joined_spans(row["spans"]), 0, []
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out = [row[ID], row[HASH], sum(b - a for a, b in runs), len(runs), [{"a": a, "b": b} for a, b in runs], b"".join(kept)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.binary()))],
                                                 names=[ID, HASH, "n_removed", "n_spans", "removed", "kept"])

    rows = touched.select(ID, HASH, "packed").join(per_text, [ID, HASH])
    return rows.mapInArrow(scan, _CUT).dropDuplicates([ID, HASH])


def fingerprints(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of its fingerprints, each once a text."""
    starts, ends, first = part.words()
    count = np.maximum(np.diff(first) - PASSAGE + 1, 0)
    if not count.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = span_hash(part.prefix(fold=False), starts, ends)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words) + 1)[0][:-1], out=prefix[1:])
    at = np.arange(len(words) - PRINT + 1)
    least = sliding_min(span_hash(prefix, at, at + PRINT), PASSAGE - PRINT + 1)
    doc = np.repeat(np.arange(len(part)), count)
    chosen = least[np.repeat(first[:-1], count) + ranges(count)]
    for again in (False, True):  # neighbours first: few are left to be sorted
        order = np.lexsort((chosen, doc)) if again else slice(None)
        doc, chosen = doc[order], chosen[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (chosen[1:] != chosen[:-1])
        doc, chosen = doc[new], chosen[new]
    return doc, chosen.view(np.int64)


def print_rows(docs: DataFrame) -> DataFrame:
    def scan(batches) -> Iterator[pa.RecordBatch]:
        for rows, part in frames(batches):
            doc, chosen = fingerprints(part)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(chosen)], names=[ID, HASH, "print"])

    return keyed(docs).select(ID, HASH, "text").mapInArrow(scan, f"{ID} BIGINT, {HASH} BIGINT, print BIGINT")


def passage_rows(docs: DataFrame) -> DataFrame:
    """(id, text hash) of the rows that share a fingerprint with another row; rows that repeat are rows of their own."""
    prints = materialise(print_rows(docs), "prints")
    shared = materialise(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "shared")  # a row has it once
    total = prints.count()
    hot = F.broadcast(shared.where(F.col("n") * HOT_SHARE > total).select("print"))  # a thousand at most
    cold = prints.join(hot, "print", "left_anti").join(shared.where(F.col("n") * HOT_SHARE <= total).select("print"), "print", "left_semi")
    found = materialise(prints.join(hot, "print", "left_semi").unionByName(cold).select(ID, HASH).distinct(), "passages")
    release(prints, shared)
    return found


def repeat_digest(docs: DataFrame, length: int = 400, bucket_suffixes: int = BUCKET_SUFFIXES, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with ``passages`` also shares_passage, whether it is one of
    :func:`passage_rows`."""
    cut = cut_texts(docs, length, bucket_suffixes).select(ID, HASH, "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = keyed(docs).select("doc_id", ID, HASH, F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    zero = F.lit(0).cast("bigint")
    out = [F.col("doc_id"), F.col("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"),
           F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "whole").alias("kept_sha256")]
    digest = whole.join(cut, [ID, HASH], "left")
    if not passages:
        return digest.select(*out)
    shared = passage_rows(docs).withColumn("shares_passage", F.lit(True))
    return digest.join(shared, [ID, HASH], "left").select(*out, F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))


def deduplicated(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs without their repeated bytes; a character of which a part is removed becomes the replacement character."""
    cut = cut_texts(docs, length).select(ID, HASH, F.decode("kept", "UTF-8").alias("__kept"))
    return keyed_whole(docs).join(cut, [ID, HASH], "left").withColumn("text", F.coalesce("__kept", "text")).select(docs.columns)
