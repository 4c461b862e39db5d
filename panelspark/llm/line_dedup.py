"""Line dedup: lines that an earlier document already has are dropped, as keep bitmaps.

Line keys become two 64-bit hashes.  Rows (hashes, document, position) are range
partitioned and sorted by hash, document and position; each range is streamed once and
says of every line whether its document is the first to hold it.  A hash held by a third
of all rows spreads over many ranges: the first and last hash of each range report the
first document they saw, and those few rows (two a range) settle the hashes that ranges
share.  What comes back is one compressed bitmap per document, bit 1 for a kept line;
texts are only touched where a caller applies the bitmaps.

Defined results: null or empty text is one empty line; keys under ``min_chars`` code
points are always kept; a key that one document repeats, and no other holds, is kept
throughout; a null id is the smallest; rows repeating an id are the same document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import HASH, ID, keyed, keyed_whole, parts
from panelspark.llm.textbytes import give_back
from panelspark.scratch import materialise

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, UNSETTLED, FIRST = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, text hash, position) of every line long enough to be judged."""
    lines = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line")
    key = line_key(F.col("line"))
    return (keyed(docs).select(ID, HASH, lines).select(ID, HASH, "pos", key.alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), ID, HASH, "pos"))


_EVENT = f"kind TINYINT, h1 BIGINT, h2 BIGINT, {ID} BIGINT, {HASH} BIGINT, pos INT"


def _events(kind, h1, h2, doc, text, pos) -> pa.RecordBatch:
    n = len(h1)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), *(pa.array(np.asarray(x, np.int64)) for x in (h1, h2, doc, text)),
         pa.array(np.asarray(pos, np.int32))], names=["kind", "h1", "h2", ID, HASH, "pos"])


def stream_range(batches):
    """One sorted range: lines to drop, lines of the first hash (unsettled), first documents of the hashes at both ends."""
    state = None  # hashes and first document of the group being read, and whether it is the range's first
    for batch in batches:
        h1, h2, doc, text, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(h1):
            continue
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if state is not None:
            new[0] = (h1[0], h2[0]) != state[:2]
        group = np.cumsum(new)  # 0: the group that an earlier batch began
        heads = np.flatnonzero(new)
        first_doc = np.concatenate([[0 if state is None else state[2]], doc[heads]])[group]
        in_first = (group == 0) & state[3] if state is not None else group == 1
        drop = (doc != first_doc) & ~in_first
        if in_first.any():
            yield _events(UNSETTLED, *(x[in_first] for x in (h1, h2, doc, text, pos)))
        if drop.any():
            yield _events(DROP, *(x[drop] for x in (h1, h2, doc, text, pos)))
        if state is None:
            yield _events(FIRST, h1[:1], h2[:1], doc[:1], [0], [0])
        state = (h1[-1], h2[-1], first_doc[-1], bool(in_first[-1]))
    if state is not None:
        yield _events(FIRST, [state[0]], [state[1]], [state[2]], [0], [0])


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(id, text hash, pos) of every line held by an earlier document."""
    spark = docs.sparkSession
    lines = materialise(line_rows(docs, min_chars), "lines")  # ranges are sampled from it: the texts are split once
    ranged = lines.repartitionByRange(parts(spark), "h1", "h2", ID, "pos").sortWithinPartitions("h1", "h2", ID, "pos")
    events = materialise(ranged.mapInArrow(stream_range, _EVENT), "line-events")
    first = events.where(F.col("kind") == FIRST).groupBy("h1", "h2").agg(F.min(ID).alias("first"))
    # Two rows a range at most: bounded by the number of shuffle partitions.
    late = (events.where(F.col("kind") == UNSETTLED).join(F.broadcast(first), ["h1", "h2"])
            .where(F.col(ID) != F.col("first")))
    return events.where(F.col("kind") == DROP).select(ID, HASH, "pos").unionByName(late.select(ID, HASH, "pos"))


_BITMAP = f"{ID} BIGINT, {HASH} BIGINT, n_lines BIGINT, n_dropped BIGINT, keep BINARY"


def _packed(batches):
    """Bitmaps of documents from their number of lines and the positions that are dropped (null: none)."""
    for batch in batches:
        bits = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3)):
            places = dropped.values
            if places is None:
                bits.append(None)
                continue
            keep = np.ones(n, bool)
            keep[places.to_numpy(zero_copy_only=False)] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        sizes = pc.fill_null(pc.list_value_length(batch.column(3)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(bits, pa.binary())],
                                         names=[ID, HASH, "n_lines", "n_dropped", "keep"])
    give_back()


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per document and text: ``n_lines``, ``n_dropped``, ``keep`` (compressed bitmap; null: all kept)."""
    drops = (dropped_lines(docs, min_chars).groupBy(ID, HASH)
             .agg(F.collect_set("pos").alias("dropped")))  # as many as the document has lines
    n_lines = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    counted = keyed(docs).select(ID, HASH, n_lines.cast("bigint").alias("n_lines")).distinct()
    joined = counted.join(drops, [ID, HASH], "left").select(ID, HASH, "n_lines", "dropped")
    return materialise(joined.mapInArrow(_packed, _BITMAP), "bitmaps")


def unpack(keep: bytes | None, n_lines: int) -> np.ndarray:
    """The keep bits of a document's lines."""
    if keep is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def kept_text(text: str | None, keep: bytes | None) -> str:
    lines = (text or "").split("\n")
    return "\n".join(line for line, bit in zip(lines, unpack(keep, len(lines))) if bit)


SLICE_ROWS = 256


def _texts(column: int, digest: bool):
    """Rows whose text loses the lines that its bitmap (the last column) drops, a few rows at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                out = []
                for text, keep in zip(rows.column(column), rows.column(rows.num_columns - 1)):
                    text, keep = text.as_py(), keep.as_py()
                    kept = text if keep is None else kept_text(text, keep)
                    out.append(hashlib.sha256((kept or "").encode()).hexdigest() if digest else kept)
                columns = [*rows.columns[:column], pa.array(out, pa.string()), *rows.columns[column + 1:-1]]
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names[:-1])
        give_back()

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the dropped lines out of their texts; a text that loses nothing, null included, stays as it is."""
    joined = keyed_whole(docs).join(bitmaps.select(ID, HASH, F.col("keep").alias("__keep")), [ID, HASH], "left")
    return joined.select(*docs.columns, "__keep").mapInArrow(_texts(docs.columns.index("text"), False), docs.schema)


def line_digest(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs."""
    joined = keyed(docs).join(keep_bitmaps(docs, min_chars), [ID, HASH], "left")
    rows = joined.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_sha256"), "keep")
    return rows.mapInArrow(_texts(3, True), "doc_id BIGINT, n_lines BIGINT, n_dropped BIGINT, kept_sha256 STRING")
