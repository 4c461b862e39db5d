"""Best-fit packing by sums of squares.

Texts are tokenised where they lie; what moves is one short row per piece.  Pieces are
dealt by hash into shards of bounded size, and each shard packs its own: a piece goes where
the sum over residual gaps of the squared number of open bins becomes smallest, longer
pieces first.  Bins that a shard leaves underfull are taken apart again and packed in a
second round in which all shards' remainders meet, so shards cost next to nothing.

Defined results: a null or empty text is the end token alone; rows that repeat are packed
as often as they come; only documents of more than ``capacity`` ids are cut, into pieces
of ``capacity``, the last one shorter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import HASH, ID, keyed
from panelspark.llm.textbytes import give_back
from panelspark.scratch import materialise

SHARD_PIECES = 100_000
_CUT = f"doc_id BIGINT, {ID} BIGINT, {HASH} BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
_PIECE = f"{_CUT}, row BIGINT"


# The tokenizer's own pre-tokens on chunks of printable ASCII without an apostrophe and Latin letters: there, and only
# there, they are found here, so that the model is asked for words and not for texts.
_PLAIN_CHUNK = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PRE_TOKEN = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LETTER = {b: chr(b) for b in _own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _own)}


def chunk_encoder(path: str, cache_size: int = 400_000) -> Callable[[str], bytes]:
    """Text to token ids, little-endian 32-bit: chunks between spaces and line ends are encoded once and remembered.

    The tokenizer drops white space and no token spans it, so a text's ids are its chunks' ids one after another
    (tests hold this against whole texts)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    known: dict[str, bytes] = {}  # chunks, and the words in them: a plain word is a chunk too

    def word(pre: str) -> bytes:
        ids = known.get(pre)
        if ids is None:
            letters = pre if pre.isascii() else "".join([_BYTE_LETTER[b] for b in pre.encode()])
            ids = [t.id for t in model.tokenize(letters)]
            ids = known[pre] = struct.pack(f"<{len(ids)}I", *ids)
        return ids

    def encode(text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        new = {c for c in chunks if c not in known}
        if len(known) + len(new) > cache_size:
            known.clear()
            new = set(chunks)
        odd = []
        for c in new:
            if _PLAIN_CHUNK.fullmatch(c) and "<|" not in c:
                known[c] = b"".join([word(w) for w in _PRE_TOKEN.findall(c.lower())])
            else:
                odd.append(c)
        if odd:
            for c, e in zip(odd, tokenizer.encode_batch(odd, add_special_tokens=False)):
                known[c] = np.array(e.ids, "<u4").tobytes()
        return b"".join([known[c] for c in chunks])

    return encode


def piece_rows(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece of every row of docs, with the checksum of its ids."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer_path)  # what it remembers goes with the task
        for batch in batches:
            keep, out = [], []
            for i, text in enumerate(batch.column(3)):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    keep.append(i)
                    out.append((piece, at // 4, len(own) // 4, zlib.crc32(own)))
            piece, start, length, crc = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3)), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", ID, HASH, "piece", "start", "length", "ids_crc32"])
        del encode
        give_back()

    return keyed(docs).select("doc_id", ID, HASH, "text").mapInArrow(cut, _CUT)


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's gap.  Pieces come in the order in which they are placed."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = np.zeros(capacity + 1, np.int64)  # bins by gap; gap 0 isn't open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    for i, size in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - size changes the sum of squares by 2 (N(g - size) - N(g) + 1), closing it by
        # 1 - 2 N(size), and a new bin by 2 N(capacity - size) + 1.
        change = 2 * (open_[:capacity + 1 - size] - open_[size:] + 1)
        change[0] = 1 - 2 * open_[size]
        change[open_[size:] == 0] = 1 << 60
        new = 2 * open_[capacity - size] + 1 if size < capacity else 0
        best = int(np.argmin(change))
        if change[best] <= new:
            gap = best + size
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - size
        if gap > size:
            stacks[gap - size].append(b)
            open_[gap - size] += 1
    return bins, offsets, np.array(gaps, np.int64)


_PLACE = f"{_PIECE}, shard BIGINT, sequence_id BIGINT, offset BIGINT, gap BIGINT"


def _packed(rows: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", ID, HASH, "piece", "row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    bins, offsets, gaps = pack(rows["length"].to_numpy(), capacity)
    return rows.assign(sequence_id=base + bins, offset=offsets, gap=gaps[bins] if len(gaps) else bins)


def _in_shards(pieces: DataFrame, n: int, capacity: int, round_: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(ID, HASH, "piece", "row"), F.lit(n))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _packed(rows, capacity, (int(key[0]) * 2 + round_) << 32)

    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(one, _PLACE)


def packed_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs."""
    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # numbered, so that rows that repeat are dealt like others
    pieces = materialise(piece_rows(docs, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = max(1, -(-pieces.count() // shard_pieces))
    placed = _in_shards(pieces, n, capacity, 0)
    if n == 1:
        return placed.select(result)
    placed = materialise(placed, "packed")
    # Sequences left more than a fiftieth empty: few for each shard; they meet in shards of their own.
    loose = placed.where(F.col("gap") > capacity // 50)
    again = _in_shards(loose.select(pieces.columns), max(1, -(-loose.count() // shard_pieces)), capacity, 1)
    return placed.where(F.col("gap") <= capacity // 50).select(result).unionByName(again.select(result))
