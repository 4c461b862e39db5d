"""Byte-level BPE over a whole corpus: each distinct word is encoded once.

Encoding.  Texts are cut into pre-tokens where they lie, in blocks of bounded size.  A block keeps its
distinct pre-tokens and, for every position, the number of the pre-token that stands there; so exploded pre-tokens
are counted once for each block before anything moves, and a word that makes up a third of a corpus is
one entry a block.  Distinct words go to hash ranges, a block's words for one range in one row; a range encodes each
word it is asked for once, whatever the number of blocks that ask, and sends ids back to the blocks,
which put them at their positions.  Blocks are stored bucketed, so that only ids move to them.

Decoding.  Ids are exploded to (id, positions), joined with the vocabulary's table of token bytes, and put together by
position.  The table is as large as the vocabulary file and is broadcast; the join keeps the order of rows, and
a text that did not get all its tokens back is an error.

Defined results: null or empty text has no tokens; rows that repeat each get their own result; no special tokens, so
their strings are ordinary text; an id that the vocabulary lacks is an error; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.rows import parts
from panelspark.llm.textbytes import give_back
from panelspark.scratch import scratch_path

BLOCK_BYTES = 8 << 20
RANGE_WORDS = 200_000
DECODE_IDS = 1 << 20

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("seq", pa.binary()),
                    ("words", pa.binary()), ("words_bytes", pa.int64()), ("n_words", pa.int32())])
_BLOCK_DDL = ("block BIGINT, doc_ids ARRAY<BIGINT>, counts ARRAY<INT>, seq BINARY, words BINARY, words_bytes BIGINT, n_words INT")
_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_strings(strings: list[bytes]) -> tuple[bytes, int]:
    """Byte strings in one compressed value, and its size when expanded."""
    data = np.fromiter(map(len, strings), "<u4", len(strings)).tobytes() + b"".join(strings)
    return _squeeze(data) if data else b"", len(data)


def unpack_strings(packed: bytes, size: int, n: int) -> list[bytes]:
    data = _expand(packed, size)
    ends = (np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64) + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends], ends)]


class _Numbers(dict):
    """Keys numbered in the order in which they are first met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PreTokens:
    """The pre-tokens of texts as numbers of distinct words.

    Between two characters that are no white space, a space begins a pre-token and a line end is one; so a text falls
    into chunks that are cut by the pattern once each.  Texts with other white space at a cut go through the pattern whole."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.words = _Numbers()
        self.chunks = _Chunks(self)

    def numbers(self, text: str) -> np.ndarray:
        chunks, known = text.replace("\n", " \n").split(" "), self.chunks
        first = chunks[0]
        if first and not first[-1].isspace():
            at = np.fromiter(map(known.__getitem__, chunks[1:]), np.int64, len(chunks) - 1)
            starts = np.frombuffer(known.starts, np.int64)
            if not len(at) or at.min() >= 0:
                counts = starts[at + 1] - starts[at]
                ends = np.cumsum(counts)
                places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + counts, counts)
                rest = np.frombuffer(known.flat, np.int32)[places] if len(places) else np.empty(0, np.int32)
                return np.concatenate([self._whole(first), rest])
        return self._whole(text)

    def _whole(self, text: str) -> np.ndarray:
        found = self.find(text)
        return np.fromiter(map(self.words.__getitem__, found), np.int32, len(found))


class _Chunks(dict):
    """What follows a cut, by number: its words are flat[starts[n]:starts[n + 1]]; -1 where white space lies at a cut."""

    def __init__(self, owner: PreTokens):
        super().__init__()
        self.find, self.words = owner.find, owner.words
        self.starts, self.flat = array("q", [0]), array("i", [])

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[-1].isspace() or (chunk[0] != "\n" and chunk[0].isspace()) or (chunk[0] == "\n" and chunk[1].isspace()):
            self[chunk] = -1
            return -1
        found = self.find(chunk if chunk[0] == "\n" else " " + chunk)
        self.flat.extend(map(self.words.__getitem__, found))
        self[chunk] = n = len(self.starts) - 1
        self.starts.append(len(self.flat))
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers under 2^24 as their low, middle and high bytes: these compress better apart."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int32)
    return low | middle << 8 | high << 16


class _Block:
    def __init__(self, pattern: str):
        self.tokens, self.size = PreTokens(pattern), 0
        self.doc_ids, self.counts, self.seqs = [], [], []

    def add(self, doc_id, text: str) -> None:
        seq = self.tokens.numbers(text)
        self.doc_ids.append(doc_id)
        self.counts.append(len(seq))
        self.seqs.append(seq)
        self.size += len(text)

    def record(self, number: int) -> pa.RecordBatch:
        seq = np.concatenate([np.empty(0, np.int32), *self.seqs])
        words = [w.encode() for w in self.tokens.words]
        often = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), np.int32)
        rank[often] = np.arange(len(words), dtype=np.int32)
        packed, size = pack_strings([words[i] for i in often.tolist()])
        wide = len(words) >= 1 << 24
        stored = rank[seq].astype("<u4").tobytes() if wide else _planes(rank[seq])
        return pa.RecordBatch.from_pylist([{"block": number, "doc_ids": self.doc_ids, "counts": self.counts, "seq": _squeeze(stored) if stored else b"",
                                            "words": packed, "words_bytes": size, "n_words": len(words)}], schema=_BLOCK)


def _sequence(data: bytes, length: int, n_words: int) -> np.ndarray:
    if not length:
        return np.empty(0, np.int32)
    if n_words >= 1 << 24:
        return np.frombuffer(_expand(data, 4 * length), "<u4").astype(np.int32)
    return _from_planes(_expand(data, 3 * length))


def word_blocks(docs: DataFrame, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: distinct pre-tokens, and which of them stands at each position."""

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        base, made, block = TaskContext.get().partitionId() << 32, 0, _Block(pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py() or "")
                if block.size >= block_bytes:
                    yield block.record(base + made)
                    made, block = made + 1, _Block(pattern)
        if block.doc_ids:
            yield block.record(base + made)
        del block
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(blocks, _BLOCK_DDL)


def _stored_by_block(blocks: DataFrame) -> DataFrame:
    """A table bucketed by block, so that what is sent to blocks is all that moves."""
    spark, name = blocks.sparkSession, f"panelspark_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(parts(spark), "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def word_range(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n


_ASK = "part INT, block BIGINT, words BINARY, words_bytes BIGINT, n_words INT"
_ASK_NAMES = [f.split(" ")[0] for f in _ASK.split(", ")]
_ANSWER = "part INT, block BIGINT, ids BINARY, ids_bytes BIGINT"


def _asked(n: int):
    """Every block's words, one row for each range that holds any."""

    def ask(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_strings(row["words"], row["words_bytes"], row["n_words"])
                part = word_range(words, n)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                out = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                    own = [words[i] for i in order[a:b].tolist()]
                    out.append((int(part[order[a]]), row["block"], *pack_strings(own), len(own)))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32()))],
                                                 names=_ASK_NAMES)
        give_back()

    return ask


def _encoded_words(path: str):
    """Rows sorted by range: each distinct word of a range is encoded once, at its first question."""

    def encode(batches) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = read_ranks(path)
        encoding = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        known, at = {}, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != at:
                    known, at = {}, row["part"]
                found = []
                for word in unpack_strings(row["words"], row["words_bytes"], row["n_words"]):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encoding._encode_single_piece(word), "<u4").tobytes()
                    found.append(ids)
                out.append((row["part"], row["block"], *pack_strings(found)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64()))],
                                             names=["part", "block", "ids", "ids_bytes"])
        known.clear()
        give_back()

    return encode


def _id_rows(doc_ids: list, ids: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=_IDS)


def _assembled(n: int, rows):
    """One block and its answers: ids at their positions, handed to ``rows`` with their documents."""

    def assemble(block: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = block.to_pylist()
        n_words = row["n_words"]
        words = unpack_strings(row["words"], row["words_bytes"], n_words)
        part = word_range(words, n)
        del words
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=n) if n_words else np.zeros(n, np.int64)
        ids: list = [None] * n_words
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for answer in answers.to_pylist():
            p = answer["part"]
            own = unpack_strings(answer["ids"], answer["ids_bytes"], int(sizes[p]))
            for number, value in zip(order[starts[p]:starts[p + 1]].tolist(), own):
                ids[number] = value
        if None in ids:
            raise RuntimeError("a word of this block got no ids")
        lengths = np.fromiter(map(len, ids), np.int64, n_words)
        flat = np.frombuffer(b"".join(ids), "<u4")
        begins = (np.cumsum(lengths) - lengths) // 4
        lengths //= 4
        counts = row["counts"]
        seq = _sequence(row["seq"], sum(counts), n_words)
        del ids
        out, at = [], 0
        for count in counts:
            own = seq[at:at + count]
            at += count
            size = lengths[own]
            ends = np.cumsum(size)
            total = int(ends[-1]) if count else 0
            places = np.arange(total) + np.repeat(begins[own] - ends + size, size)
            out.append(flat[places])
        table = rows(row["doc_ids"], out)
        give_back()
        return table

    return assemble


def _encoded(docs: DataFrame, path: str, pattern: str, block_bytes: int, range_words: int, rows, schema: str) -> DataFrame:
    spark = docs.sparkSession
    blocks = _stored_by_block(word_blocks(docs, pattern, block_bytes))
    entries = blocks.agg(F.sum("n_words")).first()[0] or 0
    n = max(1, -(-entries // range_words))
    asked = blocks.select("block", "words", "words_bytes", "n_words").mapInArrow(_asked(n), _ASK)
    answers = asked.repartition(parts(spark), "part").sortWithinPartitions("part").mapInArrow(_encoded_words(path), _ANSWER)
    # A block without a word, of empty texts alone, has no answers: the blocks decide which groups there are.
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assembled(n, rows), schema)


def encoded(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row of docs."""
    return _encoded(docs, path, pattern, block_bytes, range_words, _id_rows, "doc_id BIGINT, n_tokens BIGINT, ids BINARY")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary as rows (token, bytes): as many as the file has lines."""
    return spark.createDataFrame([(rank, token) for token, rank in read_ranks(path).items()], "token LONG, bytes BINARY")


_PLACED = "token LONG, at BINARY, doc_ids ARRAY<BIGINT>, counts ARRAY<BIGINT>, ids_sha256 ARRAY<STRING>"
_PLACED_ARROW = pa.schema([("token", pa.int64()), ("at", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                           ("ids_sha256", pa.list_(pa.string()))])
_DECODED = "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, text BINARY"


def _runs(doc_ids: list, ids: Iterable[np.ndarray]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents in runs of a bounded number of ids."""
    run, own, size = [], [], 0
    for doc_id, value in zip(doc_ids, ids):
        run.append(doc_id)
        own.append(value)
        size += len(value)
        if size >= DECODE_IDS:
            yield run, own
            run, own, size = [], [], 0
    if run:
        yield run, own


def _placed(doc_ids: list, ids: Iterable[np.ndarray]) -> pa.Table:
    """Each run: a row that tells its documents, then one row for each distinct id with the positions where it stands."""
    out = []
    for run, own in _runs(doc_ids, ids):
        flat = np.concatenate([np.empty(0, "<u4"), *own])
        order = np.argsort(flat.astype(np.uint16) if len(flat) and flat.max() < 1 << 16 else flat, kind="stable").astype("<u4")
        cuts = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
        tokens = [None, *flat[order[cuts]].tolist()]
        at = [None, *(part.tobytes() for part in np.split(order, cuts[1:]) if len(part))]
        n = len(tokens) - 1
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.int64()), pa.array(at, pa.binary()), pa.array([run] + [None] * n, pa.list_(pa.int64())),
             pa.array([[len(x) for x in own]] + [None] * n, pa.list_(pa.int64())),
             pa.array([[hashlib.sha256(x.tobytes()).hexdigest() for x in own]] + [None] * n, pa.list_(pa.string()))], schema=_PLACED_ARROW))
    return pa.Table.from_batches(out, _PLACED_ARROW)


def _explode_ids(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _placed(batch.column(0).to_pylist(), (np.frombuffer(v.as_py() or b"", "<u4") for v in batch.column(1))).to_batches()
    give_back()


def _reassemble(digest: bool):
    def texts(batches) -> Iterator[pa.RecordBatch]:
        head, seq, tokens, missing = None, None, [], 0

        def done() -> pa.RecordBatch:
            if missing:
                raise RuntimeError(f"{missing} positions of a run of documents got no token")
            out, at = [], 0
            for count in head["counts"]:
                text = b"".join(map(tokens.__getitem__, seq[at:at + count].tolist()))
                out.append(hashlib.sha256(text).hexdigest().encode() if digest else text)
                at += count
            return pa.RecordBatch.from_arrays([pa.array(head["doc_ids"], pa.int64()), pa.array(head["counts"], pa.int64()),
                                               pa.array(head["ids_sha256"], pa.string()), pa.array(out, pa.binary())],
                                              names=["doc_id", "n_tokens", "ids_sha256", "text"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_ids"] is not None:
                    if head is not None:
                        yield done()
                    head, tokens, missing = row, [], sum(row["counts"])
                    seq = np.zeros(missing, np.int32)
                    continue
                if row["bytes"] is None:
                    raise ValueError(f"the vocabulary has no token {row['token']}")
                places = np.frombuffer(row["at"], "<u4")
                seq[places] = len(tokens)
                tokens.append(row["bytes"])
                missing -= len(places)
        if head is not None:
            yield done()
        give_back()

    return texts


def _joined(exploded: DataFrame, path: str, digest: bool) -> DataFrame:
    joined = exploded.join(F.broadcast(token_table(exploded.sparkSession, path)), "token", "left")
    return joined.select("at", "doc_ids", "counts", "ids_sha256", "bytes", "token").mapInArrow(_reassemble(digest), _DECODED)


def decoded(ids: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and text (bytes; with ``digest`` their SHA-256) of rows (doc_id, ids)."""
    return _joined(ids.select("doc_id", "ids").mapInArrow(_explode_ids, _PLACED), path, digest)


def bpe_digest(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs: encoded, then decoded from the ids, which
    blocks hand over exploded."""
    back = _joined(_encoded(docs, path, pattern, block_bytes, range_words, _placed, _PLACED), path, True)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.col("text").cast("string").alias("decoded_sha256"))
