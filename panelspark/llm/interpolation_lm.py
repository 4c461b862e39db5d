"""Deleted interpolation: n-gram estimates mixed by context frequency, weights learned on held-out counts.

P(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), where the weights l depend on how often the context h was
seen (one bucket for each power of two).  A document's fold is crc32 of its id modulo 5: fold 1 is not learned from,
fold 0 is deleted from the counts while expectation-maximisation fits the weights to it, and the final model counts
all but fold 1.

Counts grow with the corpus, so they stay distributed.  Texts are written once as compressed blocks of bounded size.
Each block asks for its distinct n-grams, as sorted packed hashes dealt by hash range; each range adds up what the
blocks counted and answers every block in its own order with packed counts.  A frequent n-gram is one entry a block, so
no range grows with it.  Blocks then meet their answers twice: fold 0 for the held-out statistics (a histogram of the
estimates' ratios, bounded by the number of its cells, is all that reaches the driver), and all blocks to be scored.

Words are runs without ASCII white space, A-Z lower-cased, and one end token closes each text; null counts as empty and
has the end token alone.  A null id has the crc of an empty text.  Rows that repeat are scored and counted as they come.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.textbytes import PLAIN, frames, give_back, gram_hash, slices, span_hash
from panelspark.scratch import materialise

BLOCK_BYTES, RANGE_BYTES = 1 << 22, 1 << 23
HELD_OUT, DELETED = 1, 0
BUCKETS = 66
CELLS_PER_OCTAVE, FARTHEST = 4, 60
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4A5B25F39)


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that what is zero in most values costs nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def rows_of(batches) -> Iterator[dict]:
    """One row at a time, so that a task holds one block and not a batch of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    give_back()


_BLOCK = "block BIGINT, deleted BOOLEAN, n_bytes BIGINT, n_train BIGINT, doc_ids ARRAY<BIGINT>, folds ARRAY<INT>, sizes ARRAY<BIGINT>, texts BINARY"


def block_rows(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, fold, text) gathered into blocks, those of the deleted fold apart from the others."""
    start, made = TaskContext.get().partitionId() << 32, 0
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def block(deleted: bool) -> pa.RecordBatch:
        nonlocal made
        ids, folds, texts = zip(*held[deleted])
        made += 1
        n_train = sum(f != HELD_OUT for f in folds)
        out = [start + made, deleted, size[deleted], n_train, ids, folds, list(map(len, texts)), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        held[deleted], size[deleted] = [], 0
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)],
                                          names=["block", "deleted", "n_bytes", "n_train", "doc_ids", "folds", "sizes", "texts"])

    for rows, part in frames(batches):
        ids, folds = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        for i in range(len(part)):
            kind, text = folds[i] == DELETED, part.text(i)
            if held[kind] and size[kind] + len(text) > limit:
                yield block(kind)
            held[kind].append((ids[i], folds[i], text))
            size[kind] += len(text)
    for kind in (False, True):
        if held[kind]:
            yield block(kind)


def tokens_of(sizes: list[int], texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's texts, each closed by the end token, and where each text's begin."""
    data = zstandard.ZstdDecompressor().decompress(texts)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes),
                                              [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data)])
    found, counts = [], []
    for part in slices(column):
        begins, ends, first = part.words(PLAIN)
        count = np.diff(first)
        out = np.full(len(begins) + len(part), END, np.uint64)
        out[np.arange(len(begins)) + np.repeat(np.arange(len(part)), count)] = span_hash(part.prefix(fold=True), begins, ends)
        found.append(out)
        counts.append(count + 1)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def grams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first follows a begin mark."""
    with_begin = np.empty(len(tokens) + 1, np.uint64)
    with_begin[1:] = tokens
    with_begin[0] = BEGIN
    out = gram_hash(with_begin, 2)
    heads = first[:-1]
    out[heads] = gram_hash(np.stack([np.full(len(heads), BEGIN, np.uint64), tokens[heads]], axis=1).ravel(), 2)[::2] if len(heads) else out[heads]
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def range_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit hashes begins in sorted keys."""
    edges = np.array([(r << 64) // n for r in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


_ASKED = "gram INT, part INT, block BIGINT, deleted BOOLEAN, keys BINARY, counts BINARY"


def ask(batches, n_ranges: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words and pairs with its training counts, by hash range."""
    for row in rows_of(batches):
        tokens, first = tokens_of(row["sizes"], row["texts"])
        train = np.repeat(np.array(row["folds"]) != HELD_OUT, np.diff(first))
        for gram, keys in ((1, tokens), (2, grams(tokens, first))):
            own, place = distinct(keys)
            counts = np.bincount(place[train], minlength=len(own)).astype(np.uint32)
            bounds = range_bounds(own, n_ranges)
            some = [r for r in range(n_ranges) if bounds[r] < bounds[r + 1]]
            cut = [slice(bounds[r], bounds[r + 1]) for r in some]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([gram] * n, pa.int32()), pa.array(some, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array([row["deleted"]] * n),
                 pa.array([_packed(np.diff(own[c], prepend=np.uint64(0))) for c in cut], pa.binary()), pa.array([_packed(counts[c]) for c in cut], pa.binary())],
                names=["gram", "part", "block", "deleted", "keys", "counts"])


_ANSWER = "gram INT, part INT, block BIGINT, kept BINARY, held BINARY, v_all BIGINT, n_all BIGINT, v_kept BIGINT, n_kept BIGINT"


def answer(table: pa.Table) -> pa.Table:
    """One hash range: totals of all blocks, for each block in the order of its own keys; and the range's distinct words."""
    rows = table.to_pylist()
    keys = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    sizes = np.array([len(k) for k in keys])
    own, place = distinct(np.concatenate(keys))
    counts = np.concatenate([_unpacked(r["counts"], np.uint32) for r in rows]).astype(np.float64)
    deleted = np.repeat([r["deleted"] for r in rows], sizes)
    held = np.bincount(place, weights=counts * deleted, minlength=len(own)).astype(np.uint64)
    kept = np.bincount(place, weights=counts * ~deleted, minlength=len(own)).astype(np.uint64)
    total = held + kept
    cut = np.split(place, np.cumsum(sizes)[:-1])
    n = len(rows)
    stats = [int((total > 0).sum()), int(total.sum()), int((kept > 0).sum()), int(kept.sum())]
    columns = [pa.array([r["gram"] for r in rows], pa.int32()), pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int64()),
               pa.array([_packed(kept[c]) for c in cut], pa.binary()), pa.array([_packed(held[c]) for c in cut], pa.binary()),
               *(pa.array([v] + [0] * (n - 1), pa.int64()) for v in stats)]
    del keys, own, place, counts, held, kept, total, cut
    give_back()
    return pa.Table.from_arrays(columns, names=[c.split()[0] for c in _ANSWER.split(", ")])


class Totals:
    """Training tokens, distinct words and documents: of all training folds, and without the deleted one."""

    def __init__(self, n_all: int, v_all: int, docs_all: int, n_kept: int, v_kept: int, docs_kept: int):
        self.n_all, self.v_all, self.docs_all = n_all, v_all, docs_all
        self.n_kept, self.v_kept, self.docs_kept = n_kept, v_kept, docs_kept


def block_counts(row: dict) -> tuple[np.ndarray, ...]:
    """A block's tokens with their answers: first token of each text, and for each token the counts (kept, all) of the
    word, of the pair it ends, and of its context (0 stands for a begin mark, see ``heads``)."""
    tokens, first = tokens_of(row["sizes"], row["texts"])
    answers = sorted(row["answers"], key=lambda a: (a["gram"], a["part"]))
    out = []
    for gram, keys in ((1, tokens), (2, grams(tokens, first))):
        mine = [a for a in answers if a["gram"] == gram]
        kept = np.concatenate([_unpacked(a["kept"], np.uint64) for a in mine])
        total = kept + np.concatenate([_unpacked(a["held"], np.uint64) for a in mine])
        _, place = distinct(keys)
        out += [kept[place].astype(np.float64), total[place].astype(np.float64)]
    return first, *out


def contexts(count: np.ndarray, first: np.ndarray, docs: int) -> np.ndarray:
    """Count of the token before each token; a text's first token follows as many begin marks as there are documents."""
    out = np.empty(len(count))
    out[1:] = count[:-1]
    out[first[:-1]] = docs
    return out


def estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Maximum-likelihood estimates by pair and by word, the uniform one, and the context's bucket."""
    p2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
    bucket = np.where(context > 0, np.frexp(context)[1], 0)
    return p2, word / max(n, 1), 1.0 / (v + 1), np.minimum(bucket, BUCKETS - 1)


_CELL = "bucket INT, q2 INT, q1 INT, n BIGINT"


def held_out_cells(batches, totals: Totals) -> Iterator[pa.RecordBatch]:
    """Held-out tokens by context bucket and by how far the two estimates lie above the uniform one (null: estimate 0)."""
    for row in rows_of(batches):
        first, word, _, pair, _ = block_counts(row)
        p2, p1, p0, bucket = estimates(word, pair, contexts(word, first, totals.docs_kept), totals.n_kept, totals.v_kept)

        def cell(p):
            q = np.rint(np.log2(np.maximum(p, 1e-300) / p0) * CELLS_PER_OCTAVE)
            return np.where(p > 0, np.clip(q, -FARTHEST * CELLS_PER_OCTAVE, FARTHEST * CELLS_PER_OCTAVE), -10_000).astype(np.int64) + 10_000

        key, n = np.unique((bucket.astype(np.int64) << 40) | (cell(p2) << 20) | cell(p1), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array((key >> 40).astype(np.int32)), *(pa.array((((key >> s) & 0xFFFFF) - 10_000).astype(np.int32)) for s in (20, 0)), pa.array(n)],
            names=["bucket", "q2", "q1", "n"])


def mixture_weights(bucket: np.ndarray, q2: np.ndarray, q1: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (pair, word, uniform) of every bucket by expectation-maximisation; a bucket without held-out tokens takes
    those of the nearest smaller one that has some."""
    p = np.stack([np.where(q > -10_000, 2.0 ** (q / CELLS_PER_OCTAVE), 0.0) for q in (q2, q1)] + [np.ones(len(q1))], axis=1)
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    some = np.bincount(bucket, weights=n, minlength=BUCKETS) > 0
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1).astype(float)
        sums[:, 2] += 1e-3  # no bucket rules out what it has not seen
        weights = np.where(some[:, None], sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300), weights)
    for b in range(1, BUCKETS):
        if not some[b] and some[:b].any():
            weights[b] = weights[b - 1]
    return weights


_SCORED = ("doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE")


def score_block(batches, totals: Totals, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        first, _, word, _, pair = block_counts(row)
        base = np.log10((word + 0.5) / (totals.n_all + 0.5 * (totals.v_all + 1)))
        p2, p1, p0, bucket = estimates(word, pair, contexts(word, first, totals.docs_all), totals.n_all, totals.v_all)
        w = weights[bucket]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        heads, n = first[:-1], len(first) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), pa.array(np.array(row["folds"]) == HELD_OUT), pa.array(np.diff(first)),
             pa.array(np.add.reduceat((word > 0).astype(np.int64), heads)), pa.array(np.full(n, totals.n_all, np.int64)),
             pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(model, heads))],
            names=[c.split()[0] for c in _SCORED.split(", ")])


class Model:
    """Blocks, answers, totals and weights of one corpus."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES):
        fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)).cast("int")
        rows = docs.select(F.col("doc_id").cast("bigint"), fold.alias("fold"), "text")
        self.blocks = materialise(rows.mapInArrow(lambda b: block_rows(b, block_bytes), _BLOCK), "blocks")
        size, docs_all, docs_kept = self.blocks.agg(F.sum("n_bytes"), F.sum("n_train"), F.sum(F.when(~F.col("deleted"), F.col("n_train")))).first()
        n_ranges = max(1, -(-(size or 0) // range_bytes))
        asked = self.blocks.mapInArrow(lambda b: ask(b, n_ranges), _ASKED)
        self.answers = materialise(asked.groupBy("gram", "part").applyInArrow(answer, _ANSWER), "answers")
        n_all, v_all, n_kept, v_kept = (self.answers.where("gram = 1").agg(*(F.sum(c) for c in ("n_all", "v_all", "n_kept", "v_kept"))).first())
        self.totals = Totals(*(x or 0 for x in (n_all, v_all, docs_all, n_kept, v_kept, docs_kept)))
        totals = self.totals
        cells = self._answered(self.blocks.where("deleted")).mapInArrow(lambda b: held_out_cells(b, totals), _CELL)
        # As many rows as there are cells at most, whatever the corpus: buckets by two estimates' ratios.
        found = cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
        self.weights = mixture_weights(*(found[c].to_numpy(np.int64) for c in ("bucket", "q2", "q1", "n")))

    def _answered(self, blocks: DataFrame) -> DataFrame:
        parts = self.answers.groupBy("block").agg(F.collect_list(F.struct("gram", "part", "kept", "held")).alias("answers"))
        return blocks.select("block", "doc_ids", "folds", "sizes", "texts").join(parts, "block")

    def scores(self) -> DataFrame:
        totals, weights = self.totals, self.weights
        return self._answered(self.blocks).mapInArrow(lambda b: score_block(b, totals, weights), _SCORED)


def scores(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    return Model(docs, **options).scores()
