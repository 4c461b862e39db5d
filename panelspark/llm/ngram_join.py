"""N-gram Jaccard join with Bayesian pruning of candidates.

Every text becomes the set of its five-word shingles and 128 MinHash values of 16 bits.
Copies (equal word sequences) are represented by one of them.  Representatives that agree on
one of 32 bands of four values meet in a bucket (of pairs with a similarity of 0.8, fewer
than one in ten million never meet); buckets with the same members are kept once.  In a
bucket, a pair belongs to the first band on which it agrees, so it is looked at once; its
MinHash values are compared 16 at a time, and it is dropped as soon as the posterior
probability (uniform prior) of reaching the threshold falls below ``tolerance``.  What is
left is verified on the sets themselves (of 48-bit hashes).

A bucket is dealt into blocks of bounded size and bounded text, and a task resolves one pair
of blocks, so that a bucket with a third of all rows is shared by many.  Tasks return one row
per member: its number of links and a link to its group's smallest member, never the pairs.
:func:`linked_pairs` lists pairs for those who want them.

Defined results: words as runs of ASCII letters (A-Z as a-z), digits and anything beyond
ASCII; a text of fewer than five words is one shingle; a text without words (null, empty)
is linked to nothing and a group of its own; rows that repeat id and text are one document;
a null id is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import HASH, ID, NULL_ID, keyed, keyed_whole, parts
from panelspark.llm.suffix_dedup import packed_texts
from panelspark.llm.textbytes import ALNUM, Slice, frames, give_back, gram_hash, powers, slices, span_hash
from panelspark.scratch import materialise, release

HASHES, ROWS_PER_BAND, STEP = 128, 4, 16
BANDS = HASHES // ROWS_PER_BAND
BLOCK_DOCS, BLOCK_WORDS = 1500, 3_000_000

_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_rows(part: Slice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, the first of each text, word hashes, and the first word of each."""
    starts, ends, first = part.words(ALNUM)
    words = span_hash(part.prefix(fold=True), starts, ends)
    count = np.diff(first)
    grams = gram_hash(words, n)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero(doc[:len(grams)] == doc[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    out, owner = [grams[inside]], [doc[inside]]
    for k in range(1, n):  # texts shorter than a shingle
        short = np.flatnonzero(count == k)
        if len(short):
            whole = gram_hash(words, k, order=1000)
            out.append(whole[first[short]])
            owner.append(short)
    owner, hashes = np.concatenate(owner), np.concatenate(out)
    order = np.argsort(owner, kind="stable")
    return hashes[order], np.searchsorted(owner[order], np.arange(len(count) + 1)), words, first


def minhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 values of 16 bits for each text that has a shingle; zeros for others."""
    count = np.diff(first)
    some = np.flatnonzero(count)
    out = np.zeros((len(count), HASHES), np.uint16)
    if not len(some):
        return out
    base = (hashes >> np.uint64(32)).astype(np.uint32)
    heads = first[:-1][some]
    for k in range(HASHES):
        v = (base ^ _SHIFT[k]) * _MULTIPLY[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        low = np.minimum.reduceat(v, heads)
        out[some, k] = ((low ^ (low >> np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's words in their order."""
    out = []
    p, inverse = powers(len(words) + 2)
    for salt in (0x1234567, 0x7654321ABCDEF):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(((words ^ np.uint64(salt)) * np.uint64(0x94D049BB133111EB)) * p[:len(words)], out=total[1:])
        out.append(((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]]).view(np.int64))
    return out


def signature_lists(values: np.ndarray) -> pa.ListArray:
    """Each text's values as 32 longs, one for each band."""
    wide = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, wide.size + 1, BANDS, dtype=np.int32)), pa.array(wide.ravel()))


_SIGNED = f"{ID} BIGINT, {HASH} BIGINT, n_words INT, s1 BIGINT, s2 BIGINT, signature ARRAY<BIGINT>"


def signatures(docs: DataFrame, n: int = 5) -> DataFrame:
    def scan(batches) -> Iterator[pa.RecordBatch]:
        for rows, part in frames(batches):
            hashes, at, words, first = shingle_rows(part, n)
            lists = signature_lists(minhash(hashes, at))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(first).astype(np.int32)), *map(pa.array, sequence_hashes(words, first)),
                 lists], names=[ID, HASH, "n_words", "s1", "s2", "signature"])

    return keyed(docs).select(ID, HASH, "text").mapInArrow(scan, _SIGNED)


def six_bytes(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each distinct hash, sorted: enough to tell a pair's shingles apart, and a quarter less to move."""
    return (np.unique(hashes >> np.uint64(16))).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def shingle_sets(packed: DataFrame, n: int = 5) -> DataFrame:
    """Signatures and sorted distinct shingle hashes of texts that come compressed, under the pair that names their row.

    The few texts that are needed get their signature anew: cheaper than to move all texts' signatures to them."""
    def scan(batches) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, hashes, texts = (batch.column(i) for i in range(3))
            for at in range(0, len(texts), 256):
                own = pa.array([unpress.decompress(t.as_py()) for t in texts[at:at + 256]], pa.large_binary())
                for part in slices(own):
                    found, first, _, _ = shingle_rows(part, n)
                    sets = [six_bytes(found[a:b]) for a, b in zip(first[:-1], first[1:])]
                    place = at + part.first
                    yield pa.RecordBatch.from_arrays([ids.slice(place, len(part)), hashes.slice(place, len(part)), signature_lists(minhash(found, first)),
                                                      pa.array(sets, pa.binary())], names=[ID, HASH, "signature", "shingles"])
        give_back()

    return packed.select(ID, HASH, "packed").mapInArrow(scan, f"{ID} BIGINT, {HASH} BIGINT, signature ARRAY<BIGINT>, shingles BINARY")


def least_agreement(threshold: float, tolerance: float) -> np.ndarray:
    """For 16, 32, ... values compared: the fewest agreements at which the posterior probability of a similarity of
    ``threshold`` is not below ``tolerance``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        k = np.arange(m + 1)[:, None]
        log = k * np.log(s) + (m - k) * np.log1p(-s)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        above = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(above >= tolerance)))
    return np.array(out)


def surviving(signs: np.ndarray, a: np.ndarray, b: np.ndarray, band: int, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) first agree on this band and are not pruned."""
    wide = signs.view(np.uint64)
    live = np.flatnonzero(wide[a, band] == wide[b, band])
    for k in range(band):
        live = live[wide[a[live], k] != wide[b[live], k]]
    agreed = np.zeros(len(live), np.int64)
    for step, low in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        agreed += (signs[a[live], part] == signs[b[live], part]).sum(axis=1)
        keep = agreed >= low
        live, agreed = live[keep], agreed[keep]
    return live


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact number of shingles that the sets of each pair share."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    # Many pairs among few sets: products of the incidence matrix, columns at a time; a shingle of one set adds nothing.
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros(len(a), np.float64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - at] = 1
        product = matrix @ matrix.T
        total += product[a, b]
    return np.rint(total).astype(np.int64)


def links(signs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, band: int, threshold: float,
          least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between members ``left`` and ``right`` (within ``left`` if None)."""
    found_a, found_b = [], []
    chunk = max(1, 200_000 // max(1, len(left if right is None else right)))
    for at in range(0, len(left), chunk):
        rows = np.arange(at, min(at + chunk, len(left)))
        if right is None:
            a, b = np.repeat(rows, len(left)), np.tile(np.arange(len(left)), len(rows))
            a, b = left[a[a < b]], left[b[a < b]]
        else:
            a, b = np.repeat(left[rows], len(right)), np.tile(right, len(rows))
        live = surviving(signs, a, b, band, least)
        found_a.append(a[live])
        found_b.append(b[live])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return a, b
    used = np.unique(np.concatenate([a, b]))
    shared = intersections([sets[i] for i in used], np.searchsorted(used, a), np.searchsorted(used, b))
    size = np.array([len(s) for s in sets])
    # The quotient as any reader would divide it: 4 of 5 is 0.8.
    near = shared / (size[a] + size[b] - shared) >= threshold
    return a[near], b[near]


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first member of each member's group, over links a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def members(batches) -> Iterator[tuple[tuple, list]]:
    """Rows of one unit at a time, from batches sorted by unit."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[:4] != key:
                if rows:
                    yield key, rows
                key, rows = row[:4], []
            rows.append(row[4:])
    if rows:
        yield key, rows
    give_back()


def distinct_sorted(rows: list) -> list:
    return [row for _, row in sorted({(r[0], r[1]): r for r in rows}.items())]


def _resolved(key: tuple, rows: list, threshold: float, least: np.ndarray):
    signs = np.array([r[3] for r in rows], np.int64).view(np.uint16)
    sets = [from_six_bytes(r[4]) for r in rows]
    block = np.array([r[2] for r in rows])
    _, band, i, j = key
    left = np.flatnonzero(block == i)
    return links(signs, sets, left, None if i == j else np.flatnonzero(block == j), band, threshold, least)


_LINKED = f"{ID} BIGINT, {HASH} BIGINT, links BIGINT, root_id BIGINT, root_hash BIGINT"
_PAIR = f"{ID} BIGINT, {HASH} BIGINT, other_id BIGINT, other_hash BIGINT"


def resolve(batches, threshold: float, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for every member of a unit that has a link in it: how many, and its group's smallest member."""
    for key, rows in members(batches):
        rows = distinct_sorted(rows)
        a, b = _resolved(key, rows, threshold, least)
        if len(a):
            count = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
            root = smallest_linked(len(rows), a, b)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), pa.array(count[some]),
                 pa.array([rows[i][0] for i in root[some]], pa.int64()), pa.array([rows[i][1] for i in root[some]], pa.int64())],
                names=[ID, HASH, "links", "root_id", "root_hash"])


def pairs(batches, threshold: float, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    for key, rows in members(batches):
        rows = distinct_sorted(rows)
        a, b = _resolved(key, rows, threshold, least)
        for at in range(0, len(a), 10_000):
            x, y = a[at:at + 10_000], b[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][k] for i in side], pa.int64()) for side in (x, y) for k in (0, 1)],
                                             names=[ID, HASH, "other_id", "other_hash"])


class Join:
    """The join's shared steps over one table of documents, each written once."""

    def __init__(self, docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6,
                 block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS):
        self.docs, self.n, self.threshold = docs, n, threshold
        self.block_docs, self.block_words = block_docs, block_words
        self.least = least_agreement(threshold, tolerance)
        self.signed = materialise(signatures(docs, n), "signatures")
        #: The smallest row of each word sequence stands for its copies; n_copies counts rows.
        self.copies = materialise(self.signed.where("n_words > 0").groupBy("s1", "s2").agg(
            F.min(F.struct(ID, HASH)).alias("rep"), F.min_by("signature", F.struct(ID, HASH)).alias("signature"),
            F.min("n_words").alias("n_words"), F.count("*").alias("n_copies")), "copies")

    def units(self) -> DataFrame:
        """(key, band, i, j, id, hash, block, signature, shingles): the members of every pair of blocks to be resolved."""
        reps = self.copies.select("rep.*", "n_words", "signature")
        banded = reps.select(ID, HASH, "n_words", F.posexplode("signature").alias("band", "value")).withColumn("band", F.col("band").cast("tinyint"))
        # Most values are one text's: they go by a count of values alone, before rows move.
        # Joins are merges at every size: none of these tables has a bound below which it could be sent to all tasks.
        often = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value")
        met = materialise(banded.join(often.hint("merge"), ["band", "value"], "left_semi"), "bucket-members")
        mark = F.xxhash64(ID, HASH).cast("decimal(38,0)")
        buckets = (met.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.sum(mark).alias("mark"),
                                                    F.min(F.struct(ID, HASH)).alias("least"))
                   .groupBy("n", "mark", "least").agg(F.min(F.struct("band", "value")).alias("b"), F.first("words").alias("words")))
        blocks = F.greatest(F.ceil(F.col("n") / self.block_docs), F.ceil(F.col("words") / self.block_words)).cast("int")
        buckets = buckets.select(F.col("b.band").alias("band"), F.col("b.value").alias("value"), blocks.alias("blocks"))
        placed = (met.join(buckets.hint("merge"), ["band", "value"])
                  .withColumn("block", F.pmod(F.xxhash64(F.lit(3), F.col(ID), F.col(HASH)), F.col("blocks")).cast("int")))
        placed = materialise(placed.select(ID, HASH, "band", "value", "block", "blocks"), "buckets")
        release(met)
        some = placed.select(ID, HASH).distinct().hint("merge")
        self.read = [placed]
        payload = materialise(shingle_sets(packed_texts(self.docs).join(some, [ID, HASH], "left_semi"), self.n), "shingle-sets")
        self.read.append(payload)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return (placed.select(ID, HASH, "band", "value", "block", other.alias("other"))
                .select(F.col("value").alias("key"), "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        ID, HASH, "block").join(payload.hint("merge"), [ID, HASH])
                .select("key", "band", "i", "j", ID, HASH, "block", "signature", "shingles")
                .repartition(parts(self.docs.sparkSession), "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j"))

    def linked(self) -> DataFrame:
        threshold, least = self.threshold, self.least
        linked = materialise(self.units().mapInArrow(lambda b: resolve(b, threshold, least), _LINKED), "linked")
        release(*self.read)
        return linked

    def pairs(self) -> DataFrame:
        threshold, least = self.threshold, self.least
        return self.units().mapInArrow(lambda b: pairs(b, threshold, least), _PAIR)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node linked to each, over edges (node, root); nodes are structs.

    Labels go over edges and are then followed once more, so that long chains halve; each round is a written table and
    only the number of changed labels comes back."""
    both = materialise(edges.select("node", "root").union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
                       .where(F.col("node") != F.col("root")).distinct(), "edges")
    labels = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        labels = materialise(labels, "labels")
        seen = both.join(labels.select(F.col("node").alias("root"), F.col("label").alias("theirs")), "root").groupBy("node").agg(F.min("theirs").alias("m"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("next"))
        step = materialise(near.join(far, "mid", "left").select("node", "old", F.coalesce("next", "mid").alias("label")), "labels")
        if not step.where(F.col("old") != F.col("label")).limit(1).count():
            return labels
        labels = step.select("node", "label")


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, **options) -> DataFrame:
    """For every distinct row of docs: id, text hash, ``rep`` (smallest copy), ``label`` (smallest of its group),
    n_copies, n_links (other texts of a similarity of ``threshold`` or more)."""
    join = Join(docs, threshold, n, **options)
    linked = join.linked()
    node = F.struct(F.col(ID), F.col(HASH))
    root = F.struct(F.col("root_id").alias(ID), F.col("root_hash").alias(HASH))
    labels = components(linked.select(node.alias("node"), root.alias("root")))
    counts = linked.groupBy(node.alias("rep")).agg(F.sum("links").alias("n_links"))
    reps = (join.copies.drop("signature", "n_words").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .select("s1", "s2", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("label", "rep").alias("label")))
    own = F.struct(F.col(ID), F.col(HASH))
    rows = join.signed.select(ID, HASH, F.when(F.col("n_words") > 0, F.col("s1")).alias("s1"), "s2").distinct()
    return (rows.join(reps, ["s1", "s2"], "left")
            .select(ID, HASH, F.coalesce("rep", own).alias("rep"), F.coalesce("label", own).alias("label"),
                    F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))


def class_digest(docs: DataFrame, threshold: float = 0.8, n: int = 5, **options) -> DataFrame:
    """doc_id, class_id (smallest id of its group), copy_id (smallest id of its copies), n_copies, n_links of every row."""
    found = classes(docs, threshold, n, **options)
    shown = lambda c: F.nullif(c, F.lit(NULL_ID))
    return (keyed(docs).select("doc_id", ID, HASH).join(found, [ID, HASH], "left")
            .select("doc_id", shown(F.col("label")[ID]).alias("class_id"), shown(F.col("rep")[ID]).alias("copy_id"), "n_copies", "n_links"))


def linked_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 5, **options) -> DataFrame:
    """Pairs of representatives (smallest ids of their copies) of a similarity of ``threshold`` or more."""
    return Join(docs, threshold, n, **options).pairs().select(F.col(ID).alias("doc_id"), F.col("other_id").alias("other_id"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """docs with the smallest document of each group, one row of it where rows repeat; columns as they are."""
    gone = classes(docs, threshold, n).where((F.col("label")[ID] != F.col(ID)) | (F.col("label")[HASH] != F.col(HASH)))
    left = keyed_whole(docs).join(gone.select(ID, HASH).hint("merge"), [ID, HASH], "left_anti")
    # The row kept of those that repeat id and text is the least by its other columns; a hot pair is combined map-side.
    rest = [F.to_json(F.struct(F.col(c).alias(f"c{i}")), {"ignoreNullFields": "false"}) for i, c in enumerate(docs.columns) if c != "text"]
    return left.groupBy(ID, HASH).agg(F.min_by(F.struct(*docs.columns), F.array(*rest)).alias("row")).select("row.*")
