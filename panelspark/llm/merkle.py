"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

Every row is a leaf; the leaves of a source in order of their ids form a tree of runs of 16, and the roots of the
sources, in order of their names, form one more.  Leaves are range partitioned into slices of bounded size.  A slice hashes
what lies wholly inside it and gives away the nodes of the runs that it shares with others; these few nodes, level
by level, make up the rest of each tree.  Then each slice works out the smallest set of node coordinates that it can't
derive from its own leaves (the octopus multiproof of all of them), fetches those once by a join, derives the interior
nodes that its leaves share, and expands every leaf's own proof where it is.  A source that holds most rows is many
slices; nothing but counts, slices and shared nodes moves after the leaves are in order.

Defined results: a null field is ``-``; a null source is a source of its own, before all; a null id comes
before all of its source; rows that share an id are in order of their digests, and rows that repeat wholly are leaves of
their own; a tree of one leaf is that leaf; no rows give no rows; other columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.rows import parts
from panelspark.llm.textbytes import give_back
from panelspark.scratch import materialise

ARITY = 16
SLICE_BITS = 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column] | None = None) -> Column:
    """The leaf of a row; ``fields`` replaces columns by other values."""
    values = {name: F.col(name) for name in FIELDS} | (fields or {})
    return F.sha2(F.concat(*(field(values[name]) for name in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, at, doc_id, leaf, changed): the tree's key, and the leaf that a row has after tampering (null: the same)."""
    lower = leaf_digest({"text": F.translate("text", UPPER, LOWER)})
    changed = F.when(tampered & F.col("text").isNotNull(), lower) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest().alias("leaf"), changed.alias("changed"))


class Forest:
    """Trees over ``rows`` (tree, leaf, and the columns of ``order``): slices, their spans, and the nodes that slices share."""

    def __init__(self, rows: DataFrame, order: list[str], slice_bits: int = SLICE_BITS):
        spark = rows.sparkSession
        keys = ["tree", *order, "leaf"]
        ranged = rows.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys)
        numbered = ranged.withColumn("number", F.monotonically_increasing_id())
        self.rows = materialise(numbered.withColumn("slice", F.shiftright("number", slice_bits)), "leaves")
        sizes = self.rows.groupBy("slice", "tree").agg(F.count("*").alias("n"))
        tree = W.partitionBy("tree")
        before = F.sum("n").over(tree.orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
        self.spans = materialise(sizes.withColumns({"start": F.coalesce(before, F.lit(0)), "width": F.sum("n").over(tree)}), "spans")
        self.nodes = self._shared_nodes()

    def _shared_nodes(self) -> DataFrame:
        """Nodes of runs that no slice holds whole, and each tree's root (``top``)."""
        fringe = materialise(self.rows.select("slice", "tree", "number", "leaf").groupBy("slice").cogroup(self.spans.groupBy("slice"))
                             .applyInArrow(_fringe, _NODE), "fringe")
        found, up = [fringe], None
        widest = self.spans.agg(F.max("width")).first()[0] or 1
        for level in range(_levels(widest)):
            here = fringe.where((F.col("level") == level) & ~F.col("top"))
            here = here if up is None else here.unionByName(up.where(~F.col("top")))
            run = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # 16 at most
            merged = here.groupBy("tree", "width", F.shiftright("idx", 4).alias("run")).agg(run.alias("nodes"))
            up = materialise(merged.select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("idx"),
                                           F.sha2(F.array_join("nodes.digest", "").cast("binary"), 256).alias("digest"), "width",
                                           (F.col("width") <= ARITY ** (level + 1)).alias("top")), "merged")
            found.append(up)
        nodes = found[0]
        for more in found[1:]:
            nodes = nodes.unionByName(more)
        return nodes

    def roots(self) -> DataFrame:
        """(tree, root) of every tree."""
        return self.nodes.where("top").select("tree", F.col("digest").alias("root"))

    def multiproofs(self) -> DataFrame:
        """(slice, tree, level, idx, digest): what each slice has to fetch, every node once."""
        wanted = self.spans.mapInArrow(_wanted, "slice BIGINT, tree STRING, level INT, idx BIGINT")
        return wanted.join(self.nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])

    def expanded(self, consumer, schema: str, roots: DataFrame, extra: list[str]) -> DataFrame:
        """Each slice's leaves with their proofs, through ``consumer``; ``roots`` has a row of further columns for each tree."""
        spans = self.spans.join(roots, "tree")
        fetched = self.multiproofs().withColumns({"n": F.lit(None).cast("bigint"), "start": F.lit(None).cast("bigint"), "width": F.lit(None).cast("bigint")})
        own = fetched.unionByName(spans, allowMissingColumns=True)
        rows = self.rows.select("slice", "tree", "number", "leaf", *extra)
        return rows.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(consumer, schema)


def _levels(width: int) -> int:
    levels = 0
    while width > 1:
        width, levels = -(-width // ARITY), levels + 1
    return levels


_NODE = "tree STRING, level INT, idx BIGINT, digest STRING, width BIGINT, top BOOLEAN"


def climb(nodes: list[str], start: int, width: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, idx, digest, top) of the nodes over consecutive leaves whose runs reach beyond them, and of the root."""
    level, lo = 0, start
    while nodes:
        if width == 1:
            yield level, 0, nodes[0], True
            return
        hi = lo + len(nodes)
        first, last = -(-lo // ARITY), -(-width // ARITY) if hi == width else hi // ARITY
        last = max(first, last)
        for i, node in enumerate(nodes, lo):
            if not first * ARITY <= i < last * ARITY:
                yield level, i, node, False
        nodes = [digest("".join(nodes[i:i + ARITY]).encode()) for i in range(first * ARITY - lo, min(last * ARITY, hi) - lo, ARITY)]
        level, lo, width = level + 1, first, -(-width // ARITY)


def _by_tree(rows: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """A slice's rows, tree by tree, in order."""
    rows = rows.sort_by("number")
    names = rows.column("tree").to_pylist()
    at = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield names[at], rows.slice(at, i - at)
            at = i


def _fringe(rows: pa.Table, spans: pa.Table) -> pa.Table:
    span = {s["tree"]: s for s in spans.to_pylist()}
    out = []
    for tree, own in _by_tree(rows):
        start, width = span[tree]["start"], span[tree]["width"]
        out += [(tree, level, idx, node, width, top) for level, idx, node, top in climb(own.column("leaf").to_pylist(), start, width)]
    columns = list(zip(*out)) or [()] * 6
    types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["tree", "level", "idx", "digest", "width", "top"])


def missing_nodes(known: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For any leaves of a tree, level by level, the nodes that their proofs need and they can't derive: an octopus multiproof."""
    level = 0
    while width > 1:
        above = np.unique(known // ARITY)
        children = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(children[children < width], known, assume_unique=True)
        known, width, level = above, -(-width // ARITY), level + 1


def _wanted(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for span in batch.to_pylist():
            for level, idx in missing_nodes(np.arange(span["start"], span["start"] + span["n"]), span["width"]):
                if len(idx):
                    n = len(idx)
                    yield pa.RecordBatch.from_arrays([pa.array([span["slice"]] * n, pa.int64()), pa.array([span["tree"]] * n), pa.array([level] * n, pa.int32()),
                                                      pa.array(idx, pa.int64())], names=["slice", "tree", "level", "idx"])


def interiors(nodes: list[str], start: int, width: int, fetched: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[bytes]]], str]:
    """The runs over consecutive leaves: on each level the first run's number and all runs' texts, and the root."""
    levels, lo = [], start
    while width > 1:
        first, hi, level = lo // ARITY, lo + len(nodes), len(levels)
        end = min(-(-hi // ARITY) * ARITY, width)
        whole = [fetched[level, i] for i in range(first * ARITY, lo)] + nodes + [fetched[level, i] for i in range(hi, end)]
        runs = ["".join(whole[i:i + ARITY]).encode() for i in range(0, len(whole), ARITY)]
        levels.append((first, runs))
        nodes = [digest(run) for run in runs]
        lo, width = first, -(-width // ARITY)
    return levels, nodes[0]


def path(levels: list[tuple[int, list[bytes]]], leaf: int) -> list[tuple[int, bytes]]:
    """A leaf's proof: on each level its place in its run, and the run's text."""
    out = []
    for first, runs in levels:
        out.append((leaf % ARITY, runs[leaf // ARITY - first]))
        leaf //= ARITY
    return out


def siblings(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join([run[:64 * at] + run[64 * at + 64:] for at, run in steps])


def fold(leaf: str, steps: list[tuple[int, bytes]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, run in steps:
        leaf = digest(run[:64 * at] + leaf.encode() + run[64 * at + 64:])
    return leaf


def _spanned(own: pa.Table) -> tuple[dict[str, dict], dict[str, dict]]:
    """A slice's spans by tree, and the nodes it fetched by tree, level and index."""
    spans, fetched = {}, {}
    for row in own.to_pylist():
        if row["n"] is not None:
            spans[row["tree"]] = row
        else:
            fetched.setdefault(row["tree"], {})[row["level"], row["idx"]] = row["digest"]
    return spans, fetched


_PATH = "name STRING, leaf STRING, root STRING, places ARRAY<INT>, runs ARRAY<STRING>"


def _paths(rows: pa.Table, own: pa.Table) -> pa.Table:
    """Proofs as columns, for trees whose leaves are few."""
    spans, fetched = _spanned(own)
    out = []
    for tree, group in _by_tree(rows):
        nodes, start = group.column("leaf").to_pylist(), spans[tree]["start"]
        levels, root = interiors(nodes, start, spans[tree]["width"], fetched.get(tree, {}))
        for i, (name, node) in enumerate(zip(group.column("name").to_pylist(), nodes), start):
            steps = path(levels, i)
            out.append((name, node, root, [at for at, _ in steps], [run.decode() for _, run in steps]))
    columns = list(zip(*out)) or [()] * 5
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["name", "leaf", "root", "places", "runs"])


_PROOF = "doc_id BIGINT, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN"


def _verify(rows: pa.Table, own: pa.Table) -> pa.Table:
    """Every leaf's own proof, hashed and folded to the root of all sources."""
    spans, fetched = _spanned(own)
    out = []
    for tree, group in _by_tree(rows):
        span, nodes = spans[tree], group.column("leaf").to_pylist()
        levels, subroot = interiors(nodes, span["start"], span["width"], fetched.get(tree, {}))
        if subroot != span["subroot"]:
            raise RuntimeError("a slice's leaves and what it fetched don't give its tree's root")
        top = [(at, run.encode()) for at, run in zip(span["places"], span["runs"])]
        run_number, above, tail = -1, [], b""
        for i, (doc_id, leaf, changed) in enumerate(zip(group.column("doc_id").to_pylist(), nodes, group.column("changed").to_pylist()), span["start"]):
            if i // ARITY != run_number:  # the leaves of a run share all steps but the first
                run_number = i // ARITY
                steps = path(levels, i)
                above = steps[1:] + top
                tail = siblings(above)
            first = [(i % ARITY, steps[0][1])] if steps else []
            folded = fold(changed or leaf, first + above)
            out.append((doc_id, leaf, subroot, span["root"], digest(siblings(first) + tail), folded, folded == span["root"]))
    columns = list(zip(*out)) or [()] * 7
    types = (pa.int64(), *([pa.string()] * 5), pa.bool_())
    table = pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                     names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    give_back()
    return table


def manifest(docs: DataFrame, tampered: Column | None = None, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Each row's leaf, the roots over it, the digest of its proof, and whether the row folds to the root.

    ``tampered`` marks rows whose text is lower-cased before they are checked against the manifest."""
    forest = Forest(materialise(leaves(docs, tampered), "hashed"), ["doc_id"], slice_bits)
    subroots = materialise(forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf")), "subroots")
    sources = Forest(subroots, ["name"], slice_bits)
    whole = sources.expanded(_paths, _PATH, sources.roots(), ["name"])
    tops = materialise(whole.select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "root", "places", "runs"), "source-paths")
    return forest.expanded(_verify, _PROOF, tops, ["doc_id", "changed"])


def merkle_digest(docs: DataFrame, slice_bits: int = SLICE_BITS) -> DataFrame:
    """The manifest of docs, checked against rows of which a fifth (by the checksum of their ids) are tampered with."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return manifest(docs, crc % 5 == 0, slice_bits)
