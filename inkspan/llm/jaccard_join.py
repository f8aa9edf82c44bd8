"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashed five-word shingles, sketched by ``COORDS`` minwise tokens: two sets share the token of a
coordinate with a probability equal to their similarity. Each run starts with all sets at a root and splits them
recursively: a node of the path draws one coordinate, and with chance 1/4 a second, from a hash of the path, and every set
goes on to the child that its own token of that coordinate names. Sets that share no token part at once. Nodes of at most
``leaf`` sets are compared by brute force, larger ones split again, up to ``depth`` times. What is still larger then are mostly
sets alike, which no split parts: ``FIRST`` runs compare them in blocks, pair of blocks by pair of blocks, and close what they find to
components; in the other runs a large node is left out if all of it lies in one component already, and else only its smaller
components are compared, with all of it. So no case is dropped, and sets that are known to be connected are not compared again.
Runs repeat until the chance that a pair at the threshold met nowhere is below ``1 - recall``.

Brute force in a leaf compares sketches and keeps links of estimate ``THRESHOLD - 4 sigma`` or more, as a forest. Components
of these candidate links are then verified as a whole on the texts: within a component all pairs are counted exactly, as a
matrix product of incidence blocks, so a pair that met in no leaf still counts if other links connect it. A component of more
than ``BLOCK`` sets is verified by differences: each text is shingled once, only what its set differs in from one member's goes
to pairs of blocks, and the intersection of two sets follows from that of their differences. Documents with equal shingle sets
are one node throughout and are never expanded into pairs.

Words are those of the pattern ``[^\\x20\\x09-\\x0D]+``, unchanged. A document of 1 to 4 words has one shingle; one without
words, or null, has none: it links to nothing and is a class of its own. Rows that repeat an id or a text are documents of
their own; class_id is the least id in the class (null only if no member has an id). An empty table gives an empty one.

At scale: the texts are scanned once for sketches and exchanged once to verify candidates; all else is narrow. Nothing is
collected but row counts and checksums. Counts are dealt anew before they are joined back, so that adaptive execution can
split these joins at a hot key. Node sizes are known before rows are gathered, so no task gets more than two blocks. A
difference is copied ``COPIES`` times, up to components of ``COPIES * LARGEST`` sets; beyond that once for each ``LARGEST`` of them, which counting the links of all pairs needs
if a task's memory is to be bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C
from .components import components

COORDS, SHINGLE, THRESHOLD = 64, 5, 0.8
DEPTH, LEAF, RECALL = 3, 200, 0.9999
#: Sets in a block of a node that is still large at the last level, and documents in a block of the exact check.
SKETCH_BLOCK, BLOCK = 1000, 256
#: Blocks that a large component is cut into, if these hold between SMALLEST and LARGEST sets.
COPIES, SMALLEST, LARGEST = 32, 64, 4096
#: Runs that compare all of a large node.
FIRST = 3
#: Low bits of a path that name its run.
_RUN = np.uint64(63)
_U = np.uint64
_SCALE = C.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_SHIFT = C.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def runs_for(recall: float, depth: int, threshold: float) -> int:
    """Runs until a pair at ``threshold``, which survives ``depth`` splits with at least threshold**depth, has met with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def _nodes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets, which are not empty, and a hash of each of those as a whole."""
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    sums = np.add.reduceat(C.mix(values ^ _U(0x5851F42D4C957F2D)), first[some]) if len(some) else np.zeros(0, np.uint64)
    return sizes, some, C.mix(sums + sizes[some].astype(np.uint64))


def _sketches(key: str, text: str, shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text):
                values, first = C.shingle_sets(C.Words(part.column(text)), shingle)
                sizes, some, nodes = _nodes(values, first)
                sketch = np.empty((len(some), COORDS), np.uint64)
                for c in range(COORDS if len(some) else 0):
                    sketch[:, c] = np.minimum.reduceat(values * _SCALE[c] + _SHIFT[c], first[some])
                node = np.zeros(part.num_rows, np.int64)
                node[some] = nodes.view(np.int64)
                packed = np.zeros((part.num_rows, COORDS), np.uint64)
                packed[some] = sketch
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("text_hash"), pa.array(node), pa.array(sizes.astype(np.int64)), pa.array([x if n else None for x, n in zip(map(bytes, packed), sizes.tolist(), strict=True)], pa.binary())], names=[key, "text_hash", "node", "n", "sketch"])

    return run


def _tokens(column: pa.Array) -> np.ndarray:
    """The sketches of a chunk as a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, COORDS)


def _children(paths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): one coordinate for each row, drawn by its path, and for a quarter of the paths another."""
    draw = C.mix(paths ^ _U(0x2545F4914F6CDD1D))
    rows, a = np.arange(len(paths)), (draw % _U(COORDS)).astype(np.int64)
    b = ((draw >> _U(20)) % _U(COORDS)).astype(np.int64)
    two = np.flatnonzero(((draw >> _U(40)) & _U(3) == 0) & (a != b))
    rows, coord = np.concatenate([rows, two]), np.concatenate([a, b[two]])
    child = C.mix(paths[rows] * _U(0x9FB21C651E98DF25) + C.mix(sketch[rows, coord] + coord.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    return rows, child & ~_RUN | paths[rows] & _RUN


def _roots(runs: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sketch, node = _tokens(part.column("sketch")), np.asarray(part.column("node"))
                for r in range(runs):
                    rows, child = _children(C.mix(np.full(len(node), r + 1, np.uint64)) & ~_RUN | _U(r % 64), sketch)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[rows])], names=["path", "node"])

    return run


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            node = np.asarray(part.column("node"))
            rows, child = _children(np.asarray(part.column("path")).view(np.uint64), _tokens(part.column("sketch")))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[rows])], names=["path", "node"])


def _gathered(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 1 << 14) -> Iterator[pa.Table]:
    """Sorted batches, cut anew so that no group by ``by`` is torn; each table holds whole groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        cut = _starts(table, by)[-1]
        if cut:
            yield table.slice(0, cut)
            # a slice keeps the whole batch alive, so its rows are copied
            held = table.slice(cut).take(pa.array(np.arange(table.num_rows - cut))).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for c in by:
        x = np.asarray(C.to_array(table.column(c)))
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _forest(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For n vertices and links i-j, of each vertex the vertex of least ``rank`` in its component."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    label, i, j = np.arange(n), place[i], place[j]
    while len(i):
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == old).all() and (label[i] == label[j]).all():
            break
    return order[label[place]]


#: Groups of more rows are compared column by column of their marks, smaller ones all at once.
_MANY = 48


def _alike_in_group(marks: np.ndarray, size: np.ndarray, minor: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """(minor rows x all rows): which pairs have ``least`` marks in common and sizes that allow the threshold."""
    by_column = np.ascontiguousarray(marks.T)
    out = np.empty((len(minor), len(marks)), bool)
    for at in range(0, len(minor), 512):
        rows = minor[at : at + 512]
        same = np.zeros((len(rows), len(marks)), np.uint8)
        for c in by_column:
            same += c[rows][:, None] == c[None, :]
        small, large = np.minimum(size[rows][:, None], size[None, :]), np.maximum(size[rows][:, None], size[None, :])
        out[at : at + 512] = (same >= least) & (small >= threshold * large - 1e-9)
    return out


def _least(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each column of ``links``, whose row r stands for column rows[r], the least column of its component."""
    n = links.shape[1]
    label = np.arange(n, dtype=np.int32)
    while True:
        old = label.copy()
        label[rows] = np.minimum(label[rows], np.where(links, label[None, :], n).min(axis=1, initial=n))
        label = np.minimum(label, np.where(links, label[rows][:, None], n).min(axis=0, initial=n))
        label = label[label]
        if (label == old).all():
            return label


def _alike(threshold: float) -> Callable:
    """Candidate links within sorted groups (path, pair): a forest of (u, v). Pairs without a ``minor`` row are left out.

    The group of two different blocks leaves out what the groups of each block alone say, so the rows of a large node go as
    its size, not as its size times its blocks.
    """
    least = max(1, math.ceil(COORDS * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, ["path", "pair"]):
            node, size = np.asarray(C.to_array(table.column("node"))), np.asarray(C.to_array(table.column("n")))
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, COORDS)
            start = _starts(table, ["path", "pair"])
            length = np.diff(np.append(start, table.num_rows))
            minor = np.asarray(C.to_array(table.column("minor")).to_numpy(zero_copy_only=False), bool)
            block = np.asarray(C.to_array(table.column("block")))
            cross = np.maximum.reduceat(block, start) != np.minimum.reduceat(block, start)
            left, right, u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], node.copy(), node.copy()
            for m in np.unique(length[length > 1]).tolist():
                of = start[length == m]
                if m > _MANY:
                    for at in of.tolist():
                        # in the order of nodes, so that the least row is the least node
                        rows = at + np.argsort(node[at : at + m], kind="stable")
                        few = np.flatnonzero(minor[rows])
                        links = _alike_in_group(marks[rows], size[rows], few, threshold, least)
                        v[rows] = node[rows[_least(links, few)]]
                        if block[at : at + m].min() != block[at : at + m].max():
                            u[rows] = node[rows[_least(links & (block[rows[few]][:, None] == block[rows][None, :]), few)]]
                    continue
                i, j = np.triu_indices(m, 1)
                for at in np.array_split(of, max(1, len(of) * len(i) // 100_000)):
                    a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                    ok = (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9) & (minor[a] | minor[b])
                    a, b = a[ok], b[ok]
                    ok = np.count_nonzero(marks[a] == marks[b], axis=1) >= least
                    left.append(a[ok])
                    right.append(b[ok])
            a, b = np.concatenate(left), np.concatenate(right)
            own = block[a] == block[b]
            few = np.repeat(length <= _MANY, length)
            u[few] = np.where(np.repeat(cross, length), node[_forest(len(node), a[own], b[own], node)], node)[few]
            v[few] = node[_forest(len(node), a, b, node)][few]
            u, v = np.unique(np.stack([u, v])[:, u != v], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _intersections(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence blocks."""
    n = len(first) - 1
    of = np.repeat(np.arange(n), np.diff(first))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    of, column = of[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    out, width = np.zeros((n, n)), 4096
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        m[of[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _counted(node: np.ndarray, block: np.ndarray, copies: np.ndarray, sizes: np.ndarray, both: np.ndarray, threshold: float) -> tuple:
    """(node, root, links) of a group, given the sizes of all intersections; of two different blocks only what lies across counts."""
    links = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(links, False)
    if len(np.unique(block)) > 1:
        links &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(links))
    return node, node[_forest(len(node), i, j, node)], links @ copies


def _batch_of(found: list[tuple]) -> pa.RecordBatch:
    """found: (comp, blocks, node, root, links) of groups."""
    sizes = [len(x[2]) for x in found]
    comp, multi = (np.repeat(np.array([x[c] for x in found]), sizes) for c in (0, 1))
    node, root, n = (np.concatenate(x) for x in list(zip(*found, strict=True))[2:])
    return pa.RecordBatch.from_arrays([pa.array(comp), pa.array(multi.astype(np.int32)), pa.array(node), pa.array(root), pa.array(n.astype(np.int64))], names=["comp", "blocks", "node", "root", "links"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[list[pa.Table]]:
    for table in _gathered(batches, by, most=most):
        start = _starts(table, by).tolist()
        yield [table.slice(lo, hi - lo) for lo, hi in zip(start, [*start[1:], table.num_rows], strict=True)]


def _column(part: pa.Table, name: str) -> np.ndarray:
    return np.asarray(C.to_array(part.column(name)))


def _verify(text: str, shingle: int, threshold: float) -> Callable:
    """All pairs of a component of at most BLOCK sets, from the texts, or of two blocks of a larger one, from differences.

    If A and B differ from R in a and b, A and B share R less what either misses, which with what both add is
    |R| - miss(a) - miss(b) + |a and b|.
    """

    def by_texts(part: pa.Table) -> tuple:
        node, copies = _column(part, "node"), _column(part, "n_docs")
        values, first = C.shingle_sets(C.Words(C.to_array(part.column(text))), shingle)
        sizes, some, nodes = _nodes(values, first)
        own = np.zeros(len(node), np.int64)
        own[some] = nodes.view(np.int64)
        # a row whose text only shares the hash of the one meant goes
        one = np.flatnonzero(own == node)
        if len(one) < len(node):
            values = np.concatenate([values[:0], *[values[first[d] : first[d + 1]] for d in one]])
            node, copies, sizes = node[one], copies[one], sizes[one]
            first = np.concatenate([[0], np.cumsum(sizes)])
        return _counted(node, np.zeros(len(node)), copies, sizes, _intersections(values, first), threshold)

    def by_differences(part: pa.Table) -> tuple:
        node, block, copies, miss, ref, n = (_column(part, c) for c in ("node", "block", "n_docs", "miss", "ref", "n"))
        raw = part.column("d").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
        both = ref[0] - miss[:, None] - miss[None, :] + _intersections(np.frombuffer(b"".join(raw), np.uint64), first)
        return _counted(node, block, copies, n, both, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches, ["comp", "pair"], 512):
            yield _batch_of([(_column(p, "comp")[0], _column(p, "blocks")[0], *(by_differences(p) if p.column("d")[0].is_valid else by_texts(p))) for p in parts])

    return run


def _set_rows(text: str, shingle: int) -> Callable:
    """The shingle set of each text, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text):
                values, first = C.shingle_sets(C.Words(part.column(text)), shingle)
                _, some, nodes = _nodes(values, first)
                own = np.zeros(part.num_rows, np.int64)
                own[some] = nodes.view(np.int64)
                at = pa.array(np.flatnonzero(own == np.asarray(part.column("node"))))
                sets = [values[first[d] : first[d + 1]].tobytes() for d in at.to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in ("comp", "node", "n_docs", "size")], pa.array(sets, pa.binary())], names=["comp", "node", "n_docs", "size", "set"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set: what it and the reference do not share, how much of that is the reference's, and both sizes."""
    for batch in batches:
        rows = []
        for own, ref in zip(batch.column("set").to_pylist(), batch.column("ref").to_pylist(), strict=True):
            a, b = np.frombuffer(own, np.uint64), np.frombuffer(ref or b"", np.uint64)
            d = np.setxor1d(a, b, assume_unique=True)
            rows.append((d.tobytes(), (len(d) + len(b) - len(a)) // 2, len(b), len(a)))
        d, miss, ref, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("comp", "node", "n_docs", "size")], pa.array(d, pa.binary()), *[pa.array(x, pa.int64()) for x in (miss, ref, n)]], names=["comp", "node", "n_docs", "size", "d", "miss", "ref", "n"])


def _in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for each pair of blocks that its block is in."""
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    df = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("pair", (F.least("block", "__o") * F.col("blocks") + F.greatest("block", "__o")).cast("long")).drop("__o")


def blocks_of(size: Column) -> Column:
    """Into how many blocks a large component is cut, which is how often a set's differences are copied."""
    return F.greatest(F.least(F.ceil(size / SMALLEST), F.lit(COPIES)), F.ceil(size / LARGEST))


def _rest_of_large(large: DataFrame, known: DataFrame) -> DataFrame | None:
    """Of large nodes (path, node), what components (node, root) leave open: (path, pair, block, node, minor); None if nothing.

    Nodes within one component go. Of others the largest component is not compared with itself: the rest is cut into blocks, and
    these meet each other and the blocks of the largest one.
    """
    named = C.durable(large.select("path", "node").join(known.withColumnRenamed("root", "label"), "node", "left").select("path", "node", F.coalesce("label", "node").alias("label")))
    per = named.groupBy("path", "label").agg(F.count(F.lit(1)).alias("c"))
    facts = C.durable(per.groupBy("path").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("c"), F.sum("c").alias("total")).where("c < total"))
    if facts.isEmpty():
        return None
    n_minor, n_major = F.ceil((F.col("total") - F.col("c")) / SKETCH_BLOCK).cast("int"), F.ceil(F.col("c") / SKETCH_BLOCK).cast("int")
    rows = named.join(facts.select("path", "major", n_minor.alias("n0"), n_major.alias("n1")), "path")
    minor = F.col("label") != F.col("major")
    rows = rows.withColumn("block", F.when(minor, F.pmod(F.xxhash64("node"), F.col("n0"))).otherwise(F.col("n0") + F.pmod(F.xxhash64("node"), F.col("n1"))).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("n0") + F.col("n1")).otherwise(F.col("n0")) - 1)))
    return rows.withColumn("minor", minor).select("path", "minor", (F.least("block", "__o") * (F.col("n0") + F.col("n1")) + F.greatest("block", "__o")).cast("long").alias("pair"), "block", "node")


def _with_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) closed over more links: those between different components, as a rule few or none, are closed
    first, between roots, and roots renamed by what that gives."""
    found = links.join(comps.toDF("u", "a"), "u", "left").join(comps.toDF("v", "b"), "v", "left")
    new = C.durable(found.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v").distinct())
    if new.isEmpty():
        return comps
    above = C.durable(components(new))
    renamed = comps.join(above.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # nodes that were in no component so far
    return C.durable(renamed.unionByName(above.join(comps, "node", "left_anti")))


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, depth: int = DEPTH, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (the least id among documents that links connect), n_links (other documents
    of similarity ``threshold`` or more, copies included), n_copies (documents with the same shingles, itself included), and
    for :func:`keep_one` class_key (the class, whatever its ids; null without words) and text_hash."""
    key = "__key"
    narrow = docs.select(F.col(doc_id).cast("long").alias(key), F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("text_hash"))
    members = C.durable(narrow.mapInArrow(_sketches(key, "__text", shingle), f"{key} long, text_hash long, node long, n long, sketch binary"))
    sets = C.durable(members.where("n > 0").groupBy("node").agg(F.min(key).alias("rep"), F.min(F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("id"), F.col("text_hash").alias("hash"))).alias("row"), F.count(F.lit(1)).alias("n_docs"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    rows = sets.select("node", "sketch").mapInArrow(_roots(runs_for(recall, depth, threshold)), "path long, node long")
    leaves = []
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        level_rows = C.durable(rows.join(sizes.hint("rebalance"), "path"))
        leaves.append(level_rows if level == depth else level_rows.where(F.col("size") <= leaf))
        large = level_rows.where(F.col("size") > leaf)
        if level == depth or large.isEmpty():
            break
        rows = large.select("path", "node").join(sets.select("node", "sketch"), "node").mapInArrow(_splits, "path long, node long")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    marks = sets.select("node", "n", "sketch").mapInArrow(_marks, "node long, n long, marks binary")

    def compared(placed: DataFrame) -> DataFrame:
        """Candidate links of rows (path, pair, block, node, minor)."""
        dealt = placed.join(marks, "node").repartition("path", "pair").sortWithinPartitions("path", "pair")
        return dealt.select("path", "pair", "block", "node", "minor", "n", "marks").mapInArrow(_alike(threshold), "u long, v long")

    # nodes that were still large at the last level: some runs compare them, the others what that leaves open
    later = (F.col("size") > leaf) & (F.col("path").bitwiseAND(int(_RUN)) >= FIRST)
    links = compared(_in_blocks(every.where(~later), F.ceil(F.col("size") / SKETCH_BLOCK)).withColumn("minor", F.lit(True)))
    comps = C.durable(components(links))
    large = every.where(later)
    rest = None if large.isEmpty() else _rest_of_large(large, comps)
    if rest is not None:
        comps = _with_links(comps, compared(rest))
    comps = comps.withColumnRenamed("root", "comp")

    sized = comps.join(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).hint("rebalance"), "comp").join(sets.select("node", "row.id", "row.hash", "n_docs"), "node")
    # rows that repeat the representative, id and text, are one before they are gathered
    texts = C.durable(narrow.join(sized.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).dropDuplicates(["node"]).select("comp", "node", "n_docs", "size", "__text"))
    small = texts.where(F.col("size") <= BLOCK).select("comp", F.lit(0).cast("long").alias("pair"), F.lit(1).alias("blocks"), F.lit(0).alias("block"), "node", "n_docs", "__text", *[F.lit(None).cast(k).alias(c) for c, k in (("d", "binary"), ("miss", "long"), ("ref", "long"), ("n", "long"))])
    checked = small
    big = texts.where(F.col("size") > BLOCK)
    if not big.isEmpty():
        shingled = C.durable(big.mapInArrow(_set_rows("__text", shingle), "comp long, node long, n_docs long, size long, set binary"))
        # a component is named by one of its members, whose set is the reference; a large one's rows are dealt by salt
        salts = F.ceil(F.col("size") / LARGEST).cast("int")
        refs = shingled.where("node = comp").select("comp", F.col("set").alias("ref"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        salted = shingled.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).join(refs, ["comp", "salt"], "left")
        differing = C.durable(salted.select("comp", "node", "n_docs", "size", "set", "ref").mapInArrow(_differences, "comp long, node long, n_docs long, size long, d binary, miss long, ref long, n long"))
        checked = checked.unionByName(_in_blocks(differing, blocks_of(F.col("size"))).withColumn("__text", F.lit(None).cast("string")).select(*small.columns))
    dealt = checked.repartition("comp", "pair").sortWithinPartitions("comp", "pair")
    exact = dealt.mapInArrow(_verify("__text", shingle, threshold), "comp long, blocks int, node long, root long, links long")
    exact = C.durable(exact)
    counts = exact.groupBy("node").agg(F.sum("links").alias("links"))
    roots = exact.where("blocks = 1").select("node", "root")
    across = exact.where("blocks > 1 and root <> node").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not across.isEmpty():
        roots = roots.unionByName(components(across))
    facts = sets.select("node", "rep", "n_docs").join(roots, "node", "left").join(counts, "node", "left")
    facts = facts.select("node", F.coalesce("root", "node").alias("root"), "rep", "n_docs", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    classes = facts.groupBy("root").agg(F.min("rep").alias("class_id"))
    facts = facts.join(classes.hint("rebalance"), "root").select("node", "root", "class_id", "n_links", "n_docs")
    own = F.col(key)
    out = members.select(key, "text_hash", "node", "n").join(facts, "node", "left")
    return out.select(own.alias(doc_id), F.when(F.col("n") > 0, F.col("class_id")).otherwise(own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.when(F.col("n") > 0, F.col("n_docs")), F.lit(1)).cast("long").alias("n_copies"), F.when(F.col("n") > 0, F.col("root")).alias("class_key"), "text_hash")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each token: enough to estimate similarity."""
    for batch in batches:
        if batch.num_rows:
            marks = (C.mix(_tokens(batch.column("sketch"))) & _U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array([bytes(x) for x in marks], pa.binary())], names=["node", "n", "marks"])


def keep_one(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of ``docs``, one row of each class in ``found``: that of the least id (null last), then text hash. Rows without words all stay."""
    id_, hash_ = C.free_name(docs, "__id"), C.free_name(docs, "__hash")
    order = F.struct(F.col(doc_id).isNull().alias("x"), F.col(doc_id).alias("id"), F.col("text_hash").alias("hash"))
    of_class = found.where("class_key is not null").groupBy("class_key").agg(F.min(order).alias("m")).select("m.id", "m.hash")
    wordless = found.where("class_key is null").select(F.col(doc_id).alias("id"), F.col("text_hash").alias("hash")).distinct()
    hashed = docs.withColumn(hash_, F.xxhash64(F.col(text)))

    def among(chosen: DataFrame) -> DataFrame:
        named = chosen.toDF(id_, hash_ + "2")
        match = F.col(doc_id).cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(hash_ + "2"))
        return hashed.join(named.hint("shuffle_hash"), match).drop(id_, hash_ + "2")

    repeated = found.where("class_key is not null").groupBy(doc_id, "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return among(of_class.unionByName(wordless)).drop(hash_)
    # some rows repeat both id and text: of these, one stays
    return among(of_class).dropDuplicates([doc_id, hash_]).unionByName(among(wordless)).drop(hash_)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(C.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_key", "text_hash")


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, md5(array_to_string(words[i:i + 4], ' ')) as h from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b, c, x.n as na, y.n as nb from pairs join n x on x.doc_id = a join n y on y.doc_id = b where c * 5 >= (x.n + y.n - c) * 4),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join link l on r.b = l.a),
cls as (select a as doc_id, min(b) as class_id from reach group by a),
cnt as (select a as doc_id, count(*) as n_links, 1 + count(*) filter (where c = na and c = nb) as n_copies from link group by a)
select d.doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(n_copies, 1)::bigint as n_copies from documents d join cls using (doc_id) left join cnt using (doc_id)
"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join}
SQL = {"op6_jaccard_join": OP6_SQL}
