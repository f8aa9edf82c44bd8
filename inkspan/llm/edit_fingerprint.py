"""Document fingerprints by randomised edit embedding.

A pointer walks over the characters of a text. At step j it stays or moves on, as a random function that all texts share
says for (j, character): a hash of the two, so steps never repeat and every character is its own. The embedding's j-th symbol
is what stands at the pointer. Texts a small edit distance apart fall into step again soon after each edit, so the Hamming
distance of their embeddings follows their edit distance.

The fingerprint samples the embedding at fixed places: up to ``PER_OCTAVE`` in each octave [2**k, 2**(k + 1)), over the
whole walk, however long. A sample is one hexadecimal digit: a hash of the ``GRAM`` characters from the pointer on, or 0
where the text has ended (these are left out at the end). Likeness weighs each octave's agreement by the embedded symbols
it stands for, less what chance would give, so it estimates the share of the embedding that two texts have in common.

Walks go in step over thousands of texts at once; the last few, longest texts of a chunk are walked one by one.

:func:`fingerprint_pairs` gives each document the next one by id, at the cost of one exchange of the texts: ids alone are
dealt into ranges first (of id, then of a hash of the text, so rows of one id or none are no group), and the first document of
each range is also sent to the range before it. :func:`near_groups` samples places of the fingerprints for bands and verifies
all that share one; the query ``near_fingerprints`` applies it to all documents.

Defined results: null texts count as empty; an empty text has the empty fingerprint, which is like another empty one (1.0)
and unlike all others (0.0). Null ids come first; rows that share an id are ordered by a hash of their text. The only
document is its own next one. An empty table gives an empty table; of the input only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C
from .components import components

PER_OCTAVE, OCTAVES, GRAM, SEED = 32, 40, 4, 11
#: Steps whose moves are made at once, for all characters of a chunk.
STEPS = 256
CHUNK = 6 << 20
_LANES = 48
#: Nodes of a band that are compared at once.
BLOCK = 256
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_VALUES = np.zeros(256, np.uint8)
_VALUES[_DIGITS] = np.arange(16)


def _plan() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places in order, the octave of each, and how many each octave has."""
    rng = np.random.default_rng(SEED)
    places, octave = [np.array([0])], [np.array([0])]
    for k in range(1, OCTAVES):
        n = min(PER_OCTAVE, 1 << k)
        got = np.arange(1 << k) if n == 1 << k else np.unique(rng.integers(0, 1 << k, 4 * n))
        got = np.sort(rng.permutation(got)[:n])
        places.append((1 << k) - 1 + got)
        octave.append(np.full(len(got), k))
    octave_of = np.concatenate(octave)
    return np.concatenate(places), octave_of, np.bincount(octave_of, minlength=OCTAVES)


PLACES, OCTAVE_OF, OCTAVE_SIZE = _plan()


def moves(step: int, n: int, alphabet: np.ndarray) -> np.ndarray:
    """For n steps from ``step`` on, and each character (0: a text's end, which never moves), 0 or 1."""
    steps = C.mix(np.arange(step, step + n, dtype=np.uint64) + np.uint64((SEED + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = (C.mix(steps[:, None] ^ C.mix(alphabet.astype(np.uint64))[None, :]) >> np.uint64(63)).astype(np.uint8)
    out[:, alphabet == 0] = 0
    return out


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """Fingerprints of texts, given as arrays of code points."""
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts], np.int64)
    size = int(lengths.sum()) + len(texts)
    points = np.zeros(size + GRAM, np.uint32)
    first = np.cumsum(lengths + 1) - lengths - 1
    for t, at in zip(texts, first.tolist(), strict=True):
        points[at : at + len(t)] = t + np.uint32(1)
    ends = first + lengths
    # characters are numbered within the chunk; the end is number 0
    seen = np.zeros(0x110001, bool)
    seen[points] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110001, np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    cls = number[points]
    if len(alphabet) <= 256:
        cls = cls.astype(np.uint8)
    # the gram's characters after a text's end count as nothing: each document's last ones are made anew below
    grams = np.zeros(size, np.uint32)
    for g in range(GRAM):
        grams = (grams * np.uint32(0x01000193)) ^ (points[g : g + size] * np.uint32(0x9E3779B1))
    for back in range(1, GRAM):
        at = (ends - back)[lengths >= back]
        value = np.zeros(len(at), np.uint32)
        for g in range(GRAM):
            value = (value * np.uint32(0x01000193)) ^ ((points[at + g] if g < back else np.zeros(len(at), np.uint32)) * np.uint32(0x9E3779B1))
        grams[at] = value
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x85EBCA6B)
    symbols = ((grams >> np.uint32(16)) % np.uint32(15) + np.uint32(1)).astype(np.uint8)
    symbols[ends] = 0
    del points, grams, number, seen

    # a walk has about two steps a character; room is added for those that take more
    out = np.zeros((len(texts), int(np.searchsorted(PLACES, 3 * int(lengths.max()) + STEPS))), np.uint8)
    active = np.argsort(-lengths, kind="stable")
    active = active[lengths[active] > 0]
    pos = first[active].astype(np.int64)
    step, sample = 0, 0
    while len(active) > _LANES:
        table = moves(step, STEPS, alphabet)
        for row in table:
            if PLACES[sample] == step:
                if sample == out.shape[1]:
                    out = np.pad(out, ((0, 0), (0, PER_OCTAVE)))
                out[active, sample] = symbols[pos]
                sample += 1
            pos += row.take(cls.take(pos))
            step += 1
        going = cls.take(pos) > 0
        active, pos = active[going], pos[going]
    alone = {lane: _alone(cls, symbols, alphabet, at, step, sample) for lane, at in zip(active.tolist(), pos.tolist(), strict=True)}
    fit = out.shape[1] - np.argmax(out[:, ::-1] > 0, axis=1) if out.shape[1] else np.zeros(len(texts), np.int64)
    fit[~out.any(axis=1)] = 0
    digits = _DIGITS[out]
    return [digits[i, : fit[i]].tobytes().decode() if i not in alone else (digits[i, :sample].tobytes() + _DIGITS[alone[i]].tobytes()).decode() for i in range(len(texts))]


def _alone(cls: np.ndarray, symbols: np.ndarray, alphabet: np.ndarray, start: int, step: int, sample: int) -> list[int]:
    """The symbols sampled in the rest of one text's walk, from ``start`` at ``step``."""
    stop = start + int(np.argmin(cls[start:] > 0))
    kinds, own = np.unique(cls[start : stop + 1], return_inverse=True)
    width, of = len(kinds), alphabet[kinds]
    own = own.astype(np.uint8).tobytes() if width <= 256 else own.tolist()
    most = max(64, (1 << 20) // width)
    out, at, end = [], 0, len(own) - 1
    table, begin, upto = b"", step, step
    while at < end:
        to = int(PLACES[sample])
        while step < to and at < end:
            if step == upto:
                begin, upto = step, step + most
                table = moves(step, most, of).tobytes()
            run = min(to, upto)
            for b in range((step - begin) * width, (run - begin) * width, width):
                at += table[b + own[at]]
            step = run
        if at >= end:
            break
        out.append(int(symbols[start + at]))
        sample += 1
    return out


def likeness(a: str, b: str) -> float:
    """From 0 to 1: about the share of the longer text's embedding that both texts have in common."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.frombuffer(a.ljust(n, "0").encode(), np.uint8)
    y = np.frombuffer(b.ljust(n, "0").encode(), np.uint8)
    some = (x != 48) | (y != 48)
    octave = OCTAVE_OF[:n]
    of = np.bincount(octave[some], minlength=OCTAVES)
    same = np.bincount(octave[(x == y) & some], minlength=OCTAVES)
    # an octave of s samples, v of which the texts reach, stands for 2**k * v / s symbols, of which same / v agree
    scale = np.exp2(np.arange(OCTAVES)) / OCTAVE_SIZE
    rate = float((scale * same).sum() / (scale * of).sum())
    return min(1.0, max(0.0, (rate - 1 / 15) / (14 / 15)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, extra, key, tie); each part's last document is followed by the extra ones."""
    held: list[tuple] = []  # (part, extra, id, text)
    size = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        rows, done = [], 0
        for i, (part, extra, doc, text) in enumerate(held):
            if i + 1 == len(held) and not final:
                break
            done = i + 1
            if not extra:
                rows.append((doc, text, held[i + 1][3]))
        held, size = held[done:], sum(len(x[3]) for x in held[done:])
        if rows:
            yield _digest(rows)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for row in zip(*(piece.column(c).to_pylist() for c in ("part", "extra", "id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size > CHUNK:
                    yield from flush(False)
    yield from flush(True)


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, nexts = zip(*rows, strict=True)
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts, strict=True)]
    every = dict.fromkeys([*texts, *edited, *nexts])
    prints = dict(zip(every, fingerprints([_points(t) for t in every]), strict=True))
    own, changed, after = ([prints[t] for t in x] for x in (texts, edited, nexts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(own),
            pa.array(changed),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)]),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)]),
        ],
        names=[x.split()[0] for x in _SCHEMA.split(", ")],
    )


def fingerprint_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each document, and of it with its second half replaced by the start of the next document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.coalesce("id", F.lit(-(2**63))))
    # null ids before the least one, then by a hash of the text
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.when(F.col("id").isNotNull(), F.lit(1 << 62)).otherwise(F.lit(0)))
    # the least (id, tie) of each range, a row a range
    ids = rows.select("key", "tie").repartitionByRange(4 * n, "key", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "tie")).alias("head"))
    heads = sorted({tuple(r["head"]) for r in ids.collect()})
    keys, ties = (np.array([h[i] for h in heads], np.int64) for i in (0, 1))

    @F.pandas_udf("part int, before int")
    def place(key: pd.Series, tie: pd.Series) -> pd.DataFrame:
        k, t = key.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        part = high - 1
        # rows whose id begins one range or several are told apart by the tie
        for lo in np.unique(low[low < high]):
            of = np.flatnonzero((low == lo) & (low < high))
            part[of] = lo - 1 + np.searchsorted(ties[lo : high[of[0]]], t[of], "right")
        is_head = (keys[part] == k) & (ties[part] == t)
        before = np.where(is_head, (part - 1) % len(keys), -1)
        return pd.DataFrame({"part": part.astype(np.int32), "before": before.astype(np.int32)})

    to = F.array(F.struct(F.col("at.part").alias("part"), F.lit(0).alias("extra")))
    both = F.concat(to, F.array(F.struct(F.col("at.before").alias("part"), F.lit(1).alias("extra"))))
    dealt = rows.withColumn("at", place("key", "tie")).select("id", "key", "tie", "text", F.explode(F.when(F.col("at.before") >= 0, both).otherwise(to)).alias("to"))
    placed = dealt.select("to.part", "to.extra", "id", "key", "tie", "text").repartition(n, "part").sortWithinPartitions("part", "extra", "key", "tie")
    return placed.mapInArrow(_pairs, _SCHEMA)


def _links(rows: list[tuple], threshold: float) -> pa.RecordBatch:
    """Links (u, v) that connect what the alike pairs of a band's blocks i and j connect; rows: (i, j, own block, node, fingerprint)."""
    u, v = [], []
    if len(rows) > 1:
        i, j = rows[0][:2]
        left = [r[3:] for r in rows if r[2] == i]
        right = left if i == j else [r[3:] for r in rows if r[2] == j]
        n = max(len(fp) for *_, fp in rows)
        grid = np.frombuffer("".join(fp.ljust(n, "0") for _, fp in right).encode(), np.uint8).reshape(len(right), n)
        scale = np.exp2(np.arange(OCTAVES)) / OCTAVE_SIZE
        starts, octave = np.unique(OCTAVE_OF[:n], return_index=True)[::-1]
        root = {node: node for node, _ in [*left, *right]}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for at, (node, fp) in enumerate(left):
            own = np.frombuffer(fp.ljust(n, "0").encode(), np.uint8)
            first = at + 1 if i == j else 0
            some = (grid[first:] != 48) | (own != 48)
            of, same = (np.add.reduceat(x, starts, axis=1, dtype=np.int64) @ scale[octave] for x in (some, (grid[first:] == own) & some))
            # sums in another order may differ in the last places: what is close is measured again
            for k in np.flatnonzero((same / of - 1 / 15) / (14 / 15) >= threshold - 1e-9) + first:
                other, fp2 = right[k]
                a, b = top(node), top(other)
                if a != b and likeness(fp, fp2) >= threshold:
                    root[max(a, b)] = min(a, b)
                    u.append(node)
                    v.append(other)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def near_groups(prints: DataFrame, threshold: float = 0.7, bands: int = 24, rows: int = 6, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Groups of alike fingerprints: (doc_id, class_id), a row for each row of ``prints``; class_id is the least id in the class.

    Equal fingerprints are one node, named by a hash of theirs, so ids may be null or repeat. At most 10 ``rows``. Each band takes ``rows`` samples of one octave, the octave of the band's choice among
    those that the fingerprint fills; all nodes that share a band are compared, by pairs of blocks of ``BLOCK`` or so, and
    links of likeness ``threshold`` or more are closed to components. Empty fingerprints form one group.
    """
    nodes = C.durable(prints.groupBy(F.coalesce(F.col(fingerprint), F.lit("")).alias("fp")).agg(F.min(doc_id).alias("least"))).withColumn("node", F.xxhash64("fp"))

    samples = {(k, b): np.random.default_rng((SEED, k, b)).permutation(int(OCTAVE_SIZE[k]))[:rows].tolist() for k in range(OCTAVES) for b in range(bands)}

    starts = np.searchsorted(OCTAVE_OF, np.arange(OCTAVES + 1))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(band, node): octave, band and sampled digits as one number."""
        for batch in batches:
            prints, ids = batch.column("fp").to_pylist(), np.asarray(batch.column("node"))
            some = np.flatnonzero([bool(fp) for fp in prints])
            if not len(some):
                continue
            width = max(len(prints[i]) for i in some)
            grid = _VALUES[np.frombuffer("".join(prints[i].ljust(width, "0") for i in some).encode(), np.uint8)].reshape(len(some), width)
            top = OCTAVE_OF[[len(prints[i]) - 1 for i in some]]
            for k in range(int(top.max()) + 1):
                of = np.flatnonzero((top >= k) & (top <= k + 3))
                for b in range(bands if len(of) else 0):
                    at = starts[k] + np.array(samples[k, b])
                    if at.max() >= width:
                        continue
                    own = grid[np.ix_(of, at)].astype(np.int64)
                    full = (own > 0).all(axis=1)
                    key = (own << (4 * np.arange(len(at)))).sum(axis=1) + ((k * bands + b) << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key[full]), pa.array(ids[some[of[full]]])], names=["band", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "own", "node", "fp")), strict=True):
                if row[:3] != key:
                    yield _links(held, threshold)
                    key, held = row[:3], []
                held.append(row[1:])
        yield _links(held, threshold)

    banded = nodes.mapInArrow(band, "band long, node long")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # each block of a band meets each block, itself included, once
    dealt = banded.join(shared.hint("rebalance"), "band").select("band", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node").join(nodes.select("node", "fp"), "node")
    placed = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    roots = components(placed.mapInArrow(compare, "u long, v long").distinct())
    facts = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = facts.groupBy("root").agg(F.min("least").alias("class_id"))
    named = facts.join(classes.hint("rebalance"), "root").select("node", "class_id")
    return prints.select(doc_id, F.xxhash64(F.coalesce(F.col(fingerprint), F.lit(""))).alias("node")).join(named.hint("rebalance"), "node").select(doc_id, "class_id")


def op10_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(C.read(spark, sf_dir, "documents").select("doc_id", "text"))


def own_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) alone, by a scan without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, "text"):
                prints = fingerprints([_points(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of alike fingerprints over all documents, by banding and verification."""
    return near_groups(C.durable(own_fingerprints(C.read(spark, sf_dir, "documents"))))


QUERIES = {"op10_edit_fingerprint": op10_edit_fingerprint, "near_fingerprints": near_fingerprints}
SQL: dict[str, str] = {}
