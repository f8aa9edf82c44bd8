"""Learning byte-level BPE merges.

Merges are learned by levels. A level begins with the counts of all adjacent pairs and takes a limit, a part of the largest
count. A pair of later tokens stands only where its left's last token and its right's first one stand now, so where two
neighbours make a pair below the limit, no merge of the limit or above will ever cross. There texts are cut, and a text is
mostly cut into few tokens, so the distinct segments and how often each stands are a small table, of which the driver
learns all merges down to the limit. One more pass over the texts applies them and counts pairs anew. So there are about as
many levels as the counts of merges fall by halves or quarters, however many merges that is.

Two things bound a level. A merge that spells a token which is there already ends it, as from then on a token does not tell
any more what it was made of. And where segments are more than the driver may hold (``HELD`` tokens; say, texts of two
characters), the level is a batch: merges from the top of the counts that are sure to be the next ones whatever the earlier
of them change. A pair joins it if its left is no accepted right and its right no accepted left. Counts of such pairs don't
change, pairs with new tokens can't overtake what stands below them, and ties go to smaller ids. Both ways equal one-by-one
training.

Tokens are kept as arrays of two bytes each (four from 65535 ids on), whole documents with an end mark after each, some of
them a row (merges may cross any place in a document). They are written to the shared folder once a level, and the level
before is deleted. Texts themselves are read three times, before the first tokens are written.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkspan.plans.config import Tokenizer

from .durable import durable, forget, written
from .vocabulary import Merge, Merges, Vocabulary

#: Pairs looked at for a batch; pairs that segments may be made of; tokens of distinct segments on the driver.
TOP, PAIRS, HELD = 512, 1 << 16, 1 << 22
#: The largest count of a level is so many times its limit, at first.
SPAN = 2.0
#: Tokens worked on at once, tokens a row, and distinct segments that a task holds, with how many bytes at most.
PIECE, ROW, DISTINCT, BYTES = 1 << 20, 1 << 13, 1 << 19, 1 << 26
#: How tables are written: a writer holds a row group, and a reader a column of it.
WRITER = {"compression": "zstd", "parquet.block.size": str(1 << 24)}
_log = logging.getLogger(__name__)


def byte_tokens(docs: DataFrame, base: int, text: str = "text") -> DataFrame:
    """(tokens): each document's bytes as ids from ``base`` on, packed little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.frombuffer(t.encode(), np.uint8).astype("<i4") + base).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["tokens"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "tokens binary")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all documents with -1 after each, and where each document starts."""
    parts = column.to_pylist()
    lengths = np.array([len(p) // 4 for p in parts], np.int64)
    end = np.full(1, -1, "<i4").tobytes()
    return np.frombuffer(b"".join(p + end for p in parts), "<i4"), np.concatenate([[0], np.cumsum(lengths + 1)])


def hits(x: np.ndarray, batch: list[Merge]) -> np.ndarray:
    """Where, from the left, the pairs of a batch stand in joined tokens."""
    if len(x) < 2:
        return np.zeros(0, np.int64)
    keys, top = np.sort([(m.left << 32) | m.right for m in batch]), max(int(x.max()), *(max(m.left, m.right) for m in batch))
    lefts, rights = np.zeros(top + 2, bool), np.zeros(top + 2, bool)  # the last stands for -1
    lefts[[m.left for m in batch]] = rights[[m.right for m in batch]] = True
    hit = np.flatnonzero(lefts[x[:-1]] & rights[x[1:]])
    code = (x[hit].astype(np.int64) << 32) | x[hit + 1]
    hit = hit[keys[np.minimum(np.searchsorted(keys, code), len(keys) - 1)] == code]
    if len(batch) == 1 and batch[0].left == batch[0].right and len(hit):
        # in a run of equal tokens, every other place from the run's start
        first = np.concatenate([[True], np.diff(hit) > 1])
        begin = hit[first][np.cumsum(first) - 1]
        hit = hit[(hit - begin) % 2 == 0]
    return hit


def replaced(x: np.ndarray, starts: np.ndarray, batch: list[Merge], hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined tokens with the pairs at ``hit`` merged, and where each document starts then."""
    if not len(hit):
        return x, starts
    order = sorted(batch, key=lambda m: (m.left, m.right))
    keys = np.array([(m.left << 32) | m.right for m in order], np.int64)
    new, keep = x.copy(), np.ones(len(x), bool)
    new[hit] = np.array([m.new_token_id for m in order], x.dtype)[np.searchsorted(keys, (x[hit].astype(np.int64) << 32) | x[hit + 1])]
    keep[hit + 1] = False
    return new[keep], starts - np.searchsorted(hit, starts)


def apply(x: np.ndarray, starts: np.ndarray, batch: list[Merge]) -> tuple[np.ndarray, np.ndarray]:
    """One pass over joined tokens: every occurrence of the pairs of a batch."""
    return replaced(x, starts, batch, hits(x, batch))


def _counted(code: np.ndarray, specials: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, packed into longs, and how often each stands in ``code``; those with a special id or a document's end are left out."""
    return np.unique(code[(code >> 32 >= specials) & (code & 0xFFFFFFFF >= specials) & (code & 0xFFFFFFFF < 1 << 31)], return_counts=True)


def _pairs(x: np.ndarray) -> np.ndarray:
    return (x[:-1].astype(np.int64) << 32) | x[1:].astype(np.int64) & 0xFFFFFFFF


def pair_counts(tokens: DataFrame, specials: int) -> DataFrame:
    """(left, right, freq): adjacent pairs, overlapping ones too, that touch no special id and cross no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                x, _ = joined(b.column(0).slice(at, 512))
                code, n = _counted(_pairs(x), specials)
                yield pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["left", "right", "n"])

    return tokens.mapInArrow(run, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("freq"))


def best_pair(counts: DataFrame) -> tuple[int, int, int]:
    """(left, right, freq) of the most frequent pair; of equals the least left, then right."""
    row = counts.agg(F.max_by(F.struct("left", "right", "freq"), F.struct("freq", -F.col("left"), -F.col("right")))).first()[0]
    if row is None:
        raise ValueError("No pairs available")
    return tuple(row)


@dataclass
class Coding:
    """How tokens are packed: ids below ``end``, which is the mark after each document."""

    end: int
    specials: int

    @property
    def kind(self) -> str:
        return "<u2" if self.end < 1 << 16 else "<u4"

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Adjacent pairs as numbers, in the order of left, then right."""
        wide = np.uint32 if self.end < (1 << 16) - 1 else np.int64
        return x[:-1].astype(wide) * wide(self.end + 1) + x[1:].astype(wide)

    def spread(self, data: np.ndarray, offsets: np.ndarray, kind: str, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """The values between offsets with ``mark`` after each, and where each starts."""
        starts = offsets - offsets[0] + np.arange(len(offsets))
        out, own = np.full(int(starts[-1]), mark, kind), np.ones(int(starts[-1]), bool)
        own[starts[1:] - 1] = False
        out[own] = data[offsets[0] : offsets[-1]]
        return out, starts

    def read(self, batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[tuple[np.ndarray, int]]:
        """Tokens of whole documents, ``PIECE`` or so at once, and how many rows these are."""
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            offsets, raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64), column.buffers()[2]
            size = 1 if texts else np.dtype(self.kind).itemsize
            data = np.frombuffer(raw or b"", np.uint8)
            i = 0
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE * size, "right")) - 1)
                if texts:
                    x, starts = self.spread(data, offsets[i : j + 1], self.kind, 0)
                    x += np.array(self.specials, x.dtype)
                    x[starts[1:] - 1] = self.end
                else:
                    x = np.frombuffer(raw, self.kind, (offsets[j] - offsets[i]) // size, offsets[i])
                yield x, j - i
                i = j

    def packed(self, x: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    def rows(self, x: np.ndarray) -> pa.Array:
        """Tokens of whole documents as rows of ``ROW`` tokens or more, each again of whole documents."""
        ends = np.flatnonzero(x == self.end) + 1
        cuts = ends[np.unique(np.minimum(np.searchsorted(ends, np.arange(ROW, len(x) + ROW, ROW)), len(ends) - 1))]
        return self.packed(x, np.concatenate([[0], cuts]))

    def counted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, as numbers, and how often each stands in ``x``; those with a special id or a document's end are left out."""
        found = pa.array(self.codes(x)).value_counts()
        code, n = (found.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        left, right = code // (self.end + 1), code % (self.end + 1)
        own = (left >= self.specials) & (right >= self.specials) & (left < self.end) & (right < self.end)
        return code[own], n[own]

    def segments(self, x: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of tokens each neighbours of which are one of ``pairs``: places of their tokens, and where each run starts among these."""
        if len(x) < 2 or not len(pairs):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        code = self.codes(x)
        if (self.end + 1) ** 2 <= 1 << 24:
            table = np.zeros((self.end + 1) ** 2, bool)
            table[pairs] = True
            hit = np.flatnonzero(table[code])
        else:
            hit = np.flatnonzero(pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
        inside = np.zeros(len(x), bool)
        inside[hit] = inside[hit + 1] = True
        return np.flatnonzero(inside), np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(hit))) + 1)])

    def unpacked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Packed segments as joined tokens, -1 after each, and where each starts."""
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // np.dtype(self.kind).itemsize
        return self.spread(np.frombuffer(column.buffers()[2], self.kind), offsets, "<i4", -1)

    def merged(self, x: np.ndarray, pairs: np.ndarray, batches: list[list[Merge]]) -> np.ndarray:
        """Tokens after all merges of a level. Each distinct segment is merged once."""
        at, starts = self.segments(x, pairs)
        if not len(at) or not batches:
            return x
        own = self.packed(x[at], starts).dictionary_encode()
        y, begins = self.unpacked(own.dictionary)
        for batch in batches:
            y, begins = apply(y, begins, batch)
        which, left = own.indices.to_numpy(), np.diff(begins) - 1
        new = self.packed(y[y >= 0].astype(self.kind), np.concatenate([[0], np.cumsum(left)])).take(pa.array(which)).cast(pa.large_binary())
        offsets = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1]
        lengths = np.diff(starts)
        stays = np.arange(len(at)) - np.repeat(starts[:-1], lengths) < np.repeat(left[which], lengths)
        out, keep = x.copy(), np.ones(len(x), bool)
        out[at[stays]] = np.frombuffer(new.buffers()[2], self.kind, (offsets[-1] - offsets[0]) // x.itemsize, offsets[0])
        keep[at[~stays]] = False
        return out[keep]


def _summed(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and their sums, by number."""
    key, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, ns))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first) if len(first) else n


#: Rows of counts that are of no pair: all tokens, and documents.
_TOKENS, _DOCUMENTS = -1, -2


def level_pass(source: DataFrame, texts: bool, coding: Coding, pairs: np.ndarray, batches: list[list[Merge]], keep: bool) -> DataFrame:
    """One pass that applies a level's merges: rows of either tokens (if ``keep``) or (code, n), how often a pair stands then."""
    names, kinds = ["tokens", "code", "n"], [pa.binary(), pa.int64(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, held, tokens, documents = [], [], 0, 0, 0
        for x, _ in coding.read(it, texts):
            x = coding.merged(x, pairs, batches)
            ends = int((x == coding.end).sum())
            tokens, documents = tokens + len(x) - ends, documents + ends
            code, n = coding.counted(x)
            keys, ns, held = [*keys, code], [*ns, n], held + len(code)
            if held > 1 << 22:
                key, total = _summed(keys, ns)
                keys, ns, held = [key], [total], len(key) // 2
            if keep:
                rows = coding.rows(x)
                yield pa.RecordBatch.from_arrays([rows, *[pa.nulls(len(rows), k) for k in kinds[1:]]], names=names)
        key, total = _summed([*keys, np.array([_TOKENS, _DOCUMENTS])], [*ns, np.array([tokens, documents])])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(total)], names=names)

    return source.mapInArrow(run, "tokens binary, code long, n long")


def distinct_segments(source: DataFrame, texts: bool, coding: Coding, pairs: np.ndarray) -> DataFrame:
    """(segment, n): the distinct segments of all texts and how often each stands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.to_batches(max_chunksize=max(1, min(1 << 15, len(table) * (1 << 22) // table.nbytes)))

        held = None
        for x, _ in coding.read(it, texts):
            at, starts = coding.segments(x, pairs)
            if not len(at):
                continue
            found = coding.packed(x[at], starts).value_counts()
            more = pa.table({"segment": found.field(0), "n": found.field(1)})
            held = pa.concat_tables([held, more]) if held else more
            if len(held) > DISTINCT or held.nbytes > BYTES:
                held = held.group_by("segment").aggregate([("n", "sum")]).rename_columns(["segment", "n"])
                if len(held) > DISTINCT // 2 or held.nbytes > BYTES // 2:
                    yield from sent(held)
                    held = None
        if held:
            yield from sent(held.group_by("segment").aggregate([("n", "sum")]).rename_columns(["segment", "n"]))

    return source.mapInArrow(run, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))


@dataclass
class Training:
    vocabulary: Vocabulary
    merges: Merges
    statistics: dict


def next_batch(ranked: list[tuple[int, int, int]], vocabulary: Vocabulary, merges: Merges, most: int, least: int) -> list[Merge]:
    """Record the merges that are sure to come next. ranked: the most frequent (left, right, freq), best first."""
    out: list[Merge] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for left, right, freq in ranked:
        token = vocabulary.tokens[left] + vocabulary.tokens[right]
        alone = left == right or token in vocabulary.ids
        if freq < least or len(out) == most or left in rights or right in lefts or alone and out:
            break
        out.append(merges.record(left, right, vocabulary.add(token), freq))
        lefts.add(left)
        rights.add(right)
        if alone:
            break
    return out


def _ranked(x: np.ndarray, weights: np.ndarray, specials: int, least: int) -> list[tuple[int, int, int]]:
    """The most frequent pairs of joined tokens, best first, each place counted by its weight."""
    own = np.flatnonzero((x[:-1] >= specials) & (x[1:] >= specials))
    left, right, base = x[own].astype(np.int64), x[own + 1], int(x.max(initial=0)) + 1
    code, w = left * base + right, weights[own]
    if base**2 <= 1 << 22:
        n = np.bincount(code, w, base**2).astype(np.int64)  # exact below 2 ** 53
        keys = np.flatnonzero(n >= least)
        n = n[keys]
    else:
        keys, n = _summed([code], [w])
        keys, n = keys[n >= least], n[n >= least]
    best = np.lexsort((keys, -n))[:TOP]
    return [(k // base, k % base, f) for k, f in zip(keys[best].tolist(), n[best].tolist(), strict=True)]


def learn_level(segments: pa.Table, coding: Coding, vocabulary: Vocabulary, merges: Merges, most: int, least: int) -> tuple[list[list[Merge]], int]:
    """Record the merges of at least ``least`` that distinct segments tell, until one reuses an id. Returns them, by batches, and
    how many tokens they take away from all texts."""
    x, starts = coding.unpacked(segments.column("segment").combine_chunks())
    n = segments.column("n").to_numpy()
    out, gone = [], 0
    while most:
        weights, known = np.repeat(n, np.diff(starts)), len(vocabulary)
        batch = next_batch(_ranked(x, weights, coding.specials, least), vocabulary, merges, most, least)
        if not batch:
            break
        hit = hits(x, batch)
        gone += int(weights[hit].sum())
        x, starts = replaced(x, starts, batch, hit)
        out.append(batch)
        most -= len(batch)
        if any(m.new_token_id < known for m in batch):
            break
    return out, gone


def train(docs: DataFrame, config: Tokenizer | None = None, text: str = "text", rounds: int | None = None) -> Training:
    """Learn up to ``vocab_size`` less the base size merges; ``rounds`` stops after so many levels (for tests). Texts of any length count."""
    config = config or Tokenizer()
    vocabulary, merges = Vocabulary(config.special_tokens), Merges()
    cap, coding = config.vocab_size - len(vocabulary), Coding(config.vocab_size, len(config.special_tokens))
    spark, before = docs.sparkSession, written()
    source, texts, nothing = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")), True, np.zeros(0, np.int64)
    counts, span, done, initial, total = level_pass(source, True, coding, nothing, [], False), SPAN, 0, None, 0
    while True:
        # the totals, then the most frequent pairs
        best = counts.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.col("code") >= 0, F.desc("n"), "code").limit(PAIRS + 3).toArrow()
        code, n = (best.column(i).to_numpy() for i in (0, 1))
        total = int(n[code == _TOKENS].sum())
        initial = initial or (int(n[code == _DOCUMENTS].sum()), total)
        code, n = code[code >= 0], n[code >= 0]
        if len(merges) == cap or done == rounds or not len(n) or n[0] < config.min_frequency:
            break
        least = max(config.min_frequency, int(-(-n[0] // span)))
        if len(n) > PAIRS:
            least = max(least, int(n[-1]) + 1)
        pairs, batches, gone = np.sort(code[n >= least]), [], None
        if span > 1.05 and len(pairs):
            found = durable(distinct_segments(source, texts, coding, pairs), **WRITER)
            held = (found.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) // np.dtype(coding.kind).itemsize
            if held <= HELD:
                batches, gone = learn_level(found.toArrow(), coding, vocabulary, merges, cap - len(merges), least)
                span *= 2 if held < HELD // 8 else 1
            else:
                span = 1 + (span - 1) / 4
        if gone is None:
            base = coding.end + 1
            batch = next_batch([(k // base, k % base, f) for k, f in zip(code[:TOP].tolist(), n[:TOP].tolist(), strict=True)], vocabulary, merges, cap - len(merges), config.min_frequency)
            batches, pairs = [batch], np.sort([m.left * base + m.right for m in batch])
        done += 1
        _log.info("level %d: %d merges, vocabulary %d", done, len(merges), len(vocabulary))
        if gone is not None and len(merges) == cap:
            total -= gone
            break
        after = durable(level_pass(source, texts, coding, pairs, batches, True), **WRITER)
        forget(spark, since=before, but=1)
        source, texts, counts = after.where("tokens is not null").select("tokens"), False, after.where("tokens is null").select("code", "n")
    forget(spark, since=before)
    documents, first = initial
    return Training(vocabulary, merges, training_statistics(config, vocabulary, merges, documents, first + 2 * documents, total + 2 * documents))


def training_statistics(config: Tokenizer, vocabulary: Vocabulary, merges: Merges, documents: int, initial: int, final: int, corpus_bytes: int = 0, corpus_characters: int = 0) -> dict:
    freq = [m.frequency for m in merges]
    # The names of all keys
    return {
        "initial_vocab_size": vocabulary.bpe_start,
        "final_vocab_size": len(vocabulary),
        "merge_count": len(merges),
        "min_frequency": config.min_frequency,
        "max_merge_frequency": max(freq, default=0),
        "num_documents": documents,
        "training_corpus_bytes": corpus_bytes,
        "training_corpus_characters": corpus_characters,
        "initial_token_count": initial,
        "final_token_count": final,
        "compression_ratio": initial / final if final else 0.0,
        "average_bytes_per_token": corpus_bytes / final if final else 0.0,
        "merge_frequency_stats": {"min": min(freq, default=0), "max": max(freq, default=0), "mean": sum(freq) / len(freq) if freq else 0},
    }
