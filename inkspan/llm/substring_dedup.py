"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored, greedily from left to right, against a reference that holds each repeated sequence of ``window``
words once: where it first occurs, by row key and position. A factor is the longest match of ``window`` words or more that
begins at a window, as (source, position, length); the source's key names its reference block. After a factor ends, the first
window that crosses its boundary is checked, and so on, so repeats that only begin inside a factor are found as well. As the
reference holds each window once, the window at which a match begins tells its only place there, and a match goes on as long as
the next window's place is the next one: greedy factors follow from the places of windows, and no text of the reference
travels.

* **Index.** Places are looked up by phrases. Each window selects an anchor: the ``gram``-word sequence in it with the least
  hash (the leftmost of equals). Neighbouring windows with the same anchor make a phrase. The choice depends on the window's
  words alone, so equal windows fall under equal anchors wherever they stand, and one look-up by the anchor's hash reaches the
  only part of the index that can hold them. About ``2 / (window - gram + 2)`` rows a word are indexed and asked for.
* **Whole phrases.** If all phrases under an anchor are the same and there are two or more, the first one's place gives that
  of all windows in it.
* **Boundaries.** If they differ, a factor begins or ends inside: the windows of these phrases are looked up one by one.

A window is covered by a factor exactly if its words also start elsewhere (up to collisions of 64-bit hashes). All decisions
are made on the input, not on what is left.

At scale: one exchange of phrases, partly aggregated first, one of (anchor, row) pairs as a join that adaptive execution can
split at hot anchors (the counts are dealt anew before it, so both sides have exchanges of their own), the same for windows
at boundaries, two of the texts. Nothing is broadcast or collected, and no group is gathered: an anchor or window has a count
and one place, however often it occurs, and a row gets back what concerns its own words, each fact once.

Defined results: a null text has no words; text shorter than a window loses nothing; rows that repeat an id or a whole row
are documents of their own (their windows repeat); rows are told apart by a hash of id and text, so null ids are no group; an
empty table gives an empty table; columns of the input whose names this operator writes are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, GRAM = 35, 8
#: Reference blocks.
BLOCKS = 4096
#: Low bits of an anchor's sort key that hold its place in the chunk.
_PLACE = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


class Phrases:
    """The phrases of a chunk. ``window_at``: first words of all windows; ``run``: the phrase of each, ``inner``: its place in that; by
    phrase: ``anchor``, ``content``, ``doc``, and ``start``, the word of ``doc`` at which it begins."""

    def __init__(self, words: C.Words, window: int, gram: int):
        hashes, counts = words.hashes(), words.counts()
        n, last = len(hashes), np.repeat(words.first[1:], counts)
        self.window_at = at = np.flatnonzero(np.arange(n) + window <= last)
        self.run = self.inner = self.anchor = self.content = self.doc = self.start = np.zeros(0, np.int64)
        self.windows = np.zeros(0, np.uint64)
        if not len(at):
            return
        grams = C.gram_hashes(hashes, gram)
        width = window - gram + 1
        place = (sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), width)[at] & _PLACE).astype(np.int64)
        self.windows = C.gram_hashes(hashes, window)[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.inner = np.arange(len(at)) - first[self.run]
        lengths = np.diff(np.append(first, len(at)))
        self.anchor = grams[place[first]].view(np.int64)
        self.content = C.mix(np.add.reduceat(self.windows * C.powers("run", width)[self.inner], first) + lengths.astype(np.uint64)).view(np.int64)
        self.doc = np.searchsorted(words.first, at[first], "right") - 1
        self.start = at[first] - words.first[self.doc]


class Places:
    """Where the reference holds what a chunk's rows asked for: ``hash``, sorted and once each, ``source`` and ``position``."""

    def __init__(self, column: pa.Array):
        flat = C.to_array(column).flatten()
        fields = [np.asarray(flat.field(i), dtype=np.int64) for i in range(3)] if len(flat) else [np.zeros(0, np.int64)] * 3
        self.hash, at = np.unique(fields[0], return_index=True)
        self.source, self.position = fields[1][at], fields[2][at]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are held, and the number of each that is."""
        if not len(self.hash):
            return np.zeros(len(x), bool), np.zeros(0, np.int64)
        at = np.searchsorted(self.hash, x)
        at[at == len(self.hash)] = 0
        found = self.hash[at] == x
        return found, at[found]


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``columns``, the first of which names groups, and where each group starts in it."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = columns[0][order[1:]] != columns[0][order[:-1]]
    return order, np.flatnonzero(new)


def _index(key: str, text: str, window: int, gram: int):
    """Of each anchor in a chunk: how many phrases it has there, their least and largest content, and the first one's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text):
                p = Phrases(C.Words(part.column(text)), window, gram)
                keys = np.asarray(part.column(key))[p.doc]
                order, first = _first_of(p.anchor, keys, p.start)
                content = p.content[order]
                times = np.diff(np.append(first, len(order)))
                lo, hi = (f.reduceat(content, first) if len(first) else content for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.anchor[order][first], times, lo, hi, keys[order][first], p.start[order][first].astype(np.int32))], names=["anchor", "n", "lo", "hi", "source", "position"])

    return run


def _asked(key: str, text: str, window: int, gram: int):
    """(anchor, row), each once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text):
                p = Phrases(C.Words(part.column(text)), window, gram)
                keys = np.asarray(part.column(key))[p.doc]
                order = np.lexsort((keys, p.anchor))
                anchor, keys = p.anchor[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (keys[1:] != keys[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(keys[new])], names=["anchor", key])

    return run


def _boundary_windows(key: str, text: str, window: int, gram: int):
    """(window, row, times, position): windows of phrases that differ from others of their anchor, with the first place in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text):
                words = C.Words(part.column(text))
                p = Phrases(words, window, gram)
                boundary = np.unique(np.asarray(C.to_array(part.column("__boundary")).flatten(), dtype=np.int64))
                take = np.isin(p.anchor, boundary)[p.run] if len(p.run) else np.zeros(0, bool)
                doc = p.doc[p.run[take]]
                keys, values, at = np.asarray(part.column(key))[doc], p.windows[take].view(np.int64), p.window_at[take] - words.first[doc]
                order = np.lexsort((at, keys, values))
                values, keys, at = values[order], keys[order], at[order]
                new = np.ones(len(values), bool)
                new[1:] = (values[1:] != values[:-1]) | (keys[1:] != keys[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(values[first]), pa.array(keys[first]), pa.array(times.astype(np.int64)), pa.array(at[first].astype(np.int32))], names=["window", key, "times", "position"])

    return run


def factors(p: Phrases, whole: Places, single: Places, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of a chunk's documents: source, position there, first word (of the chunk) and number of words of each."""
    source, position, held = np.zeros(len(p.run), np.int64), np.zeros(len(p.run), np.int64), np.zeros(len(p.run), bool)
    for places, names, offset in ((whole, p.anchor[p.run], p.inner), (single, p.windows.view(np.int64), np.zeros(len(p.run), np.int64))):
        found, at = places.find(names)
        held |= found
        source[found], position[found] = places.source[at], places.position[at] + offset[found]
    at, source, position = p.window_at[held], source[held], position[held]
    # a match goes on while the next window's place is the next one of the same source
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (position[1:] != position[:-1] + 1)
    # the next window may be another document's
    first_windows = np.append(True, p.doc[p.run[1:]] != p.doc[p.run[:-1]]) if len(p.run) else np.zeros(0, bool)
    new |= first_windows[held]
    first = np.flatnonzero(new)
    return source[first], position[first], at[first], np.diff(np.append(first, len(at))) + window - 1


def _cut(text: str, lookups: tuple[str, str, str], window: int, gram: int, with_text: bool, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text):
                words = C.Words(part.column(text))
                p, n, n_docs = Phrases(words, window, gram), len(words), part.num_rows
                source, position, begin, length = factors(p, *(Places(part.column(c)) for c in lookups[1:]), window)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                keep, counts = ~gone, words.counts()
                doc_of = np.repeat(np.arange(n_docs), counts)
                removed = np.bincount(doc_of[gone], minlength=n_docs)
                lens = words.end - words.start
                kept_lens = lens[keep]
                out = np.full(int(kept_lens.sum()) + len(kept_lens), 0x20, np.uint8)
                to = np.arange(int(kept_lens.sum()))
                to += np.repeat(np.arange(len(kept_lens)), kept_lens)
                out[to] = words.data[words.inside][np.repeat(keep, lens)]
                bounds = np.zeros(n_docs + 1, np.int64)
                bounds[1:] = np.cumsum(np.bincount(doc_of[keep], weights=kept_lens + 1, minlength=n_docs)).astype(np.int64)
                view = out.data
                pieces = [view[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                new = {"n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string())}
                if with_text:
                    new["kept_text"] = pa.array([bytes(x).decode() for x in pieces], pa.string())
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    a, b = flips[::2], flips[1::2]
                    # a span that goes on in the next document is two spans
                    inner = words.first[1:-1]
                    inner = inner[(inner > 0) & (inner < n)]
                    a = np.union1d(a, inner[gone[inner] & gone[inner - 1]])
                    b = np.minimum(b[np.searchsorted(b, a, "right")], words.first[np.searchsorted(words.first, a, "right")]) if len(a) else a
                    of = np.searchsorted(words.first, a, "right") - 1
                    spans = pa.StructArray.from_arrays([pa.array((a - words.first[of]).astype(np.int64)), pa.array((b - a).astype(np.int64))], names=["first_word", "n_words"])
                    doc = np.searchsorted(words.first, begin, "right") - 1
                    parsed = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (source % BLOCKS, source, position, begin - words.first[doc], length)], names=["block", "source", "position", "first_word", "n_words"])
                    new["factors"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)), parsed)
                    new["row_key"] = part.column(lookups[0])
                    new["spans"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n_docs + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([new[f] if f in new else part.column(f) for f in fields], names=fields)

    return run


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Find the words that windows repeated anywhere in ``docs`` cover.

    Adds n_words, n_removed, kept_sha256 and, ``with_text``, kept_text (the other words, joined by spaces), spans (first_word
    and n_words of each duplicate span), factors (block, source, position there, first_word and n_words of each, in order; a
    factor that is its own source is where the reference has it from) and row_key (by which factors name sources). ``keep``: the columns that are kept; all, if None.
    """
    made = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    if with_text:
        longs = lambda *names: T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in names]))
        made |= {"kept_text": T.StringType(), "spans": longs("first_word", "n_words"), "factors": longs("block", "source", "position", "first_word", "n_words"), "row_key": T.LongType()}
    base = C.replace_columns(docs if keep is None else docs.select(*dict.fromkeys([*keep, doc_id, text])), set(made))
    kept = base.schema.fields
    key, whole_, windows_ = (C.free_name(base, n) for n in ("__key", "__whole", "__windows"))
    base = base.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text)))
    narrow = base.select(key, text)
    place = [F.min("source").alias("source"), F.min_by("position", "source").alias("position")]

    phrases = narrow.mapInArrow(_index(key, text, window, gram), "anchor long, n long, lo long, hi long, source long, position int")
    index = phrases.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *place).where("n >= 2").select("anchor", (F.col("lo") != F.col("hi")).alias("differ"), "source", "position")
    asked = narrow.mapInArrow(_asked(key, text, window, gram), f"anchor long, `{key}` long")
    at = F.struct(F.col("anchor").alias("hash"), "source", F.col("position").cast("long").alias("position"))
    # sets: rows that are the same have one list, whatever their number
    found = C.durable(asked.join(index.hint("rebalance"), "anchor").groupBy(key).agg(F.collect_set(F.when(~F.col("differ"), at)).alias("__whole"), F.collect_set(F.when(F.col("differ"), F.col("anchor"))).alias("__boundary")))

    edges = narrow.join(found.where(F.size("__boundary") > 0).select(key, "__boundary").hint("shuffle_hash"), key)
    windows = C.durable(edges.select(key, text, "__boundary").mapInArrow(_boundary_windows(key, text, window, gram), f"window long, `{key}` long, times long, position int"))
    again = windows.withColumnRenamed(key, "source").groupBy("window").agg(F.sum("times").alias("n"), *place).where("n >= 2").select("window", "source", "position")
    at = F.struct(F.col("window").alias("hash"), "source", F.col("position").cast("long").alias("position"))
    single = windows.select("window", key).join(again.hint("rebalance"), "window").groupBy(key).agg(F.collect_set(at).alias("__windows"))

    full = base.join(found.select(key, F.col("__whole").alias(whole_)).hint("shuffle_hash"), key, "left").join(single.withColumnRenamed("__windows", windows_).hint("shuffle_hash"), key, "left")
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in made.items()]])
    return full.select(*[F.col(f"`{f.name}`") for f in kept], key, whole_, windows_).mapInArrow(_cut(text, (key, whole_, windows_), window, gram, with_text, schema.fieldNames()), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows as strings; a word is removed if one of the windows over it occurs twice.
OP4_SQL = r"""
with w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, row_number() over () as rid from documents),
n as (select *, len(words) as n_words from w),
win as (select rid, unnest(range(1, n_words - 33)) as i, words from n where n_words >= 35),
keyed as (select rid, i, md5(array_to_string(words[i:i + 34], ' ')) as h from win),
dup as (select rid, i from keyed where h in (select h from keyed group by h having count(*) >= 2)),
gone as (select distinct rid, i + o as i from dup, (select unnest(range(0, 35)) as o)),
lists as (select rid, list(i) as gone_i from gone group by rid),
kept as (select doc_id, n_words, coalesce(len(gone_i), 0) as n_removed, case when gone_i is null then array_to_string(words, ' ') else coalesce(array_to_string(list_filter(words, lambda x, j: not list_contains(gone_i, j)), ' '), '') end as kept from n left join lists using (rid))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(kept) as kept_sha256 from kept
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL = {"op4_substring_dedup": OP4_SQL}
