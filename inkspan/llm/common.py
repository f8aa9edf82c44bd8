"""What the operators share: durable intermediate tables, vectorised words and hashes, global offsets.

Hashes here are 64-bit, computed by numpy on whole Arrow batches. All of them are functions of content alone, so a task
that is run again, or run on another executor, gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from inkspan.operators.durable import durable, forget, running_totals, shared_dir

__all__ = ["durable", "forget", "running_totals", "shared_dir"]

#: Separators of words: space and U+0009 to U+000D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: A word as Spark SQL and DuckDB patterns write it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are turned into arrays at once; one longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text, modulo 4, is 2; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replace_columns(df: DataFrame, new: set[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to write."""
    gone = {c.lower() for c in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


# --- Arrow and numpy ---------------------------------------------------------------------------------------------------


def to_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``rows`` rows whose texts have about ``most`` bytes together, and one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each text starts (one more entry for the end). Null: no bytes."""
    array = pa.compute.fill_null(to_array(array), "")
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.string()), np.int32
    _, offs, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _MIX[0]
    x ^= x >> _U(27)
    x *= _MIX[1]
    x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASES = {"byte": 0xD1342543DE82EF95, "word": 0xAF251AF3B0F025B5, "run": 0x9FB21C651E98DF25}
_powers: dict[str, np.ndarray] = {}


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of an odd constant modulo 2**64, or of its inverse."""
    key = kind + "-" * inverse
    if len(_powers.get(key, ())) < n:
        base = _BASES[kind]
        steps = np.full(max(n, 1024), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True


class Words:
    """The words of a chunk of texts: ``start`` and ``end`` in ``data``; those of document d are ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, array: pa.Array, separators: np.ndarray | None = None):
        """separators: of each byte, whether it separates words; those of ``SEPARATORS``, if None."""
        self.data, self.offsets = text_bytes(array)
        self.inside = inside = ~(_IS_SEP if separators is None else separators)[self.data]
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            begins[cut] = inside[cut]
            ends[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, data: np.ndarray | None = None, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """A hash of each word's bytes, in ``data`` if given (the texts' bytes, folded).

        With ``prefixes``, a list: that hash, then for each length one of the first so many bytes, 0 for shorter words.
        """
        if not len(self):
            return [np.zeros(0, np.uint64)] * (1 + len(prefixes)) if prefixes else np.zeros(0, np.uint64)
        lens = self.end - self.start
        at = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum()), dtype=np.int64)
        place -= np.repeat(at, lens)
        values = _BYTE_VALUES[(self.data if data is None else data)[self.inside]]
        values *= powers("byte", int(lens.max()))[place]
        whole = mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        if not prefixes:
            return whole
        sums, out = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)]), [whole]
        for n in prefixes:
            long = lens >= n
            part = np.zeros(len(lens), np.uint64)
            part[long] = mix(sums[at[long] + n] - sums[at[long]] + _U(n))
            out.append(part)
        return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of ``words`` (documents are not looked at)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers("word", n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers("word", n, inverse=True)[: n - k + 1] + _U(k))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles, on end, and where each document's set starts.

    A document of 1 to k - 1 words has one shingle, all its words; one without words has none.
    """
    hashes, counts, first = words.hashes(), words.counts(), words.first
    grams = gram_hashes(hashes, k)
    n_docs = len(counts)
    doc_of = np.repeat(np.arange(n_docs), counts)
    ok = np.zeros(len(hashes), bool)
    ok[: len(grams)] = doc_of[: len(grams)] == doc_of[k - 1 :] if len(grams) else False
    short = np.flatnonzero((counts > 0) & (counts < k))
    extra = np.array([int(mix(np.add.reduce(hashes[first[d] : first[d + 1]] * powers("word", int(counts[d])), keepdims=True) + _U(counts[d]))[0]) for d in short], np.uint64)
    at = np.flatnonzero(ok)
    docs, values = np.concatenate([doc_of[at], short]), np.concatenate([grams[at], extra])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    docs, values = docs[new], values[new]
    return values, np.searchsorted(docs, np.arange(n_docs + 1))


def struct_of(df: DataFrame, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in extra]])
