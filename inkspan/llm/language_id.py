"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs. A letter trigram is bound into one vector: the first letter's, rotated
by two places, times the second's, rotated by one, times the third's. A text's vector is the bundle (sum) of its trigrams'
vectors, a language's prototype the bundle over its learning texts, and a text gets the language whose prototype, less the
mean of all prototypes, has the largest cosine with the text's vector, less the same mean.

The sum over a text's trigrams is the product of its trigram counts with the table of trigram vectors, which gives the
same integers with far less work; vectors are made for the letters and trigrams of each chunk only, from a hash of the letter,
so every letter of every script has one of its own. Letters are folded to lower case; all that is not a letter is one gap. Words
are padded by a gap on both sides. A chunk has at most ``CHUNK_ROWS`` texts, which bounds its counts whatever their lengths.

Prototypes are learned from all learning rows, as exact integer sums by (language, place): DIM rows a language reach the
driver. Prediction is a scan without an exchange.

The score tells languages apart, not languages from other texts: of centred profiles one is always on a text's side. For that,
:func:`identify` takes :func:`limits` and says whether a text is alike to a learned language at all: by the plain cosine of
the language's prototype with the bundle of the text's ``COMMONEST`` distinct trigrams, so that repeats don't count. Limits are learned for
each language and each doubling of distinct trigrams from all labelled rows, each against the prototype less its own part.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and if nothing could be learned; ties go to
the language first in code point order. Scores are (1 + cosine) / 2. Rows are independent: repeats get equal results, an
empty table gives an empty one, and columns named like the results are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from . import common as C

DIM, SEED = 1024, 7
CHUNK_BYTES, CHUNK_ROWS = 1 << 19, 256
#: The symbol of all that is not a letter; that of a letter is its code point.
_GAP = 0
#: A limit is this share of the likeness that all but 5 % of a language's labelled texts reach, or less where they vary more.
SHARE = 0.6
#: Three standard deviations of the cosine of vectors that have nothing in common.
FLOOR = 3 / DIM**0.5
#: Labelled texts by which a size is measured; sizes with fewer go by the nearest one.
LEAST_ROWS, CELLS = 20, 1024
#: A text with more distinct trigrams is judged by so many that it has most often, ties in order of their codes.
COMMONEST = 512
SIZES = COMMONEST.bit_length()


_cache: dict = {}


def _symbol(cp: int) -> int:
    c = chr(cp)
    return ord(c.lower()[0]) if unicodedata.category(c).startswith("L") else _GAP


def _table() -> np.ndarray:
    """The symbol of each code point under U+10000."""
    if "symbols" not in _cache:
        _cache["symbols"] = np.array([_symbol(cp) for cp in range(0x10000)], np.uint32)
    return _cache["symbols"]


def symbols(code_points: np.ndarray) -> np.ndarray:
    out = _table()[np.minimum(code_points, 0xFFFF)]
    high = np.flatnonzero(code_points > 0xFFFF)
    if len(high):
        kinds, at = np.unique(code_points[high], return_inverse=True)
        out[high] = np.array([_symbol(int(cp)) for cp in kinds], np.uint32)[at]
    return out


def letter_vectors(alphabet: np.ndarray) -> np.ndarray:
    """A vector of DIM signs for each symbol, from a hash of it: 64 signs a hash."""
    words = np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = C.mix(C.mix(alphabet.astype(np.uint64) + np.uint64(SEED << 32))[:, None] + words[None, :])
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def trigram_counts(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents x trigrams) counts of a chunk, the trigrams' symbols (n x 3), and which documents have a letter."""
    texts = [t or "" for t in array.to_pylist()]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    sym = symbols(np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32))
    # runs of gaps become one, but each document keeps one at its start and end
    keep = (sym != _GAP) | (np.concatenate([[1], sym[:-1]]) != _GAP)
    doc_of = np.repeat(np.arange(len(texts)), lengths)
    sym, doc_of = sym[keep], doc_of[keep]
    has = np.bincount(doc_of[sym != _GAP], minlength=len(texts)) > 0
    if len(sym) < 2:
        return np.zeros((len(texts), 0), np.float32), np.zeros((0, 3), np.uint32), has
    # symbols are numbered within the chunk, in their own order, so trigrams are in the same order in every chunk
    seen = np.zeros(0x110000, bool)
    seen[sym] = True
    seen[_GAP] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    local, n = number[sym], len(alphabet)
    before = np.concatenate([[0], local[:-1]])
    code = (before[:-1] * n + local[:-1]) * n + local[1:]
    same = (doc_of[1:] == doc_of[:-1]) & (local[:-1] != 0)
    code, of = code[same], doc_of[:-1][same]
    if n**3 <= 1 << 21:
        there = np.zeros(n**3, bool)
        there[code] = True
        codes = np.flatnonzero(there)
        place = np.zeros(n**3, np.int32)
        place[codes] = np.arange(len(codes))
        place = place[code]
    else:
        codes, place = np.unique(code, return_inverse=True)
    counts = np.bincount(of * len(codes) + place, minlength=len(texts) * len(codes)).reshape(len(texts), len(codes))
    return counts.astype(np.float32), alphabet[np.stack([codes // n**2, codes // n % n, codes % n], axis=1)].astype(np.uint32), has


def bind(trigrams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, given as rows of three symbols."""
    alphabet, at = np.unique(trigrams, return_inverse=True)
    letters, at = letter_vectors(alphabet), at.reshape(trigrams.shape)
    return np.roll(letters, 2, axis=1)[at[:, 0]] * np.roll(letters, 1, axis=1)[at[:, 1]] * letters[at[:, 2]]


def bundles(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a chunk of texts (whole numbers), and which of them have a letter."""
    counts, codes, has = trigram_counts(array)
    out = np.zeros((len(has), DIM))
    for at in range(0, len(codes), 4096):
        out += counts[:, at : at + 4096] @ bind(codes[at : at + 4096])
    return out, has


def profiles(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a chunk of texts, those of their distinct trigrams (units), the doublings of distinct trigrams, and which have a letter."""
    counts, codes, has = trigram_counts(array)
    some = (counts > 0).astype(np.float32)
    for i in np.flatnonzero(some.sum(axis=1) > COMMONEST):
        some[i] = 0
        some[i, np.argsort(-counts[i], kind="stable")[:COMMONEST]] = 1
    out, once = np.zeros((len(has), DIM)), np.zeros((len(has), DIM))
    for at in range(0, len(codes), 4096):
        vectors = bind(codes[at : at + 4096])
        out += counts[:, at : at + 4096] @ vectors
        once += some[:, at : at + 4096] @ vectors
    once /= np.maximum(np.linalg.norm(once, axis=1, keepdims=True), 1e-12)
    return out, once, np.log2(np.maximum(some.sum(axis=1), 1)).astype(np.int64), has


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of the languages in ``lang``, over all rows where it isn't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in C.chunks(batch, "__text", CHUNK_BYTES, CHUNK_ROWS):
                names = np.array(part.column("__lang").to_pylist(), object)
                counts, codes, _ = trigram_counts(part.column("__text"))
                for name in dict.fromkeys(names.tolist()):
                    # counts are summed first; the bundle of a sum is the sum of the bundles
                    of = counts[names == name].sum(axis=0, dtype=np.float64)
                    for at in range(0, len(codes), 4096):
                        sums[name] = sums.get(name, 0) + of[at : at + 4096] @ bind(codes[at : at + 4096]).astype(np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(np.broadcast_to(total, (DIM,))).astype(np.int64))], names=["lang", "place", "total"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang")).mapInArrow(run, "lang string, place int, total long")
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "place").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["place"]] = r["total"]
    return {k: out[k] for k in sorted(out)}


def _names(prototypes: dict[str, np.ndarray]) -> list[str]:
    return [k for k, v in prototypes.items() if np.any(v)]


def limits(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> np.ndarray:
    """The least likeness of a text to each language, by doublings of distinct trigrams; ``docs``: the rows that ``prototypes`` were learned from."""
    names = _names(prototypes)
    index = {k: i for i, k in enumerate(names)}
    total = np.array([prototypes[k] for k in names], np.float64).reshape(len(names), DIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part in C.chunks(batch, "__text", CHUNK_BYTES, CHUNK_ROWS):
                label = np.array([index.get(x, -1) for x in part.column("__lang").to_pylist()], np.int64)
                vectors, once, size, has = profiles(part.column("__text"))
                ok = has & (label >= 0)
                label, size = label[ok], size[ok]
                others = total[label] - vectors[ok]
                cosine = (once[ok] * others).sum(axis=1) / np.maximum(np.linalg.norm(others, axis=1), 1e-12)
                cell = np.clip((cosine * CELLS).astype(np.int64), 0, CELLS - 1)
                for key, n in zip(*np.unique((label * SIZES + size) * CELLS + cell, return_counts=True), strict=True):
                    seen[int(key)] = seen.get(int(key), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["cell", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang")).mapInArrow(run, "cell long, n long")
    held = np.zeros(len(names) * SIZES * CELLS, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        held[r["cell"]] = r["n"]
    held = held.reshape(len(names), SIZES, CELLS)
    out = np.full((len(names), SIZES), FLOOR)
    for i, of in enumerate(held):
        n = of.sum(axis=1)
        good = np.flatnonzero(n >= min(LEAST_ROWS, n.max()))
        good = good[n[good] > 0]
        for size in range(SIZES if len(good) else 0):
            by = good[np.abs(good - size).argmin()]
            low, half = (int(np.searchsorted(np.cumsum(of[by]), share * n[by])) / CELLS for share in (0.05, 0.5))
            # fewer trigrams have a smaller cosine, as the root of their number; more of them add rare ones, which takes less away
            out[i, size] = max(FLOOR, min(SHARE * low, 2 * low - half) * 2.0 ** (min(size - by, 0) / 2 - max(size - by, 0) / 4))
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", least: np.ndarray | None = None, known: str = "known") -> DataFrame:
    """``docs`` with lang_pred and score; with ``least``, the :func:`limits`, also whether a text reaches that of some language, as ``known``."""
    names = _names(prototypes)
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).reshape(len(names), DIM)
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    centred = unit - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    base = C.replace_columns(docs, {"lang_pred", "score"} | ({known} if least is not None else set()))
    fields = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.chunks(batch, text, CHUNK_BYTES, CHUNK_ROWS):
                if least is None:
                    vectors, has = bundles(part.column(text))
                else:
                    vectors, once, size, has = profiles(part.column(text))
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                if names:
                    vectors -= mean
                    cosines = (vectors @ centred.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                    best = cosines.argmax(axis=1)
                    score = np.clip((1 + cosines[np.arange(len(best)), best]) / 2, 0, 1)
                ok = has & bool(names)
                pred = [names[best[i]] if ok[i] else "und" for i in range(part.num_rows)]
                out = np.where(ok, score, 0.0) if names else np.zeros(part.num_rows)
                made = [pa.array(pred, pa.string()), pa.array(out, pa.float64())]
                if least is not None:
                    made.append(pa.array(has & (once @ unit.T >= least.T[size]).any(axis=1)))
                yield pa.RecordBatch.from_arrays([*[part.column(f) for f in fields], *made], names=[*fields, *results])

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType())] + ([(known, T.BooleanType())] if least is not None else [])
    results = [n for n, _ in added]
    return base.mapInArrow(run, C.struct_of(base, added))


def learning_rows(doc_id: str = "doc_id") -> Column:
    return ~C.held_out(doc_id)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    prototypes = learn(docs.where(learning_rows()))
    return identify(docs.select("doc_id", "text"), prototypes).select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
