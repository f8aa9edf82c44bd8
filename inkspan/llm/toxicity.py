"""Toxicity by a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits (bytes from 0x80 on count as letters), folded to lower case in ASCII and Latin-1. The
chain has two states, clean and toxic. A token's emission adds hashed weights of itself, of its first 4 to 8 bytes and of
both neighbours; transitions have weights of their own. A document is one chain, whatever its length. Forward-backward gives each
token's marginal, in step over thousands of stretches of ``STRETCH`` tokens at once: the product of a stretch's transfer
matrices first carries the messages from stretch to stretch of a document, then each stretch runs with what enters it at both
ends. Spans of marginals of 0.5 or more are the offending offsets; a document's score is a logistic function of the sum and the
largest of its marginals.

Learning. Labels are of documents, so token labels come from them: in toxic learning texts a token is labelled toxic if it,
or one of its prefixes, is rare in clean texts and common enough in toxic ones (``PRECISION``, ``SUPPORT``), copies and near copies (by minwise
hashing) counting once; all other tokens are clean. At most
``PER_CLASS`` toxic and as many clean labelled documents, those of the least hash of their id, are fitted on, and of these as
many as have ``PER_CLASS_CHARS`` characters together (one at least), texts of more than ``LONG`` characters last, so that one of
them can't take the room of all others; these bounds are parameters. How common each label is, which the score needs, is counted over all learning labels.

Defined results: null and empty texts score as a text without toxic tokens; a document with several labels counts with the
largest; without labels of both kinds, all scores are the share of toxic labels (0.0 without labels). Rows are scored one by
one, whatever their id; an empty table gives an empty one; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from . import common as C

PER_CLASS, PER_CLASS_CHARS, LONG, STRETCH, BITS = 1500, 4_000_000, 20_000, 64, 17
PRECISION, SUPPORT = 0.9, 0.02
ROUNDS, PENALTY, THRESHOLD = 60, 1e-6, 0.3

_SPLIT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
PREFIXES = (4, 5, 6, 7, 8)
#: Kinds of features: the token, its prefixes, the tokens before and after.
KINDS = 3 + len(PREFIXES)


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and Latin-1 (0xC3, then 0x80 to 0x9E but 0x97) made small."""
    out = _FOLD[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    b = data[second]
    out[second[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 0x20
    return out


@dataclass
class Model:
    weights: np.ndarray  # (KINDS, 2**BITS)
    bias: float
    moves: np.ndarray  # (2, 2) transition weights, from row to column
    rule: np.ndarray  # constant, sum, largest
    share: float  # of toxic labels
    fitted: bool


class Tokens:
    """Tokens of a chunk of texts, and how they are laid out in stretches: ``place`` (STRETCH x stretches) holds token numbers, or -1;
    ``depth``: of each stretch, how many of its document come before it."""

    def __init__(self, array: pa.Array):
        self.words = words = C.Words(array, _SPLIT)
        self.kinds = words.hashes(folded(words.data), PREFIXES)
        self.hashes = self.kinds[0]
        n, counts = len(words), words.counts()
        self.doc = np.repeat(np.arange(len(counts)), counts)
        token = np.arange(n)
        inner = token - np.repeat(words.first[:-1], counts)
        per_doc = -(-counts // STRETCH)
        stretch = np.repeat(np.cumsum(per_doc) - per_doc, counts) + inner // STRETCH
        self.depth = np.arange(int(per_doc.sum())) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        self.place = np.full((STRETCH, int(per_doc.sum())), -1, np.int64)
        self.place[inner % STRETCH, stretch] = token
        buckets = [(h >> np.uint64(64 - BITS)).astype(np.int32) for h in self.kinds]
        before, after = np.roll(buckets[0], 1), np.roll(buckets[0], -1)
        # at a text's ends the neighbour is the empty bucket 0
        edge = np.ones(n, bool)
        edge[1:] = self.doc[1:] != self.doc[:-1]
        before[edge] = 0
        after[np.roll(edge, -1) if n else edge] = 0
        self.features = (*buckets, before, after)

    def emissions(self, model: Model) -> np.ndarray:
        out = np.full(len(self.hashes), model.bias)
        for w, f in zip(model.weights, self.features, strict=True):
            out += w[f]
        return out


def messages(e: np.ndarray, real: np.ndarray, m: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds (toxic over clean) that enter each stretch from the one before it, and those that the ones after it send back.

    e and m: exponentials of emissions and moves. A stretch's transfer matrix is the product of (move, emission) over its tokens,
    from the state of the token before it to that of its last one; a document's first token has no move. Documents of one
    stretch, most of them, need none of this.
    """
    enter, back = np.ones(len(depth)), np.ones(len(depth))
    last = np.append(depth[1:] == 0, True) if len(depth) else np.zeros(0, bool)
    many = np.flatnonzero(~((depth == 0) & last))
    if not len(many):
        return enter, back
    x, there, first = e[:, many], real[:, many], depth[many] == 0
    p = [[np.where(first, 1.0, m[0, 0]), np.where(first, 1.0, m[0, 1]) * x[0]], [np.where(first, 1.0, m[1, 0]), np.where(first, 1.0, m[1, 1]) * x[0]]]
    for t in range(1, len(x)):
        go = there[t]
        p = [[np.where(go, a * m[0, 0] + b * m[1, 0], a), np.where(go, (a * m[0, 1] + b * m[1, 1]) * x[t], b)] for a, b in p]
        if t % 8 == 0:
            size = p[0][0] + p[0][1] + p[1][0] + p[1][1]
            p = [[a / size, b / size] for a, b in p]
    matrix = np.ones((len(depth), 2, 2))
    matrix[many] = np.stack([np.stack(row, axis=-1) for row in p], axis=1)
    by_depth = many[np.argsort(depth[many], kind="stable")]
    cuts = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    row, col = np.full((len(depth), 2), 0.5), np.ones((len(depth), 2))
    for d, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        of = by_depth[lo:hi]
        before = row[of - 1] if d else row[of]
        if d:
            enter[of] = before[:, 1] / before[:, 0]
        after = np.einsum("ni,nij->nj", before, matrix[of])
        row[of] = after / after.sum(axis=1, keepdims=True)
    for lo, hi in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):
        of = by_depth[lo:hi]
        after = np.where(last[of][:, None], 1.0, col[np.minimum(of + 1, len(depth) - 1)])
        back[of] = after[:, 1] / after[:, 0]
        sent = np.einsum("nij,nj->ni", matrix[of], after)
        col[of] = sent / sent.sum(axis=1, keepdims=True)
    return enter, back


def _exponentials(emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(np.clip(emission, -40, 40)), np.exp(moves)


def forward_backward(emission: np.ndarray, real: np.ndarray, moves: np.ndarray, depth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Toxic marginals (steps x stretches), expected numbers of the four moves, and the sum of the chains' log partition functions.

    emission: weight of the toxic state against the clean one; real: which places hold a token, always a stretch's first ones;
    depth: of each stretch, its number within its chain, whose stretches stand next to each other (None: each is a chain).
    """
    steps, n = emission.shape
    e, m = _exponentials(emission, moves)
    depth = np.zeros(n, np.int64) if depth is None else depth
    enter, back = messages(e, real, m, depth)
    first = depth == 0
    f1 = np.empty_like(e)
    total = 0.0
    # the state before the stretch; a first token's own is taken as it is
    g = enter / (1 + enter)
    a0, a1 = 1 - g, g
    for t in range(steps):
        n0, n1 = a0 * m[0, 0] + a1 * m[1, 0], a0 * m[0, 1] + a1 * m[1, 1]
        if not t:
            n0, n1 = np.where(first, 1.0, n0), np.where(first, 1.0, n1)
        n1 = n1 * e[t]
        a0, a1 = np.where(real[t], n0, a0), np.where(real[t], n1, a1)
        scale = a0 + a1
        a0, a1 = a0 / scale, a1 / scale
        total += float(np.log(scale[real[t]]).sum())
        f1[t] = a1
    marginal = np.zeros_like(e)
    expected = np.zeros((2, 2))
    b0, b1 = 1 / (1 + back), back / (1 + back)
    for t in range(steps - 1, -1, -1):
        x1, x0 = f1[t] * b1, (1 - f1[t]) * b0
        marginal[t] = np.where(real[t], x1 / (x0 + x1), 0)
        before, r = (f1[t - 1], real[t]) if t else (g, real[0] & ~first)
        # unnormalised joint of the states before and at t
        p = [[(1 - before) * m[0, 0] * b0, (1 - before) * m[0, 1] * e[t] * b1], [before * m[1, 0] * b0, before * m[1, 1] * e[t] * b1]]
        z = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        for i in range(2):
            for j in range(2):
                expected[i, j] += float((p[i][j] / z)[r].sum())
        n0, n1 = m[0, 0] * b0 + m[0, 1] * e[t] * b1, m[1, 0] * b0 + m[1, 1] * e[t] * b1
        size = n0 + n1
        b0, b1 = np.where(r, n0 / size, b0), np.where(r, n1 / size, b1)
    return marginal, expected, total


def marginals(tokens: Tokens, model: Model) -> np.ndarray:
    """The toxic marginal of each token."""
    n = len(tokens.hashes)
    out = np.zeros(n)
    if n:
        real = tokens.place >= 0
        e = np.where(real, tokens.emissions(model)[tokens.place], 0)
        out[tokens.place[real]] = _marginals_only(e, real, model.moves, tokens.depth)[real]
    return out


def _marginals_only(emission: np.ndarray, real: np.ndarray, moves: np.ndarray, depth: np.ndarray | None = None) -> np.ndarray:
    """As :func:`forward_backward`, on odds: r is the weight of toxic over clean."""
    e, m = _exponentials(emission, moves)
    depth = np.zeros(e.shape[1], np.int64) if depth is None else depth
    enter, back = messages(e, real, m, depth)
    forward = np.empty_like(e)
    r = forward[0] = np.where(depth == 0, 1.0, (m[0, 1] + m[1, 1] * enter) / (m[0, 0] + m[1, 0] * enter)) * e[0]
    for t in range(1, len(e)):
        r = forward[t] = (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r) * e[t]
    after = back
    for t in range(len(e) - 1, -1, -1):
        if t + 1 < len(e):
            x = e[t + 1] * back
            back = np.where(real[t + 1], (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x), after)
        forward[t] *= back
    return forward / (1 + forward)


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of the learning texts are labelled toxic; ``toxic``: of each text."""
    one = _first_of_copies(tokens, len(toxic))
    n1, n0 = max(1, (toxic & one).sum()), max(1, (~toxic & one).sum())
    out = np.zeros(len(tokens.doc), bool)
    for hashes in tokens.kinds:
        use = one[tokens.doc] & (hashes != 0)
        order = np.lexsort((tokens.doc[use], hashes[use]))
        h, d = hashes[use][order], tokens.doc[use][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        kinds, at = np.unique(h, return_inverse=True)
        in_toxic = np.bincount(at, weights=toxic[d], minlength=len(kinds))
        in_clean = np.bincount(at, weights=~toxic[d], minlength=len(kinds))
        rate1, rate0 = (in_toxic + 0.1) / n1, (in_clean + 0.1) / n0
        marked = kinds[(in_toxic >= max(3, SUPPORT * n1)) & (rate1 / (rate1 + rate0) >= PRECISION)]
        out |= np.isin(hashes, marked)
    return out & toxic[tokens.doc]


def _first_of_copies(tokens: Tokens, n: int) -> np.ndarray:
    """False for texts that share one of four minwise hashes of their three-token sequences with an earlier text."""
    grams = C.gram_hashes(tokens.hashes, 3)
    doc = tokens.doc[: len(grams)]
    inner = doc == tokens.doc[2:] if len(grams) else np.zeros(0, bool)
    grams, doc = grams[inner], doc[inner]
    out = np.ones(n, bool)
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    for f in range(4 if len(doc) else 0):
        least = np.minimum.reduceat(C.mix(grams + np.uint64(f)), begin)
        _, first = np.unique(least, return_index=True)
        again = np.ones(len(least), bool)
        again[first] = False
        out[doc[begin[again]]] = False
    return out


def _features_of_docs(p: np.ndarray, tokens: Tokens, n: int) -> np.ndarray:
    total = np.bincount(tokens.doc, weights=p, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, tokens.doc, p)
    return np.stack([np.ones(n), np.log1p(total), top], axis=1)


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit the field on texts and their labels; ``share``: of toxic labels among all."""
    model = Model(np.zeros((KINDS, 1 << BITS)), -4.0, np.array([[0.0, -1.0], [-1.0, 0.0]]), np.array([0.0, 0.0, 0.0]), share, False)
    if not len(texts) or toxic.all() or not toxic.any():
        return model
    tokens = Tokens(pa.array(texts, pa.large_string()))
    gold = token_labels(tokens, toxic)
    real = tokens.place >= 0
    n = len(gold)
    inner = tokens.doc[1:] == tokens.doc[:-1]
    seen = np.bincount(2 * gold[:-1][inner] + gold[1:][inner], minlength=4).reshape(2, 2).astype(float)
    # Adam on the penalised log likelihood a token
    step = {"w": model.weights, "b": np.array([model.bias]), "m": model.moves}
    first, second = ({k: np.zeros_like(v) for k, v in step.items()} for _ in range(2))
    for i in range(1, ROUNDS + 1):
        model.weights, model.bias, model.moves = step["w"], float(step["b"][0]), step["m"]
        e = np.where(real, tokens.emissions(model)[tokens.place], 0)
        p, expected, _ = forward_backward(e, real, model.moves, tokens.depth)
        flat = np.zeros(n)
        flat[tokens.place[real]] = p[real]
        miss = (gold - flat) / n
        grad = {"w": np.stack([np.bincount(f, weights=miss, minlength=1 << BITS) for f in tokens.features]) - PENALTY * step["w"], "b": np.array([miss.sum()]), "m": (seen - expected) / n}
        grad["m"][0, 0] = 0  # one move is the measure of the others
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            step[k] = step[k] + 0.3 * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-9)
    model.weights, model.bias, model.moves = step["w"].astype(np.float32), float(step["b"][0]), step["m"]
    x = _features_of_docs(marginals(tokens, model), tokens, len(texts))
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (~toxic).mean())
    rule = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ rule, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        rule = rule + np.linalg.solve(h, x.T @ (weight * (toxic - q)) - 1e-2 * rule)
    model.rule, model.fitted = rule, True
    return model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, per_class_chars: int = PER_CLASS_CHARS, long: int = LONG) -> Model:
    """Fit on at most ``per_class`` documents of each label; rows without id, text or label are passed over."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).alias("__toxic"))
    n = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    share = n.get(True, 0) / max(1, sum(n.values()))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = known.where("__toxic").orderBy(*order).limit(per_class).unionByName(known.where("not __toxic").orderBy(*order).limit(per_class))
    read = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
    # at most 2 * per_class ids; rows that repeat both id and text are one
    found = C.durable(read.join(F.broadcast(chosen), "__id").dropDuplicates(["__id", "__hash"]))
    facts = found.select("__id", "__hash", "__toxic", F.length("__text").alias("__size"))
    w = W.partitionBy("__toxic").orderBy(F.col("__size") > long, *order, "__hash").rowsBetween(W.unboundedPreceding, 0)
    placed = facts.withColumns({"__upto": F.sum("__size").over(w), "__n": F.count(F.lit(1)).over(w)})
    # rows that share an id are no more than there may be ids
    taken = placed.where(((F.col("__upto") <= per_class_chars) & (F.col("__n") <= per_class)) | (F.col("__n") == 1)).select("__id", "__hash")
    fits = found.join(F.broadcast(taken), ["__id", "__hash"])
    rows = fits.groupBy("__text").agg(F.max("__toxic").alias("__toxic"))
    got = sorted(rows.collect(), key=lambda r: r["__text"])
    return fit([r["__text"] for r in got], np.array([r["__toxic"] for r in got], bool), share)


def score(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = True) -> DataFrame:
    """``docs`` with score, predicted and, ``with_spans``, spans: (start, end, marginal) in characters of each run of toxic tokens."""
    extra = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    if with_spans:
        extra.append(("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))))
    base = C.replace_columns(docs, {n for n, _ in extra})
    fields = base.columns
    names = [*fields, *[n for n, _ in extra]]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in C.chunks(batch, text):
                n = part.num_rows
                tokens = Tokens(part.column(text))
                p = marginals(tokens, model)
                z = _features_of_docs(p, tokens, n) @ model.rule
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if model.fitted else np.full(n, model.share)
                new = [pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))]
                if with_spans:
                    new.append(_spans(tokens, p, n))
                yield pa.RecordBatch.from_arrays([*[part.column(f) for f in fields], *new], names=names)

    return base.mapInArrow(run, C.struct_of(base, extra))


def _spans(tokens: Tokens, p: np.ndarray, n: int) -> pa.Array:
    words, hot = tokens.words, np.flatnonzero(p >= 0.5)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
    out: list[list] = [[] for _ in range(n)]
    chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    last = -2
    for t in hot.tolist():
        d = int(tokens.doc[t])
        base = chars[words.offsets[d]]
        if t == last + 1 and out[d]:
            out[d][-1]["end"] = int(chars[words.end[t]] - base)
            out[d][-1]["marginal"] = max(out[d][-1]["marginal"], float(p[t]))
        else:
            out[d].append({"start": int(chars[words.start[t]] - base), "end": int(chars[words.end[t]] - base), "marginal": float(p[t])})
        last = t
    return pa.array(out, pa.list_(kind))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    model = learn(docs.where(~C.held_out()), labels.where(~C.held_out()))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", C.held_out().alias("held_out"), "score", "predicted", F.to_json("spans").alias("spans"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
