"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, those of the least hash of their id) the graph of nearest neighbours is cut into
equally large parts: bisection, again and again, first at the median of a principal direction, then improved by swaps of
vertices across the cut that lower the number of cut edges and keep the balance. A small network (one hidden layer) learns,
from a vector, the shares of the parts among its neighbours. Every row of the table is indexed under its most probable
part. A query goes to its most probable parts, as many as a calibration on sample queries needs for ``RECALL`` (on the
sample, where neighbours are sparser than in the table), and on until these hold enough candidates; those are ranked again
by exact cosines of the original vectors, in double precision.

Parts grow in number with the table: as many levels are made as parts of about ``PART_ROWS`` rows need, with at most
``MAX_PARTS`` parts a level. Below the first level every part has a sample, a graph and a network of its own, fitted by the
task that gets the sample; rows are placed and queries routed level by level, and each level's share of the recall is
``RECALL`` to the power of one over their number.

Parts are split into blocks of about ``BLOCK`` rows, whatever their size, and so are the queries that a part gets, so a
task holds two blocks, or a block and a network; only each query's best few of a block go on. The driver holds the first
level's sample, its network and one count for each of its parts, whatever the table's size. Rows are dealt to blocks by a number drawn
for each, so neither equal vectors nor rows of one id are a group; it is written with the row, so a task that runs again deals as before.
Queries have an id of their own each and are dealt by its hash.

Vectors that are null, zero, or hold a null or non-finite component take no part; shorter vectors count as padded with
zeros. Ties go to the smaller id; rows that share a query's id are no candidates for it, and rows that share an id are one
candidate, the nearest of them; of query rows that share an id, one (the least by its components) asks. Null ids take no
part. With fewer than k candidates, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common as C

SAMPLE, PART_ROWS, MAX_PARTS, NEIGHBOURS = 8192, 1024, 256, 10
HIDDEN, EPOCHS, RECALL, CALIBRATE = 128, 12, 0.94, 512
BLOCK, K = 4096, 5


@dataclass
class Index:
    layers: list[np.ndarray]
    parts: int
    probes: int
    width: int

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum(unit @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Of each row of x the k rows of y with the largest dot products; ``own``: a row of y to leave out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ y.T
        if own is not None:
            s[np.arange(len(s)), own[at : at + 1024]] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def cut_graph(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Equally large parts (a power of two of them) of the graph; graph: each vertex's neighbours."""
    part = np.zeros(len(x), np.int64)
    src, dst = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    size = 1
    while size < parts:
        side = np.zeros(len(x), np.int64)
        for p in range(size):
            rows = np.flatnonzero(part == p)
            c = x[rows] - x[rows].mean(axis=0)
            direction = np.linalg.svd(c[: 2048], full_matrices=False)[2][0] if len(rows) > 1 else np.ones(x.shape[1])
            side[rows[np.argsort(c @ direction, kind="stable")[len(rows) // 2 :]]] = 1
        within = part[src] == part[dst]
        s, d = src[within], dst[within]
        for _ in range(30):
            # edges to the other side less edges to the own one
            gain = np.bincount(s, weights=np.where(side[s] != side[d], 1, -1), minlength=len(x))
            moved = 0
            for p in range(size):
                a, b = np.flatnonzero((part == p) & (side == 0)), np.flatnonzero((part == p) & (side == 1))
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                m = min(len(a), len(b))
                good = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
                side[a[:good]], side[b[:good]] = 1, 0
                moved += good
            if not moved:
                break
        part, size = part * 2 + side, size * 2
    return part


def train(x: np.ndarray, target: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """One hidden layer, soft targets, Adam."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    layers = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)) * np.sqrt(width) / 2, np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, target.shape[1])), np.zeros(target.shape[1])]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    t = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            t += 1
            h = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[rows]) / len(rows)
            gh = (g @ layers[2].T) * (h > 0)
            for i, grad in enumerate((x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                layers[i] = layers[i] - 0.003 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def levels_of(rows: int) -> int:
    """Levels of at most MAX_PARTS parts each that parts of about PART_ROWS rows need."""
    levels = 1
    while PART_ROWS * MAX_PARTS**levels < rows:
        levels += 1
    return levels


def fit(sample: np.ndarray, rows: int, k: int = K, recall: float = RECALL, levels: int = 1, max_parts: int = MAX_PARTS, part_rows: int = PART_ROWS) -> Index:
    """Learn parts, the network and the number of probes from sample vectors; ``rows``: of what is to be parted, over ``levels`` levels."""
    n = len(sample)
    want = min(max_parts, max(1, rows // part_rows) ** (1 / levels))
    parts = 1
    while parts * 2 <= want * (1 + 1e-9) or (levels == 1 and parts < min(16, max_parts) and parts * 64 <= n):
        parts *= 2
    while parts > 1 and parts * 4 > n:  # too few vectors to learn so many
        parts //= 2
    width = sample.shape[1] if n else 0
    if parts == 1:
        return Index([np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1, width)
    x = units(sample)
    graph = nearest(x, x, min(NEIGHBOURS, n - 1), np.arange(n))
    part = cut_graph(x, graph, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n)[:, None], part[graph]), 1.0)
    target[np.arange(n), part] += 1
    index = Index(train(x, target / target.sum(axis=1, keepdims=True)), parts, parts, width)
    probability = index.probabilities(x)
    home = probability.argmax(axis=1)
    asked = np.arange(0, n, max(1, n // CALIBRATE))
    true = nearest(x[asked], x, min(k, n - 1), asked)
    order = np.argsort(-probability[asked], axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], 1)
    need = np.take_along_axis(rank, home[true], 1)
    share = np.array([(need < m).mean() for m in range(1, parts + 1)])
    index.probes = int(np.argmax(share >= recall)) + 1
    return index


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    array = C.to_array(column)
    flat = np.asarray(array.flatten(), np.float64)
    if len(flat) == width * len(array):
        return flat.reshape(len(array), width)
    out = np.zeros((len(array), width))
    for i, row in enumerate(array.to_pylist()):
        out[i, : len(row)] = row
    return out


def place_rows(index: Index, v: pa.Array) -> np.ndarray:
    """The part under which each vector is indexed."""
    return index.probabilities(units(_matrix(v, index.width))).argmax(axis=1)


def route_rows(index: Index, v: pa.Array, sizes: np.ndarray, ids_in: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): to which parts, among those that hold rows, each query goes. ids_in: distinct ids, each counted in one part."""
    order = np.argsort(-index.probabilities(units(_matrix(v, index.width))), axis=1, kind="stable")
    # the last part asked is the first by which enough candidates are in reach, the query itself aside
    reach = np.cumsum(ids_in[order], axis=1) > k
    enough = np.where(reach.any(axis=1), reach.argmax(axis=1), index.parts - 1)
    asked = np.arange(index.parts)[None, :] <= np.maximum(enough, index.probes - 1)[:, None]
    row, at = np.nonzero(asked & (sizes[order] > 0))
    return row, order[row, at]


def _first_level(rows: DataFrame, n: int, width: int, k: int, recall: float, sample: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v, q, draw, part) and queries (id, v, part) by the index that the driver fits."""
    spark = rows.sparkSession
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v")
    fitted = fit(_matrix(picked, width), n, k, recall, levels, MAX_PARTS, PART_ROWS)
    fitted.width = width
    index = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place_rows(index.value, batch.column("v")))], names=["id", "v", "q", "draw", "part"])

    placed = C.durable(rows.mapInArrow(place, "id long, v array<double>, q boolean, draw int, part long"))
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    # rows of an id may lie in several parts: each id counts in one, so that any parts hold as many ids as they count, or more
    home = {r["part"]: r["count"] for r in placed.groupBy("id").agg(F.min("part").alias("part")).groupBy("part").count().collect()}
    sizes, ids_in = (np.array([of.get(p, 0) for p in range(fitted.parts)]) for of in (held, home))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, part = route_rows(index.value, batch.column("v"), sizes, ids_in, k)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(part)], names=["id", "v", "part"])

    asking = placed.where("q").groupBy("id").agg(F.min("v").alias("v"))
    return placed, C.durable(asking.mapInArrow(route, "id long, v array<double>, part long"))


def _in_blocks(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """``df`` with ``b``, one of its part's blocks; blocks: (part, blocks). Rows go by what was drawn for them, queries by their id."""
    dealt = F.col("draw") if "draw" in df.columns else F.xxhash64("id")
    return df.join(blocks, "part").withColumn("b", F.pmod(dealt, F.col("blocks")).cast("int")).drop("blocks")


def _next_level(placed: DataFrame, routed: DataFrame, width: int, k: int, recall: float, sample: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The same one level down: each part is parted by an index of its own. Nothing is collected."""
    most, part_rows = MAX_PARTS, PART_ROWS
    sizes = C.durable(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    # about twice the sample by a hash of the row, then exactly those of the least hash of their id
    few = placed.join(sizes, "part").where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) * F.col("n") < F.lit(2 * sample << 30))
    first = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("id"), "id"))
    picked = few.withColumn("r", first).where(F.col("r") <= sample).select("part", "n", "v")

    def learn(table: pa.Table) -> pa.Table:
        index = fit(_matrix(table.column("v"), width), table.column("n")[0].as_py(), k, recall, levels, most, part_rows)
        index.width = width
        return pa.table({"part": table.column("part")[:1], "model": pa.array([pickle.dumps(index)], pa.binary())})

    models = C.durable(picked.groupBy("part").applyInArrow(learn, "part long, model binary"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        part = place_rows(pickle.loads(right.column("model")[0].as_py()), left.column("v")) if left.num_rows else np.zeros(0, np.int64)
        return pa.table({"id": left.column("id"), "v": left.column("v"), "q": left.column("q"), "draw": left.column("draw"), "part": pa.array(np.asarray(left.column("part")) * most + part)})

    by = ["part", "b"]
    blocks = sizes.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    each = lambda df: df.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    below = C.durable(_in_blocks(placed, blocks).groupBy(*by).cogroup(each(models.join(blocks, "part")).groupBy(*by)).applyInArrow(place, "id long, v array<double>, q boolean, draw int, part long"))

    above = F.expr(f"part div {most}")
    held = below.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    home = below.groupBy("id", above.alias("above")).agg(F.min("part").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("ids"))
    counts = held.join(home, "part", "left").groupBy(above.alias("above")).agg(F.collect_list(F.struct(F.pmod("part", F.lit(most)).alias("p"), "n", F.coalesce("ids", F.lit(0)).alias("ids"))).alias("counts"))  # at most MAX_PARTS each

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "v", "part"]
        if not left.num_rows:
            return left.select(names)
        index = pickle.loads(right.column("model")[0].as_py())
        sizes, ids_in = np.zeros(index.parts, np.int64), np.zeros(index.parts, np.int64)
        for c in right.column("counts")[0].as_py():
            sizes[c["p"]], ids_in[c["p"]] = c["n"], c["ids"]
        row, part = route_rows(index, left.column("v"), sizes, ids_in, k)
        at = pa.array(row)
        return pa.table([left.column("id").take(at), left.column("v").take(at), pa.array(np.asarray(left.column("part"))[row] * most + part)], names=names)

    blocks = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    told = each(models.join(counts.withColumnRenamed("above", "part"), "part").join(blocks, "part"))
    return below, C.durable(_in_blocks(routed, blocks).groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(route, "id long, v array<double>, part long"))


def search(table: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, report: dict | None = None) -> DataFrame:
    """For each row where ``is_query`` holds, its k nearest others: query_id, rank (from 1), vec_id, score. ``report`` gets the
    numbers of levels, of rows, of queries and of comparisons."""
    rows = table.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), (F.rand(7) * (1 << 30)).cast("int").alias("draw"))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, width = facts[0], facts[1] or 1
    levels = levels_of(n)
    share = recall ** (1 / levels)
    placed, routed = _first_level(rows, n, width, k, share, sample, levels)
    for left in range(levels - 1, 0, -1):
        placed, routed = _next_level(placed, routed, width, k, share, sample, left)
    of = [df.groupBy("part").agg(F.count(F.lit(1)).alias(name)) for df, name in ((placed, "n"), (routed, "m"))]
    pairs = C.durable(of[0].join(of[1], "part"))
    if report is not None:
        report |= {"levels": levels, "rows": n, "queries": routed.select("id").distinct().count(), "comparisons": pairs.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0}
    n_rows, n_asked = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "m"))

    def dealt(df: DataFrame, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        df = _in_blocks(df, pairs.select("part", own.alias("blocks"), other.alias("others")))
        df = df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        return df.select("part", F.col("b").alias(names[0]), F.col("o").alias(names[1]), "id", "v")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        xi, yi = np.asarray(left.column("id")), np.asarray(right.column("id"))
        order = np.argsort(yi, kind="stable")
        y, yi = y[order], yi[order]
        heads = np.flatnonzero(np.concatenate([[True], yi[1:] != yi[:-1]]))  # the first row of each id
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        out = []
        for at in range(0, len(x), 512):
            rough = (x[at : at + 512] / nx[at : at + 512, None]) @ (y / ny[:, None]).T
            rough[xi[at : at + 512, None] == yi[None, :]] = -4
            each = rough if len(heads) == len(yi) else np.maximum.reduceat(rough, heads, axis=1)
            m = min(k, len(heads))
            least = -np.partition(-each, m - 1, axis=1)[:, m - 1]
            for i in range(len(rough)):
                # the product's rounding depends on its blocks; what might be among the best is measured again, row by row
                near = np.flatnonzero((rough[i] >= least[i] - 1e-9) & (rough[i] > -3))
                s = (x[at + i] * y[near]).sum(axis=1) / (nx[at + i] * ny[near])
                first = np.lexsort((yi[near], -s))
                ids = yi[near][first]
                _, once = np.unique(ids, return_index=True)
                first = first[np.sort(once)][:k]
                out.append((np.full(len(first), xi[at + i]), yi[near[first]], s[first]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    by = ["part", "rb", "qb"]
    found = dealt(routed, n_asked, n_rows, ("qb", "rb")).groupBy(*by).cogroup(dealt(placed, n_rows, n_asked, ("rb", "qb")).groupBy(*by)).applyInArrow(best, "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_learned_partitions": op1_learned_partitions}
SQL: dict[str, str] = {}
