"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked: in turn each margin's cells are scaled so that their sums meet
the margin's targets, until no margin is off by more than ``TOLERANCE`` of all tokens, or, where targets contradict each other,
``ROUNDS`` rounds are done; the residual is logged and given to the caller. A cell's raked share over its present share is its documents'
relative weight; probabilities are these weights times one factor, at most 1, such that the expected tokens kept are
``fraction`` of all (cells at 1 give what they have, the others make up for it). A document is kept if a uniform number,
from a hash of seed and id, is below its cell's probability, so a larger fraction only adds documents.

Targets: for each margin a dict of weights, or an exponent a: each category's target is its present share to the power of a
(0: all equal, 1: as it is). Categories missing from a dict keep their present share among themselves.

Cells are pre-aggregated before the exchange and, up to ``MAX_CELLS``, raked on the driver; beyond that, the same runs on the
cluster over the table of cells (:func:`rake_frame`), and the probabilities are joined without a broadcast. There is no exchange
of texts: if the text is not among the columns kept, texts are scanned once and the narrow facts written; else there is one
scan to count and one to decide.

A topic is a column of the input or any expression. By default it is a coarse form of the text (:func:`topic_of`), as the
tables have none.

Null sources, languages and topics count as the category ''. Null texts have no tokens and are kept by their cell's
probability like all others. Rows that share an id share their fate within a cell. An empty table gives an empty table.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

MARGINS = ("source", "lang", "topic")
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, TOLERANCE, FRACTION, SEED, MAX_CELLS = 200, 1e-12, 0.7, 8, 1 << 17
_log = logging.getLogger(__name__)


def topic_of(text: str = "text") -> Column:
    """A coarse form of a text, by its characters: empty, lines (a line break in 60 characters or more often), figures (a digit in 50), prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    breaks, digits = n - F.length(F.replace(t, F.lit("\n"), F.lit(""))), n - F.length(F.translate(t, "0123456789", ""))
    return F.when(n == 0, "empty").when(breaks * 60 >= n, "lines").when(digits * 50 >= n, "figures").otherwise("prose")


def rake(cells: list[tuple], tokens: np.ndarray, targets: dict, rounds: int = ROUNDS, tolerance: float = TOLERANCE, report: dict | None = None) -> np.ndarray:
    """Raked tokens of cells, given as tuples of categories; each margin's sums meet its targets after its own step. ``report``
    gets rounds and residual: the largest share of all tokens by which a category is off before its step in the last round."""
    weight = tokens.astype(float)
    total = weight.sum()
    steps = []
    for i, margin in enumerate(MARGINS):
        names, at = np.unique([c[i] for c in cells], return_inverse=True)
        now = np.bincount(at, weights=tokens)
        steps.append((at, _target(names.tolist(), now, targets[margin]) * total, len(names)))
    done, residual = 0, 0.0
    while done < rounds:
        done, residual = done + 1, 0.0
        for at, want, n in steps:
            have = np.bincount(at, weights=weight, minlength=n)
            residual = max(residual, float(np.abs(have - want).max(initial=0.0)) / max(total, 1.0))
            weight = weight * np.divide(want, have, out=np.zeros(n), where=have > 0)[at]
        if residual <= tolerance:
            break
    _tell(report, done, residual)
    return weight


def _tell(report: dict | None, rounds: int, residual: float) -> None:
    _log.info("raked in %d rounds, residual %g", rounds, residual)
    if report is not None:
        report |= {"rounds": rounds, "residual": residual}


def _target(names: list, now: np.ndarray, rule: float | dict) -> np.ndarray:
    share = now / max(now.sum(), 1)
    if not isinstance(rule, dict):
        share = np.where(now > 0, share ** float(rule), 0)
        return share / max(share.sum(), 1e-300)
    named = np.array([n in rule for n in names])
    want = np.array([float(rule.get(n, 0)) for n in names])
    left = max(0.0, 1 - want.sum())
    want[~named] = left * share[~named] / max(share[~named].sum(), 1e-300)
    return want / max(want.sum(), 1e-300)


def probabilities(raked: np.ndarray, tokens: np.ndarray, fraction: float) -> np.ndarray:
    """min(1, s * raked / tokens), with s such that the expected tokens are ``fraction`` of all (or all that can be had)."""
    ratio = np.divide(raked, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    order = np.argsort(-ratio, kind="stable")
    want, t, w = fraction * tokens.sum(), tokens[order].astype(float), raked[order]
    full = np.concatenate([[0], np.cumsum(t)])
    rest = w.sum() - np.concatenate([[0], np.cumsum(w)])
    for k in range(len(order)):
        if rest[k] <= 0:
            break
        scale = (want - full[k]) / rest[k]
        if scale * ratio[order[k]] <= 1:
            return np.minimum(1, np.maximum(0, scale) * ratio)
    return np.minimum(1, np.where(ratio > 0, 1.0, 0.0))


def _wants(cells: DataFrame, margin: str, rule: float | dict, total: float) -> DataFrame:
    """(category, __want): the tokens each category should have; the same rule as :func:`_target`."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("__t"))
    if not isinstance(rule, dict):
        sums = sums.withColumn("__w", F.when(F.col("__t") > 0, F.pow(F.col("__t") / total, F.lit(float(rule)))).otherwise(0.0))
    else:
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in rule.items()], f"{margin} string, __v double")  # the caller's own dict
        sums = sums.join(F.broadcast(named), margin, "left")
        of = sums.agg(F.sum("__v"), F.sum(F.when(F.col("__v").isNull(), F.col("__t")))).first()
        left, others = max(0.0, 1 - (of[0] or 0.0)), of[1] or 0.0
        sums = sums.withColumn("__w", F.coalesce("__v", F.col("__t") * F.lit(left / others if others else 0.0)))
    norm = sums.agg(F.sum("__w")).first()[0] or 1.0
    return C.durable(sums.select(margin, (F.col("__w") / norm * total).alias("__want")))


def rake_frame(cells: DataFrame, targets: dict, rounds: int = ROUNDS, fraction: float = FRACTION, tolerance: float = TOLERANCE, report: dict | None = None) -> DataFrame:
    """The same on the cluster, for more cells than a driver should hold."""
    cells = C.durable(cells.withColumn("raked", F.col("tokens").cast("double")))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wants = {margin: _wants(cells, margin, targets[margin], max(total, 1.0)) for margin in MARGINS}
    done, residual = 0, 0.0
    while done < rounds:
        done, residual = done + 1, 0.0
        for margin in MARGINS:
            have = C.durable(cells.groupBy(margin).agg(F.sum("raked").alias("__have")).join(wants[margin], margin))
            off = have.agg(F.max(F.abs(F.col("__have") - F.col("__want")))).first()[0] or 0.0
            residual = max(residual, off / max(total, 1.0))
            factor = have.select(margin, F.when(F.col("__have") > 0, F.col("__want") / F.col("__have")).otherwise(0.0).alias("__f"))
            cells = cells.join(factor, margin).withColumn("raked", F.col("raked") * F.col("__f")).drop("__f")
        cells = C.durable(cells)
        if residual <= tolerance:
            break
    _tell(report, done, residual)
    ratio = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    low, high = 0.0, 1.0
    gained = lambda s: cells.agg(F.sum(F.least(F.lit(1.0), F.lit(s) * ratio) * F.col("tokens"))).first()[0] or 0.0
    while gained(high) < fraction * total and high < 2**40:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if gained(mid) < fraction * total else (low, mid)
    return cells.select(*MARGINS, F.least(F.lit(1.0), F.lit(high) * ratio).alias("probability"))


def mix(docs: DataFrame, targets: dict | None = None, fraction: float = FRACTION, rounds: int = ROUNDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | str | None = None, max_cells: int = MAX_CELLS, columns: list[str] | None = None, report: dict | None = None) -> DataFrame:
    """``docs`` with topic, n_tokens, probability and keep. ``columns``: those of the input that are kept; all, if None. ``topic``:
    a column's name or an expression. ``report`` gets the rounds and the residual of the raking."""
    spark, targets = docs.sparkSession, ALPHAS | (targets or {})
    base = C.replace_columns(docs if columns is None else docs.select(*columns), {"topic", "n_tokens", "probability", "keep"})
    names = base.columns
    own = {k: C.free_name(docs, k) for k in ("__source", "__lang", "__topic", "__n", "__u", "__p")}
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD_PATTERN)), F.lit(0)).cast("long")
    theme = topic_of(text) if topic is None else F.col(topic) if isinstance(topic, str) else topic
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2**32
    cell = {own["__source"]: F.coalesce(F.col(source).cast("string"), F.lit("")), own["__lang"]: F.coalesce(F.col(lang).cast("string"), F.lit("")), own["__topic"]: F.coalesce(theme.cast("string"), F.lit(""))}
    full = docs.withColumns(cell | {own["__n"]: tokens, own["__u"]: uniform}).select(*[F.col(f"`{c}`") for c in names], *[own[k] for k in ("__source", "__lang", "__topic", "__n", "__u")])
    if text not in names:
        full = C.durable(full)
    keys = [own["__source"], own["__lang"], own["__topic"]]
    cells = C.durable(full.groupBy(*keys).agg(F.sum(own["__n"]).alias("tokens")).toDF(*MARGINS, "tokens"))
    if cells.count() <= max_cells:
        rows = sorted(cells.collect())
        t = np.array([r["tokens"] for r in rows], float)
        p = probabilities(rake([tuple(r)[:3] for r in rows], t, targets, rounds, report=report), t, fraction) if rows else []
        table = F.broadcast(spark.createDataFrame([(*tuple(r)[:3], float(x)) for r, x in zip(rows, p, strict=True)], "a string, b string, c string, p double"))
    else:
        table = rake_frame(cells, targets, rounds, fraction, report=report)
    placed = full.join(table.toDF(*keys, own["__p"]), keys)
    return placed.select(*[F.col(f"`{c}`") for c in names], F.col(own["__topic"]).alias("topic"), F.col(own["__n"]).alias("n_tokens"), F.col(own["__p"]).alias("probability"), (F.col(own["__u"]) < F.col(own["__p"])).alias("keep"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(C.read(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang"])
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "keep")


#: Rounds of the SQL: by then the residual is below the tolerance on the test tables.
SQL_ROUNDS = 20


def mixing_sql(rounds: int = SQL_ROUNDS, fraction: float = FRACTION, seed: int = SEED) -> str:
    text, prev, at = "", "c", 0
    for _ in range(rounds):
        for m in MARGINS:
            at += 1
            text += f"r{at} as materialized (select p.* replace (p.w * coalesce(t.want, 0) / sum(p.w) over (partition by p.{m}) as w) from {prev} p left join t_{m} t using ({m})),\n"
            prev = f"r{at}"
    margins = "".join(f"t_{m} as materialized (select {m}, pow(s, {ALPHAS[m]}) / sum(pow(s, {ALPHAS[m]})) over () * total as want from (select {m}, sum(tokens) / any_value(total) as s, any_value(total) as total from c group by 1 having sum(tokens) > 0)),\n" for m in MARGINS)
    return f"""
with d as (select doc_id, source as src, lang as lng, coalesce(source, '') as source, coalesce(lang, '') as lang, len(regexp_extract_all(coalesce(text, ''), '{C.WORD_PATTERN}')) as n_tokens,
 case when length(coalesce(text, '')) = 0 then 'empty' when (length(text) - length(replace(text, chr(10), ''))) * 60 >= length(text) then 'lines' when (length(text) - length(translate(text, '0123456789', ''))) * 50 >= length(text) then 'figures' else 'prose' end as topic from documents),
c as materialized (select source, lang, topic, tokens, tokens as w, sum(tokens) over () as total from (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)),
{margins}{text}q as (select *, case when tokens > 0 then w / tokens else 0 end as ratio from {prev}),
o as (select *, sum(tokens) over (order by ratio desc, source, lang, topic rows between unbounded preceding and 1 preceding) as full_before, sum(w) over (order by ratio desc, source, lang, topic rows between current row and unbounded following) as rest from q),
k as (select min(({fraction} * total - coalesce(full_before, 0)) / rest) as lo, arg_max(({fraction} * total - coalesce(full_before, 0)) / rest, ratio) as s from o where rest > 0 and ({fraction} * total - coalesce(full_before, 0)) / rest * ratio <= 1),
p as (select source, lang, topic, least(1, greatest(0, s) * ratio) as probability from q, k)
select doc_id, src as source, lng as lang, topic, n_tokens::bigint as n_tokens, round(probability, 6) as probability, ('0x' || substr(md5('{seed}:' || doc_id::varchar), 1, 8))::bigint / 4294967296.0 < probability as keep from d join p using (source, lang, topic)
"""


QUERIES = {"op8_mixing": op8_mixing}
SQL = {"op8_mixing": mixing_sql()}
