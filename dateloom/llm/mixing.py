"""Mixing to target weights: token counts of cells are raked to marginals, documents sampled by calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.functions.text import bound
from dateloom.llm.common import small, written
from dateloom.llm.line_rules import words

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mixture:
    """temper: exponent of the natural shares of source and language (1 keeps them, 0 makes all equal), topic_temper: of topics;
    topics: buckets; share: of all tokens that the sample shall hold; cells: combinations up to which the driver rakes;
    values: of a dimension, whose sums and targets the driver holds; rounds: of raking at most; tolerance: greatest miss of a target, as a share of the sample."""

    temper: float = 0.7
    topic_temper: float = 0.5
    topics: int = 8
    share: float = 0.8
    rounds: int = 200
    tolerance: float = 1e-6
    cells: int = 200_000
    values: int = 1_000_000
    seed: int = 3


def _told(text: Column, topics: int) -> Column:
    """struct<tokens, topic> of a text: its number of words, and a stand-in for a topic label, which the table lacks: the bucket
    into which most of its words of five characters or more fall, of equally full ones the first. The whole text counts;
    texts without such words are topic0."""

    def topic(buckets: Column) -> Column:
        full = F.array(*[F.struct((F.size(buckets) - F.size(F.array_remove(buckets, F.lit(k)))).alias("n"), F.lit(-k).alias("k")) for k in range(topics)])
        return F.concat(F.lit("topic"), (-F.array_max(full)["k"]).cast("string"))

    def of(own: Column) -> Column:
        buckets = F.transform(F.filter(own, lambda w: F.char_length(w) >= 5), lambda w: F.pmod(F.xxhash64(w), F.lit(topics)).cast("int"))
        return F.struct(F.size(own).cast("long").alias("tokens"), bound(buckets, topic).alias("topic"))

    return bound(words(F.lower(text)), of)


def labelled(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """(row, doc_id, source, lang, topic, tokens) of documents (doc_id, text, source, lang, ...); row holds all their columns, a
    null source or language is '' of its own."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", text("source").alias("source"), text("lang").alias("lang"), _told(text("text"), mixture.topics).alias("told"))
    return out.select("row", "doc_id", "source", "lang", F.col("told.topic").alias("topic"), F.col("told.tokens").alias("tokens"))


class Infeasible(ValueError):
    """Targets that no probabilities up to 1 meet at the share asked for; `greatest` is the greatest share that meets them."""

    def __init__(self, share: float, greatest: float):
        super().__init__(f"no sample of a share of {share} meets the targets; the greatest that does is {greatest:.4f}")
        self.greatest = greatest


def flattened(tokens: dict[str, float], power: float, share: float) -> dict[str, float]:
    """Target shares of a dimension: natural token shares to a power, scaled to 1, none above what its tokens give to a
    sample of `share`; what a cut target loses goes to the others in proportion. Values without tokens have none."""
    known = {v: n for v, n in tokens.items() if n > 0}
    total = sum(known.values())
    out, open_ = {}, {v: (n / total) ** power for v, n in known.items()}
    while open_:
        scale = (1 - sum(out.values())) / sum(open_.values())
        over = [v for v, t in open_.items() if scale * t > known[v] / total / share]
        if not over or len(over) == len(open_):
            return out | {v: scale * t for v, t in open_.items()}
        out |= {v: known[v] / total / share for v in over}
        open_ = {v: t for v, t in open_.items() if v not in out}
    return out


def _multipliers(code: np.ndarray, n: int, tokens: np.ndarray, factor: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each value the m at which sum(tokens * min(1, m * factor)) is as wanted; 1 / least factor where all its tokens are too few."""
    by = np.lexsort((-factor, code))
    c, t, f = code[by], tokens[by], factor[by]
    first = np.searchsorted(c, np.arange(n))
    sums = lambda x: np.concatenate(([0.0], np.cumsum(x)))
    held, weight = sums(t), sums(t * f)
    ends = np.searchsorted(c, np.arange(n), side="right")
    # with the k largest factors of a value at 1, the rest shares what is left; the first k that fits is the answer
    capped, rest = held[:-1] - held[first[c]], weight[ends[c]] - weight[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (wanted[c] - capped) / rest
    fits = np.flatnonzero((rest > 0) & (m * f <= 1 + 1e-12) & (m >= 0))
    out = np.array([1 / max(f[e - 1], 1e-300) if e > s else 1.0 for s, e in zip(first, ends)])
    out[c[fits][::-1]] = m[fits][::-1]
    return out


def _raked_here(cells: pd.DataFrame, targets: dict[str, dict], mixture: Mixture, share: float) -> tuple[np.ndarray, float]:
    """(factors, greatest miss as a share of the sample): min(1, factor) is the probability that meets the targets."""
    tokens = cells["tokens"].to_numpy(float)
    total = share * tokens.sum()
    factor, off, best, stalled = np.full(len(cells), share), 0.0, np.inf, 0
    if not total:
        return factor, off
    codes = {d: pd.factorize(cells[d], sort=True) for d in DIMENSIONS}
    aims = {d: np.array([targets[d].get(n, 0.0) for n in codes[d][1]]) * total for d in DIMENSIONS}
    some = tokens > 0
    for _ in range(mixture.rounds):
        off = max(float(np.abs(np.bincount(codes[d][0], tokens * np.minimum(1, factor), len(aims[d])) - aims[d]).max()) for d in DIMENSIONS) / total
        stalled = 0 if off < 0.9 * best else stalled + 1
        best = min(best, off)
        if off < mixture.tolerance or stalled > 20:
            break
        for d in DIMENSIONS:
            code = codes[d][0]
            factor[some] *= _multipliers(code[some], len(aims[d]), tokens[some], factor[some], aims[d])[code[some]]
    return factor, off


def _raked_there(cells: DataFrame, targets: dict[str, DataFrame], mixture: Mixture, share: float) -> tuple[DataFrame, float]:
    """The same as a loop of joins, for more cells than the driver should hold; each step is a table. A step moves the
    factors of a value by what its tokens below probability 1 need, so that no group is sorted in one task."""
    total = share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.withColumn("factor", F.lit(share))
    off, best, stalled = 0.0, float("inf"), 0
    for _ in range(mixture.rounds if total else 0):
        off = 0.0
        for d in DIMENSIONS:
            below = F.col("factor") < 1
            now = cells.groupBy(d).agg(F.sum(F.when(below, 0.0).otherwise(F.col("tokens"))).alias("capped"), F.sum(F.when(below, F.col("tokens") * F.col("factor")).otherwise(0.0)).alias("rest"), F.sum(F.col("tokens") * F.col("factor")).alias("all"))
            now = now.join(targets[d], d, "left").withColumn("wanted", F.coalesce("target", F.lit(0.0)) * total)
            told = F.when((F.col("rest") > 0) & (F.col("wanted") > F.col("capped")), (F.col("wanted") - F.col("capped")) / F.col("rest")).when(F.col("wanted") < F.col("capped"), F.col("wanted") / F.col("all")).otherwise(1.0)
            scale = written(now.select(d, told.alias("m"), F.abs(F.col("capped") + F.col("rest") - F.col("wanted")).alias("miss")), "margin")
            off = max(off, (scale.agg(F.max("miss")).first()[0] or 0.0) / total)
            cells = written(cells.join(small(scale.drop("miss")), d).withColumn("factor", F.col("factor") * F.col("m")).drop("m"), "raked")
        stalled = 0 if off < 0.9 * best else stalled + 1
        best = min(best, off)
        if off < mixture.tolerance or stalled > 20:
            break
    return cells, off


def raked(cells: DataFrame, mixture: Mixture = Mixture(), targets: dict[str, dict] | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with `factor` and `probability` = min(1, factor): the tokens expected of a sample
    of mixture.share meet the targets ({dimension: {value: share of the sample}}) of all three dimensions.

    Raking caps probabilities within its loop, so nothing is lost by capping afterwards. Given targets that cannot be met
    at that share raise Infeasible. Without given ones, natural shares are flattened as far as the share allows for
    each dimension, and moved towards the natural ones in steps of a tenth until all three can be met together. Up to
    mixture.cells cells the driver rakes, beyond that Spark does; both find the same probabilities.
    """
    spark = cells.sparkSession
    sums = {d: {r[0]: r[1] or 0 for r in _few(cells.groupBy(d).agg(F.sum("tokens")), mixture).collect()} for d in DIMENSIONS}
    here = cells.orderBy(*DIMENSIONS).toPandas() if cells.limit(mixture.cells + 1).count() <= mixture.cells else None

    def attempt(aims: dict[str, dict], share: float):
        if here is not None:
            return _raked_here(here, aims, mixture, share)
        return _raked_there(cells, {d: spark.createDataFrame(list(aims[d].items()) or [("", 0.0)], f"{d} string, target double") for d in DIMENSIONS}, mixture, share)

    met = max(1e-4, mixture.tolerance)
    if targets is not None:
        factor, off = attempt(targets, mixture.share)
        if off > met:
            low, high = 0.0, mixture.share
            while high - low > 1e-4:
                middle = (low + high) / 2
                low, high = (middle, high) if attempt(targets, middle)[1] <= met else (low, middle)
            raise Infeasible(mixture.share, low)
    else:
        for flat in range(10, -1, -1):
            factor, off = attempt(blended(sums, mixture, flat / 10), mixture.share)
            if off <= met:
                break
    if here is None:
        return factor.withColumn("probability", F.least(F.lit(1.0), "factor"))
    rows = [(*map(str, r[:3]), int(r[3]), float(x), float(min(1.0, x))) for r, x in zip(here[[*DIMENSIONS, "tokens"]].itertuples(index=False), factor)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, factor double, probability double")


def blended(sums: dict[str, dict], mixture: Mixture, flat: float) -> dict[str, dict]:
    """Targets {dimension: {value: share}}: `flat` parts of the flattened shares, the rest of the natural ones."""
    out = {}
    for d in DIMENSIONS:
        total = sum(sums[d].values())
        aims = flattened(sums[d], mixture.topic_temper if d == "topic" else mixture.temper, mixture.share)
        out[d] = {v: flat * t + (1 - flat) * sums[d][v] / total for v, t in aims.items()}
    return out


def _few(margin: DataFrame, mixture: Mixture) -> DataFrame:
    """The sums of a dimension, a row for each of its values, which the driver holds; more of them than cells are refused."""
    if margin.limit(mixture.values + 1).count() > mixture.values:
        raise ValueError(f"a dimension has more than {mixture.values} values; group the rare ones before mixing")
    return margin


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone; a null id counts as the empty text."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(16**12)


def mixed(documents: DataFrame, mixture: Mixture = Mixture(), targets: dict[str, dict] | None = None) -> DataFrame:
    """documents (doc_id, text, source, lang, ...) with topic, n_tokens, probability and sampled.

    Counts cover all documents, added up within partitions first; the tokens expected of the sample meet the targets
    (see raked). Rows that repeat a doc_id share its random number, so copies in one cell go or stay together. A null
    text has no tokens; cells without tokens have the share as probability. An empty table gives no rows. Columns of an
    added name are replaced, other columns are passed on.
    """
    rows = labelled(documents.drop("topic", "n_tokens", "probability", "sampled"), mixture)
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    told = written(raked(written(cells, "cells"), mixture, targets), "told")
    out = rows.join(small(told.select(*DIMENSIONS, "probability")), list(DIMENSIONS), "left")
    sampled = uniform(F.col("doc_id"), mixture.seed) < F.col("probability")
    return out.select("row.*", "topic", F.col("tokens").alias("n_tokens"), "probability", sampled.alias("sampled"))
