"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or combines them, documents teach them.

A sentence's log-odds are a bias plus the weights of its features: whole words and the first 4, 5 and 6 characters of
words, hashed to BUCKETS. Only document labels are known. Each partition counts, over all labelled documents, how
many of either label hold each bucket; the buckets that tell most are kept. Noisy-or gradients then teach their
weights from a sample of labelled documents, whose size is a documented parameter; what models without a fold say of
it calibrates the scores. Every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import frugal, small, tune, written
from dateloom.llm.quality import held_out, isotonic

#: Folds of the taught documents, for calibration.
FOLDS = 3
#: Hashed features.
BUCKETS = 1 << 18
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
#: Words that a worker remembers at most.
_REMEMBERED = 200_000


def buckets_of(word: str) -> tuple[int, ...]:
    """The hashed features of a lower-case word."""
    names = ["=" + word, *(f"{n}^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return tuple({zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names})


def sentences(text: str):
    """(start, end) of each sentence: a run without . ! ? or line break that holds a word."""
    for m in _SENTENCE.finditer(text):
        if _WORD.search(text, m.start(), m.end()):
            yield m.start(), m.end()


@dataclass(frozen=True)
class ToxicityModel:
    """kept: buckets with a weight at most; sample: labelled documents that the noisy-or learns from at most, on average;
    aim: score at which documents are called toxic; cut: the chance that is given this score."""

    kept: int = 4096
    sample: int = 40_000
    least_documents: int = 5
    steps: int = 300
    shrink: float = 1e-3
    base: float = 0.5
    bias: float = -7.0
    aim: float = 0.7
    cut: float = 0.7
    chosen: np.ndarray = field(default=None, repr=False, compare=False)
    weights: np.ndarray = field(default=None, repr=False, compare=False)
    knots: tuple = field(default=None, repr=False, compare=False)

    def calibrated(self, raw):
        """The share of labels among documents that a model without them gave such a chance, stretched so that cut is at aim."""
        share = np.interp(raw, *self.knots)
        return np.where(share < self.cut, share * self.aim / self.cut, self.aim + (share - self.cut) * (1 - self.aim) / (1 - self.cut))


class _Reader:
    """Texts to sentences with the positions of their kept features."""

    def __init__(self, chosen: np.ndarray):
        self.position = {int(b): k for k, b in enumerate(chosen)}
        self.words: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= _REMEMBERED:
                self.words.clear()
            found = self.words[word] = tuple(self.position[b] for b in buckets_of(word) if b in self.position)
        return found

    def read(self, text: str):
        """(number of sentences, [(start, end, features)] of those with a kept feature)."""
        n, told = 0, []
        for start, end in sentences(text):
            n += 1
            features: set[int] = set()
            for word in set(_WORD.findall(text[start:end].lower())):
                features.update(self.of_word(word))
            if features:
                told.append((start, end, sorted(features)))
        return n, told


def _counted(batches):
    """Each partition's number of labelled documents by bucket and label."""
    found = np.zeros((2, BUCKETS), np.int64)
    words: dict[str, tuple[int, ...]] = {}
    documents = [0, 0]
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            here: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                got = words.get(word)
                if got is None:
                    if len(words) >= _REMEMBERED:
                        words.clear()
                    got = words[word] = buckets_of(word)
                here.update(got)
            if here:
                found[int(y), np.fromiter(here, np.int64, len(here))] += 1
            documents[int(y)] += 1
    if sum(documents):
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[1, at], documents[1])), pa.array(np.append(found[0, at], documents[0]))], ["bucket", "with", "without"])


def learnt(texts: DataFrame, model: ToxicityModel = ToxicityModel()) -> ToxicityModel:
    """A model from all rows of texts (doc_id, text, y 0 or 1)."""
    counts = written(texts.select("text", "y").mapInArrow(frugal(_counted), "bucket long, with long, without long").groupBy("bucket").agg(F.sum("with").alias("p"), F.sum("without").alias("q")), "buckets")
    totals = counts.where("bucket = -1").first()
    if totals is None or not totals["p"] or not totals["q"]:
        return model
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    told = counts.where(f"bucket >= 0 and p + q >= {model.least_documents}").withColumn("gain", F.col("p") / totals["p"] - F.col("q") / totals["q"]).withColumn("odds", F.log(rate("p", totals["p"]) / rate("q", totals["q"])))
    # buckets that speak for the label clearly, by share of its documents times log of the ratio
    top = told.where("odds > 0.7").orderBy(F.desc(F.col("gain") * F.col("odds")), "bucket").limit(model.kept).select("bucket").toPandas()["bucket"].to_numpy()
    chosen = np.sort(top)
    if not len(chosen):
        return model
    wanted = totals["p"] + totals["q"]
    sample = texts if wanted <= model.sample else texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1e6 * model.sample / wanted))

    def bags(batches):
        reader = _Reader(chosen)
        for batch in batches:
            ys, plain, features, ends = [], [], [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                n, told = reader.read(text or "")
                ys.append(int(y))
                plain.append(n - len(told))
                features.append([k for _, _, found in told for k in found])
                ends.append([len(found) for _, _, found in told])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(plain, pa.int64()), pa.array(features, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), batch.column("fold")], ["y", "plain", "features", "sizes", "fold"])

    # copies of a text share a fold
    sample = sample.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    found = sample.mapInArrow(frugal(bags), "y int, plain long, features array<int>, sizes array<int>, fold int").toArrow()
    return _taught(model, chosen, found)


def _taught(model: ToxicityModel, chosen: np.ndarray, bags: pa.Table) -> ToxicityModel:
    """The climb on all bags; and the calibration that climbs on all folds but one teach by the bags of that one."""
    y = bags.column("y").to_numpy().astype(float)
    plain = bags.column("plain").to_numpy().astype(float)
    flat = lambda name: bags.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = flat("sizes")
    bag = np.repeat(np.arange(len(y)), [len(x) for x in bags.column("sizes").to_pylist()])
    data = _Bags(y, plain, flat("features"), np.repeat(np.arange(len(size)), size), bag, len(chosen))
    fold = bags.column("fold").to_numpy()
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        raw[fold == k] = data.chances(*data.climbed(model, fold != k))[fold == k]
    order = np.argsort(raw, kind="stable")
    steps = [x for x in np.array_split(order, min(len(order), 400)) if len(x)]
    fitted = isotonic(np.array([len(x) for x in steps], float), np.array([y[x].mean() for x in steps]))
    knots = np.array([raw[x].mean() for x in steps]), fitted
    cut = _best_cut(fitted, np.array([y[x].sum() for x in steps]), np.array([len(x) for x in steps]), model.aim)
    weights, bias = data.climbed(model, np.ones(len(y), bool))
    return ToxicityModel(**{**model.__dict__, "chosen": chosen, "weights": weights, "bias": float(bias), "knots": knots, "cut": cut})


def _best_cut(shares: np.ndarray, toxic: np.ndarray, documents: np.ndarray, most: float) -> float:
    """The share, `most` at most, from which calling documents toxic errs least by F1 on what was left out; the highest of equals.

    Where labels are few the shares of left-out documents are spread out, and a fixed cut misses toxic ones that are told.
    """
    best, cut = -1.0, most
    for t in sorted({most, *(float(s) for s in shares if 0.2 <= s <= most)}, reverse=True):
        of = shares >= t
        hit = toxic[of].sum()
        f1 = 2 * hit / max(1.0, documents[of].sum() + toxic.sum())
        if f1 > best + 1e-12:
            best, cut = f1, t
    return cut


class _Bags:
    """Documents as bags of sentences, these as bags of features; sentences without feature are counted only."""

    def __init__(self, y, plain, feature, sentence, bag, features):
        self.y, self.plain, self.feature, self.sentence, self.bag, self.features = y, plain, feature, sentence, bag, features

    def _parts(self, weights, bias):
        p = _sigmoid(bias + np.bincount(self.sentence, weights[self.feature], len(self.bag)))
        # log of the chance that no sentence offends
        clean = np.bincount(self.bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(self.y)) + self.plain * np.log1p(-_sigmoid(bias))
        return p, -np.expm1(clean)

    def chances(self, weights, bias) -> np.ndarray:
        """The noisy-or of each document."""
        return self._parts(weights, bias)[1]

    def climbed(self, model: ToxicityModel, of: np.ndarray):
        """Weights and bias at which the labels of the documents `of` are likeliest, by Adam; weights are shrunk."""
        weights, bias = np.full(self.features, model.base), model.bias
        moments = np.zeros((2, self.features + 1))
        for step in range(1, model.steps + 1):
            p, chance = self._parts(weights, bias)
            # d loss / d log-odds of a sentence = p * (1 - y / chance)
            pull = np.where(of, 1 - self.y / np.maximum(chance, 1e-9), 0)
            each = p * pull[self.bag]
            down = np.append(np.bincount(self.feature, each[self.sentence], self.features), each.sum() + (self.plain * _sigmoid(bias) * pull).sum()) / max(1, of.sum())
            down[:-1] += model.shrink * weights / self.features**0.5
            moments[0] = 0.9 * moments[0] + 0.1 * down
            moments[1] = 0.99 * moments[1] + 0.01 * down**2
            move = 0.1 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - move[-1]
        return weights, bias


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


_SCORED = "doc_id long, score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"


def _scores(model: ToxicityModel, least: float):
    def run(batches):
        known = model.chosen is not None
        reader = _Reader(model.chosen if known else np.zeros(0, np.int64))
        plain = np.log1p(-1 / (1 + np.exp(-model.bias))) if known else 0.0
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                n, told = reader.read(text or "")
                clean, here = plain * (n - len(told)), []
                for start, end, found in told:
                    z = model.bias + model.weights[found].sum()
                    clean -= np.logaddexp(0, z)  # log(1 - sigmoid(z))
                    p = _sigmoid(z)
                    if p >= least:
                        here.append({"start": start, "end": end, "score": float(p)})
                scores.append(float(model.calibrated(-np.expm1(clean))) if known else 0.5)
                counts.append(n)
                spans.append(here)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_sentences", "offending"])

    return run


def toxicity_scores(documents: DataFrame, labels: DataFrame, model: ToxicityModel = ToxicityModel(), threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, offending) of every row of documents (doc_id, text).

    offending lists start, end (characters) and score of each sentence that reaches the threshold by itself. Labels of
    held-out ids are not learnt from. A null text counts as empty; an empty text has no sentence and the lowest score, or 0.5
    if nothing could be learnt (no labels, or one label only). Of several labels of an id the largest counts; null
    labels and ids teach nothing. Rows that repeat a doc_id are scored each by its text.
    """
    tune(documents.sparkSession, 512)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    marks = written(marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")), "marks")
    known = written(rows.join(small(marks), "doc_id"), "labelled")
    model = learnt(known, replace(model, aim=threshold))
    out = rows.mapInArrow(frugal(_scores(model, threshold)), _SCORED)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")
