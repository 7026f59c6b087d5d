"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

One pass reads each whole text and reduces it to `len(STATISTICS)` numbers; all that follows works on those. The ridge
fit needs only sums over labelled rows: each partition adds up its own normal equations for every fold, the partial sums
are added row by row of the matrix, and the driver solves systems whose size does not depend on the data. Scores of
rows that a fold left out give the isotonic calibration, from counts in a fixed number of bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.llm import kernels
from dateloom.llm.common import frugal, small, tune, written

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "bangs", "bars",
    "stops", "wide_bytes", "distinct_words", "repeated_neighbours", "distinct_windows", "log_lines", "repeated_lines", "log_line_words",
    "lines_ended", "short_words", "top_word", "capital_words", "one_byte_words", "long_words",
)
#: Folds of the labelled rows; each is scored by a fit without it.
FOLDS = 4
#: Bins of raw scores from which calibration counts.
BINS = 1000


def _of_class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters)] = 1
    return out


_UPPER, _DIGIT = _of_class(bytes(range(65, 91))), _of_class(bytes(range(48, 58)))
_PUNCTUATION = _of_class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SYMBOL, _BANG, _BAR, _STOP = _of_class(b"#*$%&|<>"), _of_class(b"!"), _of_class(b"|"), _of_class(b".?!")
_WIDE, _NEWLINE = _of_class(bytes(range(128, 256))), _of_class(b"\n")


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    out = np.zeros((len(off) - 1, len(STATISTICS)))
    for i, j in kernels.blocks(off):
        _block(raw[off[i] : off[j]], off[i : j + 1] - off[i], out[i:j])
    return out


def _block(raw: np.ndarray, off: np.ndarray, out: np.ndarray) -> None:
    w = kernels.Words(raw, off, fold=False)
    added = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[off])
    share = lambda kind: added(kind[raw]) / size
    n = np.diff(off)
    size = np.maximum(n, 1)
    words = np.diff(w.bounds)
    some = np.maximum(words, 1)
    by_text = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[w.bounds])
    mean = by_text(w.length) / some
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(n), np.log1p(words), mean
    out[:, 3] = np.sqrt(np.maximum(by_text(w.length.astype(float) ** 2) / some - mean**2, 0))
    for k, kind in enumerate((_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, _BANG, _BAR, _STOP, _WIDE)):
        out[:, 4 + k] = share(kind)
    follows = np.zeros(len(w.hash), bool)
    follows[1:] = w.hash[1:] == w.hash[:-1]
    out[:, 13] = by_text(follows) / some
    out[:, 19] = by_text(w.length <= 3) / some
    out[:, 21] = by_text(_UPPER[raw[w.start]]) / some if len(w.start) else 0
    out[:, 22] = by_text(w.length == 1) / some
    out[:, 23] = by_text(w.length >= 20) / some
    triples = kernels.windows(w.hash, 3)
    # lines: those with a word, told apart by the order-dependent sum of their words
    breaks = np.concatenate(([0], np.cumsum(_NEWLINE[raw])))
    line = breaks[w.start] + np.searchsorted(off, w.start, side="right") if len(w.start) else np.zeros(0, np.int64)
    opens = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    if len(opens):
        step = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(opens, np.diff(np.append(opens, len(line)))).astype(np.uint64)
        with np.errstate(over="ignore"):
            line_hash = np.add.reduceat(kernels.mix(w.hash + step * np.uint64(0x9E3779B97F4A7C15)), opens)
        last = raw[w.end[np.append(opens[1:], len(line)) - 1] - 1]
        text_of = np.searchsorted(w.bounds, opens, side="right") - 1
        lines = np.bincount(text_of, minlength=len(n))
        ended = np.bincount(text_of, weights=_of_class(b".?!\"'):;")[last], minlength=len(n))
        first_line = np.concatenate(([0], np.cumsum(lines)))
        out[:, 15], out[:, 17], out[:, 18] = np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), ended / np.maximum(lines, 1)
    for t, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
        if b > a:
            counts = np.unique(w.hash[a:b], return_counts=True)[1]
            out[t, 12], out[t, 20] = len(counts) / (b - a), counts.max() / (b - a)
            out[t, 14] = len(np.unique(triples[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
            out[t, 16] = 1 - len(np.unique(line_hash[first_line[t] : first_line[t + 1]])) / lines[t]


def _measured(batches):
    for batch in batches:
        found = statistics(*kernels.string_buffers(batch.column("text")))
        values = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "x"])


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of each row of documents, written to the shared folder."""
    tune(documents.sparkSession, 512)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(frugal(_measured), "doc_id long, x array<double>"), "statistics")


def held_out(doc_id, of: int, remainder: int):
    """True where the crc32 of the id as text leaves that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder


@dataclass(frozen=True)
class QualityModel:
    """features: random Fourier features; width: of the kernel, in units of the standardised statistics."""

    features: int = 256
    width: float = 3.0
    ridges: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1)
    seed: int = 11
    centre: np.ndarray = field(default=None, repr=False, compare=False)
    scale: np.ndarray = field(default=None, repr=False, compare=False)
    weights: np.ndarray = field(default=None, repr=False, compare=False)  # by fold; the last row is the fit on all
    knots: tuple = field(default=(), repr=False, compare=False)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Features whose inner products approximate exp(-|x - y|^2 / (2 width^2)), and a constant."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        angles = rng.normal(0, 1 / self.width, (x.shape[1], self.features // 2))
        at = np.clip((x - self.centre) / self.scale, -6, 6) @ angles
        return np.hstack([np.cos(at), np.sin(at), np.ones((len(x), 1))]) * np.sqrt(2 / self.features)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in [0, 1]."""
        if self.weights is None:
            return np.full(len(x), self.knots[1][0] if self.knots else 0.5)
        at, to = self.knots
        return np.clip(np.interp(self.mapped(x) @ self.weights[-1], at, to), 0, 1)


def _matrix(batch, name: str = "x") -> np.ndarray:
    values = batch.column(name)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _normal_equations(model: QualityModel):
    """Each partition's sums over its rows, by fold: one row for each row of [Z'Z | Z'y | y'y, n]."""

    def run(batches):
        size = model.features + 1
        sums = np.zeros((FOLDS, size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([model.mapped(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
                fold = batch.column("fold").to_numpy()
                for k in range(FOLDS):
                    sums[k] += z[fold == k].T @ z[fold == k]
        if sums.any():
            rows = sums.reshape(-1, size + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), size + 1).cast(pa.list_(pa.float64()))], ["k", "v"]
            )

    return run


def _added(rows: pa.Table) -> pa.Table:
    values = rows.column("v").combine_chunks()
    total = values.flatten().to_numpy().reshape(len(values), -1).sum(axis=0)
    return pa.table({"k": rows.column("k")[:1], "v": pa.array([total], pa.list_(pa.float64()))})


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value in weighted least squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for w, v in zip(weight, value):
        pools.append([w, v, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, v2, n2 = pools.pop()
            w1, v1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.repeat([p[1] for p in pools], [p[2] for p in pools])


def fit(rows: DataFrame, labels: DataFrame, label: str, model: QualityModel = QualityModel()) -> QualityModel:
    """A model fitted on all measured rows (doc_id, x) that have a label (doc_id, `label` 0 or 1).

    Null labels and ids are left out; of several labels of an id the largest counts. Without rows of both labels the
    model scores every text alike: the one label seen, or 0.5.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    # what is known of a row's fold must not depend on how rows are dealt
    known = written(rows.join(marks, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    columns = [F.col("x")[k] for k in range(len(STATISTICS))]
    seen = known.agg(F.count("*"), F.avg("y"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        return QualityModel(**{**model.__dict__, "knots": ((0.0,), (seen[1] if seen[0] else 0.5,))})
    d = len(STATISTICS)
    model = QualityModel(**{**model.__dict__, "centre": np.array(seen[2 : 2 + d], float), "scale": np.maximum(np.array(seen[2 + d :], float), 1e-6)})
    sums = known.select("x", "y", "fold").mapInArrow(frugal(_normal_equations(model)), "k int, v array<double>").groupBy("k").applyInArrow(_added, "k int, v array<double>")
    found = sums.toPandas().sort_values("k")
    size = model.features + 1
    total = np.zeros((FOLDS, size + 1, size + 1))
    total.reshape(-1, size + 1)[found["k"].to_numpy()] = np.stack(found["v"].to_list())
    gram, moment, squares = total[:, :size, :size], total[:, :size, size], total[:, size, size]
    n = gram[:, -1, -1] * model.features / 2  # the constant feature counts rows
    keep = np.diag([1.0] * (size - 1) + [0.0])

    def solved(of: np.ndarray, ridge: float) -> np.ndarray:
        return np.linalg.solve(gram[of].sum(axis=0) + ridge * n[of].sum() / size * keep + 1e-9 * np.eye(size), moment[of].sum(axis=0))

    others = [np.arange(FOLDS) != k for k in range(FOLDS)]
    loss = {}
    for ridge in model.ridges:
        fits = [solved(o, ridge) for o in others]
        loss[ridge] = sum(squares[k] - 2 * w @ moment[k] + w @ gram[k] @ w for k, w in enumerate(fits))
    ridge = min(loss, key=loss.get)
    model = QualityModel(**{**model.__dict__, "weights": np.stack([*(solved(o, ridge) for o in others), solved(np.arange(FOLDS) >= 0, ridge)])})

    def left_out(batches):
        for batch in batches:
            if batch.num_rows:
                z = model.mapped(_matrix(batch))
                raw = (z * model.weights[batch.column("fold").to_numpy()]).sum(axis=1)
                at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    bins = known.mapInArrow(frugal(left_out), "bin int, raw double, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).toPandas().sort_values("bin")
    fitted = isotonic(bins["n"].to_numpy(float), bins["y"].to_numpy(float))
    return QualityModel(**{**model.__dict__, "knots": (bins["raw"].to_numpy(float), fitted)})


def scored(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of each measured row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)) if batch.num_rows else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(frugal(run), "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents (doc_id, text).

    Only labels of ids that are not held out are learnt from; other columns than text are never read. A null text is
    scored as an empty one. Rows that repeat a doc_id are scored each by its text, and each trains with the id's label.
    Empty tables of labels give 0.5 to every text; an empty table of documents gives no rows.
    """
    rows = measured(documents)
    model = fit(rows, labels.where(~held_out(F.col("doc_id"), 5, 0)), "quality")
    out = scored(rows, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of documents whose score reaches the threshold, as they are.

    The model learns as in quality_scores; each text is then judged where it is read, so no text is shuffled. Nulls, rows that
    repeat and empty tables are treated as there; other columns, of whatever names, are passed on.
    """
    tune(documents.sparkSession, 512)
    marks = written(labels.where(~held_out(F.col("doc_id"), 5, 0)), "marks")
    ids = marks.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids), "doc_id", "left_semi")
    model = fit(measured(known), marks, "quality")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = model.score(statistics(*kernels.string_buffers(batch.column("text").cast(pa.string()))))
                yield batch.filter(pa.array(found >= threshold))

    return documents.mapInArrow(frugal(run), documents.schema)
