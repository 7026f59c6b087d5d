import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from dateloom.llm.quality import STATISTICS, QualityModel, isotonic, quality_scores, statistics, with_quality
from dateloom.llm.toxicity import sentences, toxicity_scores


def prose(rng, n=80):
    return ". ".join(" ".join(rng.choice("the of and to in is some word here there tale river stone light".split()) + rng.choice(["", "s", "ed"]) for _ in range(8)).capitalize() for _ in range(n // 8)) + "."


def junk(rng):
    return rng.choice([lambda: "BUY NOW!! " * 40, lambda: " | ".join(f"item{i}" for i in range(40)), lambda: "word word word " * 30, lambda: "%%% $$$ ### " * 30])()


def labelled(spark, rng, n=400, toxic=False):
    texts, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        if toxic:
            t = prose(rng)
            if bad:
                at = t.index(" ", len(t) // 2)
                t = t[:at] + " " + rng.choice(["idiotic", "moronic", "scumbag"]) + rng.choice(["", "al", "ity"]) + t[at:]
            labels.append((i, int(bad)))
        else:
            t = junk(rng) if bad else prose(rng)
            labels.append((i, int(not bad)))
        texts.append((i, t))
    name = "toxic" if toxic else "quality"
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {name} int"), dict(labels)


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark, random.Random(1))
    out = quality_scores(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels, _ = labelled(spark, random.Random(2), 150)
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    turned = labels.withColumn("quality", F.when(key == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.predicted for r in quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "x" * 200_000), (3, " \n\t")], "doc_id long, text string").withColumns({"x": F.lit(1), "score": F.lit(0.1), "fold": F.lit(9)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_scores(docs, one).collect())
    assert quality_scores(docs.limit(0), one).count() == 0
    docs2, labels, _ = labelled(spark, random.Random(3), 120)
    kept = with_quality(docs2.withColumn("extra", F.lit("e")), labels)
    assert kept.columns == ["doc_id", "text", "extra"] and 60 < kept.count() < 110


def test_statistics():
    import pyarrow as pa

    from dateloom.llm import kernels

    s = dict(zip(STATISTICS, statistics(*kernels.string_buffers(pa.array(["aa aa bb\naa aa bb", ""])))[0]))
    assert s["repeated_lines"] == 0.5 and abs(s["distinct_words"] - 1 / 3) < 1e-9 and abs(s["repeated_neighbours"] - 2 / 6) < 1e-9
    assert not statistics(*kernels.string_buffers(pa.array(["", None]))).any()


def test_isotonic():
    y = isotonic(np.ones(6), np.array([1, 0, 2, 1.5, 3, 2.9]))
    assert (np.diff(y) >= 0).all() and abs(y.mean() - np.mean([1, 0, 2, 1.5, 3, 2.9])) < 1e-12


def test_kernel_approximation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, len(STATISTICS)))
    m = QualityModel(features=8192, centre=np.zeros(len(STATISTICS)), scale=np.ones(len(STATISTICS)))
    z = m.mapped(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * m.width**2))
    assert np.abs(z @ z.T - exact).max() < 0.06


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark, random.Random(4), 500, toxic=True)
    out = toxicity_scores(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [texts[r.doc_id][s.start : s.end] for r in held for s in r.offending]
    assert spans and all(any(w in s for w in ("idiot", "moron", "scum")) for s in spans)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "x. " * 50_000)], "doc_id long, text string").withColumn("y", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity_scores(docs, none).collect()} == {0.5}
    assert toxicity_scores(docs.limit(0), none).count() == 0
    known, labels, _ = labelled(spark, random.Random(5), 200, toxic=True)
    both = known.unionByName(docs.select("doc_id", "text"))
    out = {(r.doc_id, r.n_sentences): r.score for r in toxicity_scores(both, labels).collect()}
    assert all(0 <= v <= 1 for v in out.values())
    assert list(sentences("A b. C!\nd ... e")) == [(0, 3), (4, 6), (8, 10), (13, 15)]
