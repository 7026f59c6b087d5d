import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dateloom.llm.mixing import DIMENSIONS, Infeasible, Mixture, blended, flattened, mixed, raked, uniform

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bounded(cells, aims, share, rounds=300):
    """Probabilities of cells (source, lang, topic, tokens) by the plain rule: each value's multiplier by bisection."""
    total = share * sum(c[3] for c in cells)
    w = [share] * len(cells)
    for _ in range(rounds):
        for d, name in enumerate(DIMENSIONS):
            for v, t in aims[name].items():
                here = [i for i, c in enumerate(cells) if c[d] == v]
                low, high = 0.0, 1e6
                for _ in range(80):
                    m = (low + high) / 2
                    low, high = (m, high) if sum(cells[i][3] * min(1, m * w[i]) for i in here) < t * total else (low, m)
                for i in here:
                    w[i] *= high
    return [min(1.0, x) for x in w]


def some_cells(seed):
    rng = random.Random(seed)
    return [(s, l, t, rng.randint(1, 900)) for s in ("", "a", "b") for l in ("x", "y") for t in ("p", "q") if rng.random() < 0.95]


def sums_of(cells):
    return {name: {v: sum(c[3] for c in cells if c[d] == v) for v in sorted({c[d] for c in cells})} for d, name in enumerate(DIMENSIONS)}


@pytest.mark.parametrize("seed, share", [(8, 0.5), (9, 0.7), (10, 0.85)])
def test_raking_equals_the_plain_rule(spark, seed, share):
    cells = some_cells(seed)
    mixture = Mixture(share=share)
    out = {(r.source, r.lang, r.topic): r.probability for r in raked(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), mixture).collect()}
    tokens = np.array([c[3] for c in cells])
    sums, got = sums_of(cells), np.array([out[c[:3]] for c in cells])
    # of the targets in steps of a tenth, the first that the plain rule meets too
    for flat in range(10, -1, -1):
        aims = blended(sums, mixture, flat / 10)
        plain = np.array(bounded(cells, aims, share, 60))
        if max(abs(sum(n * p for c, n, p in zip(cells, tokens, plain) if c[d] == v) / (share * tokens.sum()) - t) for d, name in enumerate(DIMENSIONS) for v, t in aims[name].items()) < 1e-3:
            break
    assert abs((tokens * got).sum() / tokens.sum() - share) < 1e-4
    for d, name in enumerate(DIMENSIONS):
        for v, t in aims[name].items():
            assert abs((tokens * got)[[c[d] == v for c in cells]].sum() / (share * tokens.sum()) - t) < 1e-3
    assert np.abs(plain - got).max() < 0.02


def test_spark_rakes_as_the_driver_does(spark):
    cells = some_cells(8)
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    here, there = ({(r.source, r.lang, r.topic): r.probability for r in raked(df, m).collect()} for m in (Mixture(share=0.5), Mixture(share=0.5, cells=0)))
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-4 for k in here)


def test_targets_that_cannot_be_met_are_refused(spark):
    cells = spark.createDataFrame([("s", "a", "t", 100), ("s", "b", "t", 900)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"s": 1.0}, "topic": {"t": 1.0}, "lang": {"a": 0.5, "b": 0.5}}
    with pytest.raises(Infeasible) as e:
        raked(cells, Mixture(share=0.5), targets)
    assert abs(e.value.greatest - 0.2) < 1e-3
    met = {r.lang: r.probability for r in raked(cells, Mixture(share=0.2), targets).collect()}
    assert abs(met["a"] - 1) < 1e-3 and abs(met["b"] - 1 / 9) < 1e-3


def test_flattened_targets_are_met_by_what_is_there():
    sums = {"a": 900.0, "b": 80.0, "c": 20.0, "d": 0.0}
    for share in (0.1, 0.5, 0.9, 1.0):
        t = flattened(sums, 0.5, share)
        assert abs(sum(t.values()) - 1) < 1e-9 and all(share * t[v] * 1000 <= sums[v] + 1e-6 for v in t) and "d" not in t
    assert flattened(sums, 1.0, 0.9) == pytest.approx({"a": 0.9, "b": 0.08, "c": 0.02}) and flattened({}, 0.5, 0.9) == {}


def test_sample_meets_its_targets(spark):
    """Sources, languages and topics of a whole table at the pipeline's share."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    out = mixed(docs, Mixture(share=0.9)).select(*DIMENSIONS, "n_tokens", "probability", "sampled").toPandas()
    total = out.n_tokens.sum()
    assert abs((out.n_tokens * out.probability).sum() / total - 0.9) < 1e-4 and abs((out.n_tokens * out.sampled).sum() / total - 0.9) < 0.02
    sums = {d: {v: float(n) for v, n in out.groupby(d).n_tokens.sum().items()} for d in DIMENSIONS}
    told = [blended(sums, Mixture(share=0.9), flat / 10) for flat in range(10, -1, -1)]
    expected = {d: (out.n_tokens * out.probability).groupby(out[d]).sum() / (0.9 * total) for d in DIMENSIONS}
    misses = [max(abs(expected[d][v] - t) for d in DIMENSIONS for v, t in aims[d].items()) for aims in told]
    assert min(misses) < 1e-3
    aims = told[int(np.argmin(misses))]
    sample = out[out.sampled]
    for d in DIMENSIONS:
        drawn = sample.groupby(d).n_tokens.sum() / sample.n_tokens.sum()
        assert all(abs(expected[d][v] - t) < 0.001 and abs(drawn[v] - t) < 0.01 for v, t in aims[d].items())


def test_topic_is_of_the_whole_text(documents):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdéÉF") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "a b", "word " * 150_000 + "other " * 150_001]
    out = {r.doc_id: (r.topic, r.n_tokens) for r in mixed(documents(texts)).collect()}
    for i, t in enumerate(texts):
        own = WORD.findall((t or "").lower())
        buckets = [int(np.int64(np.uint64(xxhash.xxh64(w.encode(), seed=42).intdigest()))) % 8 for w in own if len(w) >= 5]
        assert out[i] == (f"topic{max(range(8), key=lambda k: (buckets.count(k), -k))}", len(own))


def test_mixture_edges(spark, documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "gamma", "delta", "omega"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["big"] * 8 + ["small", None])) for i in range(800)]
    rows += [(None, "x y", "en", "big"), (5000, None, None, None), (5000, None, None, None)]
    df = documents(rows).withColumns({"topic": F.lit(3), "tokens": F.lit(1), "factor": F.lit(1), "_told": F.lit(4), "_topic": F.lit(5)})
    out = mixed(df, Mixture(share=0.6)).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    kept, total = sum(r.n_tokens for r in out if r.sampled), sum(r.n_tokens for r in out)
    expected = sum(r.n_tokens * r.probability for r in out)
    assert abs(expected / total - 0.6) < 1e-4 and abs(kept / total - 0.6) < 0.06
    mean = lambda s: sum(r.probability for r in out if r.source == s) / sum(1 for r in out if r.source == s)
    assert mean("small") > mean("big")
    assert mixed(df.limit(0)).count() == 0 and mixed(documents([None, ""])).where("sampled is not null").count() == 2


def test_uniform(spark):
    v = [r[0] for r in spark.range(4000).select(uniform(F.col("id"), 3)).collect()]
    assert all(0 <= x < 1 for x in v) and abs(sum(v) / 4000 - 0.5) < 0.02
