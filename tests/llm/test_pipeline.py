import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dateloom.llm import kernels
from dateloom.llm.decontaminate import Search, edit_distance_in, normalised
from dateloom.llm.mixing import DIMENSIONS, Mixture, blended, mixed
from dateloom.llm.quality import BINS, FOLDS, QualityModel, isotonic, statistics
from dateloom.llm.queries import QUERIES
from test_files import expected
from test_mixing import bounded
from test_near import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels", "benchmark")}


@pytest.fixture(scope="module")
def stages(spark, tables):
    """The rows before the first stage and after each."""
    now, out = tables["documents"], [tables["documents"].collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, FOLDER)
        assert name == "tokens" or after.columns == now.columns
        out.append(after.collect())
        now = spark.createDataFrame(out[-1], after.schema)
    return out


def folds_of(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("f")).collect()
    return {r.doc_id: r.f for r in rows}


def plain_scores(spark, documents, labels):
    """Quality by one matrix of all labelled rows in memory."""
    from zlib import crc32

    told = {r.doc_id: r.quality for r in labels if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5}
    x = statistics(*kernels.string_buffers(pa.array([r.text or "" for r in documents])))
    known = [k for k, r in enumerate(documents) if r.doc_id in told]
    y = np.array([told[documents[k].doc_id] for k in known], float)
    folds = folds_of(spark, [documents[k].doc_id for k in known])
    fold = np.array([folds[documents[k].doc_id] for k in known])
    model = QualityModel(centre=x[known].mean(axis=0), scale=np.maximum(x[known].std(axis=0), 1e-6))
    z = model.mapped(x[known])

    def solved(of, ridge):
        keep = np.diag([1.0] * (z.shape[1] - 1) + [0.0])
        return np.linalg.solve(z[of].T @ z[of] + ridge * of.sum() / z.shape[1] * keep + 1e-9 * np.eye(z.shape[1]), z[of].T @ y[of])

    loss = {r: sum(((y - z @ solved(fold != k, r))[fold == k] ** 2).sum() for k in range(FOLDS)) for r in model.ridges}
    ridge = min(loss, key=loss.get)
    raw = np.concatenate([(z @ solved(fold != k, ridge))[fold == k] for k in range(FOLDS)])
    truth = np.concatenate([y[fold == k] for k in range(FOLDS)])
    at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1)
    bins = sorted(set(at))
    fitted = isotonic(np.array([(at == b).sum() for b in bins], float), np.array([truth[at == b].mean() for b in bins]))
    final = model.mapped(x) @ solved(fold >= 0, ridge)
    return np.interp(final, [raw[at == b].mean() for b in bins], fitted)


def test_quality_equals_one_matrix(spark, tables, stages):
    documents, labels = tables["documents"].collect(), tables["labels"].collect()
    want = {r.doc_id: s for r, s in zip(documents, plain_scores(spark, documents, labels))}
    out = {r.doc_id: r.score for r in QUERIES["op2_quality_classifier"](spark, FOLDER).collect()}
    assert out.keys() == want.keys() and max(abs(out[k] - want[k]) for k in out) < 0.02
    sure = {k for k, s in want.items() if abs(s - 0.3) > 0.02}
    assert {r.doc_id for r in stages[1]} & sure == {k for k in sure if want[k] >= 0.3}


def test_near_duplicates_equal_all_pairs(stages):
    told = brute([(r.doc_id, r.text) for r in stages[1]], 5, 80)
    assert {r.doc_id for r in stages[2]} == {d for d, (_, c) in told.items() if c == d}


def test_decontamination_equals_the_plain_search(tables, stages):
    search, items = Search(), [normalised(r.text) for r in tables["benchmark"].collect()]
    left = {r.doc_id for r in stages[3]}
    for r in stages[2]:
        text = normalised(r.text)
        # an item within its edits holds one of its blocks of ten bytes whole
        near = [x for x in items if x in text or any(x[k : k + 10] in text for k in range(0, len(x) - 9, 10)) and edit_distance_in(x, text, search.allowed(len(x)))]
        if any(x in text for x in near):
            assert r.doc_id not in left
        elif not near:
            assert r.doc_id in left


def test_mixture_equals_the_plain_rule(spark, stages):
    import hashlib

    mixture = Mixture(share=0.9)
    rows = mixed(spark.createDataFrame(stages[3]), mixture).select("doc_id", *DIMENSIONS, "n_tokens", "probability").collect()
    number = lambda i: int(hashlib.md5(f"{i}:{mixture.seed}".encode()).hexdigest()[:12], 16) / 16**12
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in rows if number(r.doc_id) < r.probability}
    cells, told = {}, {}
    for r in rows:
        key = tuple(r[d] for d in DIMENSIONS)
        cells[key], told[key] = cells.get(key, 0) + r.n_tokens, r.probability
    listed = [(*k, n) for k, n in sorted(cells.items())]
    sums = {d: {v: float(sum(c[3] for c in listed if c[i] == v)) for v in {c[i] for c in listed}} for i, d in enumerate(DIMENSIONS)}
    total = sum(c[3] for c in listed)
    miss = lambda aims, p: max(abs(sum(c[3] * x for c, x in zip(listed, p) if c[i] == v) / (0.9 * total) - t) for i, d in enumerate(DIMENSIONS) for v, t in aims[d].items())
    # the targets that the operator met are the flattest that the plain rule meets, and it finds the same chances
    levels = [blended(sums, mixture, flat / 10) for flat in range(10, -1, -1)]
    met = min(range(len(levels)), key=lambda k: miss(levels[k], [told[c[:3]] for c in listed]))
    assert miss(levels[met], [told[c[:3]] for c in listed]) < 1e-3
    plain = bounded(listed, levels[met], 0.9, 150)
    assert miss(levels[met], plain) < 5e-3
    assert sum(c[3] * abs(x - told[c[:3]]) for c, x in zip(listed, plain)) / total < 0.02


def test_tokens_equal_the_tokenizer(stages):
    assert sorted(tuple(r) for r in stages[5]) == expected(sorted((r.doc_id, r.text) for r in stages[4]))


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, stages[-1]))


def test_stages_take_any_rows(spark, tables):
    """Nulls, an empty and a long text, repeated rows, columns with names that the operators use, and no rows at all."""
    text = " ".join(f"Word{i} of the story." for i in range(300))
    rows = [(None, text, None, "s"), (1, None, "en", None), (2, "", "en", "s"), (3, text, "en", "s"), (3, text, "en", "s"), (4, text + " end", None, None), (5, "z" * 200_000, "de", "s"), (6, "x y", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["row", "id", "key", "_key", "_id", "score", "topic2", "tokens", "_topic", "_told", "text_key", "node", "fold", "x"]
    docs = docs.withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        got = out.collect()
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in extra), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "5", "6"]
        if name == "decontaminate":
            assert len(got) == len(rows)
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, FOLDER).count() == len(rows) and stage(spark, docs.limit(0), FOLDER).count() == 0


def test_entry_without_the_folders(tmp_path):
    """Without llm the entry offers the rest, with or without corpus_pipeline.py; a broken import in it is told."""
    root = Path(corpus_pipeline.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    ask = [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print('pipeline' in q, 'op1_decontaminate' in q, 'event_time_pipeline' in q, len(e.oracle_sql()) > 60)"]
    run = lambda: subprocess.run(ask, cwd=copy, capture_output=True, text=True)
    assert run().stdout.split() == ["False", "False", "True", "True"]
    (copy / "corpus_pipeline.py").unlink()
    assert run().stdout.split() == ["False", "False", "True", "True"]
    (copy / "dateloom" / "llm").mkdir()
    (copy / "dateloom" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    assert run().returncode != 0
