import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dateloom.llm import kernels
from dateloom.llm.lsh_forest import Forest, _near, near_duplicates, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    """component_id of each row by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(rows)}


def corpus(seed, groups=12, copies=6, crowd=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in is a".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(copies):
            edited = [word() if rng.random() < rng.choice((0, 0.005, 0.02, 0.05)) else w for w in base]
            texts.append(" ".join(edited) if rng.random() < 0.5 else "\n".join(edited).upper())
        texts.append(" ".join(base))
    base = [word() for _ in range(150)]
    texts += [" ".join(word() if rng.random() < 0.012 else w for w in base) for _ in range(crowd)]
    texts += ["", "  \t", "one", "One", "one two", "a b c", "a b d"]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(documents, k, percent):
    rows = corpus(k)
    out = near_duplicates(documents(rows), Forest(shingle=k, percent=percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_crowd_beyond_the_window(documents):
    """A group whose pairs straddle the threshold, far larger than the window."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    rows = [(i, " ".join(f"x{rng.randint(0, 10**9)}" if rng.random() < 0.022 else w for w in base)) for i in range(260)]
    out = near_duplicates(documents(rows), Forest(shingle=3, percent=85, window=3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 85)


def templated(rng, n, links):
    """Documents of 60 common words and 30 of their own, none near another but for `links` copies with a word changed."""
    common = [f"t{i}" for i in range(60)]
    rows = [" ".join(common + [f"w{rng.randint(0, 10**9)}" for _ in range(30)]) for _ in range(n - links)]
    rows += [" ".join([*t.split()[:-1], "other"]) for t in rng.sample(rows, links)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_templated_pages_are_compared_in_deeper_trees(documents, monkeypatch):
    import dateloom.llm.lsh_forest as L

    rows = templated(random.Random(20), 700, 40)
    seen = []
    inner = L._in_blocks
    monkeypatch.setattr(L, "_in_blocks", lambda rows, *more: seen.append(rows.count()) or inner(rows, *more))
    monkeypatch.setattr(L, "CROWD", 4)
    out = near_duplicates(documents(rows), Forest(shingle=3, percent=85, window=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 85)
    assert len(seen) >= 2 and not seen[-1]  # the last trees leave no region to be compared in blocks


def test_crowded_at_every_depth(documents, monkeypatch):
    """Regions that no depth thins out are compared in blocks."""
    import dateloom.llm.lsh_forest as L

    monkeypatch.setattr(L, "CROWD", 4)
    monkeypatch.setattr(L, "DEEPER", (8, 10))
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    rows = [(i, " ".join(f"x{rng.randint(0, 10**9)}" if rng.random() < 0.03 else w for w in base)) for i in range(150)]
    out = near_duplicates(documents(rows), Forest(shingle=3, percent=85, window=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 85)


def test_hubs_and_hot_classes_are_dealt(spark):
    from dateloom.llm.lsh_forest import HUB, _named, _with_text

    pairs = spark.createDataFrame([(b"a", bytes([0, i % 256, i // 256])) for i in range(5 * HUB)] + [(b"c", b"d")], "a binary, b binary")
    texts = spark.createDataFrame([(b"a", "A"), (b"c", "C")], "node binary, text string")
    out = _with_text(pairs, texts, "a")
    assert {(r.a, r.b, r.text_a) for r in out.collect()} == {(r.a, r.b, chr(r.a[0] - 32)) for r in pairs.collect()} and out.count() == 5 * HUB + 1
    rows = spark.createDataFrame([(i, 9, b"hot" if i % 3 else bytes([i % 7]), i) for i in range(20_001)], "doc_id long, n_shingles long, digest binary, text_key long")
    names = spark.createDataFrame([(b"hot", 1, 13_334), (bytes([1]), 7, 2), (bytes([2]), 8, 2)], "digest binary, component_id long, rows long")
    a, b = ({(r.doc_id, r.component_id) for r in _named(rows, names, few).collect()} for few in (100, 0))
    assert a == b and len(a) == 20_001 and (1, 1) in a


def test_nulls_repeats_and_empty_table(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (6, None), (7, ""), (8, text + " tail"), (None, "alone in here")]
    df = documents(rows).withColumns({"digest": F.lit("x"), "node": F.lit(1), "root": F.lit(2)})
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, Forest(3, 85)).where("doc_id is not null").collect())
    assert out == [(5, 38, 5, True), (5, 38, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 39, 5, False)]
    none = sorted((r.component_id is None, r.kept) for r in near_duplicates(df, Forest(3, 85)).where("doc_id is null").collect())
    assert none == [(False, False), (True, True)]
    kept = without_near_duplicates(df, Forest(3, 85))
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "6", "7", "None"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_long_text(documents):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    changed = list(words)
    changed[30_000] = "other"
    out = near_duplicates(documents([" ".join(words), " ".join(changed), "x" * 300_000]), Forest(3, 85)).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 0, 2: 2}


def test_shingle_kernel():
    import pyarrow as pa

    texts = ["a b c d", "A  b\tC\nd", "", None, " ", "é É", "a\x0bb\x0cc", "a\xa0b", "x"]
    for k in (1, 2, 3, 5):
        found = list(kernels.shingle_sets(*kernels.string_buffers(pa.array(texts)), k))
        assert [len(f) for f in found] == [len(shingles(t, k)) for t in texts]
        assert (found[0] == found[1]).all()


def test_neighbours_need_a_common_prefix():
    f = Forest(3, 85)
    prefix = np.zeros((4, 8), np.uint16)
    prefix[2:] = 9
    pairs = list(_near(prefix, np.zeros(4, int), np.full(4, 10), [b"a", b"b", b"c", b"d"], [b"a", b"b", b"c", b"d"], f, 3, 0))
    assert pairs == [(b"a", b"b"), (b"c", b"d")]


def test_candidates_reach_their_recall():
    """Of random pairs at the threshold, nearly all share the least depth in some tree."""
    f = Forest(3, 85)
    assert (1 - 0.85**f.least_depth) ** f.trees < 1e-4


def crowd(n, share, seed=33):
    """Texts that straddle the threshold, with the pairs of all of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{rng.randint(0, 10**9)}" if rng.random() < share else w for w in base)) for i in range(n)]
    return rows, [(bytes([i // 256, i % 256]), bytes([j // 256, j % 256])) for j in range(n) for i in range(j)]


def tops(links, names):
    from dateloom.llm.lsh_forest import _Joined

    joined = _Joined()
    for a, b in links:
        joined.join(a, b)
    groups = {}
    for x in names:
        groups.setdefault(joined.top(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_pairs_of_a_crowd_meet_in_blocks(spark, documents, monkeypatch):
    """What a crowd is joined by has fewer rows than the crowd, and no join has a row for each pair."""
    import dateloom.llm.lsh_forest as L

    rows, pairs = crowd(150, 0.022)
    f = Forest(3, 85)
    docs = documents(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    name = {i: bytes([i // 256, i % 256]) for i, _ in rows}
    keys = {r.doc_id: r.text_key for r in docs.collect()}
    nodes = spark.createDataFrame([(name[i], i, keys[i]) for i, _ in rows], "node binary, rep_id long, text_key long")
    seen, inner = [], L._with_text
    monkeypatch.setattr(L, "_with_text", lambda pairs, *more: seen.append(pairs.count()) or inner(pairs, *more))
    out = [(r.a, r.b) for r in L._links(spark.createDataFrame([(bytes(a), bytes(b)) for a, b in pairs], "a binary, b binary"), nodes, docs, f).collect()]
    sets = [shingles(t, 3) for _, t in rows]
    every = [(name[i], name[j]) for j in range(150) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    out = [(bytes(a), bytes(b)) for a, b in out]
    assert set(out) <= set(every) and tops(out, name.values()) == tops(every, name.values())
    assert len(out) < 2 * len(rows) < len(every) and max(seen, default=0) < len(rows)


def test_a_block_makes_fewer_links_than_rows():
    import pyarrow as pa

    from dateloom.llm import lsh_forest as L

    rows, _ = crowd(60, 0.01)
    f = Forest(3, 85)
    nodes = [bytes([i]) for i, _ in rows]
    table = pa.table({"node": pa.array(nodes, pa.binary()), "text": [t for _, t in rows]})
    [sketches] = L._sketched(f)(iter(table.to_batches()))
    table = table.append_column("sketch", sketches.column("sketch")).append_column("root", pa.array(nodes, pa.binary()))
    sets = [shingles(t, 3) for _, t in rows]
    table = table.append_column("n_shingles", pa.array([len(x) for x in sets], pa.int64())).append_column("majority", pa.array([nodes[0]] * 60, pa.binary()))
    out = L._crossing(f)((1, 0, 0), table.slice(1), table)
    found = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
    every = [(nodes[i], nodes[j]) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert set(found) <= set(every) and tops(found, nodes) == tops(every, nodes) and len(found) < 60 < len(every)
