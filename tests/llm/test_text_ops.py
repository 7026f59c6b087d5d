import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dateloom.llm.decontaminate import Index, Search, contaminated, edit_distance_in, normalised, without_contaminated
from dateloom.llm.line_chunks import deduplicated, pieces
from dateloom.llm.line_rules import LineRules, cleaned
from dateloom.llm.url_filter import intervals, keys_of, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- decontamination -----------------------------------------------------------------------------------------------------


def nearest(item, text):
    """Least edit distance of item to a substring of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(200):
        item, text = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (9, 30))
        best = nearest(item, text)
        got = edit_distance_in(item, text, len(item))
        assert (got[0] if got else len(item)) == best


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, edits):
    b = list(text)
    for _ in range(edits):
        p = rng.randrange(len(b))
        kind = rng.randrange(3)
        if kind == 0:
            b[p] = "z"
        elif kind == 1:
            b.insert(p, "z")
        else:
            del b[p]
    return "".join(b)


def test_finds_items_and_leaves_clean_texts(spark, documents):
    rng = random.Random(3)
    items = [prose(rng, rng.randint(14, 60)) for _ in range(30)]
    rows, want = [], set()
    for i in range(120):
        text = prose(rng, 150)
        if i % 2:
            k = rng.randrange(30)
            leak = items[k] if i % 4 == 1 else edited(rng, items[k], max(1, int(0.03 * len(items[k]))))
            at = text.index(" ", rng.randrange(len(text) - 20))
            text = text[:at] + "\n " + leak.upper() + "  " + text[at + 1 :]
            want.add((i, k))
        rows.append((i, text))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = contaminated(documents(rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in out}
    assert found <= want and {(i, k) for i, k in want if i % 4 == 1} <= found and len(found) >= 0.93 * len(want)
    for r in out:
        item, text = normalised(items[r.item_id]), normalised(dict(rows)[r.doc_id])
        assert r.distance <= int(0.05 * len(item)) and nearest(item, text[max(0, r.start - 30) : r.start + len(item) + 60]) == r.distance
    kept = without_contaminated(documents(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in found} and kept.columns[1] == "text"


def test_contamination_edges(spark, documents):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "some words that are here to be found"), (3, "short"), (4, "some words that are here to be found"), (5, "some words that are here to be found")], "item_id long, text string")
    docs = documents([(1, None), (2, ""), (None, "some words that are here to be found"), (4, "x" * 300_000), (6, "some words  that are here\nto be found"), (6, "some words that are here to be found")])
    out = contaminated(docs.withColumn("item_id", F.lit(1)), bench)
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in out.collect()) == sorted([(d, i, 0) for d in ("None", "6", "6") for i in (4, 5)])
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def test_items_are_found_at_any_byte(spark, documents):
    rng = random.Random(11)
    items = [prose(rng, rng.randint(6, 50)) for _ in range(20)] + ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(rng.randint(10, 60))) for _ in range(20)] + ["short quoted item"]
    glued = ["<div class='x'>", "Question:", "https://example.org/a/b/c?d=", "「『（" + "字" * 12, '"', "é"]
    rows = [(len(glued) * k + g, f"{prose(rng, 5)} {glue}{item}{glue}{prose(rng, 5)}") for k, item in enumerate(items) for g, glue in enumerate(glued)]
    out = contaminated(documents(rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out if r.distance == 0} == {(i, i // len(glued)) for i, _ in rows}
    for r in out:
        if r.distance == 0:
            assert normalised(dict(rows)[r.doc_id])[r.start :][: r.length] == normalised(items[r.item_id])


def test_edited_long_items_are_found():
    rng = random.Random(12)
    items = [prose(rng, n).encode() for n in (300, 400, 900, 1000)]
    search = Search()
    index = Index(list(enumerate(items)), search)
    texts = [f"{prose(rng, 20)} {edited(rng, t.decode(), search.allowed(len(t)))} {prose(rng, 20)}".encode() for t in items for _ in range(3)]
    assert {(t, n) for t, n, *_ in index.search_block(texts)} == {(i, i // 3) for i in range(len(texts))}


def test_items_under_a_gram_are_found(spark, documents):
    items = ["to be", "x", "字", "é", "ninebytes", "eightbyt", "a b", "abcdefghi", "to be", "\n"]
    rows = [(1, "He said to  BE or not"), (2, "xé字x"), (3, "a\nb abcdefgh abcdefghi"), (4, "nineBYTESeightbyt"), (5, None), (6, "to  b")]
    out = contaminated(documents(rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = {(d, i, normalised(t).find(normalised(x))) for d, t in rows for i, x in enumerate(items) if normalised(x) and normalised(x) in normalised(t)}
    assert {(r.doc_id, r.item_id, r.start) for r in out} == want and all((r.distance, r.length) == (0, len(normalised(items[r.item_id]))) for r in out)
    assert len(out) == len(want)


def test_very_long_items():
    """Items of 5 to 100 KB, whole and with all edits but one, against the plain bit-parallel search; no table grows with them."""
    import pickle
    import time

    rng = random.Random(13)
    search = Search()
    items = [prose(rng, n).encode()[:size] for n, size in ((1200, 5_000), (5000, 20_000), (25_000, 100_000))]
    began = time.perf_counter()
    index = Index(list(enumerate(items)), search)
    texts = [f"{prose(rng, 30)}{t.decode()}{prose(rng, 30)}".encode() for t in items]
    texts += [f"{prose(rng, 30)} {edited(rng, t.decode(), search.allowed(len(t)) - 1)} {prose(rng, 30)}".encode() for t in items[:2]]
    texts += [prose(rng, 300).encode(), items[1][:15_000]]
    got = {(t, n): (d, s, length) for t, n, d, s, length in index.search_block(texts)}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 1)}
    for t in range(3):
        assert got[t, t] == (0, texts[t].index(items[t]), len(items[t]))
    assert got[3, 0][0] == edit_distance_in(items[0], texts[3], search.allowed(5_000))[0]
    assert len(pickle.dumps(index)) < 20_000_000 and time.perf_counter() - began < 60


def test_no_item_lies_far_below_the_recall():
    rng = random.Random(14)
    odd = [("ab" * 60 + prose(rng, 3)).encode(), (" ".join(["a"] * 80)).encode(), ("=" * 150).encode()]
    items = [prose(rng, rng.randint(15, 30)).encode() for _ in range(60)] + odd
    search = Search()
    index = Index(list(enumerate(items)), search)
    found = [0] * len(items)
    for _ in range(12):
        texts = [f"{prose(rng, 6)} {edited(rng, t.decode(), search.allowed(len(t)))} {prose(rng, 6)}".encode() for t in items]
        for t, n, *_ in index.search_block(texts):
            found[n] += t == n
    assert sum(found) >= 0.95 * 12 * len(items) and min(found) >= 7 and all(found[-k] >= 11 for k in (1, 2, 3))


def test_query_equals_the_plain_search(spark):
    """Near matches too: twenty items against every text of a table, joined so that one pass of an item reads all."""
    from dateloom.llm.queries import QUERIES

    folder, search = "/root/testdata/sf0.001", Search()
    items = sorted((r.item_id, normalised(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect())
    docs = sorted((r.doc_id, normalised(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    out = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op1_decontaminate"](spark, folder).collect()}
    some = sorted({i for _, i in out})[:10]
    items = [x for k, x in enumerate(items) if x[0] in some or k < 6]
    want = {}
    for i, item in items:
        edits = search.allowed(len(item))
        for d, text in docs:
            got = edit_distance_in(item, text, edits) if item[:12] in text or item[-12:] in text or any(item[k : k + 10] in text for k in range(0, len(item) - 9, 10)) else None
            if got:
                want[d, i] = got[0]
    found = {k: v for k, v in out.items() if k[1] in dict(items)}
    assert set(found) <= set(want) and all(found[k] == want[k] for k in found) and len(found) >= 0.95 * len(want)


def test_only_starts_near_a_copy_walk(monkeypatch):
    """Starts far from where a copy can begin do not walk, and the copies are found wherever they lie against the stride."""
    from dateloom.llm import decontaminate

    rng = random.Random(15)
    items = [prose(rng, n).encode() for n in (30, 40, 60)]
    search = Search()
    index = Index(list(enumerate(items)), search)
    walked, walk = [], decontaminate._Walker.walk
    monkeypatch.setattr(decontaminate._Walker, "walk", lambda self, which, raw, starts, steps: walked.extend(starts.tolist() if which == 0 else []) or walk(self, which, raw, starts, steps))
    for shift in range(4):
        texts = [prose(rng, 40).encode() + b"x" * shift + t + b" " + prose(rng, 40).encode() for t in items]
        walked.clear()
        assert {(t, n, d) for t, n, d, *_ in index.search_block(texts)} == {(i, i, 0) for i in range(3)}
        assert 0 < len(walked) <= sum(6 * search.allowed(len(t)) + 1 for t in items)


def test_counts_of_grams_lose_no_copy():
    """Every copy with all edits passes the counts at all strides, however it lies, and its start is among those that walk."""
    rng = random.Random(16)
    items = [prose(rng, n).encode() for n in (20, 25, 30, 60, 90)]
    index = Index(list(enumerate(items)), Search())
    for n, item in list(enumerate(items)) * 8:
        edits = index.search.allowed(len(item))
        before = (prose(rng, 30) + "z" * rng.randrange(4)).encode()
        copy = edited(rng, item.decode(), edits).encode()
        raw = np.frombuffer(before + copy + prose(rng, 30).encode() + b"\0" * 1000, np.uint8)
        for step in (1, 2, 4):
            at, _ = index._held(raw, 0, len(raw) - 9, step)
            assert ((at >= len(before)) & (at <= len(before) + len(copy) - 10)).sum() >= index._least(n, step)
        at, grams = index._near(raw, len(raw) - 1000)
        assert len(before) in index._starts(n, at, grams, 0, len(raw) - 1000)


def test_repetitions_grow_with_recall():
    rng = random.Random(5)
    items = [(i, prose(rng, 40).encode()) for i in range(20)]
    count = lambda recall: sum(len(c.keys) for c in Index(items, Search(recall=recall)).classes)
    assert count(0.5) <= count(0.9) <= count(0.99)


# --- line rules --------------------------------------------------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places)


def test_base_columns(documents):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "é# | <b> é#", "x\r\nx\r\nx", "l\n\nl\nl ", "a\x0bb\x0cc\x85d\xa0e"]
    texts += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "\t", "#", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    out = {r.doc_id: r for r in cleaned(documents(texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_lines(documents):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    more = " ".join(f"tale{i}" for i in range(60)) + "!"
    text = "\n".join([good, "Home | About | Contact", "We use cookies. Read our cookie policy", "NOW!! WIN!! BIG!!", " ".join(f"no{i}" for i in range(20)), "", more])
    r = cleaned(documents([text]).withColumns({"kept": F.lit(5), "other": F.lit(7)})).first()
    assert r.clean_text == "\n".join([good, "", more]) and r.n_failed_lines == 4 and r.kept and r.other == 7
    assert not cleaned(documents([text]), LineRules(lost=0.01)).first().kept
    assert cleaned(documents([good])).first().clean_text == good
    assert cleaned(documents(["x"]).limit(0)).count() == 0


def test_long_line_is_linear(documents):
    r = cleaned(documents([" ".join(f"w{i % 7000}" for i in range(100_000))])).first()
    assert r.n_words == 100_000 and r.n_repeat_words == 100_000


# --- line chunks -----------------------------------------------------------------------------------------------------------------


def test_repeated_passages_go(documents):
    rng = random.Random(7)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(9))
    passage = [line() for _ in range(25)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 9))] + passage + [line() for _ in range(5)])) for i in range(40)] + [(100, line()), (101, None), (102, ""), (103, "\n\n\n"), (104, "\n\n\n")]
    out = {r.doc_id: r for r in deduplicated(documents(rows).withColumns({"chunks": F.lit(1), "lines": F.lit(2), "gone": F.lit(3), "first": F.lit(4)})).collect()}
    text = dict(rows)
    assert out[0].text == text[0] and out[0].n_removed_lines == 0
    for i in range(1, 40):
        assert out[i].text.split("\n") == [x for x in text[i].split("\n") if x not in passage] and out[i].n_removed_chunks >= 3
    assert [out[i].text for i in (100, 101, 102, 103, 104)] == [text[100], "", "", "\n\n\n", "\n\n\n"]
    assert sum(r.n_lines for r in out.values()) == sum(len((t or "").split("\n")) for _, t in rows)


def test_chunks_are_two_lines_or_more_and_shift_with_their_text(documents):
    rng = random.Random(10)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(4))
    passage = [line() for _ in range(60)]
    texts = ["\n".join([line() for _ in range(k)] + passage) for k in (0, 1, 5, 8)] + ["\n".join(["-----"] * 41), "\n".join(["a"] * 3 + ["b"] * 50 + ["c"])]
    found = {}
    for r in pieces(documents(texts)).where("kind = 1").collect():
        found.setdefault(r.doc_id, []).append((r.first, r.last, r.hash))
    for rows in found.values():
        rows.sort()
        assert all(2 <= b - a + 1 <= 12 for a, b, _ in rows) and all(x[1] + 1 == y[0] for x, y in zip(rows, rows[1:]))
    hashes = [{h for *_, h in found[i]} for i in range(4)]
    assert all(len(hashes[0] & h) >= len(hashes[0]) - 2 for h in hashes) and len(found[0]) >= 15


def test_runs_of_one_line_and_long_lines(documents):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    rows = ["\n".join(["a"] * 9), "x\n" + "\n".join(["a"] * 6) + "\ny", f"{long}\nq", f"{short}\nr", f"s\n{long}", f"t\n{short}", "b\n" * 7]
    out = {r.doc_id: r.text for r in deduplicated(documents(rows)).collect()}
    assert out == {0: "a", 1: "x\na\ny"[:0] + "x\ny", 2: rows[2], 3: rows[3], 4: "s", 5: rows[5], 6: "b\n"}


def test_chunk_rows_that_repeat(documents):
    text = "\n".join(f"line number {i} of this" for i in range(30))
    out = deduplicated(documents([(1, text), (1, text), (2, text), (None, text)])).collect()
    assert {str(r.doc_id): r.n_removed_lines for r in out} == {"None": 0, "1": 30, "2": 30} and len(out) == 4
    assert deduplicated(documents([(1, text)]).limit(0)).count() == 0


def test_no_short_passage_stays(documents):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(9))
    rows, own = [], {}
    for i in range(100):
        passage = [line() for _ in range(2 + i % 5)]
        rows.append((2 * i, "\n".join([line(), *passage, line()])))
        own[2 * i + 1] = [line() for _ in range(i % 3)], [line() for _ in range(i % 2)]
        rows.append((2 * i + 1, "\n".join([*own[2 * i + 1][0], *passage, *own[2 * i + 1][1]])))
    out = {r.doc_id: r for r in deduplicated(documents(rows)).collect()}
    for i, text in rows:
        assert out[i].text == (text if i % 2 == 0 else "\n".join(sum(own[i], []))) and out[i].n_lines == len(text.split("\n"))


def test_passages_equal_pairs_by_hand(documents):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["a", "b", "c", "d", "e", "f", "", " "]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "x\n\ny", "x\ny", "x\ny"]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        at, gone = [k for k, x in enumerate(lines) if WORD.search(x)], set()
        for a, b in zip(at, at[1:]):
            if (lines[a], lines[b]) in seen:
                gone |= set(range(a, b + 1))
            seen.add((lines[a], lines[b]))
        want[i] = len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)
    out = deduplicated(documents(texts).withColumn("lines", F.lit(1))).collect()
    assert {r.doc_id: (r.n_removed_lines, r.text) for r in out} == want and len(out) == len(texts)


def test_very_long_texts(documents):
    text = "\n".join(f"line {i % 30_000} of a long text" for i in range(60_000))
    out = {r.doc_id: r.n_removed_lines for r in deduplicated(documents([text, "x" * 1_000_000, text])).collect()}
    assert out == {0: 29_999 + 1, 1: 0, 2: 60_000}


# --- URL filter --------------------------------------------------------------------------------------------------------------------


def test_intervals_and_verdicts(spark):
    day = lambda n: f"2024-01-{n:02d}"
    entries = [("bad.com", day(5), "add"), ("bad.com", day(5), "add"), ("bad.com", day(10), "remove"), ("bad.com", day(10), "add"), ("BAD.com", day(20), "add"), ("a.org/x", day(1), "add"), (None, day(1), "add"), ("c.net", None, "add"), ("d.net", day(1), "keep"), ("bad.com", day(12), "add")]
    e = spark.createDataFrame(entries, "pattern string, d string, action string").select("pattern", F.col("d").cast("timestamp_ntz").alias("listed"), "action")
    got = sorted((r.pattern, r.valid_from.day, r.valid_to and r.valid_to.day) for r in intervals(e).collect())
    assert got == [("a.org/x", 1, None), ("bad.com", 5, 10), ("bad.com", 12, None)]
    rows = [(1, "http://www.BAD.com/p", 4), (2, "http://www.bad.com/p", 5), (3, "https://u:p@bad.com:80/", 10), (4, "http://bad.com", 30), (5, "http://notbad.com/", 30), (6, "http://a.org/x/y?q", 2), (7, "http://a.org/xy", 2), (8, None, 2), (9, "nonsense", 2), (10, "http://bad.com", None), (2, "http://www.bad.com/p", 5)]
    c = spark.createDataFrame([(i, u, f"2024-01-{d:02d}" if d else None) for i, u, d in rows], "id long, url string, f string").select("id", "url", F.col("f").cast("timestamp_ntz").alias("fetched"), F.lit("x").alias("pattern"))
    out = verdicts(c, e).collect()
    assert len(out) == len(rows) and {r.id for r in out if r.blocked} == {2, 4, 6}
    assert {r.pattern for r in out if r.id == 6} == {"a.org/x"}
    assert verdicts(c, e.limit(0)).where("blocked").count() == 0 and verdicts(c.limit(0), e).count() == 0


def test_paths_keep_their_case(spark):
    e = spark.createDataFrame([("Host.org/News",)], "pattern string").selectExpr("pattern", "timestamp_ntz'2024-01-01' as listed", "'add' as action")
    c = spark.createDataFrame([("http://HOST.org/News/a",), ("http://host.org/news/a",)], "url string").selectExpr("url", "timestamp_ntz'2024-01-02' as fetched")
    assert {r.url: r.pattern for r in verdicts(c, e).collect()} == {"http://HOST.org/News/a": "host.org/News", "http://host.org/news/a": None}


def test_keys(spark):
    df = spark.createDataFrame([("http://a.b.c.com/x/y?z",), ("http://localhost/",), ("",)], "u string")
    assert [r[0] for r in df.select(keys_of(F.col("u"))).collect()] == [["a.b.c.com", "b.c.com", "c.com", "a.b.c.com/x", "a.b.c.com/x/y"], ["localhost"], []]


@pytest.mark.parametrize("text", ["a", ""])
def test_normalised(text):
    assert normalised(text) == text.encode() and normalised(" A\n\tB ") == b"a b" and normalised(None) == b""
