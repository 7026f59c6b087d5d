import json
import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dateloom import sinks
from dateloom.functions import dates as D
from dateloom.operators import clusters, evaluate, sampling, timeline
from dateloom.operators.components import connected_components
from dateloom.schema import backfill_events, evolve, identifier
from dateloom.sources import api, feeds, files, models
from dateloom.streaming import ingest

ANCHOR = "2026-03-20 13:19:34"
PARSED = {
    "2 day ago": "2026-03-18T13:19:34+08:00",
    "2026-03-18 00:00:00": "2026-03-18T00:00:00+08:00",
    "Published 03/18/2026 | last updated 17 hours ago": "2026-03-18T00:00:00+08:00",
    "2026年03月18日 05:41:42": "2026-03-18T05:41:42+08:00",
    "2026-03-18 17:22:54": "2026-03-18T17:22:54+08:00",
    "Aug 5, 2025, 19:27 GMT+1": "2025-08-06T02:27:00+08:00",
    "2019-02-20 21:26:25": "2019-02-20T21:26:25+08:00",
    "": None,
    "soon": None,
}


def test_scraped_times(spark):
    df = spark.createDataFrame([(r,) for r in PARSED], "raw string")
    out = df.select("raw", D.iso_text(D.heterogeneous_time(F.col("raw"), F.lit(ANCHOR).cast("timestamp_ntz"))).alias("t")).collect()
    assert {r.raw: r.t for r in out} == PARSED


def test_standard_times(spark):
    rows = {"20250601T000000Z": "2025-06-01 08:00:00", "20250601123059": "2025-06-01 20:30:59", "20250601": None, "Mon, 02 Jun 2025 10:00:00 GMT": None, "2025-06-01": None, "": None}
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "raw string")
    out = {r.raw: r for r in df.select("raw", F.date_format(D.standard_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("t"), F.date_format(D.standard_time(F.col("raw"), strict=False), "yyyy-MM-dd HH:mm:ss").alias("u"), D.feed_text(F.col("raw")).alias("f")).collect()}
    assert {k: out[k].t for k in rows} == rows and out[None].t is None and out[None].f == ""
    assert out["20250601"].u == "2025-06-01 08:00:00" and out["Mon, 02 Jun 2025 10:00:00 GMT"].u == "2025-06-02 18:00:00"
    assert out["20250601123059"].f == "20250601T123059Z"


def test_timex(spark):
    want = {"2025-Q2": "2025-04-01", "2025-W01": "2024-12-30", "2025-03": "2025-03-01", "2025": "2025-01-01", "PRESENT_REF": "2026-03-20", "2025-W99": None, "2025-W00": None, "P1D": None}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    out = df.select("v", F.date_format(D.timex_date(F.col("v"), F.lit(ANCHOR).cast("timestamp_ntz")), "yyyy-MM-dd").alias("t")).collect()
    assert {r.v: r.t for r in out} == want


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u2")], "id int, v string, url string")
    new = spark.createDataFrame([(2, "B", "u2"), (3, "c", "u3"), (4, "d", "u3"), (5, "e", None)], "id int, v string, url string")
    assert {r.id for r in sinks.append_new(old, new, "url", ["id"]).collect()} == {3}
    assert sinks.appended(sinks.appended(old, new, "url", ["id"]), new, "url", ["id"]).count() == 3
    assert {(r.id, r.v) for r in sinks.upserted(old, new).collect()} == {(1, "a"), (2, "B"), (3, "c"), (4, "d"), (5, "e")}
    partial = sinks.partially_upserted(old, new.where("id <= 3").withColumn("url", F.lit("x")), ["v"])
    assert {(r.id, r.v, r.url) for r in partial.collect()} == {(1, "a", "u1"), (2, "B", "u2"), (3, "c", "x")}
    assert {(r.id, r.v) for r in sinks.updated(old, new, ["v"]).collect()} == {(1, "a"), (2, "B")}


def test_replace_and_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3).toDF("id"), path)
    sinks.replace_table(spark.range(5).toDF("id"), path)
    assert spark.read.parquet(path).count() == 5
    wrote = sinks.write_report(str(tmp_path / "r"), "20260101", spark.range(1), spark.range(0), spark.range(2))
    assert [w.rsplit("_", 1)[1] for w in wrote] == ["summary", "detail"]


def test_schema(spark):
    df = spark.createDataFrame([(1, None, datetime(2026, 1, 1)), (2, datetime(2026, 1, 1), datetime(2026, 1, 1)), (3, datetime(2026, 1, 2), datetime(2026, 1, 1))], "id int, event_timestamp timestamp_ntz, standard_timestamp timestamp_ntz")
    assert [r.parse_mode for r in backfill_events(df).orderBy("id").collect()] == ["missing_event", "fallback_like", "parsed_like"]
    assert evolve(df).columns[:3] == ["id", "title", "raw_time"]
    with pytest.raises(ValueError):
        identifier("a; drop table b")


def test_export_source(spark, tmp_path):
    row = lambda n, url: "\t".join(["0", "20250601", *["x"] * (n - 3), url])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.CSV", "\n".join([row(61, "https://www.BBC.com/1"), row(61, "https://other.org/2"), "short\tline", row(61, "https://dwxcom.net")]))
    out = feeds.export_news(files.export_rows(spark, str(tmp_path / "a.zip"))).collect()
    assert {(r.source, r.raw_time) for r in out} == {("bbc.com", "20250601"), ("Unknown", "20250601")}
    lines = spark.createDataFrame([("1 h http://x/20250601000000.export.CSV.zip",), ("1 h http://x/20250701000000.export.CSV.zip",), ("bad",), ("1 h http://x/20250601000000.gkg.csv.zip",)], "value string")
    assert [r.day for r in files.listed_exports(lines, "20250601", "20250630").collect()] == ["20250601"]


def test_json_and_rss(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "title": "t"}, {"id": "2"}]))
    (tmp_path / "b.json").write_text("{not json")
    assert files.json_array(spark, str(tmp_path / "a.json")).count() == 2
    assert files.json_array(spark, str(tmp_path / "b.json")).count() == 0
    with pytest.raises(ValueError):
        files.json_array(spark, str(tmp_path / "b.json"), required=True)
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(f"<item><title> t{i} </title><link>http://a/{i % 25}</link><pubDate>Mon, 0{1 + i % 9} Jan 2024 00:00:00 GMT</pubDate></item>" for i in range(30)) + "</channel></rss>")
    items = files.feed_items(spark, str(tmp_path / "f.xml"), "A")
    kept = feeds.fresh_items(items, spark.createDataFrame([("http://a/0",)], "url string"), F.lit("2024-01-05").cast("timestamp_ntz"))
    rows = kept.collect()
    assert 0 < len(rows) <= 20 and len({r.url for r in rows}) == len(rows) and "http://a/0" not in {r.url for r in rows}


def test_api_replies(spark):
    body = json.dumps({"articles": [{"title": "t", "seendate": "20250601T000000Z", "url": "u"}, {"title": "", "url": "v"}]})
    out = feeds.api_news(spark.createDataFrame([(body,), ("{}",)], "body string"), "BBC").collect()
    assert [(r.title, r.raw_time, r.source) for r in out] == [("t", "20250601T000000Z", "BBC")]
    docs = json.dumps({"response": {"docs": [{"_id": "k", "headline": {"main": "h"}, "pub_date": "p", "web_url": "w"}]}})
    assert feeds.search_news(spark.createDataFrame([(docs,)], "body string")).first().id == "nyt_k"


def test_retry():
    def run(replies):
        waits, left = [], iter(replies)
        return api.fetch_with_retry("u", lambda u: next(left), waits.append), waits

    assert run([(429, ""), (503, ""), (200, "{}")]) == ("{}", [900, 30])
    assert run([(404, "")]) == (None, [])
    assert run([(599, "")] * 5) == (None, [30] * 5)
    assert "fl=headline" in api.page_url("http://a", "q", "1", "2", 0)


def test_full_windows_are_cut():
    records = [*range(0, 1000, 10), *[500] * 3]
    read = lambda w: [r for r in records if w[0] <= r <= w[1]][:20]
    assert sorted(api.whole_window(lambda a, b: (a, b), 0, 999, read, 20)) == sorted(records)
    with pytest.raises(ValueError):
        api.whole_window(lambda a, b: (a, b), 0, 999, lambda w: [0] * 20, 20)
    with pytest.raises(ValueError):
        api.whole_window(lambda a, b: (a, b), 0, 999, lambda w: None, 20)


def test_pages_end():
    asked = []
    read = lambda p: asked.append(p) or ([p] * 2 if p < 2 else [])
    assert api.all_pages(lambda p: p, read) == [0, 0, 1, 1] and asked == [0, 1, 2]
    assert len(api.all_pages(lambda p: p, lambda p: [p])) == 5


def test_models(spark):
    sent = []

    def send(replies):
        left = iter(replies)
        return lambda url, payload: sent.append(payload) or next(left)

    said = {"message": {"content": " yes "}, "eval_count": 10, "eval_duration": 2_000_000_000}
    assert models.chatted("m", "s", "p", "u", send([{"message": {"content": ""}}, said]))[0] == "yes"
    assert [x["messages"][1]["content"] for x in sent] == ["p", "/no_think\np"]
    with pytest.raises(models.EmptyReply):
        models.chatted("m", "s", "p", "u", send([{}, {}]))
    with pytest.raises(RuntimeError):
        models.chatted("m", "s", "p", "u", send([{"error": "no such model"}]))
    assert models.generated("m", "p", "u", send([{"response": " r ", "done": True}])) == "r"
    for bad in ({"response": "r", "done": False}, {"response": " "}):
        with pytest.raises(models.EmptyReply):
            models.generated("m", "p", "u", send([bad]))
    text, cost = models.measured(lambda: models.chatted("m", "s", "p", "u", send([said])))
    assert text == "yes" and cost.tokens_per_second == 5 and cost.seconds >= 0 and cost.peak_mb > 1
    assert models.measured(lambda: ("x", {}))[1].tokens_per_second is None


def test_data_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    there, other = str(tmp_path / "b"), str(tmp_path / "c")
    assert files.data_folder(spark, str(tmp_path / "a"), there, other) == there
    assert files.data_folder(spark, str(tmp_path / "a"), other) == other and (tmp_path / "c").is_dir()


def test_scans(spark):
    df = spark.createDataFrame([("1", "t", None, datetime(2026, 1, 1)), ("2", "", "20250601", None), ("3", "u", "", None), ("4", "v", "x", datetime(2026, 1, 2))], "id string, title string, raw_time string, standard_timestamp timestamp_ntz")
    assert files.raw_news(df).columns == ["id", "title", "raw_time", "standard_timestamp", "source", "url", "true_order", "is_noise"]
    assert {r.id for r in files.standardised(df).collect()} == {"1", "4"} and {r.id for r in files.unstandardised(df).collect()} == {"2"}
    assert {r.id for r in files.evaluable_news(df).collect()} == {"1", "4"} and files.evaluable_news(df, 1).count() == 1


def test_batched_cursor(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(1, 41).withColumn("v", F.col("id") * 2).write.jdbc(url, "numbers", mode="overwrite")
    assert spark.read.jdbc(url, "numbers").count() == 40
    assert files.jdbc(spark, url, "numbers", "id", 1, 41, 4, 5).rdd.getNumPartitions() == 4


def test_embedder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "a")], "id int, title string")
    out = {r.id: r.vector for r in clusters.batches_of(df, "title", lambda: lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert out == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}


def test_checkpoints(spark):
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    bounds = spark.createDataFrame([("a", "2025-06-01 00:00:00", "2025-06-20 00:00:00"), ("b", "2025-06-02 00:00:00", "2025-06-01 00:00:00")], "source string, s string, e string").select("source", ts("s").alias("start"), ts("e").alias("stop"))
    windows = feeds.fetch_windows(bounds)
    assert [str(r.window_end) for r in windows.orderBy("window_start").collect()] == ["2025-06-08 00:00:00", "2025-06-15 00:00:01", "2025-06-20 00:00:00"]
    outcomes = windows.withColumn("ok", F.col("window_start") != F.lit("2025-06-08 00:00:01").cast("timestamp_ntz")).select("source", "window_start", "ok")
    assert feeds.advanced(windows, outcomes).first().next_start_time == "20250608T000001Z"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(0, 120))
def test_allocation_adds_up(spark, sizes, size):
    strata = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "stratum string, n long")
    rows = sampling.allocation(strata, size).collect()
    assert sum(r["take"] for r in rows) == min(size, sum(sizes))
    assert all(0 <= r["take"] <= r.n for r in rows)


def test_sample_is_stable(spark):
    df = spark.range(500).withColumn("lang", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    one, two = (sorted(r.id for r in sampling.stratified_sample(d, 50, F.col("lang")).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 50


def test_summary_of_nothing(spark):
    flags = "lang string, is_evaluable int, is_exact int, is_relaxed int, is_range_hit int, is_anchor_in_gold_range int, is_interval_gold int"
    row = evaluate.metrics(spark.createDataFrame([], flags), []).first()
    assert (row.sample_count, row.evaluable_coverage, row.exact_accuracy) == (0, 0.0, None)


def test_clusters(spark):
    rows = [(1, [1.0, 0.0], "2026-03-18"), (2, [0.9, 0.1], "2026-03-19"), (3, [1.0, 0.0], "2026-04-18"), (4, [0.0, 1.0], "2026-03-18"), (5, None, "2026-03-18"), (6, [1.0, 0.0], None), (7, [0.8, 0.2], "2026-03-26")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, t string").select("id", "vector", F.col("t").cast("timestamp_ntz").alias("at"))
    out = {r.id: r.cluster_id for r in clusters.clusters(df).collect()}
    assert out == {1: 0, 2: 0, 3: None, 4: None, 5: None, 6: None, 7: 0}
    assert clusters.banded_pairs(df).count() == sum(1 for a in (1, 2, 4, 5, 7) for b in (1, 2, 4, 5, 7) if a < b and not (b == 7 and a != 2))
    probed = {r.id: r.outside for r in clusters.probe(df.withColumn("title", F.concat(F.lit("Minister "), "id")), "Minister").collect()}
    assert probed[3] and probed[6] and not probed[2]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    parent = list(range(13))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    out = connected_components(spark.createDataFrame(edges, "a int, b int")).collect()
    roots = {r.node: r.root for r in out}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(roots) == nodes
    assert all((roots[x] == roots[y]) == (top(x) == top(y)) for x in nodes for y in nodes)


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_few_edges_meet_in_one_task(spark, monkeypatch, kind):
    """A long path among stars: one task names the components that rounds name, in two tables and not several a round."""
    import dateloom.operators.components as C

    seen, inner = [], C.written
    monkeypatch.setattr(C, "written", lambda df, tag: seen.append(tag) or inner(df, tag))
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 9)] + [(300 + i, 300) for i in range(1, 9)] + [(7, 7), (5, 4), (None, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long").select(*[F.col(c).cast("string" if kind != "long" else "long").cast(kind).alias(c) for c in "ab"])
    groups = lambda rows: sorted(sorted(str(r.node) for r in rows if r.root == x) for x in {r.root for r in rows})
    found = connected_components(edges)
    assert seen == ["edges", "labels"] and found.schema["node"].dataType == edges.schema["a"].dataType
    found = found.collect()
    assert groups(found) == groups(connected_components(edges, few=len(pairs) - 4).collect()) and [61, 9, 9] == sorted((sum(r.root == x for r in found) for x in {r.root for r in found}), reverse=True)
    assert len(seen) > 6 and connected_components(edges.where("a is null")).collect() == []


def test_timeline(spark):
    items = spark.createDataFrame([("1", "2026-03-18", "A", False, 0, 0), ("2", "2026-03-17", "B", True, None, 1), ("3", None, "C", None, None, 2)], "id string, parsed_time string, title string, system_is_noise boolean, cluster_id int, position int")
    assert [r.id for r in timeline.timeline(items).orderBy("position").collect()] == ["2", "1", "3"]
    context = timeline.prompt_context(items).first().context
    assert context.index("【事件ID】: 1") < context.index("【事件ID】: 2") and "归属簇 0" in context and "归属簇 未知" in context
    told = timeline.timeline(items, lambda text: '```json\n[{"id":"2"},{"id":"9","event_type":"无关噪声"}]\n```')
    steps = {r.id: r for r in timeline.titled(told, items).collect()}
    assert steps["2"].original_title == "B" and steps["2"].event_type == "未知类型" and steps["9"].original_title == "未知标题"


def test_stream_is_idempotent(spark, tmp_path):
    ddl = "id string, title string, raw_time string, source string, url string"
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *urls):
        (folder / name).write_text("\n".join(json.dumps({"id": u, "title": "t", "raw_time": "" if u == "u3" else "20250601T000000Z", "source": "s", "url": u}) for u in urls))

    def run():
        rows = ingest.standardised_stream(ingest.once(ingest.json_stream(spark, str(folder), ddl)))
        ingest.append_stream(rows, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        return sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a.json", "u1", "u1", "u2")
    assert run() == ["u1", "u2"]
    put("b.json", "u2", "u3")
    assert run() == ["u1", "u2", "u3"]
    assert run() == ["u1", "u2", "u3"]




def test_first_n_and_numbering(spark):
    from dateloom.tables import first_n, numbered

    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7919) % 3001).alias("o"))
    got = sorted((r.g, r.o) for r in first_n(df, ["g"], ["o"], 5).collect())
    rows = [(r.g, r.o) for r in df.collect()]
    assert got == sorted(x for g in ("hot", "cold") for x in sorted(r for r in rows if r[0] == g)[:5])
    places = {r.o: r.place for r in numbered(df, "o", "place").collect()}
    assert places == {o: k for k, o in enumerate(sorted(places))}
    assert numbered(df.limit(0), "o", "place").count() == 0
