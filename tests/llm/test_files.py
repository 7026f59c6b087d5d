import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dateloom.llm import warc
from dateloom.llm.elias_fano import EliasFano
from dateloom.llm.token_files import Encoder, _is_known, documents_in, footer_of, open_tokens, opened, read_tokens, write_tokens
from dateloom.llm.warc import HEADERS, IDENTICAL, WarcReader, WarcWriter, _Members, digests, member, parsed, plan_records, read_warc, write_pages

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    e = EliasFano.loads(EliasFano.of(values).dumps())
    assert len(e) == len(values)
    if len(values):
        ks = np.random.default_rng(1).permutation(len(values))
        assert (e.select(ks) == values[ks]).all() and (e.select(np.arange(len(values))) == values).all()
        assert 8 * (len(e.lows) + len(e.highs)) <= len(values) * (3 + np.log2(max(1, int(values[-1]) / len(values) + 2))) + 40
        assert len(e.before) <= 2 + 8 * len(e.highs) // 512
    with pytest.raises(IndexError):
        e.select([len(values)])


def test_elias_fano_refuses_disorder():
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def test_reading_asks_select_and_decodes_no_table(monkeypatch):
    """Two million documents: every boundary comes from select, of a bounded run at once, in little memory."""
    import tracemalloc

    n = 2_000_000
    sizes = np.random.default_rng(2).integers(1, 4, n)
    bounds, names = EliasFano.of(np.concatenate(([0], np.cumsum(sizes)))), EliasFano.of(np.cumsum(sizes) - sizes[0])
    told = {"n_documents": n, "width": 2, "without": 0, "least": 5, "bounds": EliasFano.loads(bounds.dumps()), "names": EliasFano.loads(names.dumps())}

    class Zeros:
        def seek(self, at):
            pass

        def read(self, n):
            return bytes(n)

    asked = []
    select = EliasFano.select
    monkeypatch.setattr(EliasFano, "select", lambda self, ks: asked.append(len(ks)) or select(self, ks))
    tracemalloc.start()
    documents = tokens = last = 0
    for doc_ids, cuts, ids in documents_in(Zeros(), told):
        assert cuts[0] == tokens
        documents, tokens, last = documents + len(doc_ids), int(cuts[-1]), doc_ids[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (documents, tokens, last) == (n, int(sizes.sum()), 5 + int(sizes.sum() - sizes[0]))
    assert len(asked) >= 2 * n // 4096 and max(asked) <= 4097 and peak < 4_000_000
    assert 8 * len(bounds.dumps()) < 5 * n


def test_making_a_code_takes_bounded_memory():
    import tracemalloc

    values = np.cumsum(np.random.default_rng(3).integers(0, 5000, 1_000_000)).astype(np.uint64)
    tracemalloc.start()
    code = EliasFano.of(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and code.select([999_999])[0] == values[-1]


def expected(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_tokens_round_trip(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "l'été,", "naïve", "x1y2", "don't", "ΣΑΣ", "汉字", "<|endoftext|>", "İx", "\x85", "é́", "Ünï!!"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(7 * i - 500, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "word " * 40_000)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit(2)})
    tokens = write_tokens(df, VOCABULARY, shards=5)
    read = lambda t: sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read_tokens(t).collect())
    assert read(tokens) == expected(rows) == read(open_tokens(spark, tokens.folder))
    for r in tokens.shards.collect():
        files, at = opened(r.path)
        with files.open_input_file(at) as f:
            told = footer_of(f)
        assert (told["n_documents"], told["n_tokens"], told["width"]) == (r.n_documents, r.n_tokens, 2)


def test_tokens_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (3, "c"), (3, "d e f"), (None, None), (3, "c")]
    out = read_tokens(write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, shards=2)).collect()
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, None, 3, 3, 3]
    assert sum(r.n_tokens for r in out) == out[-1].start + out[-1].n_tokens
    assert read_tokens(write_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aZ09'stremvld é<|>ſİ \n\t\x1c\x85\xa0Σ漢²"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=8))
def test_encoder_equals_tokenizer(texts):
    global _ENCODER
    e = _ENCODER = globals().get("_ENCODER") or Encoder(open(VOCABULARY, encoding="utf-8").read())
    assert e.by_piece
    ids, counts = e.encode(pa.array(texts, pa.string()))
    want = [np.frombuffer(x, "<u4") for x in e.whole(texts)]
    assert counts.tolist() == [len(x) for x in want] and (ids == np.concatenate(want)).all()


def test_query_equals_the_tokenizer(spark):
    """The whole query over a whole table against the library alone."""
    from dateloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    out = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, folder).collect())
    assert out == expected(rows)


def test_encoder_of_a_changed_file():
    """Any setting that differs sends whole texts to the tokenizer."""
    import copy
    import json

    told = json.load(open(VOCABULARY, encoding="utf-8"))
    assert _is_known(told)
    changes = [
        lambda t: t["normalizer"]["normalizers"][1].update(content="_"),
        lambda t: t["normalizer"]["normalizers"][1]["pattern"].update(Regex="e+"),
        lambda t: t["normalizer"]["normalizers"].pop(),
        lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(invert=False),
        lambda t: t["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        lambda t: t["model"].update(end_of_word_suffix="</x>"),
        lambda t: t["model"].update(dropout=0.1),
        lambda t: t["added_tokens"][0].update(content="of"),
        lambda t: t["added_tokens"][0].update(normalized=True),
        lambda t: t.update(truncation={"max_length": 3, "strategy": "LongestFirst", "stride": 0, "direction": "Right"}),
    ]
    for k, change in enumerate(changes):
        other = copy.deepcopy(told)
        change(other)
        assert not _is_known(other), k
    other = copy.deepcopy(told)
    changes[1](other)
    e = Encoder(json.dumps(other))
    ids, counts = e.encode(pa.array(["the teeth of trees", "x"]))
    assert not e.by_piece and (ids == np.concatenate([np.frombuffer(x, "<u4") for x in e.whole(["the teeth of trees", "x"])])).all()


def test_encoder_of_another_file():
    e = Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    ids, counts = e.encode(pa.array(["Hello  World", None]))
    assert not e.by_piece and counts.tolist() == [len(ids), 0]


# --- WARC ------------------------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "size": F.lit(1), "first": F.lit(2)})


def test_warc_round_trip(spark):
    same, short = "é" * 60, "x" * 99
    rows = [(5, "http://a", same), (3, "http://b", same), (9, None, same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u\r\nX: y", ""), (None, "u", same), (7, "u", "z" * 500_000), (8, "u", "\r\n\r\nWARC/1.1")]
    folder = write_pages(pages_of(spark, rows))
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in digests(spark, folder).collect()}
    want = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and html == same and page_id not in (3, None)
        want[page_id] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)
    assert out == want
    assert read_warc(spark, folder).where("record_type = 'warcinfo'").count() >= 1
    plain = read_warc(spark, folder).where("record_type <> 'warcinfo'")
    assert {(r.record_type, r.profile) for r in plain.collect()} == {("response", None), ("revisit", IDENTICAL)}
    assert plain.where("date rlike '^20[0-9]{2}-[0-9]{2}-[0-9]{2}T.*Z$'").count() == len(rows)
    assert plain.where("record_type = 'revisit'").select("payload").distinct().collect()[0].payload == b""
    assert plain.where("target_uri = 'http://a'").count() == 1 and plain.where("record_type in ('revisit', 'x') and refers_to is not null").count() == 2
    bare = read_warc(spark, folder, payload=False)
    assert bare.where("payload is null and record_type in ('response', 'revisit')").count() == len(rows)
    dated = pages_of(spark, rows[:1]).withColumn("fetched", F.expr("timestamp_ntz'2024-05-06 07:08:09'"))
    assert plan_records(dated).first().date == "2024-05-06T07:08:09Z"
    assert digests(spark, write_pages(pages_of(spark, []))).count() == 0


def test_filters_are_judged_on_headers():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = WarcReader({"path": "x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", None)), IsNotNull(("refers_to",)), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.wanted == [("record_type", {"response"}), ("target_uri", {"a"}), ("refers_to", None)]


def test_members_skip_and_foreign_archives():
    records = [member({"WARC-Type": "response", "WARC-Record-ID": str(i)}, bytes(str(i), "ascii") * 70_000) for i in range(4)]
    data = b"".join(records)
    assert all(gzip.decompress(r).startswith(b"WARC/1.1\r\n") for r in records)

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.read_bytes += len(got)
            return got

    ids = [h["warc-record-id"] for h, _ in _Members(Counted(data), 0, len(data))]
    assert ids == ["0", "1", "2", "3"] and Counted.read_bytes <= 4 * 4096
    foreign = b"".join(gzip.compress(gzip.decompress(r)) for r in records)
    assert [p()[:1] for _, p in _Members(io.BytesIO(foreign), 0, len(foreign))] == [b"0", b"1", b"2", b"3"]
    bare = b"".join(gzip.decompress(r) for r in records)
    assert [len(p()) for _, p in _Members(io.BytesIO(bare), 0, len(bare))] == [70_000] * 4
    assert parsed(b"WARC/1.0\r\nA: b:c\r\nbad") == {"a": "b:c", "bad": ""}


def records(n, size):
    rng = random.Random(3)
    names = list(HEADERS)
    rows = [{name: None for name in names} | {"record_id": str(i), "record_type": "response", "payload": rng.randbytes(size)} for i in range(n)]
    return pa.RecordBatch.from_pylist(rows, pa.schema([*(pa.field(name, pa.string()) for name in names), pa.field("payload", pa.binary())]))


def test_files_are_cut_by_tasks(tmp_path, monkeypatch):
    """Parts of a large file hold each record once; the driver opens no index; uncommitted files are not read."""
    monkeypatch.setattr(warc, "_PART", 10_000)
    monkeypatch.setattr(warc, "_FILE", 100_000)
    folder = f"file://{tmp_path}"
    writer = WarcWriter({"path": folder})
    message = writer.write(iter([records(150, 1500)]))
    reader = WarcReader({"path": folder})
    ids = lambda r: sorted((int(x) for p in r.partitions() for b in r.read(p) for x in b.column("record_id").to_pylist() if not x.startswith("<")))
    assert ids(reader) == []
    writer.commit([message, None])
    assert len(message.files) == 3 and ids(reader) == list(range(150))
    parts = reader.partitions()
    assert len(parts) >= 22 and all(sum(b.num_rows for b in reader.read(p)) <= 12 for p in parts)
    again = writer.write(iter([records(3, 10)]))
    writer.abort([again, None])
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]

    def broken():
        yield records(3, 10)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    for p in tmp_path.glob("*.idx"):
        p.unlink()
    assert len(reader.partitions()) == 3 and ids(reader) == list(range(150))


def test_plan_of_ties(spark):
    rows = [(1, "u", "y" * 100), (1, "u", "y" * 100), (2, "v", "y" * 100)]
    kinds = sorted((r.record_id, r.record_type) for r in plan_records(pages_of(spark, rows)).collect())
    assert kinds == [("<urn:x-page:1>", "response"), ("<urn:x-page:1>", "response"), ("<urn:x-page:2>", "revisit")]
