"""Token-id files: one concatenated id array for each shard, document boundaries and ids in Elias-Fano code.

A shard holds, in this order: its ids, little-endian, two bytes each where the vocabulary allows and else four; the
Elias-Fano code of the n + 1 boundaries; that of the distances of the document ids from the least; a footer. Shards
are ranges of ascending doc_id, so the first token of a document is its shard's start plus a boundary. A shard's
file has a name of its own for each attempt to write it; the table of shards, written last, names those that count.
Readers ask the codes for the boundaries they need, a bounded number at once, by select; no table of offsets is made.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.llm.common import frugal, remembered, scratch, tune
from dateloom.llm.elias_fano import EliasFano

_MAGIC = b"TOKEF002"
#: magic, bytes an id, ids, documents, documents without a doc_id, least doc_id, sizes of the two codes.
_FOOTER = "<8sIQQQqQQ"
#: Pieces whose ids a worker remembers in a generation.
_REMEMBERED = 250_000
#: Fixed value: how the pre-tokenizer cuts normalised text; and the same cut for texts without code points beyond U+017F.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS, _SPACES = r"a-zA-Z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}", r"\t-\r \x{85}\x{a0}"
#: Pieces other than runs of letters, which white space and these pieces set apart.
_APART = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
_GAP = r"[\t-\r\x{85}\x{a0}]"
#: The dotted capital I becomes two code points in lower case.
_BEYOND = r"[^\x{0}-\x{12f}\x{131}-\x{17f}]"
_SHARDS = "shard int, path string, n_documents long, n_tokens long"
#: Texts encoded at once.
_AT_ONCE = 1024
#: Ids and documents read at once.
_READ, _STEP = 1 << 20, 4096


def opened(uri: str):
    """(file system, path in it) for a folder or file that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Encoder:
    """Ids of whole texts by a tokenizer file.

    Where a file normalises by NFC and lower case and then cuts a text by PIECES, which never looks across a cut, the ids
    of pieces are remembered, in two generations of bounded size. Texts with letters beyond Latin Extended-A, or with
    what may be a special token, and all texts of other files go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        told = json.loads(vocabulary)
        self.by_piece = _is_known(told)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); nulls are empty.

        Arrow cuts the texts into pieces and numbers them; each distinct one is looked up once and its ids are laid out
        by number.
        """
        texts = texts.fill_null("")
        if not self.by_piece:
            own = [np.frombuffer(x, "<u4") for x in self.whole(texts.to_pylist())]
            return np.concatenate([np.zeros(0, "<u4"), *own]), np.array([len(x) for x in own], np.int64)
        odd = pc.or_(pc.match_substring_regex(texts, _BEYOND), pc.match_substring(texts, "<|"))
        apart = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(odd, "", texts)), _APART, r" \0 ")
        lists = pc.split_pattern(pc.replace_substring_regex(apart, _GAP, " "), " ")
        codes = lists.flatten().dictionary_encode()
        found = self.looked_up(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(x) // 4 for x in found], np.int64)
        pool = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(np.frombuffer(b"".join(found), "<u4")))
        ids = pool.take(codes.indices).flatten().to_numpy()
        each = size[codes.indices.to_numpy()]
        sums = np.concatenate(([0], np.cumsum(each)))
        counts = np.diff(sums[lists.offsets.to_numpy()])
        if pc.any(odd).as_py():
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            ends = np.cumsum(counts)
            parts = np.split(ids, ends[at])
            own = [np.frombuffer(x, "<u4") for x in self.whole(texts.take(pa.array(at)).to_pylist())]
            ids = np.concatenate([x for pair in zip(parts, [*own, parts[-1][:0]]) for x in pair])
            counts[at] = [len(x) for x in own]
        return ids, counts

    def looked_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; new ones go to the tokenizer together."""
        if len(self.known) > _REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        found = list(map(self.known.get, pieces))
        missing = [p for p, x in zip(pieces, found) if x is None]
        if missing:
            old = list(map(self.older.get, missing))
            self.known.update((p, x) for p, x in zip(missing, old) if x is not None)
            new = [p for p, x in zip(missing, old) if x is None]
            for i in range(0, len(new), 8192):
                self.known.update(zip(new[i : i + 8192], self.whole(new[i : i + 8192])))
            found = list(map(self.known.__getitem__, pieces))
        return found


#: The settings of a tokenizer file whose texts may be cut into pieces, other than vocabulary and special tokens.
KNOWN = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: The same of its model.
KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _is_known(told: dict) -> bool:
    """Whether a tokenizer file is set, in all but its vocabulary, as the pieces below suppose."""
    model = {k: v for k, v in (told.get("model") or {}).items() if k not in ("vocab", "merges")}
    special = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in told.get("added_tokens") or [])
    return special and model == KNOWN_MODEL and all(k in told and told[k] == v for k, v in KNOWN.items())


def encoder(vocabulary: str) -> Encoder:
    """This worker process's encoder: what it remembers outlives a task."""
    return remembered((zlib.crc32(vocabulary.encode()), len(vocabulary)), lambda: Encoder(vocabulary))


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    shards: DataFrame


def _written(folder: str, vocabulary: str, end_id: int, width: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, at = opened(f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.tok")
        files.create_dir(at.rpartition("/")[0], recursive=True)
        encode = encoder(vocabulary).encode
        sizes, ids, without = [], [], 0
        with files.open_output_stream(at) as out:
            for batch in batches:
                for i in range(0, batch.num_rows, _AT_ONCE):
                    found, counts = encode(batch.column("text").slice(i, _AT_ONCE))
                    found = np.insert(found, np.cumsum(counts), end_id)
                    sizes.append(counts + 1)
                    out.write(found.astype("<u2").tobytes() if width == 2 else found.tobytes())
                given = batch.column("doc_id")
                without += given.null_count
                ids.append(given.drop_null().to_numpy(zero_copy_only=False))
            named = np.concatenate([np.zeros(0, np.int64), *ids])
            least = int(named[0]) if len(named) else 0
            ends = np.cumsum(np.concatenate([np.zeros(1, np.uint64), *sizes], dtype=np.uint64, casting="unsafe"))
            n, n_tokens = len(ends) - 1, int(ends[-1])
            bounds = EliasFano.of(ends).dumps()
            names = EliasFano.of((named.astype(np.int64).view(np.uint64) - np.int64(least).view(np.uint64))).dumps()
            out.write(bounds + names + struct.pack(_FOOTER, _MAGIC, width, n_tokens, n, without, least, len(bounds), len(names)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [files_uri(folder, at)], "n_documents": pa.array([n], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return run


def files_uri(folder: str, at: str) -> str:
    return f"{folder}/{at.rpartition('/')[2]}"


def write_tokens(documents: DataFrame, vocabulary_path: str, end_id: int = 1, folder: str | None = None, shards: int | None = None) -> TokenFiles:
    """Token files of whole documents (doc_id, text; other columns are ignored) in ascending doc_id.

    Null texts are empty; every document gets end_id, so an empty one has one id. Rows without doc_id come first.
    Rows that repeat a doc_id follow each other by the hash of their texts. An empty table gives empty shards.
    """
    spark = documents.sparkSession
    tune(spark, 1024)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_str(vocabulary).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    folder = folder or scratch(spark, "tokens")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows.mapInArrow(frugal(_written(folder, vocabulary, end_id, width), remembers=True), _SHARDS).write.parquet(f"{folder}/shards")
    return open_tokens(spark, folder)


def open_tokens(spark: SparkSession, folder: str) -> TokenFiles:
    return TokenFiles(folder, spark.read.schema(_SHARDS).parquet(f"{folder}/shards"))


def footer_of(file) -> dict:
    size = struct.calcsize(_FOOTER)
    file.seek(file.size() - size)
    magic, width, n_tokens, n_documents, without, least, a, b = struct.unpack(_FOOTER, file.read(size))
    if magic != _MAGIC:
        raise ValueError("not a token file")
    file.seek(file.size() - size - a - b)
    return {"width": width, "n_tokens": n_tokens, "n_documents": n_documents, "without": without, "least": least, "bounds": EliasFano.loads(file.read(a)), "names": EliasFano.loads(file.read(b))}


def documents_in(file, told: dict):
    """(doc_ids, n + 1 boundaries, ids) of runs of documents of an open shard; boundaries and doc_ids by select, of a run only."""
    n, width, without = told["n_documents"], told["width"], told["without"]
    first = 0
    while first < n:
        bounds = told["bounds"].select(np.arange(first, min(n, first + _STEP) + 1)).astype(np.int64)
        run = max(1, int(np.searchsorted(bounds, bounds[0] + _READ, side="right")) - 1)
        bounds = bounds[: run + 1]
        last = first + len(bounds) - 1
        names = told["names"].select(np.arange(max(0, first - without), max(0, last - without))).view(np.int64) + told["least"]
        file.seek(int(bounds[0]) * width)
        ids = np.frombuffer(file.read(int(bounds[-1] - bounds[0]) * width), f"<u{width}").astype("<u4")
        yield [None] * (last - first - len(names)) + names.tolist(), bounds, ids
        first = last


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            files, at = opened(path)
            with files.open_input_file(at) as file:
                for doc_ids, bounds, ids in documents_in(file, footer_of(file)):
                    cuts = ((bounds - bounds[0]) * 4).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), binary], ["doc_id", "start", "n_tokens", "ids"])


def read_tokens(tokens: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document from the files; ids: little-endian unsigned 32-bit integers.

    A row for each shard, not for each document, passes the driver: their sizes added up give the starts.
    """
    spark = tokens.shards.sparkSession
    shards = tokens.shards.orderBy("shard").toPandas()
    starts = shards["n_tokens"].cumsum() - shards["n_tokens"]
    rows = [(path, int(start)) for path, start, n in zip(shards["path"], starts, shards["n_documents"]) if n]
    planned = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return planned.mapInArrow(frugal(_read), "doc_id long, start long, n_tokens long, ids binary")
