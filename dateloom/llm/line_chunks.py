"""Duplicate passages of lines by content-defined chunks, in DataFrame operations only.

A hash rolls over the hashes of the last WINDOW lines; a chunk begins where it has a local minimum, so equal passages are
cut alike wherever they stand and no chunk is under two lines. Hashes of chunks are counted over all documents; the
bytes of those that repeat are compared, and all but the first of equal chunks are removed.

A passage of few lines often holds no whole chunk. What the chunks leave is therefore judged at the finest cut, where
every two consecutive lines are a chunk, and so is a line of LONG words or more; again repeated hashes are compared
by their bytes. Lines without a word are skipped: they neither tell passages apart nor make one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import BROADCAST_ROWS, small, written
from dateloom.llm.line_rules import words

#: Lines under the rolling hash, its multiplier and modulus, and words from which a line is a passage by itself.
WINDOW, TIMES, MODULUS, LONG = 2, 48_271, 2**31 - 1, 50
#: What a line must hold to be judged.
_WORD = "[^ \\t-\\r]"
_CHUNK, _FINE = 1, 2
_PLACE = ["doc_id", "row_key", "first", "last"]


def _texts(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row_key", F.xxhash64("text"))


def pieces(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, kind, first, last, hash, within) of each chunk, pair of lines and long line: its first and last line's
    number in the text, a hash of the lines with words in it, and the first line of the chunk that holds it, if one does
    whole. The arrays of a text are made here and only here."""
    rows = _texts(documents).withColumn("lines", F.split("text", "\n", -1))
    worded = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_WORD), F.struct(i.alias("i"), x.alias("x")))), lambda s: s.isNotNull())
    rows = rows.select("doc_id", "row_key", worded.alias("worded"))
    rows = rows.select(
        "doc_id",
        "row_key",
        F.transform("worded", lambda s: s["i"]).alias("at"),
        F.transform("worded", lambda s: F.xxhash64(s["x"])).alias("own"),
        F.transform("worded", lambda s: F.conv(F.substring(F.md5(s["x"].cast("binary")), 1, 8), 16, 10).cast("long")).alias("hashes"),
        F.transform("worded", lambda s: (F.char_length(s["x"]) >= 2 * LONG - 1) & (F.size(words(s["x"])) >= LONG)).alias("long"),
    )
    n = F.size("at")
    hash_at = lambda k: F.coalesce(F.get("hashes", k), F.lit(0))
    rows = rows.withColumn("rolled", F.transform("hashes", lambda h, k: sum(((TIMES**j) * hash_at(k - j) for j in range(1, WINDOW)), h) % MODULUS))
    rolled = lambda k: F.get("rolled", k)

    def begins(k: Column) -> Column:
        lowest = (rolled(k) < rolled(k - 1)) & (rolled(k) <= rolled(k + 1))
        # within a run of one repeated line every second line begins a chunk
        level = (k % 2 == 0) & (rolled(k) == rolled(k - 1)) & (rolled(k) == rolled(k - 2)) & (rolled(k) == rolled(k + 1))
        return (k == 0) | ((k >= 2) & (k < n - 1) & (lowest | level))

    rows = rows.withColumn("starts", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), begins)))

    def chunk(start: Column, c: Column) -> Column:
        size = F.coalesce(F.get("starts", c + 1), n) - start
        first, last = F.get("at", start), F.get("at", start + size - 1)
        return F.when(size > 1, _piece(_CHUNK, first, last, F.xxhash64(F.slice("own", start + 1, size)), first))

    def pair(start: Column, end: Column, k: Column) -> Column:
        within = F.when(k + 1 < end, F.get("at", start))
        return F.when(k + 1 < n, _piece(_FINE, F.get("at", k), F.get("at", k + 1), F.xxhash64(F.get("own", k), F.get("own", k + 1)), within))

    def single(start: Column, k: Column) -> Column:
        return F.when(F.get("long", k), _piece(_FINE, F.get("at", k), F.get("at", k), F.xxhash64(F.get("own", k)), F.get("at", start)))

    def fine(start: Column, c: Column) -> Column:
        end = F.coalesce(F.get("starts", c + 1), n)
        places = F.sequence(start, end - 1)
        return F.concat(F.transform(places, lambda k: pair(start, end, k)), F.transform(places, lambda k: single(start, k)))

    every = F.array_compact(F.concat(F.transform("starts", chunk), F.flatten(F.transform("starts", fine))))
    # the outer form: a filter inferred for the inner one would be pushed below and compute the arrays again for every line
    rows = rows.select("doc_id", "row_key", F.explode_outer(every).alias("p"))
    return rows.where("p is not null").select("doc_id", "row_key", "p.*")


def _piece(kind: int, first: Column, last: Column, hash_: Column, within: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), hash_.alias("hash"), within.alias("within"))


def _by_document(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The structs of `columns` of each document as an array."""
    return _bounded(rows.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct(*columns)).alias(name)), name)


def _bounded(rows: DataFrame, name: str) -> DataFrame:
    """rows, one for each document, as a table under _id and _key; broadcast if rows and entries of the array are few."""
    rows = written(rows, name)
    sizes = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(name)), F.lit(0)).alias("entries")).first()
    out = rows.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    return F.broadcast(out) if sizes["rows"] <= BROADCAST_ROWS and sizes["entries"] <= 5 * BROADCAST_ROWS else out


def _same(documents: DataFrame) -> Column:
    return documents.doc_id.eqNullSafe(F.col("_id")) & (documents.row_key == F.col("_key"))


def repeated(found: DataFrame, documents: DataFrame, tag: str) -> DataFrame:
    """The places (doc_id, row_key, first, last) of those pieces that an earlier piece equals byte by byte.

    Earlier: by doc_id (null first), then text hash, then place. Only texts of pieces whose hash repeats are read.
    """
    again = written(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), f"again_{tag}")
    places = written(found.join(small(again), "hash").select(*_PLACE, "hash"), f"places_{tag}")
    texts = _texts(documents)
    rows = texts.join(_by_document(places, f"asked_{tag}", ["first", "last", "hash"]), _same(texts)).withColumn("lines", F.split("text", "\n", -1))
    asked = lambda p: F.filter(F.slice("lines", p["first"] + 1, p["last"] - p["first"] + 1), lambda x: x.rlike(_WORD))
    rows = rows.select("doc_id", "row_key", F.explode(F.transform(f"asked_{tag}", lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), p["hash"].alias("hash"), F.array_join(asked(p), "\n").alias("piece")))).alias("p"))
    rows = rows.select("doc_id", "row_key", "p.first", "p.last", "p.hash", "p.piece")
    # equal bytes meet in groups that are combined before the shuffle
    compared = written(rows.groupBy("hash", "piece").agg(F.min(F.struct(*_PLACE)).alias("earliest")), f"compared_{tag}")
    owners = written(compared.groupBy("hash").agg(F.count("*").alias("texts"), F.min("earliest").alias("earliest")), f"owners_{tag}")
    out = places.join(small(owners.where("texts = 1").select("hash", "earliest")), "hash").where(F.struct(*_PLACE) != F.col("earliest")).select(_PLACE)
    mixed = owners.where("texts > 1").select("hash")
    if not mixed.isEmpty():  # different bytes under one hash: judged by the bytes themselves
        own = compared.join(mixed, "hash")
        out = out.unionByName(rows.join(own, ["hash", "piece"]).where(F.struct(*_PLACE) != F.col("earliest")).select(_PLACE))
    return written(out.distinct(), f"repeated_{tag}")


def deduplicated(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed_chunks, n_removed_lines, text) of each row of documents (doc_id, text, ...).

    text is what remains: of every passage of two lines with words or more, and of every line of LONG words or more,
    that an earlier place holds, all lines go, those without words inside it too. A short line that repeats without an
    equal neighbour stays, and each line stays at its first place at least. n_removed_chunks counts the whole chunks.
    Null texts are empty. Rows that repeat a doc_id with other texts are documents of their own, after each other by text
    hash; rows that repeat doc_id and text are one document, each with the same result. An empty table gives no
    rows; a null doc_id comes before all others. Other columns are ignored.
    """
    found = written(pieces(documents), "pieces")
    chunks = repeated(found.where(F.col("kind") == _CHUNK).select(*_PLACE, "hash"), documents, "chunks")
    # pairs within a removed chunk are gone and never the first of their kind, so they need no judging
    fine, gone = found.where(F.col("kind") == _FINE), chunks.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("first").alias("_first"))
    fine = fine.join(small(gone), _same(fine) & (F.col("within") == F.col("_first")), "left_anti")
    pairs = repeated(fine.select(*_PLACE, "hash"), documents, "fine")

    every = chunks.withColumn("whole", F.lit(1)).unionByName(pairs.withColumn("whole", F.lit(0)))
    lines = every.select("doc_id", "row_key", "whole", F.explode(F.sequence("first", "last")).alias("line_no"), "first")
    gone = lines.groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("gone"), F.count_if((F.col("whole") == 1) & (F.col("line_no") == F.col("first"))).alias("n_removed_chunks"))
    texts = _texts(documents)
    rows = texts.join(_bounded(gone, "gone"), _same(texts), "left").withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    told = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), told(F.col("n_removed_chunks")).alias("n_removed_chunks"), told(F.size("gone")).alias("n_removed_lines"), text.alias("text"))
