"""MinHash near-duplicates by an LSH forest.

Every distinct shingle set is a node. A tree is the order of all nodes by their `DEPTH` min-hashes of that tree;
nodes next to each other in an order share the longest common prefixes, so a sparse region is compared from the
shallowest useful depth on and a crowded one only at the depth where it thins out to `window` neighbours. The orders
are range partitioned and sorted, so a region of a million copies spreads over tasks; the rows on either side of a
cut meet in a second small pass. A first pass over a few trees links direct neighbours, which melts large groups of
copies into components; a second pass over all trees looks only at neighbours of different components. What still
lies in several components within a region too crowded for the window is compared at once where all but a few rows
are of one component, else in trees of greater depth, more of them, until its regions thin out. Every candidate is
confirmed on the full shingle sets of the two whole texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.llm import kernels
from dateloom.llm.common import BROADCAST_ROWS, frugal, small, tune, written
from dateloom.operators.components import connected_components

#: Min-hashes of a tree, two bytes each.
DEPTH = 8
#: Min-hashes, a byte each, by which nodes of crowded regions are told apart.
SKETCH = 1024
#: Bytes of these that rows of the deeper trees carry.
CARRIED = 512
#: Depths of the trees for crowded regions; rows of a region that are all compared, and rows of other components than the
#: most frequent up to which a larger region is compared at once.
DEEPER, CROWD = (8, 14, 20, 26), 256
#: Pairs of a node from which its text is sent to several tasks.
HUB = 64
#: Nodes of a block in which the pairs of a crowd are confirmed; pairs of a node, on average, beyond which nodes are a crowd.
BLOCK, DENSE = 128, 8
#: Trees of the first pass, in which only direct neighbours are compared.
FIRST_TREES = 4
_HASHED = "doc_id long, n_shingles long, digest binary, signature binary, text_key long"
_PAIRS = "a binary, b binary"
_MAYBE = "a binary, b binary, root_a binary, root_b binary, alike double"


@dataclass(frozen=True)
class Forest:
    """shingle: words; percent: link where 100 * intersection >= percent * union; window: neighbours on each side."""

    shingle: int = 5
    percent: int = 80
    trees: int = 20
    window: int = 8
    seed: int = 7

    @property
    def least_depth(self) -> int:
        """The deepest prefix that a pair at the threshold still shares in some tree, but for 1 in 10,000 pairs."""
        j, depth = self.percent / 100, 1
        while depth < DEPTH and (1 - j ** (depth + 1)) ** self.trees < 1e-4:
            depth += 1
        return depth

    def trees_of(self, depth: int) -> int:
        """Trees of a depth in which all but 1 in 10,000 pairs at the threshold meet once."""
        return int(np.ceil(np.log(1e-4) / np.log1p(-((self.percent / 100) ** depth))))


def _hashed(forest: Forest):
    def run(batches):
        rng = np.random.Generator(np.random.PCG64(forest.seed))
        size = forest.trees * DEPTH
        flip = rng.integers(0, 2**64, size, dtype=np.uint64)
        times = rng.integers(0, 2**64, size, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            raw, off = kernels.string_buffers(batch.column("text"))
            counts, digests, signatures = [], [], []
            for found in kernels.shingle_sets(raw, off, forest.shingle):
                least = np.full(size, 2**64 - 1, np.uint64)
                for i in range(0, len(found), 512):
                    least = np.minimum(least, ((found[i : i + 512, None] ^ flip) * times).min(axis=0))
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append((kernels.mix(least) >> np.uint64(48)).astype(">u2").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), batch.column("text_key")],
                ["doc_id", "n_shingles", "digest", "signature", "text_key"],
            )

    return run


def _near(prefix: np.ndarray, tree: np.ndarray, size: np.ndarray, root: list, node: list, forest: Forest, window: int, new: int):
    """Pairs (i, j), i < j <= i + window, j >= new, of nodes of one tree with a common prefix of least_depth or more."""
    n = len(tree)
    same = (prefix[1:] == prefix[:-1]) & (tree[1:] == tree[:-1])[:, None]
    shared = np.cumprod(same, axis=1).sum(axis=1)  # with the row before
    reach = np.full(n, DEPTH)
    for lag in range(1, min(window, n - 1) + 1):
        # the least of the `lag` steps between i and i + lag
        reach = np.minimum(reach[: n - lag], shared[lag - 1 : n - 1])
        near = reach >= forest.least_depth
        if not near.any():
            break
        lo, hi = np.minimum(size[:-lag], size[lag:]), np.maximum(size[:-lag], size[lag:])
        for i in np.flatnonzero(near & (100 * lo >= forest.percent * hi)):
            if i + lag >= new and root[i] != root[i + lag]:
                yield (node[i], node[i + lag]) if node[i] < node[i + lag] else (node[i + lag], node[i])


def _columns(table: pa.Table):
    prefix = np.frombuffer(b"".join(table.column("prefix").to_pylist()), ">u2").reshape(-1, DEPTH)
    return prefix, table.column("tree").to_numpy(), table.column("n_shingles").to_numpy(), table.column("root").to_pylist(), table.column("node").to_pylist()


def _scan(forest: Forest, window: int):
    """Over sorted rows: pairs of neighbours, and the first and last rows of the partition for the cuts."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if head is None or head.num_rows < window:
                head = rows.slice(0, window) if head is None else pa.concat_tables([head, rows]).slice(0, window)
            known = held.num_rows if held is not None else 0
            rows = pa.concat_tables([held, rows]) if known else rows
            found = set(_near(*_columns(rows), forest, window, known))
            if found:
                a, b = zip(*found)
                yield _out(pa.array(a, pa.binary()), pa.array(b, pa.binary()))
            held = rows.slice(max(0, rows.num_rows - window)).combine_chunks()
        for cut, rows in ((part, head), (part + 1, held)):
            if rows is not None:
                yield _out(None, None, pa.array([cut] * rows.num_rows, pa.int32()), rows)

    return run


_EDGE = [("prefix", pa.binary()), ("tree", pa.int32()), ("n_shingles", pa.int64()), ("root", pa.binary()), ("node", pa.binary())]


def _out(a, b, cut=None, rows=None):
    n = len(a) if a is not None else rows.num_rows
    some = [a if a is not None else pa.nulls(n, pa.binary()), b if b is not None else pa.nulls(n, pa.binary()), cut if cut is not None else pa.nulls(n, pa.int32())]
    edge = [rows.column(name).combine_chunks().cast(kind) if rows is not None else pa.nulls(n, kind) for name, kind in _EDGE]
    return pa.RecordBatch.from_arrays([*some, *edge], ["a", "b", "cut", *(name for name, _ in _EDGE)])


def _at_cut(forest: Forest, window: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("prefix", "ascending"), ("node", "ascending")])
        found = set(_near(*_columns(rows), forest, window, 0))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _near_sets(x: np.ndarray, y: np.ndarray, forest: Forest) -> bool:
    """Whether two sorted sets are as alike as asked."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    if not len(y) or 100 * len(y) < forest.percent * len(x):
        return False
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return common > 0 and 100 * common >= forest.percent * (len(x) + len(y) - common)


class _Joined(dict):
    """What links have joined so far: a name, or its first, leads to the one that stands for all."""

    def top(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x, y) -> None:
        self[self.top(x)] = self.top(y)


def _sets_of(rows: pa.Table, forest: Forest) -> list[np.ndarray]:
    return [found for batch in rows.select(["text"]).combine_chunks().to_batches() for found in kernels.shingle_sets(*kernels.string_buffers(batch.column("text")), forest.shingle)]


def _confirmed(forest: Forest):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left = kernels.shingle_sets(*kernels.string_buffers(batch.column("text_a")), forest.shingle)
            right = kernels.shingle_sets(*kernels.string_buffers(batch.column("text_b")), forest.shingle)
            keep = [_near_sets(x, y, forest) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _neighbours(nodes: DataFrame, trees: int, window: int, forest: Forest) -> DataFrame:
    """Candidate pairs of nodes (node, n_shingles, signature, root)."""
    spark = nodes.sparkSession
    wide = 2 * DEPTH
    rows = nodes.select("node", "n_shingles", "root", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("signature", t * wide + 1, wide).alias("prefix")) for t in range(trees)])).alias("x"))
    rows = rows.select("x.prefix", "x.tree", "n_shingles", "root", "node")
    # rows meet across one cut only, so no partition may be shorter than the window
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, nodes.count() * trees // (8 * window)))
    order = ["tree", "prefix", "node"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "a binary, b binary, cut int, prefix binary, tree int, n_shingles long, root binary, node binary"
    scanned = written(rows.mapInArrow(frugal(_scan(forest, window)), schema), "neighbours")
    cuts = scanned.where("cut is not null").drop("a", "b").groupBy("cut").applyInArrow(_at_cut(forest, window), _PAIRS)
    return scanned.where("cut is null").select("a", "b").unionByName(cuts).distinct()


def _sketched(forest: Forest):
    """(node, sketch): SKETCH further min-hashes of a byte each."""

    def run(batches):
        rng = np.random.Generator(np.random.PCG64(forest.seed + 1))
        flip = rng.integers(0, 2**64, SKETCH, dtype=np.uint64)
        times = rng.integers(0, 2**64, SKETCH, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            sketches = []
            for found in kernels.shingle_sets(*kernels.string_buffers(batch.column("text")), forest.shingle):
                least = np.full(SKETCH, 2**64 - 1, np.uint64)
                for i in range(0, len(found), 128):
                    least = np.minimum(least, ((found[i : i + 128, None] ^ flip) * times).min(axis=0))
                sketches.append((kernels.mix(least) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sketches, pa.binary())], ["node", "sketch"])

    return run


def _bound(forest: Forest, hashes: int) -> float:
    """The least share of equal bytes of so many min-hashes: four standard errors below the threshold. Equal bytes of
    different min-hashes only raise a share."""
    j = forest.percent / 100
    return j - 4 * (j * (1 - j) / hashes) ** 0.5


def _crossing(forest: Forest):
    """Links of a region's block that join the components of (outsider, member) pairs: those that the sketches call alike are
    confirmed on full sets where nothing has joined their components yet, so there are fewer links than rows."""
    bound = _bound(forest, SKETCH)

    def run(key, outside: pa.Table, inside: pa.Table) -> pa.Table:
        found, joined = [], _Joined()
        if outside.num_rows and inside.num_rows:
            matrix = lambda t: np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            many, size = matrix(inside), inside.column("n_shingles").to_numpy()
            node, root = inside.column("node").to_pylist(), np.array(inside.column("root").to_pylist(), object)
            majority = inside.column("majority")[0].as_py()
            sets = _sets_of(inside, forest)
            rows = zip(matrix(outside), outside.column("n_shingles").to_pylist(), outside.column("node").to_pylist(), outside.column("root").to_pylist(), _sets_of(outside, forest))
            for sketch, n, name, own, mine in rows:
                maybe = np.flatnonzero((100 * np.minimum(size, n) >= forest.percent * np.maximum(size, n)) & (root != own))
                alike = (many[maybe] == sketch).mean(axis=1)
                maybe, alike = maybe[alike >= bound], alike[alike >= bound]
                for i in maybe[np.argsort(-alike, kind="stable")]:
                    if (root[i] == majority or name < node[i]) and joined.top(own) != joined.top(root[i]) and _near_sets(mine, sets[i], forest):
                        joined.join(own, root[i])
                        found.append((name, node[i]) if name < node[i] else (node[i], name))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _maybe(a: bytes, b: bytes, root_a: bytes, root_b: bytes, alike: float) -> tuple:
    """A candidate with its nodes, and its components, in order."""
    return (*((a, b) if a < b else (b, a)), *((root_a, root_b) if root_a < root_b else (root_b, root_a)), float(alike))


def _columns_of(found) -> dict[str, pa.Array]:
    columns = list(zip(*found)) or [()] * 5
    return {name: pa.array(c, kind) for name, c, kind in zip(("a", "b", "root_a", "root_b", "alike"), columns, (pa.binary(),) * 4 + (pa.float64(),))}


def _keyed(forest: Forest, depth: int, carried: bool):
    """(key, node, root) of each node in each tree of a depth, drawn from its sketch; with n_shingles and part of the sketch if carried."""

    def run(batches):
        rng = np.random.Generator(np.random.PCG64(forest.seed + depth))
        picks = np.stack([rng.choice(SKETCH, depth, replace=False) for _ in range(forest.trees_of(depth))])
        salts = kernels.mix(np.arange(len(picks), dtype=np.uint64) + np.uint64(1))
        at_once = max(1, 20_000 // len(picks))
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                rows = batch.slice(i, at_once)
                sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
                keys = np.repeat(salts[None], len(sketch), axis=0)
                with np.errstate(over="ignore"):
                    for level in range(depth):
                        keys = kernels.mix(keys + sketch[:, picks[:, level]].astype(np.uint64) + np.uint64(1))
                each = pa.array(np.repeat(np.arange(len(sketch)), len(picks)))
                columns = {"key": pa.array(keys.ravel().view(np.int64)), "node": rows.column("node").take(each), "root": rows.column("root").take(each)}
                if carried:
                    part = pa.array([bytes(x) for x in sketch[:, :CARRIED]], pa.binary())
                    columns |= {"n_shingles": rows.column("n_shingles").take(each), "part": part.take(each)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


_KEYED, _CARRIED = "key long, node binary, root binary", "key long, node binary, root binary, n_shingles long, part binary"


def _grouped(forest: Forest):
    """Over rows sorted by key, CROWD of a key at most: pairs of a key, of different components, that look alike."""
    bound = _bound(forest, CARRIED)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            known = held.num_rows if held is not None else 0
            rows = pa.concat_tables([held, rows]).combine_chunks() if known else rows
            key, size = rows.column("key").to_numpy(), rows.column("n_shingles").to_numpy()
            node, root = (np.array(rows.column(c).to_pylist(), object) for c in ("node", "root"))
            part = np.frombuffer(b"".join(rows.column("part").to_pylist()), np.uint8).reshape(len(key), -1)
            found = set()
            for lag in range(1, min(CROWD, len(key))):
                at = np.flatnonzero(key[lag:] == key[:-lag])
                if not len(at):
                    break
                at = at[(at + lag >= known) & (root[at] != root[at + lag])]
                at = at[100 * np.minimum(size[at], size[at + lag]) >= forest.percent * np.maximum(size[at], size[at + lag])]
                alike = (part[at] == part[at + lag]).mean(axis=1) if len(at) else np.zeros(0)
                at, alike = at[alike >= bound], alike[alike >= bound]
                found |= {_maybe(*row) for row in zip(node[at], node[at + lag], root[at], root[at + lag], alike)}
            if found:
                yield pa.RecordBatch.from_pydict(_columns_of(found))
            held = rows.slice(int(np.flatnonzero(key == key[-1])[0])).combine_chunks()

    return run


def _in_blocks(rows: DataFrame, sketches: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """Links between components within regions (key, node, majority, n, outsiders): members times rows of other components
    than the most frequent, in blocks of CROWD."""
    count = lambda c: F.ceil(F.col(c) / CROWD).cast("int")
    rows = rows.withColumns({"members": count("n"), "others": count("outsiders")}).join(sketches.join(texts, "node"), "node")
    split = lambda many: F.pmod(F.xxhash64("node"), many).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), many - 1))
    inside = rows.withColumn("i", split(F.col("members"))).withColumn("k", every(F.col("others")))
    outside = rows.where("root <> majority").withColumn("k", split(F.col("others"))).withColumn("i", every(F.col("members")))
    columns = ["key", "i", "k", "node", "n_shingles", "sketch", "text", "root", "majority"]
    inside = inside.select(*[F.col(c).alias(c) for c in columns])
    return outside.select(columns).groupBy("key", "i", "k").cogroup(inside.groupBy("key", "i", "k")).applyInArrow(_crossing(forest), _PAIRS)


def _crowded(nodes: DataFrame, documents: DataFrame, forest: Forest) -> DataFrame:
    """Links between components within regions of more rows than the window reaches.

    A region whose rows but CROWD are of one component is compared at once, at a cost in proportion to its rows. The nodes of
    others go to deeper trees, whose regions of up to CROWD rows are compared; larger ones are judged in the same way
    again. Only what is as crowded in trees of the greatest depth is compared pair by pair, in blocks.
    """
    wide = 2 * DEPTH
    trees = F.explode(F.array(*[F.xxhash64(F.lit(t), F.substring("signature", t * wide + 1, 2 * forest.least_depth)) for t in range(forest.trees)])).alias("key")
    rows = nodes.select("node", "root", trees)
    several = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high and n > 1").select("key", "n")
    groups = written(several(rows).where(F.col("n") > forest.window + 1), "crowded")
    rows = written(rows.join(small(groups), "key"), "crowd")
    if rows.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    texts = written(_texts(rows.select("node").distinct(), nodes, documents), "texts")
    sketches = texts.mapInArrow(frugal(_sketched(forest)), "node binary, sketch binary").join(nodes.select("node", "n_shingles", "root"), "node")
    sketches = written(sketches, "sketches")
    found, crossing = [], []
    for depth in (0, *DEEPER):
        if depth:
            groups = written(several(sketches.mapInArrow(frugal(_keyed(forest, depth, False)), _KEYED)), "groups")
            thin = sketches.mapInArrow(frugal(_keyed(forest, depth, True)), _CARRIED).join(small(groups.where(F.col("n") <= CROWD).select("key")), "key")
            found.append(written(thin.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(_grouped(forest)), _MAYBE), "thin"))
            rows = sketches.mapInArrow(frugal(_keyed(forest, depth, False)), _KEYED).join(small(groups.where(F.col("n") > CROWD)), "key")
            rows = written(rows, "crowd")
        shares = rows.groupBy("key", "root").agg(F.count("*").alias("share"))
        majority = written(shares.groupBy("key").agg(F.max_by("root", F.struct("share", "root")).alias("majority"), (F.sum("share") - F.max("share")).alias("outsiders")), "majority")
        rows = rows.drop("root").join(small(majority), "key")
        now = rows if depth == DEEPER[-1] else rows.where(F.col("outsiders") <= CROWD)
        crossing.append(written(_in_blocks(now, sketches, texts, forest), "crossing"))
        left = written(rows.where(F.col("outsiders") > CROWD).select("node").distinct(), "left")
        if depth == DEEPER[-1] or left.isEmpty():
            break
        sketches = written(sketches.join(small(left), "node"), "sketches")
    links = reduce(DataFrame.unionByName, crossing).distinct()
    if not found:
        return links
    maybe = reduce(DataFrame.unionByName, found).groupBy("a", "b", "root_a", "root_b").agg(F.max("alike").alias("alike"))
    return links.unionByName(_between(maybe, nodes, documents, forest))


def _between(maybe: DataFrame, nodes: DataFrame, documents: DataFrame, forest: Forest) -> DataFrame:
    """Enough of the links among candidates (a, b, root_a, root_b, alike) to join all components that any of them joins.

    The most alike candidate of two components is confirmed first; the others only where the two are still apart then.
    """
    maybe = written(maybe, "maybe")
    by = maybe.groupBy("root_a", "root_b").agg(F.max_by(F.struct("a", "b"), F.struct("alike", "a", "b")).alias("best"), F.count("*").alias("n"))
    by = written(by, "best")
    first = _links(by.select("best.*"), nodes, documents, forest)
    several = by.where("n > 1").select("root_a", "root_b", "best")
    if several.isEmpty():
        return first
    linked = by.join(first, (F.col("best.a") == F.col("a")) & (F.col("best.b") == F.col("b")), "left_semi").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    top = connected_components(linked)
    named = lambda end: top.select(F.col("node").alias(f"root_{end}"), F.col("root").alias(f"top_{end}"))
    apart = several.join(named("a"), "root_a", "left").join(named("b"), "root_b", "left").where(F.coalesce("top_a", "root_a") != F.coalesce("top_b", "root_b"))
    apart = written(apart.select("root_a", "root_b"), "apart")
    rest = maybe.join(small(apart), ["root_a", "root_b"], "left_semi").select("a", "b").join(by.select("best.*"), ["a", "b"], "left_anti")
    return first.unionByName(_links(rest, nodes, documents, forest))


def _texts(wanted: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, text): the text of each wanted node, read again from the documents."""
    wanted = written(wanted.join(nodes.select("node", "rep_id", "text_key"), "node"), "wanted")
    texts = documents.join(small(wanted), documents.doc_id.eqNullSafe(wanted.rep_id) & (documents.text_key == wanted.text_key)).select("node", "text")
    # copies of a row (same id, same text) meet here; one stays
    return texts.dropDuplicates(["node"])


def _with_text(pairs: DataFrame, texts: DataFrame, end: str, bare: DataFrame | None = None) -> DataFrame:
    """pairs with the text of one end. A node of many pairs is dealt by the other end, HUB pairs to a key; its text is sent to each.

    Bare pairs are gathered by key first, so that a text meets a key once and not each of its pairs. bare: the same pairs
    before a text was joined, which are counted without that join.
    """
    other = "b" if end == "a" else "a"
    hubs = written((pairs if bare is None else bare).groupBy(end).agg(F.ceil(F.count("*") / HUB).cast("int").alias("_deals")).where("_deals > 1"), "hubs")
    dealt = pairs.join(small(hubs), end, "left").withColumn("_deal", F.pmod(F.xxhash64(other), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    sent = texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")).join(small(hubs), end, "left")
    sent = sent.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    if set(pairs.columns) != {"a", "b"}:
        return dealt.join(sent, [end, "_deal"]).drop("_deal")
    gathered = dealt.groupBy(end, "_deal").agg(F.collect_list(other).alias("_others"))
    return gathered.join(sent, [end, "_deal"]).select(end, F.explode("_others").alias(other), f"text_{end}")


def _gathered(forest: Forest):
    """Links of a block that join its nodes: rows of one end with their others, and the texts of all of these."""

    def run(key, ends: pa.Table, others: pa.Table) -> pa.Table:
        found, joined = [], _Joined()
        known = dict(zip(others.column("a").to_pylist(), _sets_of(others, forest)))
        for b, near, mine in zip(ends.column("b").to_pylist(), ends.column("others").to_pylist(), _sets_of(ends, forest)):
            for a in near:
                if joined.top(a) != joined.top(b) and _near_sets(known[a], mine, forest):
                    joined.join(a, b)
                    found.append((a, b))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _links(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, forest: Forest) -> DataFrame:
    """Of the pairs whose full sets are as alike as asked enough to join all that they join; texts are read again from the documents.

    Pairs are held as a node with its others. Nodes whose pairs lead to the same smallest node are a crowd; where it has many
    pairs, it is cut into blocks of BLOCK nodes, and a text goes to a block once, not to each of its pairs.
    """
    near = written(pairs.groupBy("b").agg(F.collect_set("a").alias("others")).withColumn("key", F.array_min("others")), "pairs")
    texts = written(_texts(near.select(F.col("b").alias("node")).union(near.select(F.explode(F.array_distinct("others")).alias("node"))).distinct(), nodes, documents), "texts")
    if near.where(F.size("others") > DENSE).limit(BLOCK).count() < BLOCK:
        return _pair_links(near.select(F.explode("others").alias("a"), "b"), texts, forest)
    for _ in range(3):
        step = small(near.select(F.col("b").alias("key"), F.col("key").alias("onward")))
        near = written(near.join(step, "key", "left").withColumn("key", F.coalesce("onward", "key")).drop("onward"), "keys")
    crowds = near.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("others")).alias("pairs")).where((F.col("n") >= BLOCK // 2) & (F.col("pairs") > DENSE * F.col("n")))
    crowds = written(crowds.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowds")
    few = near.join(small(crowds), "key", "left_anti").select(F.explode("others").alias("a"), "b")
    ends = near.join(small(crowds), "key").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).select("key", "block", "b", "others")
    others = ends.groupBy("key", "block").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")).select("key", "block", F.explode("others").alias("a"))
    others = others.join(texts.withColumnRenamed("node", "a"), "a")
    others = others.select(*[F.col(c).alias(c) for c in ("key", "block", "a", "text")])
    ends = ends.join(texts.withColumnRenamed("node", "b"), "b").select("key", "block", "b", "others", "text")
    many = ends.groupBy("key", "block").cogroup(others.groupBy("key", "block")).applyInArrow(_gathered(forest), _PAIRS)
    return written(many, "links").unionByName(_pair_links(few, texts, forest))


def _pair_links(pairs: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose full sets are as alike as asked."""
    both = _with_text(_with_text(pairs, texts, "a"), texts, "b", pairs)
    return written(both.mapInArrow(frugal(_confirmed(forest)), _PAIRS), "links")


def _named(rows: DataFrame, names: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the component_id of names (digest, component_id, rows). Beyond `few` names the join shuffles, but for the
    digests of over a 10,000th of all rows, at most 10,000, which are broadcast: no copy of a text fills a task."""
    if names.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(names.drop("rows")), "digest", "left")
    hot = F.col("rows") > rows.count() / 10_000
    often = names.where(hot).select("digest", F.col("component_id").alias("_often"), F.lit(True).alias("_hot"))
    out = rows.join(F.broadcast(often), "digest", "left")
    rest = names.where(~hot).select(F.col("digest").alias("_digest"), "component_id")
    # rows that have their name meet nothing more; keys of their own spread them
    key = F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot"), F.xxhash64("doc_id", "text_key").cast("string")).cast("binary"))
    out = out.withColumn("_key", key).join(rest, F.col("_key") == F.col("_digest"), "left")
    return out.withColumn("component_id", F.coalesce("_often", "component_id")).drop("_often", "_hot", "_key", "_digest")


def near_duplicates(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) of every row of documents (doc_id, text; other columns are ignored).

    Texts are lower-cased in A-Z and split into words [^\\x20\\x09-\\x0D]+; a set holds the distinct shingles of the
    whole text, or the whole sequence as one if it has fewer words. component_id is the smallest doc_id of the
    component. A null or blank text has an empty set, is linked with nothing and kept. Rows that repeat a doc_id are
    judged by their own texts. A null doc_id is a row of its own kind: it joins components by its text but never
    names one that has a doc_id, and is kept only if none is there. An empty table gives no rows.
    """
    tune(documents.sparkSession, 512)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    hashed = written(documents.mapInArrow(frugal(_hashed(forest)), _HASHED), "hashed")
    sets = hashed.where("n_shingles > 0")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("rows"))
    # one row of each class carries its signature: that of the smallest id, and of these the smallest text
    firsts = sets.join(classes, (sets.digest == classes.digest) & sets.doc_id.eqNullSafe(classes.rep_id)).drop(classes.digest)
    nodes = firsts.select(F.col("digest").alias("node"), "rep_id", "n_shingles", "signature", "text_key")
    nodes = written(nodes.dropDuplicates(["node"]), "nodes")

    first = _neighbours(nodes.withColumn("root", F.col("node")), min(FIRST_TREES, forest.trees), 1, forest)
    links = _links(first, nodes, documents, forest)
    roots = connected_components(links)
    labelled = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    second = _neighbours(labelled, forest.trees, forest.window, forest)
    more = _links(second, nodes, documents, forest)
    merged = lambda roots, links: connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    roots = merged(roots, more)
    labelled = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    roots = merged(roots, _crowded(labelled, documents, forest))

    linked = nodes.select("node", "rep_id").join(roots, "node")
    named = linked.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    linked = linked.join(named, "root").select("node", "component_id")
    # classes of one row that are linked with nothing need no join: they name themselves
    several = classes.where("rows > 1").select(F.col("digest").alias("node"), "rep_id", "rows").join(linked, "node", "full")
    several = several.select(F.col("node").alias("digest"), F.coalesce("component_id", "rep_id").alias("component_id"), F.coalesce("rows", F.lit(1)).alias("rows"))
    out = _named(hashed.select("doc_id", "n_shingles", "digest", "text_key"), written(several, "several"))
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def without_near_duplicates(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row of documents (doc_id, text, ...) of each component, as it is: that with the smallest doc_id.

    Of rows that repeat doc_id and text one stays; so it does of rows without doc_id that are copies of each other. Null
    and blank texts are near nothing and stay; other columns, of whatever names, are passed on; an empty table has no rows.
    """
    judged = written(near_duplicates(documents, forest), "judged")
    gone = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    out = rows.join(small(gone), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_anti")
    if not judged.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["id", "key"])
    return out.select("row.*")
