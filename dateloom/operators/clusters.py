"""Events as clusters: vectors near each other in cosine and time, joined into components of two or more.

Density clustering with two members a core needs no more than components: any point with a neighbour is a core. The time
window is a join condition on buckets of its length, so only pairs that may be near are formed; within buckets that
stay too large, vectors are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.operators.components import connected_components
from dateloom.tables import numbered

#: Vectors in a block of the comparison.
BLOCK = 2048


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, within [0, 2]; 1 if either has no length, as an empty direction."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    distance = 1 - F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance))


def days_apart(a: Column, b: Column) -> Column:
    """Absolute distance of two times in days, with fraction."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86_400_000_000.0


def banded_pairs(rows: DataFrame, days: float = 7.0, by: list[str] | None = None) -> DataFrame:
    """(id_a, id_b, days) of all pairs id_a < id_b of rows (id, at) at most `days` apart, and equal in `by`; null times pair with none.

    Each row goes to its bucket of that length and is met from the next, so a pair meets once.
    """
    width, by = int(days * 86_400_000_000), by or []
    rows = rows.where("at is not null and id is not null").withColumn("_b", F.floor(F.unix_micros(F.col("at").cast("timestamp")) / width))
    left = rows.select(F.col("id").alias("l"), F.col("at").alias("lt"), "_b", *by)
    right = rows.select(F.col("id").alias("r"), F.col("at").alias("rt"), *by, F.explode(F.array(F.struct("_b", F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("_b"), F.lit(False).alias("own")))).alias("x"))
    right = right.select("r", "rt", *by, "x._b", "x.own")
    pairs = left.join(right, ["_b", *by]).where((~F.col("own") | (F.col("l") < F.col("r"))) & (days_apart(F.col("lt"), F.col("rt")) <= days))
    return pairs.select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"), F.round(days_apart(F.col("lt"), F.col("rt")), 6).alias("days"))


def near_pairs(rows: DataFrame, eps: float = 0.40, days: float | None = 7.0) -> DataFrame:
    """(id_a, id_b, distance) of pairs of rows (id, vector, at) with cosine distance at most eps, within `days` of each other.

    Buckets of the time window are cut into blocks of BLOCK vectors by hash of the id; each pair of blocks is one group of
    bounded size whose product of matrices finds the near pairs, so no pair that is far is ever a row. Without `days`
    there is one bucket. Rows without vector, or without time where a window is asked, pair with none.
    """
    from pyspark.sql.types import StructType

    width = int(days * 86_400_000_000) if days else 1
    bucket = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / width) if days else F.lit(0).cast("long")
    micros = F.unix_micros(F.col("at").cast("timestamp")) if days else F.lit(0).cast("long")
    rows = rows.where("vector is not null and id is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), micros.alias("at"), bucket.alias("b")).where("b is not null")
    sizes = rows.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "b").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    nexts = sizes.select((F.col("b") - 1).alias("b"), F.col("blocks").alias("next"))
    # as left sides: against the blocks k.. of the own bucket and all of the next
    own = rows.withColumn("j", F.explode(F.sequence("k", F.col("blocks") - 1))).select("b", F.lit(0).alias("step"), "k", "j", "id", "vector", "at")
    left = own
    if days:
        ahead = rows.join(nexts, "b").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("next") - 1))).select("b", F.lit(1).alias("step"), "k", "j", "id", "vector", "at")
        left = own.unionByName(ahead)
    right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).select("b", F.lit(0).alias("step"), F.col("i").alias("k"), F.col("k").alias("j"), "id", "vector", "at")
    if days:
        before = sizes.select((F.col("b") + 1).alias("b"), F.col("blocks").alias("previous"))
        back = rows.join(before, "b").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("previous") - 1)))
        right = right.unionByName(back.select((F.col("b") - 1).alias("b"), F.lit(1).alias("step"), F.col("i").alias("k"), F.col("k").alias("j"), "id", "vector", "at"))
    keys = ["b", "step", "k", "j"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    schema = StructType.fromDDL("id_a long, id_b long, distance double")
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_near(eps, width if days else None), schema)


def _near(eps: float, width: int | None):
    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        a: list[int] = []
        b: list[int] = []
        d: list[float] = []
        if left.num_rows and right.num_rows:
            unit = lambda t: _units(np.array(t.column("vector").to_pylist(), float))
            x, y = unit(left), unit(right)
            i, j = left.column("id").to_numpy(), right.column("id").to_numpy()
            s, t = left.column("at").to_numpy(), right.column("at").to_numpy()
            same = key[1].as_py() == 0 and key[2].as_py() == key[3].as_py()
            for start in range(0, len(x), 256):
                distance = np.clip(1 - x[start : start + 256] @ y.T, 0, 2)
                near = distance <= eps
                if width is not None:
                    near &= np.abs(s[start : start + 256, None] - t[None, :]) <= width
                near &= (i[start : start + 256, None] < j[None, :]) if same else (i[start : start + 256, None] != j[None, :])
                p, q = np.nonzero(near)
                first, second = i[start + p], j[q]
                a += np.minimum(first, second).tolist()
                b += np.maximum(first, second).tolist()
                d += distance[p, q].tolist()
        return pa.table({"id_a": pa.array(a, pa.int64()), "id_b": pa.array(b, pa.int64()), "distance": pa.array(d, pa.float64())})

    return run


def clusters(rows: DataFrame, eps: float = 0.40, days: float | None = 7.0) -> DataFrame:
    """(id, system_is_noise, cluster_id) of each row (id, vector, at): clusters are numbered by their smallest id, noise has none."""
    pairs = near_pairs(rows, eps, days)
    labels = connected_components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    members = labels.join(numbered(least, "least", "cluster_id"), "root").select(F.col("node").alias("id"), "cluster_id")
    out = rows.select(F.col("id").cast("long").alias("id")).join(members, "id", "left")
    return out.select("id", F.col("cluster_id").isNull().alias("system_is_noise"), "cluster_id")


def distance_stats(rows: DataFrame) -> DataFrame:
    """One row: pairs, least, mean and greatest cosine distance over all pairs of rows (id, vector), before any window.

    Every two blocks of vectors are one group that returns four numbers; the work is the square of the rows by nature.
    """
    rows = rows.where("vector is not null and id is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks"))
    rows = rows.crossJoin(F.broadcast(blocks)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = rows.select(F.col("own").alias("k"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), "id", "vector")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("k"), F.col("own").alias("j"), F.col("id").alias("id"), F.col("vector").alias("vector"))
    found = left.groupBy("k", "j").cogroup(right.groupBy("k", "j")).applyInArrow(_block_stats, "pairs long, least double, total double, greatest double")
    out = found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.min("least").alias("least"), F.sum("total").alias("total"), F.max("greatest").alias("greatest"))
    return out.select("pairs", "least", F.try_divide("total", F.col("pairs")).alias("mean"), "greatest")


def _block_stats(key, left, right):
    import numpy as np
    import pyarrow as pa

    pairs, least, total, greatest = 0, None, 0.0, None
    if left.num_rows and right.num_rows:
        x, y = (_units(np.array(t.column("vector").to_pylist(), float)) for t in (left, right))
        i, j = left.column("id").to_numpy(), right.column("id").to_numpy()
        for start in range(0, len(x), 256):
            distance = np.clip(1 - x[start : start + 256] @ y.T, 0, 2)
            if key[0].as_py() == key[1].as_py():
                distance = distance[i[start : start + 256, None] < j[None, :]]
            if distance.size:
                pairs, total = pairs + distance.size, total + float(distance.sum())
                least = float(distance.min()) if least is None else min(least, float(distance.min()))
                greatest = float(distance.max()) if greatest is None else max(greatest, float(distance.max()))
    return pa.table({"pairs": pa.array([pairs], pa.int64()), "least": pa.array([least], pa.float64()), "total": pa.array([total], pa.float64()), "greatest": pa.array([greatest], pa.float64())})


def _units(m):
    import numpy as np

    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def probe(rows: DataFrame, word: str, days: float = 7.0) -> DataFrame:
    """(id, title, distance, similarity, outside) of every row to the first (by id) whose title holds the word; outside: beyond
    the window, where 2 is added to the distance."""
    target = rows.where(F.col("title").contains(word)).orderBy("id").limit(1).select(F.col("id").alias("_id"), F.col("vector").alias("_v"), F.col("at").alias("_at"))
    others = rows.crossJoin(F.broadcast(target)).where("id <> _id")
    outside = F.coalesce(days_apart(F.col("at"), F.col("_at")) > days, F.lit(True))
    distance = cosine_distance(F.col("vector"), F.col("_v")) + F.when(outside, 2.0).otherwise(0.0)
    return others.select("id", "title", distance.alias("distance"), (1 - distance).alias("similarity"), outside.alias("outside"))


def batches_of(rows: DataFrame, column: str, embed) -> DataFrame:
    """rows with `vector`, from a model that maps a list of texts to a list of vectors; the model is made once a worker."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, vector array<double>"

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        model = embed()
        for batch in batches:
            if batch.num_rows:
                found = np.asarray(model([t or "" for t in batch.column(column).to_pylist()]), float)
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                yield batch.append_column("vector", pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel())))

    return rows.mapInArrow(run, schema)
