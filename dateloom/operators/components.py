"""Connected components of an edge table, few edges by one task, more by repeated contraction; no edge or label reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from dateloom.tables import BROADCAST_ROWS, small, written


def _labelled(batches):
    """(node, root) of all edges of the batches together; a round lets every root follow its smallest neighbour."""
    ends = [batch.select(["a", "b"]) for batch in batches if batch.num_rows]
    if not ends:
        return
    named = pa.concat_arrays([batch.column(end) for end in ("a", "b") for batch in ends]).dictionary_encode()
    a, b = named.indices.to_numpy().reshape(2, -1)
    top = np.arange(len(named.dictionary))
    while (top[a] != top[b]).any():
        np.minimum.at(top, np.maximum(top[a], top[b]), np.minimum(top[a], top[b]))
        while (top != top[top]).any():
            top = top[top]
    yield pa.RecordBatch.from_arrays([named.dictionary, named.dictionary.take(pa.array(top))], ["node", "root"])


def connected_components(edges: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); root is one node of the component.

    Up to `few` distinct edges, whose nodes are numbers, strings or bytes, meet in one task, which reads them from their
    table: rounds would write several tables each, of a file for each partition. Beyond that each round every node follows its smallest neighbour (a map-side combined minimum, so a hub costs no more
    than its distinct neighbours), the edges are renamed and self loops and repeats vanish. Half of the nodes
    at least go per round, so the rounds grow with the logarithm of the nodes. Edges with a null end and self
    loops are ignored; repeated edges count once; an empty table gives an empty result.
    """
    pairs = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(pairs(edges), "edges")
    kind = edges.schema["a"].dataType
    if isinstance(kind, IntegerType | LongType | StringType | BinaryType) and edges.limit(few + 1).count() <= few:
        named = StructType([StructField("node", kind), StructField("root", kind)])
        return written(edges.coalesce(1).mapInArrow(_labelled, named), "labels")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "step")
        # a node's smallest neighbour may itself move on: two hops save rounds
        hop = small(step)
        onward = written(step.join(hop.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "onward")
        hop = small(onward)
        if labels is None:
            labels = onward.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(hop.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = written(labels, "labels")
        moved = edges.join(hop.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(hop.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        edges = written(pairs(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
