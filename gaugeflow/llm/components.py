"""Connected components of an edge table.

Tasks first unite the edges of their partitions.  Up to ``LOCAL_EDGES`` that are
left are united by one task.  Beyond, large and small stars alternate:
a round hangs every neighbour above a node, then every neighbour below it, on the
least node known there.  Minima are pre-aggregated before the shuffle and joined
back, where Spark splits a node with very many edges; each round is written to
the shared folder.  Edges never reach the driver, only their count and checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import discard, materialize

#: Edges that one task unites, some ten MB; they have at most ``HELD`` nodes.
LOCAL_EDGES = 250_000


#: Nodes that a task holds before it passes its stars on.
HELD = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) that connect what the edges of a task connect, by union-find."""
    root: dict = {}
    kind = None

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        nodes = list(root)
        columns = [pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield stars()
            root.clear()
    if root:
        yield stars()


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """A table (node, component) for the nodes of ``edges`` (a, b); the component is its least node.

    Loops, repeated edges and edges with a null end are ignored; no edges give
    no rows.  Both columns must have one type that can be ordered.  With
    ``local_edges`` 0 only DataFrame functions are used.
    """
    ends = edges.select(edges.columns[0], edges.columns[1]).toDF("a", "b").where("a <> b")
    kind = ends.schema["a"].dataType.simpleString()
    if local_edges:
        ends = ends.mapInArrow(_united, f"a {kind}, b {kind}").where("a <> b")
    current = materialize(
        ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(current)
    if state[0] <= local_edges:
        # one task holds all of them, so its stars are the components
        united = current.coalesce(1).mapInArrow(_united, f"a {kind}, b {kind}")
        return materialize(united.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    while state[0]:
        following = materialize(_small_star(_large_star(current)), "edges")
        discard(current)
        current, before, state = following, state, _state(following)
        if state == before:
            break
    roots = current.select("b", "b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
