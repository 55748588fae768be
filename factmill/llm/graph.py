"""Connected components of an edge table, by repeated local union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.common import bound_batches, cut, id_filter, slot

#: Ids that a task's union-find holds before it gives out what it has found and starts anew.
MOST_IDS = 1_000_000
#: So few edges are joined by one task, without rounds.
FEW_EDGES = 200_000


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))

    def out(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in self.up if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def _routed(pairs: DataFrame) -> DataFrame:
    """node, part and other: every edge at both its ends, u > v. An id that is the smaller end of many edges (a star's
    centre) has a part for each shuffle partition: its leaves are dealt to the parts, and its own edges to smaller ids, of
    which a round leaves one, go to all of them. Which ids these are stands in a filter of fixed size; an id that it lets
    pass wrongly is only dealt to more tasks than it needs."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = pairs.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > max(100, parts))
    if hot.isEmpty():
        ends = [F.struct(F.col(a).alias("node"), F.lit(0).alias("part"), F.col(b).alias("other")) for a, b in ("uv", "vu")]
        return pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*")
    bits = spark.sparkContext.broadcast(id_filter(hot, "v"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            u, v, su, sv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "su", "sv"))
            many_u, many_v = ((own[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool) for s in (su, sv))
            copies = np.where(many_u, parts, 1)
            at = np.repeat(np.arange(len(u)), copies)
            part = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            node, other = np.concatenate([u[at], v]), np.concatenate([v[at], u])
            part = np.concatenate([part, np.where(many_v, su % parts, 0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(part), pa.array(other)], ["node", "part", "other"])

    bound_batches(spark)
    return pairs.withColumns({"su": slot("u"), "sv": slot("v")}).mapInArrow(route, "node long, part int, other long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and comp, the smallest id of its component, for every id of the edges (edges of an id to itself count for nothing).

    At most FEW_EDGES edges are joined by one task. Of more, in each round every edge goes to the tasks of both its ends, sorted by that end; a task joins all it gets by union-find
    and gives each id an edge to its smallest known id. All edges of an id from larger to smaller ids meet in every part of
    it, so a round that changes nothing leaves only edges to the smallest id of a component. Rounds grow as the logarithm
    of the longest path; a task holds at most MOST_IDS ids, as it gives out its edges and goes on with the current id's
    smallest one. What comes to the driver in a round is a count, a sum and a filter of fixed size. An empty edge table
    gives an empty result.
    """
    pairs = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).filter("u <> v")
    pairs = cut(pairs.distinct())

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            for node, other in zip(batch.column("node").to_pylist(), batch.column("other").to_pylist(), strict=True):
                if len(forest.up) >= MOST_IDS:
                    low = forest.root(node)
                    yield forest.out()
                    forest = _Forest()
                    if low != node:
                        forest.join(node, low)
                forest.join(node, other)
        yield forest.out()

    def unite_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                forest.join(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(list(forest.up), pa.int64()), pa.array([forest.root(x) for x in list(forest.up)], pa.int64())], ["id", "comp"])

    if pairs.count() <= FEW_EDGES:
        return cut(pairs.repartition(1).mapInArrow(unite_all, "id long, comp long"))
    mark = None
    while True:
        both = _routed(pairs).repartition("node", "part").sortWithinPartitions("node", "part", "other")
        pairs = cut(both.select("node", "other").mapInArrow(unite, "u long, v long").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            ids = pairs.select(F.col("u").alias("id"), F.col("v").alias("comp"))
            return ids.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        mark = now
