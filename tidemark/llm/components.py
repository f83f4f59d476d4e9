"""Connected components of a link table, without ever holding all links in one place.

Each partition first contracts its own links to stars (union-find over one partition's rows). If few are left, one task
contracts them once more and the search is over. Otherwise large-star and
small-star rounds alternate (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): every round is two
aggregations by node and two joins, checkpointed to the shared folder. A hub's rows are reduced to a minimum before
they are shuffled, and the joins have one row per node on one side, so a hub that a third of all nodes hang from is
split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LocalSets, cut

#: As few links are contracted in one task, which ends the search; more go through the rounds, with the same result.
ONE_TASK = 50_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = LocalSets()
    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sets.union(x, y)
    nodes = [x for x in sets.up if sets.find(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.find(x) for x in part], pa.int64())], names=["u", "v"])


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link between two longs; component is the least node reachable.

    Self links, repeated links and links with a null end are allowed and change nothing; no links give no rows.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = cut(pairs.mapInArrow(_contract, "u long, v long"))
    before = None
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before = (n, total)
        if n <= ONE_TASK:
            edges = cut(edges.coalesce(1).mapInArrow(_contract, "u long, v long"))
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a node's other smaller neighbours hang from its least one, and so does the node itself
        edges = cut(small.where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
