"""Embedding near-dedup (operator 3): spherical k-means cells, blocked cosine products within cells.

Equal vectors of one label are one node with a weight from the start. Every node has a home cell (the nearest of the
centroids) and visits each lower-numbered cell that a partner could live in: two unit vectors with cosine >= t are at an
angle of arccos t at most, so a partner beyond the plane that halves the angle of centroids a and b is possible only if
y . (a - b) <= sqrt(1 - t * t) |a - b|. So no link across cells is lost, whatever the centroids; they only decide how much work
is saved. Their number is chosen on a bounded sample: more cells mean fewer products but more visits, and the least
estimated work wins; it grows with the rows of a label, as far as centroids fit into vectors.CENTRE_BYTES. A cell's home
rows are cut into blocks; each block meets the rows of the later blocks and the visitors as a stream, in products of
bounded size. Blocks send out link counts and a spanning forest, never pairs. Vectors travel in their own type (float or
double) and are compared as doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, shared, slices
from tidemark.llm.components import connected_components
from tidemark.llm.vectors import CENTRE_BYTES, kept_type, matrix, sample, spherical_kmeans, unit, usable

THRESHOLD = 0.93
BLOCK = 4096  # home rows that a task holds at once
SAMPLE = 16_384  # vectors that the centroids are fitted on
COPY = 300  # products that sending a row once more is reckoned to cost


def visits(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each unit row; and (row, cell) of the lower-numbered cells that a partner of the row could live in."""
    # a little more than the sine of the greatest angle, for rounding; no plane is out of reach of a right angle
    reach = math.sqrt(1 - threshold * threshold) + 1e-9 if threshold > 0 else 2.0
    home, rows, cells = [], [], []
    step = max(1, (16 << 20) // (8 * len(centres)))
    for k in range(0, len(x), step):
        near = x[k : k + step] @ centres.T
        own = near.argmax(1)
        stay = near[np.arange(len(near)), own]
        gap = np.sqrt(np.maximum(0, 2 - 2 * centres[own] @ centres.T))
        row, cell = ((stay[:, None] - near <= reach * gap + 1e-9) & (np.arange(len(centres)) < own[:, None])).nonzero()
        home.append(own)
        rows.append(row + k)
        cells.append(cell)
    return np.concatenate(home), np.concatenate(rows), np.concatenate(cells)


def centroids(x: np.ndarray, rows: float, threshold: float) -> np.ndarray:
    """Centroids of a sample's unit rows whose number makes the least work a row: products with home rows and visitors
    of its cell, and COPY for each time it is sent. rows: what a row's label holds on average."""
    best, least, k = None, math.inf, 1
    most = min(len(x) // 8, CENTRE_BYTES // (8 * x.shape[1]), max(1, int(rows) // 64))
    while k <= max(1, most):
        centres = spherical_kmeans(x, k, rounds=6)
        home, _, cell = visits(x, centres, threshold)
        own, guests = (np.bincount(c, minlength=len(centres)) / len(x) for c in (home, cell))
        sent = 1 + guests.sum() + (own * own).sum() * rows / BLOCK / 2 + (guests * own).sum() * rows / BLOCK
        work = rows * (own * (own / 2 + guests)).sum() + COPY * sent
        if work < least:
            best, least = centres, work
        elif work > 2 * least:
            break
        k *= 4
    return best


def cells(nodes: DataFrame, centres: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """(node, label, w, embedding, cell, home): each node at home once, and as a visitor where a link could reach."""
    sent = shared(nodes.sparkSession, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            home, row, cell = visits(unit(matrix(batch.column("embedding"))), sent(), threshold)
            taken = pa.array(np.concatenate([np.arange(len(home)), row]))
            out = batch.take(taken)
            extra = [pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(len(taken)) < len(home))]
            yield pa.RecordBatch.from_arrays([*out.columns, *extra], names=[*out.schema.names, "cell", "home"])

    return nodes.mapInArrow(run, f"node long, label string, w long, embedding array<{kind}>, cell int, home boolean")


def _blocks(threshold: float):
    """Within one key: home rows first, then guests. Gives (node, other, links): links to add, and a forest's link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None}

        def new(key):
            state.update(key=key, parts=[], node=None, out=[])

        def settle() -> None:
            """All home rows are here: products among them."""
            if state["node"] is None and state["parts"]:
                node, w, x = (np.concatenate(c) for c in zip(*state["parts"], strict=True))
                state.update(node=node, w=w, x=x, lab=np.arange(len(node)), count=np.zeros(len(node), np.int64), parts=[])
                meet(node, w, x, own=True)

        def root(k: int) -> int:
            lab = state["lab"]
            while lab[k] != k:
                lab[k] = lab[lab[k]]
                k = lab[k]
            return k

        def meet(node, w, x, own: bool = False) -> None:
            for k in range(0, len(node), 512):
                hit = x[k : k + 512] @ state["x"].T >= threshold
                if own:
                    hit[np.arange(len(hit)), k + np.arange(len(hit))] = False
                if not hit.any():
                    continue
                if not own:
                    state["count"] += hit.T @ w[k : k + 512]
                counts, first = hit @ state["w"], hit.argmax(1)
                some = hit.any(1)
                mixed = (hit & (state["lab"][None] != state["lab"][first][:, None])).any(1) & some
                for g in np.flatnonzero(mixed):
                    one = root(first[g])
                    for other in np.unique(state["lab"][hit[g]]):
                        if (two := root(other)) != one:
                            lo, hi = min(one, two), max(one, two)
                            state["lab"][hi], one = lo, lo
                for g in np.flatnonzero(some):
                    state["out"].append((node[k + g], state["node"][first[g]], counts[g]))

        def done() -> Iterator[pa.RecordBatch]:
            settle()
            if state["node"] is not None:
                tops = [root(k) for k in range(len(state["node"]))]
                state["out"] += [(state["node"][k], state["node"][t], c) for k, (t, c) in enumerate(zip(tops, state["count"], strict=True)) if t != k or c]
            if state["out"]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*state["out"], strict=True)], names=["node", "other", "links"])

        new(None)
        for batch in slices(batches):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "cell", "block")), strict=True))
            guest = batch.column("guest").to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or guest[i] != guest[i - 1]), len(keys)]
            node, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "w"))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != state["key"]:
                    yield from done()
                    new(keys[a])
                x = unit(matrix(batch.column("embedding").slice(a, b - a)))
                if guest[a]:
                    settle()
                    if state["node"] is not None:
                        meet(node[a:b], w[a:b], x)
                else:
                    state["parts"].append((node[a:b], w[a:b], x))
        yield from done()

    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null, their vectors have the same length, and the cosine in double
    precision is at least the threshold. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing: n_links 0, component_id their own id. Repeated rows count as different vectors with one id.
    A null id is kept; its component_id is the least id of its component. Other columns are ignored; no rows give none.
    """
    spark, kind = rows.sparkSession, kept_type(rows, embedding)
    base = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding"), F.col(label).cast("string").alias("label"))
    fit = usable("embedding") & F.col("label").isNotNull()
    # the length is part of the label: vectors of different lengths never meet
    valid = base.where(fit).withColumn("label", F.concat_ws(":", F.size("embedding").cast("string"), "label"))
    nodes = cut(valid.groupBy("label", "embedding").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))).withColumn("node", F.monotonically_increasing_id())
    # how many rows meet a row of each length on average: sum of squares of the labels' sizes over their sum
    held = nodes.groupBy(F.size("embedding").alias("n"), "label").count()
    sizes = held.groupBy("n").agg((F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).alias("rows")).orderBy("n").collect()
    found = None
    for r in sizes:
        own = nodes.where(F.size("embedding") == r.n).select("node", "label", "w", "embedding")
        dealt = cells(own, centroids(unit(sample(own, r.n, SAMPLE)), r["rows"], threshold), threshold, kind)
        found = dealt if found is None else found.union(dealt)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dealt = cut(found)
    counts = dealt.where("home").groupBy("label", "cell").count().select("label", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(counts, ["label", "cell"])  # visitors of cells without home rows meet nobody
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a home row is host of its own block and guest of the earlier ones; a visitor is guest of all
    most = F.when(F.col("home"), block).otherwise(F.col("blocks") - 1)
    spread = dealt.select("label", "cell", "node", "w", "embedding", "home", block.alias("own"), F.explode(F.sequence(F.lit(0), most)).alias("block"))
    spread = spread.withColumn("guest", ~F.col("home") | (F.col("own") != F.col("block"))).drop("home", "own")
    sent = spread.repartition(partitions(spark), "label", "cell", "block").sortWithinPartitions("label", "cell", "block", "guest")
    out = cut(sent.mapInArrow(_blocks(threshold), "node long, other long, links long"))
    parts = connected_components(out, "node", "other")
    counts = out.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = known.join(smallest, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = valid.join(labels, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
