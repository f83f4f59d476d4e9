"""Approximate nearest neighbours (operator 4): balanced posting lists.

Largest inner product becomes nearest direction by one added coordinate, sqrt(M^2 - |x|^2), M being the largest norm.
There are some LISTS * sqrt(n) lists, as far as their centroids fit into vectors.CENTRE_BYTES. Centroids are fitted on a
bounded sample; cells that hold more than twice the mean of the sample are split, so the lists are balanced. Every vector
is posted to its nearest centroid and, if it lies near a boundary, to others whose distance is within a closure of the
nearest, unless a list chosen before is closer to that centroid than the vector is. A query walks an in-memory neighbour
graph of the centroids and takes the lists whose distance is within a ratio of the nearest one's, which counts as no
less than a floor. All three are fitted: vectors of the sample are asked for their nearest others in it, and of the
closures and floors tried, each with the least ratio that reaches RECALL of them, those that scan least are taken.

Neighbouring lists form groups; a group's vectors are dealt to chunks of at most some CHUNK vectors whatever the lists'
sizes, so work splits as data grows. A task holds one chunk and lets the group's queries pass by as a stream; a query
meets only the chunk's vectors of its own lists. Vectors travel in their own type (float or double) and are compared as
doubles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, partitions, shared, slices
from tidemark.llm.vectors import CENTRE_BYTES, balanced, kept_type, matrix, nearest_cell, sample, spherical_kmeans, unit, usable

TOP = 20
SAMPLE = 32_768  # vectors that the centroids and the ratio are fitted on, at most
LISTS = 4  # times the root of the number of vectors
CLOSURES = (1.02, 1.05, 1.12)  # how much farther than the nearest a list of a boundary vector may be
FLOORS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)  # quantiles of the sample's distances to the nearest list
COPIES = 4  # lists of a boundary vector at most (the nearest included); every vector is in one at least
RECALL = 0.95  # of the sample's neighbours that the fitted ratio reaches
ASKED = 400  # vectors of the sample that the ratio is fitted with
GROUP = 16  # lists of a group
CHUNK = 4096  # vectors that a task holds at once
DEGREE = 32


def chord(near: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their cosines."""
    return np.sqrt(np.maximum(0, 2 - 2 * near))


class CentroidGraph:
    """Centroids linked to their nearest ones both ways; best-first search. homes: vectors whose nearest list it is."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres, self.floor, self.ratio, self.closure = centres, 0.0, 1.0, CLOSURES[-1]
        self.homes = np.full(len(centres), 1 << 40, np.int64)
        k = min(DEGREE, len(centres) - 1)
        links: list[set] = [set() for _ in centres]
        for first in range(0, len(centres), 512):
            near = centres[first : first + 512] @ centres.T
            near[np.arange(len(near)), first + np.arange(len(near))] = -2
            for i, row in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :k]):
                links[first + i].update(row.tolist())
                for j in row:
                    links[j].add(first + i)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        # one entry for each part of the graph that links do not join
        self.entries, seen = [], np.zeros(len(centres), bool)
        for i in range(len(centres)):
            if not seen[i]:
                self.entries.append(i)
                stack = [i]
                seen[i] = True
                while stack:
                    fresh = [j for j in self.links[stack.pop()].tolist() if not seen[j]]
                    seen[fresh] = True
                    stack += fresh
        groups = spherical_kmeans(centres, math.ceil(len(centres) / GROUP), rounds=4)
        self.group = nearest_cell(centres, groups).astype(np.int32)

    def lists(self, q: np.ndarray, least: int = 0) -> np.ndarray:
        """Lists within the ratio of the nearest list's distance (chord of unit vectors, taken as no less than floor),
        met by best-first search, and as many of the next ones as it takes to hold `least` vectors.

        The search goes on while the frontier is within the ratio of the best distance so far."""
        seen = np.zeros(len(self.centres), bool)
        seen[self.entries] = True
        dist = chord(self.centres[self.entries] @ q)
        heap = list(zip(dist.tolist(), self.entries, strict=True))
        heapq.heapify(heap)
        best, found, held = max(self.floor, min(dist)), [], 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > self.ratio * best and len(found) >= DEGREE and held >= least:
                break
            found.append((d, i))
            held += int(self.homes[i])
            fresh = self.links[i][~seen[self.links[i]]]
            if len(fresh):
                seen[fresh] = True
                far = chord(self.centres[fresh] @ q)
                best = min(best, max(self.floor, far.min()))
                for x in zip(far.tolist(), fresh.tolist(), strict=True):
                    heapq.heappush(heap, x)
        found.sort()
        out, held = [], 0
        for d, i in found:
            if d > self.ratio * best and held >= least:
                break
            out.append(i)
            held += int(self.homes[i])
        return np.array(out, np.int32)


def posted(centres: np.ndarray, x: np.ndarray, closure: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of unit rows: the nearest list, and near ones that no chosen list stands in front of."""
    near = x @ centres.T
    k = min(4 * COPIES, len(centres))
    order = np.argpartition(-near, k - 1, axis=1)[:, :k]
    dist = chord(np.take_along_axis(near, order, 1))
    by = np.lexsort((order, dist), axis=1)
    order, dist = np.take_along_axis(order, by, 1), np.take_along_axis(dist, by, 1)
    own = centres[order]
    between = chord(own @ own.transpose(0, 2, 1))
    chosen = np.zeros(order.shape, bool)
    chosen[:, 0] = True
    for j in range(1, k):
        behind = (chosen[:, :j] & (between[:, j, :j] <= 0.8 * dist[:, j, None])).any(1)
        chosen[:, j] = (dist[:, j] <= closure * dist[:, 0]) & (chosen.sum(1) < COPIES) & ~behind
    row, at = chosen.nonzero()
    return row, order[row, at]


def fitted(x: np.ndarray, k: int, top: int, recall: float) -> CentroidGraph:
    """Centroids of unit rows, and the closure, floor and ratio that reach `recall` of the rows' own nearest ones."""
    graph = CentroidGraph(balanced(x, k))
    asked = np.random.default_rng(11).permutation(len(x))[:ASKED]
    dist = chord(x[asked] @ graph.centres.T)
    wanted = []
    for i in asked:
        near = x @ x[i]
        near[i] = -2
        wanted.append(np.argsort(-near, kind="stable")[: min(top, len(x) - 1)])
    least = None
    for closure in CLOSURES:
        row, own = (np.concatenate(c) for c in zip(*((r + a, o) for a in range(0, len(x), 2048) for r, o in [posted(graph.centres, x[a : a + 2048], closure)]), strict=True))
        first = np.searchsorted(row, np.arange(len(x) + 1))
        size = np.bincount(own, minlength=len(graph.centres))
        # the least distance of a list that holds the neighbour; one of the whole table lies no farther than that of the sample
        far = [[dist[q, own[first[j] : first[j + 1]]].min() for j in js] for q, js in enumerate(wanted)]
        for floor in np.quantile(chord((x * graph.centres[own[first[:-1]]]).sum(1)), FLOORS):
            best = np.maximum(max(floor, 1e-12), dist.min(1))
            needed = [d / b for ds, b in zip(far, best, strict=True) for d in ds]
            ratio = float(np.quantile(needed, recall)) * (1 + 1e-9) if needed else 1.0
            cost = float(((dist <= (ratio * best)[:, None]) @ size).mean())
            if least is None or cost < least:
                least, graph.closure, graph.floor, graph.ratio = cost, closure, float(floor), ratio
    return graph


def _search(top: int):
    """Rows of one (group, chunk): its vectors first, then the queries. Gives (query, node, score) of each query's best
    among the chunk's vectors of its lists: one more than asked for, as the query itself may be among them."""
    keep = top + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None

        def gathered():
            x, node, lists = [np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]), [y for p in parts for y in p[2]]
            at: dict[int, list[int]] = {}
            for i, own in enumerate(lists):
                for j in own:
                    at.setdefault(j, []).append(i)
            x = x[0]
            scale = np.abs(x).max()
            return x, x / scale, node, {j: np.array(i) for j, i in at.items()}

        def ask(x: np.ndarray, query: np.ndarray, lists: list) -> pa.RecordBatch:
            own, scaled, node, at = held
            small = x / np.abs(x).max(axis=1, keepdims=True)
            scores = np.full((len(x), len(own)), -np.inf)
            by: dict[int, list[int]] = {}
            for i, taken in enumerate(lists):
                for j in taken:
                    if j in at:
                        by.setdefault(j, []).append(i)
            for j, rows in by.items():
                scores[np.ix_(rows, at[j])] = small[rows] @ scaled[at[j]].T
            # the products only choose; a margin keeps what rounding could move across the line
            line = np.partition(scores, -keep, axis=1)[:, -keep] if scores.shape[1] > keep else np.full(len(x), -np.inf)
            out: list[tuple] = []
            for i in range(len(x)):
                chosen = np.flatnonzero(np.isfinite(scores[i]) & (scores[i] >= line[i] - 1e-9 * max(1.0, abs(line[i])) if np.isfinite(line[i]) else True))
                with np.errstate(all="ignore"):
                    exact = (own[chosen] * x[i]).sum(1)
                order = np.lexsort((node[chosen], -exact))[:keep]
                out.append((np.full(len(order), query[i]), node[chosen][order], exact[order]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "node", "score"])

        for batch in slices(batches):
            keys = batch.column("grp").to_numpy(zero_copy_only=False).astype(np.int64) << 32 | batch.column("chunk").to_numpy(zero_copy_only=False)
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            node, lists, x = batch.column("node").to_numpy(zero_copy_only=False), batch.column("lists").to_pylist(), matrix(batch.column("embedding"))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if keys[a] != key:
                    key, parts, held = keys[a], [], None
                if not asks[a]:
                    parts.append((x[a:b], node[a:b], lists[a:b]))
                elif parts:
                    held = held or gathered()
                    yield ask(x[a:b], node[a:b], lists[a:b])

    return run


def nearest(rows: DataFrame, top: int = TOP, every: int = 20, recall: float = RECALL, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the `top` nearest other rows.

    Score is the inner product of the original vectors in double precision (infinite where that overflows); ties go to
    the smaller id. Fewer candidates than `top` give fewer rows. Null, empty, zero, null-holding or non-finite vectors and
    null ids take no part, nor do vectors whose length is not the table's most frequent one (the longer of equals). Rows
    that repeat an id are one candidate each, except to a query of that id; if their vectors differ, each of them is a
    query with ranks from 1. Other columns are ignored; an empty table gives no rows. recall >= 1 searches every list.
    """
    return _ranked(*index(rows, top, every, recall, key, embedding), top)


def index(rows: DataFrame, top: int, every: int, recall: float, key: str, embedding: str):
    """The table's distinct vectors, the queries, and what goes to the chunks of each group of lists."""
    spark, kind = rows.sparkSession, kept_type(rows, embedding)
    base = rows.where(usable(embedding) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding"))
    common = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark, None, None, None
    base = base.where(F.size("embedding") == common.n)
    # Equal vectors are one candidate with its least ids: top + 1 suffice, one of which may be the query's own.
    ranked = base.withColumn("k", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("k") <= top + 1)
    # numbered in the order of their least ids, so ties between nodes fall as ties between ids
    nodes = cut(ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).orderBy(F.col("ids")[0], "embedding")).withColumn("node", F.monotonically_increasing_id())
    wide = F.col("embedding").cast("array<double>")
    total, peak = nodes.agg(F.count("*"), F.max(F.array_max(F.transform(wide, F.abs)))).first()
    most = nodes.agg(F.max(F.aggregate(wide, F.lit(0.0), lambda s, v: s + (v / peak) * (v / peak)))).first()[0]

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / peak
        return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], axis=1) / np.sqrt(most)

    k = min(math.ceil(LISTS * math.sqrt(total)), CENTRE_BYTES // (8 * (common.n + 1)))
    drawn = unit(lifted(sample(nodes, common.n, SAMPLE)))
    graph = fitted(drawn, min(k, max(1, len(drawn) // 8)), top, min(1.0, recall))
    if recall >= 1:
        graph.ratio = math.inf
    centres = graph.centres
    sent = shared(spark, graph)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, home, group = sent(), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in slices(batches):
            row, own = posted(graph.centres, unit(lifted(matrix(batch.column(0)))), graph.closure)
            home += np.bincount(own[np.searchsorted(row, np.arange(batch.num_rows))], minlength=len(home))
            group += np.bincount(np.unique(np.stack([row, graph.group[own]]), axis=1)[1], minlength=len(group))
        at = np.flatnonzero(home + group)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(home[at]), pa.array(group[at])], names=["at", "home", "grp"])

    # at most as many rows as there are lists; group numbers are smaller than their number
    sizes = nodes.select("embedding").mapInArrow(homes, "at long, home long, grp long").groupBy("at").agg(F.sum("home").alias("home"), F.sum("grp").alias("grp")).collect()
    chunks = np.ones(len(centres), np.int64)
    graph.homes[:] = 0
    for r in sizes:
        graph.homes[r["at"]], chunks[r["at"]] = r.home, max(1, -(-r.grp // CHUNK))
    sent = shared(spark, (graph, chunks))

    def _rows(batch: pa.RecordBatch, row: np.ndarray, own: np.ndarray, group: np.ndarray, chunk: np.ndarray, query: bool) -> pa.RecordBatch:
        """One row per (row, group, chunk) with the lists of own that belong to it."""
        order = np.lexsort((own, chunk, group, row))
        row, own, group, chunk = row[order], own[order], group[order], chunk[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])])) if len(row) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(own.astype(np.int32)))
        taken = batch.take(pa.array(row[first]))
        return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int32)), pa.array(chunk[first].astype(np.int32)), taken.column("node"), taken.column("embedding"), lists, pa.array([query] * len(first))], names=["grp", "chunk", "node", "embedding", "lists", "query"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, chunks = sent()
        for batch in slices(batches):
            row, own = posted(graph.centres, unit(lifted(matrix(batch.column("embedding")))), graph.closure)
            group = graph.group[own]
            # nodes are numbered in runs: a mix of their bits deals them evenly
            mixed = (batch.column("node").to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield _rows(batch, row, own, group, (mixed[row] % chunks[group].astype(np.uint64)).astype(np.int64), False)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, chunks = sent()
        for batch in slices(batches):
            x = matrix(batch.column("embedding"))
            q = unit(np.concatenate([x / np.abs(x).max(axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1))
            own = [graph.lists(v, top + 1) for v in q]
            row, own = np.repeat(np.arange(len(x)), [len(o) for o in own]), np.concatenate(own)
            group = graph.group[own]
            times = chunks[group]
            row, own, group = (np.repeat(c, times) for c in (row, own, group))
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield _rows(batch, row, own, group, chunk, True)

    schema = f"grp int, chunk int, node long, embedding array<{kind}>, lists array<int>, query boolean"
    asked = cut(base.where(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding").count().drop("count")).withColumn("node", F.monotonically_increasing_id())
    postings = nodes.select("node", "embedding").mapInArrow(post, schema)
    questions = asked.select("node", "embedding").mapInArrow(ask, schema)
    return spark, nodes, asked, postings.union(questions)


def _ranked(spark, nodes: DataFrame | None, asked: DataFrame | None, dealt: DataFrame | None, top: int) -> DataFrame:
    if dealt is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = dealt.repartition(partitions(spark), "grp", "chunk").sortWithinPartitions("grp", "chunk", "query")
    # a vector in several groups is met more than once, with one score: the products of its components in their order
    pairs = sent.mapInArrow(_search(top), "query long, node long, score double").distinct()
    # top + 1 different vectors hold the top rows, even if one of them is the query itself
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    pairs = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
    named = pairs.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    named = named.join(asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")), "query").where("vec_id != query_id")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def scanned(rows: DataFrame, top: int = TOP, every: int = 20, recall: float = RECALL, key: str = "vec_id", embedding: str = "embedding") -> float:
    """Share of the distinct vectors that a query meets on average in its lists, copies counted each time."""
    _, nodes, asked, dealt = index(rows, top, every, recall, key, embedding)
    one = dealt.select("grp", "chunk", "query", F.explode("lists").alias("list")).groupBy("grp", "chunk", "list").agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("v"))
    met = one.agg(F.sum(F.col("q") * F.col("v"))).first()[0]
    return (met or 0) / max(1, asked.count()) / max(1, nodes.count())
