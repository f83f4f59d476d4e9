"""Best-fit packing with conflicts (operator 9).

Documents are cut into pieces of at most `capacity` words. A bin holds pieces up to the capacity, at most one per
source and at most one per cluster of duplicates. Pieces are dealt to shards of some SHARD documents: rows are numbered
within their table's partitions, and the number and a hash of the document pick the shard, so neither a source, nor a
cluster, nor one row repeated a million times fills a shard; each is packed by one task.

Within a shard, longest pieces first, bins are kept by residual: a tree over residuals holds, for each span, the
sources that every bin below it already carries. The search starts at the smallest residual that fits and goes to
the next greater ones until it finds the tightest bin whose source and cluster bitmaps are free; spans in which all
bins carry the piece's source, and groups of bins that all carry its cluster, are passed over as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, cut, map_columns

CAPACITY = 1024
SHARD = 8192


class Bins:
    """Open bins of one shard, found by residual, source and cluster."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.capacity = capacity
        # The sources that all bins of a span have in common; -1 (all of them) for a span without bins.
        self.common = [-1] * (2 * self.size)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.size)]  # residual -> source bitmap -> bins
        self.carried: list[dict[tuple[int, int], int]] = [{} for _ in range(self.size)]  # residual -> (source bitmap, cluster) -> how many of those bins carry it
        self.clusters: list[int] = []
        self.used: list[int] = []

    def _update(self, residual: int) -> None:
        k = residual + self.size
        common = -1
        for mask in self.at[residual]:
            common &= mask
        self.common[k] = common
        while k > 1:
            k >>= 1
            common = self.common[2 * k] & self.common[2 * k + 1]
            if self.common[k] == common:
                break
            self.common[k] = common

    def _next(self, residual: int, source: int) -> int:
        """The smallest residual from here on with a bin that does not carry the source; -1 if there is none."""
        k = residual + self.size
        if k >= 2 * self.size:
            return -1
        while self.common[k] & source == source and source or self.common[k] == -1:
            while k & 1:  # a right child: up
                k >>= 1
            if k == 0:
                return -1
            k += 1
            if k & (k - 1) == 0:  # past the last of a level
                return -1
        while k < self.size:
            k *= 2
            if self.common[k] & source == source and source or self.common[k] == -1:
                k += 1
        return k - self.size

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bitmaps of one bit each (0: no constraint) -> bin, start within it."""
        residual = self._next(length, source)
        while residual >= 0:
            for mask, bins in self.at[residual].items():
                if mask & source or self.carried[residual].get((mask, cluster), 0) == len(bins):
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not self.clusters[bins[k]] & cluster:
                        chosen = bins.pop(k)
                        if not bins:
                            del self.at[residual][mask]
                        self._count(residual, mask, self.clusters[chosen], -1)
                        self._update(residual)
                        return self._place(chosen, residual, mask, length, source, cluster)
            residual = self._next(residual + 1, source)
        self.clusters.append(0)
        self.used.append(0)
        return self._place(len(self.used) - 1, self.capacity, 0, length, source, cluster)

    def _count(self, residual: int, mask: int, clusters: int, by: int) -> None:
        held = self.carried[residual]
        while clusters:
            one = clusters & -clusters
            clusters ^= one
            held[mask, one] = n = held.get((mask, one), 0) + by
            if not n:
                del held[mask, one]

    def _place(self, chosen: int, residual: int, mask: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        start = self.used[chosen]
        self.used[chosen] += length
        self.clusters[chosen] |= cluster
        if residual > length:  # full bins are closed
            self.at[residual - length].setdefault(mask | source, []).append(chosen)
            self._count(residual - length, mask | source, self.clusters[chosen], 1)
            self._update(residual - length)
        return chosen, start


def pack_shard(ids: list, lengths: list[int], sources: list, clusters: list, capacity: int) -> Iterator[tuple]:
    """(position, piece, length, bin, start) for every piece of a shard's documents."""
    source_bit = {s: 1 << k for k, s in enumerate(sorted({x for x in sources if x is not None}))}
    # Only clusters with more than one piece in this shard can conflict.
    pieces = [(min(capacity, n - k * capacity), i, k) for i, n in enumerate(lengths) for k in range(max(1, -(-n // capacity)))]
    held: dict = {}
    # a document without a cluster is one by itself
    own = [("", i) if c is None else (c,) for i, c in enumerate(clusters)]
    for _, i, _ in pieces:
        held[own[i]] = held.get(own[i], 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in held.items() if n > 1)}
    bins = Bins(capacity)
    order = sorted(pieces, key=lambda p: (-p[0], ids[p[1]] is None, ids[p[1]] or 0, p[2], sources[p[1]] or ""))
    for length, i, k in order:
        yield i, k, length, *bins.put(length, source_bit.get(sources[i], 0), cluster_bit.get(own[i], 0))


def measured(docs: DataFrame, text: str, key: str, source: str, cluster: str | None) -> DataFrame:
    """doc_id, source, words of the whole text, the document's cluster, and turn: how many equal (doc_id, cluster) the
    task has met before. Without a column of clusters, documents with the same words (ASCII case aside) are one."""
    import xxhash

    def make():
        met: dict[tuple, int] = {}

        def turn(pair: tuple) -> int:
            met[pair] = met.get(pair, -1) + 1
            return met[pair]

        def work(keys: pa.Array, texts: pa.Array, sources: pa.Array, given: pa.Array) -> dict:
            words = [x.lower().split() for x in as_bytes(texts)]
            own = given.to_pylist() if cluster else [xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) for w in words]
            return {"doc_id": keys, "source": sources, "words": [len(w) for w in words], "cluster": own, "turn": [turn(p) for p in zip(keys.to_pylist(), own, strict=True)]}

        return work

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"), (F.col(cluster) if cluster else F.lit(None)).cast("long").alias("cluster"))
    return map_columns(named, ["doc_id", "text", "source", "cluster"], "doc_id long, source string, words long, cluster long, turn long", make)


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, n_words, bin_id, start, bin_words) for every piece of every document.

    Words are runs without ASCII white space. A null or wordless text is one piece of length 0. A null source
    conflicts with nothing. cluster names a column of longs, such as near-duplicate components; without it documents of
    the same words are one. A document's own pieces never share a bin; a null cluster keeps nothing else apart. bin_id
    is "<shard>-<bin>"; bin_words is what the bin holds. Repeated rows are packed apart, being each other's duplicates;
    of one row that stands in T of the table's partitions, T copies can meet in a shard. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = cut(measured(docs, text, key, source, cluster).withColumn("part", F.spark_partition_id()))
    shards = -(-max(1, rows.count()) // SHARD)
    schema = "doc_id long, piece long, n_words long, bin_id string, start long, bin_words long"

    def run(shard: pa.Table) -> pa.Table:
        ids, sources, words, clusters, number = (shard.column(c).to_pylist() for c in ("doc_id", "source", "words", "cluster", "shard"))
        out = list(pack_shard(ids, words, sources, clusters, capacity))
        fill: dict[int, int] = {}
        for _, _, length, chosen, _ in out:
            fill[chosen] = fill.get(chosen, 0) + length
        columns = ([ids[x[0]] for x in out], [x[1] for x in out], [x[2] for x in out], [f"{number[0]}-{x[3]}" for x in out], [x[4] for x in out], [fill[x[3]] for x in out])
        kinds = [pa.string() if k == 3 else pa.int64() for k in range(6)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "n_words", "bin_id", "start", "bin_words"])

    # rows that a task meets again go wherever their number sends them; a row met once goes by itself alone
    again = F.when(F.col("turn") > 0, F.xxhash64("turn", "part")).otherwise(F.lit(0).cast("long"))
    dealt = rows.select("doc_id", "source", "words", "cluster", F.pmod(F.xxhash64("doc_id", "cluster").bitwiseXOR(again), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, schema)
