"""SimHash near-dedup (operator 6) with pivot distance tables.

Equal fingerprints are one node from the start. Two fingerprints at 3 or fewer differing bits agree wholly on at
least two of five bands, so each fingerprint is dealt to ten band pairs (keys of 25 or 26 bits) and meets every
partner there. A key that holds more than HOT fingerprints is dealt again by four parts of its other bits, one of which
partners must share, and so on until no key is hot or no more than LAST bits are free, which 2 ** LAST different
fingerprints fill. Within a key, the distances of every fingerprint to the reference fingerprints are
computed once; a pair whose coordinates differ by more than 3 anywhere is discarded (triangle inequality), and
survivors are verified by their own distance. Only a spanning forest of a key's links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import as_bytes, cut, fresh, map_columns, partitions, slices
from tidemark.llm.components import connected_components

BITS = 3  # most differing bits of a link
SHINGLE = 3
SEED = 42
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width
HOT = 1024
LAST = 14
PIVOTS = 32
#: Rows that a task gathers before it compares; a key's rows stay together.
CHUNK = 100_000


def fingerprint(data: bytes) -> int:
    """64 bits of a UTF-8 text: A-Z lower-cased, words between ASCII white space, three-word shingles with repeats
    (fewer words: the whole sequence; none: zero); a bit is set if over half the shingles' XXH64 have it."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, total = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for k in range(0, total, 32_768):
        n = min(32_768, total - k)
        shingles = map(b" ".join, zip(*(words[k + i : k + i + n] for i in range(SHINGLE)), strict=True))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long, content long) of every whole text; null counts as empty. content is a hash of the text."""

    def make():
        import xxhash

        def work(keys: pa.Array, texts: pa.Array) -> dict:
            own = as_bytes(texts)
            prints, contents = ([f(x) for x in own] for f in (fingerprint, xxhash.xxh3_64_intdigest))
            return {"doc_id": keys.cast(pa.int64()), "fp": np.array(prints, np.uint64).view(np.int64), "content": np.array(contents, np.uint64).view(np.int64)}

        return work

    return map_columns(docs, [key, text], "doc_id long, fp long, content long", make)


def pivots() -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words of 64 bits."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(PIVOTS)], np.uint64)


def link_sorted(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: a spanning forest of the links among rows of one key, as pairs of positions."""
    table = np.stack([np.bitwise_count(fps ^ p) for p in pivots()]).astype(np.int8)
    root = np.arange(len(fps))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    left, step = np.flatnonzero(keys[1:] == keys[:-1]), 1
    while left.size:
        for part in np.array_split(left, -(-left.size // 500_000)):
            a, b = part, part + step
            for row in table:
                near = np.abs(row[a] - row[b]) <= BITS
                if not near.all():
                    a, b = a[near], b[near]
            close = (np.bitwise_count(fps[a] ^ fps[b]) <= BITS) & (root[a] != root[b])
            for x, y in zip(a[close].tolist(), b[close].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((x, y))
            if close.any():
                while not np.array_equal(up := root[root], root):
                    root = up
        step += 1
        left = left[left + step < len(keys)]
        left = left[keys[left] == keys[left + step]]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, last = 0, None

    def flush(whole: bool):
        nonlocal held, rows
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        end = len(keys) if whole else int(np.searchsorted(keys, keys[-1]))
        held, rows = ([(keys[end:], fps[end:])], len(keys) - end) if end < len(keys) else ([], 0)
        a, b = link_sorted(keys[:end], fps[:end].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fps[a], pa.int64()), pa.array(fps[b], pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if rows >= CHUNK and keys[0] != last:
            yield flush(True)
        elif rows >= CHUNK and held[0][0][0] != last:
            yield flush(False)
        held.append((keys, fps))
        rows, last = rows + len(keys), keys[-1]
    if held:
        yield flush(True)


def finer(mask: int) -> list[int]:
    """Four masks that hold mask's bits and a quarter of the others each."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // 4 for k in range(5)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, per key, of all pairs of fingerprints (column fp, each once) within BITS bits."""
    spark = distinct.sparkSession
    bands = [((1 << width) - 1) << first for first, width in BANDS]
    masks = [a | b for a, b in combinations(bands, 2)]
    # fingerprints meet where they agree on all bits of a mask: a key is a hash of the mask and these bits
    keyed = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"))
    key, done = F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), []
    while True:
        keys = keyed.select("fp", "mask", key)
        hot = keys.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
        if all(64 - m.bit_count() <= LAST for m in masks) or hot.isEmpty():
            done.append(keys.select("key", "fp"))
            break
        told = cut(keys.join(hot, "key", "left"))
        done.append(told.where("hot IS NULL").select("key", "fp"))
        # as many rows as there are masks: ten, and four times as many each time
        parts = spark.createDataFrame([(_signed(m), [_signed(x) for x in finer(m)]) for m in masks], "mask long, parts array<long>")
        keyed = told.where("hot").join(F.broadcast(parts), "mask").select("fp", F.explode("parts").alias("mask"))
        masks = [x for m in masks for x in finer(m)]
    dealt = reduce(DataFrame.union, done)
    return dealt.repartition(partitions(spark), "key").sortWithinPartitions("key", "fp").mapInArrow(_link, "a long, b long")


def grouped(found: DataFrame, kept: Column) -> DataFrame:
    """(fp, component, kept) of each different fingerprint of found; kept is a minimum over its rows, taken by each task
    before rows are shuffled, so that a group of copies is one row here."""
    nodes = found.groupBy("fp").agg(kept.alias("kept"))
    parts = connected_components(links(nodes.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    return nodes.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "kept")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row of docs.

    component_id is the least doc_id reachable through links. Null or wordless texts have fingerprint zero and link
    like any other. Rows with a null doc_id keep their fingerprint and get the least id of their component (null if it
    has none). Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    found = cut(fingerprints(docs, text, key))
    nodes = grouped(found, F.min("doc_id"))
    least = nodes.groupBy("component").agg(F.min("kept").alias("component_id"))
    labels = nodes.join(least, "component").select("fp", "component_id")
    return found.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their groups: of each component the row of the least
    doc_id (nulls last; of rows that share it that of the least hash of its text; of rows that share the text too any
    one). Null and wordless texts are a group, and what links to them. An empty table gives no rows.

    Rows of equal id and text are reduced to one by each task before they are shuffled, once, for both steps."""
    found = cut(fingerprints(docs, text, key))
    first = grouped(found, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content"))).groupBy("component").agg(F.min("kept").alias("r"))
    none, own, content = keys = fresh(docs.columns, "none", "own", "content")
    # the same hash as fingerprints() takes, of the same bytes, row by row beside the other columns
    at = docs.columns.index(text)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            said = np.array([xxhash.xxh3_64_intdigest(x) for x in as_bytes(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said)], names=[*batch.schema.names, content])

    rows = docs.mapInArrow(marked, StructType([*docs.schema.fields, StructField(content, LongType())]))
    # a null id is told from others by a mark, as keys of a join are never null; plain columns of one type on both sides,
    # so that the join finds the rows where the reduction has put them
    rows = rows.withColumn(none, F.col(key).isNull()).withColumn(own, F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))).dropDuplicates(keys)
    wanted = first.select(F.col("r.none").alias(none), F.coalesce("r.doc_id", F.lit(0).cast("long")).alias(own), F.col("r.content").alias(content))
    return rows.join(wanted, keys, "left_semi").select(*docs.columns)
