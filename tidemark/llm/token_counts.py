"""Token counts (operator 8): two tiers of lookup on the map side; no pre-token is shuffled.

Tier one is a compact table of the corpus's frequent pre-tokens and their lengths in tokens, broadcast once. Each task
of a first pass counts the pre-tokens of its texts in COUNTERS bounded counters (when they run over, the count of the
COUNTERS-th is taken off all, as Misra and Gries do, so no count is short by more than a COUNTERS-th of the task's
pre-tokens) and gives out its EMITTED greatest. Only these sums are merged; the table is all pre-tokens with a count of
at least the least one for which there are no more than FREQUENT. Tier two is each worker's cache: a pre-token that is
not in the table is merged once and remembered. The table decides what is looked up where, never what is counted.
"""

from __future__ import annotations

import uuid
from collections import Counter as Counts
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import as_bytes, cut, map_columns, shared, slices, worker_state

FREQUENT = 131_072  # most pre-tokens of the table
LONGEST = 32  # characters of a pre-token in it: it takes some 20 MB at the very most
COUNTERS = 131_072
EMITTED = 32_768


class Frequent:
    """Bounded counters of a task."""

    def __init__(self, size: int) -> None:
        self.size, self.counts = size, Counts()

    def add(self, words: list[str]) -> None:
        self.counts.update(words)
        if len(self.counts) > 2 * self.size:
            off = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counts({w: n - off for w, n in self.counts.items() if n > off})

    def greatest(self, most: int) -> list[tuple[str, int]]:
        return [(w, n) for w, n in self.counts.most_common() if len(w) <= LONGEST][:most]


def frequent(docs: DataFrame, codec, text: str) -> tuple[pa.Array, bytes]:
    """The table: pre-tokens, and their lengths in tokens, a byte each. codec() gives the codec on a worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = bpe.Splitter(codec()), Frequent(COUNTERS)
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                for part in split.segments(t)[0] if t else ():
                    found.add(split.pieces(part))
        words, n = zip(*out, strict=True) if (out := found.greatest(EMITTED)) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            n = [len(bpe.merge(own, w.encode())) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["word", "n"])

    sums = cut(docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # counts fall into some hundreds of classes, three per cent wide
    level = F.floor(F.log(F.col("n")) * 32).alias("level")
    held, least = 0, None
    for r in sums.groupBy(level).count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.level
    if least is None:
        return pa.array([], pa.string()), b""
    table = sums.where(level >= least).select("word").mapInArrow(lengths, "word string, n int").toArrow()
    return table.column("word").combine_chunks(), bytes(table.column("n").to_pylist())


class Counter:
    def __init__(self, codec: bpe.Codec, table: tuple[pa.Array, bytes]) -> None:
        self.split = bpe.Splitter(codec)
        self.table = dict(zip(table[0].to_pylist(), table[1], strict=True))
        self.misses = bpe.Cache(lambda word: len(bpe.merge(codec, word.encode())))

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens, and those of them that the table has."""
        texts, specials = self.split.segments(text)
        total, held, hit, get, miss = len(specials), 0, 0, self.table.get, self.misses
        for part in texts:
            words = self.split.pieces(part)
            found = list(map(get, words))
            held += len(words)
            hit += len(words) - found.count(None)
            if None in found:
                found = [miss[w] if n is None else n for w, n in zip(words, found, strict=True)]
            total += sum(found)
        return total, held, hit


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id", report: bool = False) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text; with report also n_pretokens
    and n_table, how many of them the table has.

    A null text counts as empty. Strings of special tokens inside a text count as that one token. Other columns are
    ignored; repeated rows and null keys stay; an empty table gives no rows.
    """
    codec = shared(docs.sparkSession, bpe.load(path))
    table = shared(docs.sparkSession, frequent(docs, codec, text))
    name = f"counts-{uuid.uuid4().hex}"  # the table is this run's own
    kind = docs.schema[key].dataType.simpleString()

    def make():
        counter = worker_state(name, lambda: Counter(codec(), table()))

        def work(keys: pa.Array, texts: pa.Array) -> dict:
            found = [counter.count(x or "") for x in texts.to_pylist()]
            n, held, hit = zip(*found, strict=True) if found else ((), (), ())
            return {key: keys, "n_bytes": [len(x) for x in as_bytes(texts)], "n_tokens": n, "n_pretokens": held, "n_table": hit}

        return work

    counted = map_columns(docs, [key, text], f"{key} {kind}, n_bytes long, n_tokens long" + ", n_pretokens long, n_table long" * report, make)
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(("n_pretokens", "n_table") if report else ()))
