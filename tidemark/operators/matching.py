"""One-to-one matching of predicted and true events of a file.

A matcher gives two columns over p_on, p_off, g_on, g_off: whether a pair is compatible, and its quality; and how far
beyond an event's onset a partner's onset may lie. Only events of one chain of overlapping (widened) intervals can
compete, so files are cut into such chains first: pairs are joined and matched per (file, chain), and one file with a
third of all events still spreads over many tasks. In a chain as long as a whole recording, pairs meet in stretches of
time instead, and the greedy choice is made in rounds: a pair that comes first of all pairs of both its events is taken,
the others of these events go, and so on until none is left, which is what going through them in order gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import iou
from tidemark.operators.islands import numbered
from tidemark.operators.session import cut


@dataclass(frozen=True)
class IoUMatcher:
    threshold: float = 0.5

    @property
    def name(self) -> str:
        return f"iou(>={self.threshold})"

    @property
    def reach(self) -> float | None:
        """None where disjoint events are compatible too: all events of a file can compete then."""
        return 0.0 if self.threshold > 0 else None

    def compatible(self) -> Column:
        return iou(F.col("p_on"), F.col("p_off"), F.col("g_on"), F.col("g_off")) >= self.threshold

    def quality(self) -> Column:
        return iou(F.col("p_on"), F.col("p_off"), F.col("g_on"), F.col("g_off"))


@dataclass(frozen=True)
class CollarMatcher:
    onset_collar: float = 0.2
    offset_collar: float = 0.2
    offset_fraction: float = 0.2

    @property
    def name(self) -> str:
        return f"collar(on={self.onset_collar},off={self.offset_collar},frac={self.offset_fraction})"

    @property
    def reach(self) -> float:
        return self.onset_collar

    def compatible(self) -> Column:
        slack = F.greatest(F.lit(self.offset_collar), F.lit(self.offset_fraction) * (F.col("g_off") - F.col("g_on")))
        return (F.abs(F.col("p_on") - F.col("g_on")) <= self.onset_collar) & (F.abs(F.col("p_off") - F.col("g_off")) <= slack)

    def quality(self) -> Column:
        return -F.abs(F.col("p_on") - F.col("g_on"))


COLUMNS = ("file_id", "ord", "onset_s", "offset_s", "score")


def _chained(preds: DataFrame, gts: DataFrame, reach: float | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with chain, numbered within the file; one chain a file where reach is None."""
    both = preds.select(*COLUMNS, F.lit(True).alias("_p")).union(gts.select(*COLUMNS[:-1], F.lit(0.0), F.lit(False)))
    if reach is None:
        both = both.withColumn("island", F.lit(0))
    else:
        end = F.greatest(F.col("offset_s"), F.col("onset_s") + F.lit(reach * (1 + 1e-12) + 1e-9))
        both = numbered(both, ["file_id"], F.col("onset_s") > F.col("_end"), end)
    p = both.where("_p").select("file_id", F.col("island").alias("chain"), F.col("ord").alias("p_ord"), F.col("onset_s").alias("p_on"), F.col("offset_s").alias("p_off"), "score")
    g = both.where("NOT _p").select("file_id", F.col("island").alias("chain"), F.col("ord").alias("g_ord"), F.col("onset_s").alias("g_on"), F.col("offset_s").alias("g_off"))
    return p, g


def candidates(preds: DataFrame, gts: DataFrame, matcher) -> DataFrame:
    """(file_id, chain, p_ord, score, g_ord, quality) of every compatible pair. Events: (file_id, ord, onset_s, offset_s,
    score), ord being the place in the input list."""
    p, g = _chained(preds, gts, matcher.reach)
    return p.join(g, ["file_id", "chain"]).where(matcher.compatible()).select("file_id", "chain", "p_ord", "score", "g_ord", matcher.quality().alias("quality"))


#: Pairs of a chain that are gone through in one row; more are chosen in rounds, with the same result.
CHAIN = 1000


def greedy_matches(preds: DataFrame, gts: DataFrame, matcher) -> DataFrame:
    """(file_id, p_ord, g_ord). Predictions come by descending score (ties: input order); each takes the free truth of
    the best quality (ties: input order)."""
    pair = F.struct((-F.col("score")).alias("s"), F.col("p_ord").cast("long").alias("p_ord"), (-F.col("quality")).alias("q"), F.col("g_ord").cast("long").alias("g_ord"))
    pairs = candidates(preds, gts, matcher).select("file_id", "chain", pair.alias("pair"))
    sizes = pairs.groupBy("file_id", "chain").count().where(F.col("count") > CHAIN).select("file_id", "chain", F.lit(True).alias("_long"))
    if sizes.isEmpty():
        return _in_order(pairs)
    marked = cut(pairs.join(sizes, ["file_id", "chain"], "left"))
    return _in_order(marked.where("_long IS NULL")).union(_in_rounds(marked.where("_long").select("file_id", "pair")))


def _in_order(pairs: DataFrame) -> DataFrame:
    """Each chain's pairs, at most CHAIN, gone through in their order."""
    lists = pairs.groupBy("file_id", "chain").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    start = F.expr("named_struct('last', CAST(NULL AS BIGINT), 'used', CAST(array() AS array<bigint>), 'out', CAST(array() AS array<struct<p_ord:bigint,g_ord:bigint>>))")

    def step(acc: Column, x: Column) -> Column:
        free = ~F.coalesce(acc["last"] == x["p_ord"], F.lit(False)) & ~F.array_contains(acc["used"], x["g_ord"])
        taken = F.struct(x["p_ord"].alias("last"), F.array_append(acc["used"], x["g_ord"]).alias("used"), F.array_append(acc["out"], F.struct(x["p_ord"].alias("p_ord"), x["g_ord"].alias("g_ord"))).alias("out"))
        return F.when(free, taken).otherwise(acc)

    return lists.select("file_id", F.explode(F.aggregate("pairs", start, step, lambda acc: acc["out"])).alias("m")).select("file_id", "m.p_ord", "m.g_ord")


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """(file_id, pair): pairs that come first at both their events are taken until none is left."""
    left, found = cut(pairs.select("file_id", "pair", F.col("pair.p_ord").alias("p_ord"), F.col("pair.g_ord").alias("g_ord"))), None
    while not left.isEmpty():
        firsts = [left.groupBy("file_id", e).agg(F.min("pair").alias("pair")) for e in ("p_ord", "g_ord")]
        taken = cut(firsts[0].select("file_id", "pair").intersect(firsts[1].select("file_id", "pair")).select("file_id", "pair.p_ord", "pair.g_ord"))
        found = taken if found is None else found.union(taken)
        for e in ("p_ord", "g_ord"):
            left = left.join(taken.select("file_id", e), ["file_id", e], "left_anti")
        left = cut(left)
    return found if found is not None else pairs.select("file_id", "pair.p_ord", "pair.g_ord")


def flagged(preds: DataFrame, gts: DataFrame, matcher) -> DataFrame:
    """preds with is_tp."""
    hits = greedy_matches(preds, gts, matcher).select("file_id", F.col("p_ord").alias("ord"), F.lit(True).alias("_hit"))
    return preds.join(hits, ["file_id", "ord"], "left").withColumn("is_tp", F.coalesce("_hit", F.lit(False))).drop("_hit")
