"""Where cuts come from: channels of a recording, agreement between channels, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOORS = [k / 10 for k in range(10)]


def channels(cuts: DataFrame, masters: DataFrame) -> DataFrame:
    """cuts (species, tape_id, cut_base, cut_sr) x masters (species, tape_id, path, stem, prefers_high, rank, ord) ->
    the channels of the recording whose stem is the longest that the cut's name begins with, numbered from 1 by how
    well they suit the cut's band, then rank, then ord."""
    pairs = cuts.join(masters, ["species", "tape_id"]).where((F.col("stem") != "") & F.col("cut_base").startswith(F.col("stem")))
    own = Window.partitionBy("species", "tape_id", "cut_base")
    longest = pairs.withColumn("_n", F.length("stem")).withColumn("_m", F.max("_n").over(own)).where("_n = _m").drop("_n", "_m")
    mismatch = (F.col("prefers_high") != (F.col("cut_sr") > 48000)).cast("int")
    return longest.withColumn("choice", F.row_number().over(own.orderBy(mismatch, "rank", "ord")))


def orphans(cuts: DataFrame, masters: DataFrame) -> DataFrame:
    """Cuts for which no recording of their tape has a stem that their name begins with."""
    found = cuts.join(masters, ["species", "tape_id"]).where((F.col("stem") != "") & F.col("cut_base").startswith(F.col("stem"))).select("species", "tape_id", "cut_base").distinct()
    return cuts.join(found, ["species", "tape_id", "cut_base"], "left_anti").withColumn("status", F.lit("no_master"))


def pending(cuts: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("species", "cut_file")) -> DataFrame:
    """Cuts without a row in done."""
    return cuts.join(done.select(*keys).distinct(), list(keys), "left_anti")


def agreement(rows: DataFrame, min_ncc: float = 0.5, tol: float = 0.05, keys: tuple[str, ...] = ("species", "cut_file")) -> DataFrame:
    """Qualifying channel rows with n_agree, the number of them (itself included) within tol of their offset."""
    by = ", ".join(f"`{k}`" for k in keys)
    # SQL, as the DataFrame API takes whole numbers only for the limits of a range
    near = f"count(*) OVER (PARTITION BY {by} ORDER BY offset_s RANGE BETWEEN CAST({tol!r} AS DOUBLE) PRECEDING AND CAST({tol!r} AS DOUBLE) FOLLOWING)"
    return rows.where((F.col("status") == "ok") & (F.coalesce("ncc_peak", F.lit(0.0)) >= min_ncc)).withColumn("offset_s", F.coalesce("offset_s", F.lit(0.0))).withColumn("n_agree", F.expr(near))


def consensus(rows: DataFrame, min_ncc: float = 0.5, tol: float = 0.05, keys: tuple[str, ...] = ("species", "cut_file")) -> DataFrame:
    """One row per cut from its channel rows (keys, ord, tape_id, master_file, offset_s, ncc_peak, status, ...).

    Of the qualifying rows the first one with the most rows within tol anchors the largest cluster; the cluster's row
    with the highest ncc_peak (first of equals) stands for the cut. Status: ok_single with one qualifying row, ok with
    a cluster of two or more, else no_consensus; without qualifying rows no_match (offsets blank) if any was ok, else
    the first row's status."""
    # Everything is a window over the cut's rows, so they are shuffled once.
    by = ", ".join(f"`{k}`" for k in keys)
    own = Window.partitionBy(*keys)
    ncc = F.coalesce("ncc_peak", F.lit(0.0))
    good = (F.col("status") == "ok") & (ncc >= min_ncc)
    out = rows.withColumn("_o", F.when(good, F.coalesce("offset_s", F.lit(0.0))))
    near = f"count(_o) OVER (PARTITION BY {by} ORDER BY _o RANGE BETWEEN CAST({tol!r} AS DOUBLE) PRECEDING AND CAST({tol!r} AS DOUBLE) FOLLOWING)"
    out = out.withColumn("_near", F.when(F.col("_o").isNotNull(), F.expr(near)))
    first = F.min(F.when(F.col("_o").isNotNull(), F.struct((-F.col("_near")).alias("n"), "ord", "_o"))).over(own)
    out = out.withColumns({"n_chan": F.count("*").over(own), "n_qual": F.count("_o").over(own), "_any": F.max(F.col("status") == "ok").over(own), "_first": first})
    inside = F.coalesce(F.abs(F.col("_o") - F.col("_first._o")) <= tol, F.lit(False))
    # the cluster's best row; without a cluster the cut's first one
    place = F.row_number().over(own.orderBy(F.col("_in").desc(), F.when(F.col("_in"), ncc).desc(), "ord"))
    out = out.withColumn("_in", inside).withColumn("_r", place).where("_r = 1")
    n_agree = F.coalesce(-F.col("_first.n"), F.lit(0))
    blank = (F.col("n_qual") == 0) & F.col("_any")
    status = F.when(F.col("n_qual") == 1, "ok_single").when(n_agree >= 2, "ok").when(F.col("n_qual") > 0, "no_consensus").when(F.col("_any"), "no_match").otherwise(F.col("status"))
    kept = {"offset_s": F.coalesce("_o", "offset_s")}
    for c in ("offset_s", "end_s", "ncc_peak", "peak_ratio"):
        if c in rows.columns:
            kept[c] = F.when(~blank, kept.get(c, F.col(c)))
    return out.withColumns({**kept, "n_agree": n_agree, "status": status}).select(*rows.columns, "n_chan", "n_qual", "n_agree")


def consensus_sweep(rows: DataFrame, tol: float = 0.05, keys: tuple[str, ...] = ("species", "cut_file")) -> DataFrame:
    """For each floor 0.0 to 0.9: n_ok, n_single and the distinct (species, tape) of ok cuts."""
    floors = rows.sparkSession.createDataFrame([(f,) for f in FLOORS], "floor double")
    spread = rows.crossJoin(F.broadcast(floors))  # ten rows
    spread = spread.withColumn("ncc_peak", F.when(F.coalesce("ncc_peak", F.lit(0.0)) >= F.col("floor"), F.coalesce("ncc_peak", F.lit(0.0))).otherwise(F.lit(-1.0)))
    found = consensus(spread, 0.0, tol, (*keys, "floor"))
    tape = F.when(F.col("status") == "ok", F.struct("species", "tape_id"))
    return found.groupBy("floor").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "ok_single").alias("n_single"), F.countDistinct(tape).alias("n_tapes"))


def status_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))


def species_summary(found: DataFrame) -> DataFrame:
    """Cuts, ok cuts and distinct tapes with an ok cut, for species that have one."""
    ok = F.col("status") == "ok"
    return found.groupBy("species").agg(F.count("*").alias("n_cuts"), F.count_if(ok).alias("n_ok"), F.countDistinct(F.when(ok, F.col("tape_id"))).alias("n_tapes")).where("n_ok > 0")


def canonical_channel(confident: DataFrame) -> DataFrame:
    """(species, tape_id, master_file): the file most cuts of a tape are represented by; ties by summed ncc_peak to four
    decimals, then by the first seen (column ord)."""
    # decimals: sums of doubles depend on the rows' order, and equal ones would differ in their last bits
    ncc = F.coalesce(F.col("ncc_peak").try_cast("decimal(28,10)"), F.lit(0))
    per = confident.groupBy("species", "tape_id", "master_file").agg(F.count("*").alias("n"), F.round(F.sum(ncc), 4).alias("ncc_sum"), F.min("ord").alias("first_ord"))
    order = Window.partitionBy("species", "tape_id").orderBy(F.desc("n"), F.desc("ncc_sum"), "first_ord")
    return per.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def offsets(confident: DataFrame, raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """Confident cuts with on_s: the offset on the tape's canonical channel (the last such ok row), else their own.

    Rows of raw that are of no confident cut go before anything is sorted; confident should be cheap to read twice."""
    last = Window.partitionBy("species", "cut_file", "master_file").orderBy(F.desc("ord"))
    known = raw.join(confident.select("species", "cut_file"), ["species", "cut_file"], "left_semi").where("status = 'ok'").withColumn("_r", F.row_number().over(last)).where("_r = 1").select("species", "cut_file", F.col("master_file").alias("canon"), F.col("offset_s").alias("canon_s"))
    named = confident.join(canonical.select("species", "tape_id", F.col("master_file").alias("canon")), ["species", "tape_id"])
    return named.join(known, ["species", "cut_file", "canon"], "left").withColumn("on_s", F.coalesce("canon_s", "offset_s"))
