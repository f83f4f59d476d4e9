"""Ties between channels are those of exact sums, whatever the rows' order and the column's type."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import provenance

# by cut: the files' sums are equal, but of doubles (0.6 + 0.7) + 0.8 is less than 0.5 + 0.8 + 0.8
PEAKS = [("a", 0.6), ("a", 0.7), ("a", 0.8), ("b", 0.5), ("b", 0.8), ("b", 0.8)]


@pytest.fixture(params=["double", "decimal(12,4)"])
def confident(spark, request):
    rows = [("s", "t", f"{k}", file, float(k), peak, k) for k, (file, peak) in enumerate(PEAKS)]
    schema = "species string, tape_id string, cut_file string, master_file string, offset_s double, ncc_peak double, ord long"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return df.withColumn("ncc_peak", df["ncc_peak"].cast(request.param))


def test_equal_sums_go_to_the_first_seen(confident):
    assert (0.6 + 0.7) + 0.8 < (0.5 + 0.8) + 0.8
    assert [(r.master_file, r.n) for r in provenance.canonical_channel(confident).collect()] == [("a", 3)]


def test_offsets_stand_on_the_first_seen_of_equal_sums(confident):
    raw = confident.withColumns({"status": F.lit("ok"), "master_file": F.lit("a"), "offset_s": F.col("offset_s") + 100})
    got = provenance.offsets(confident, raw, provenance.canonical_channel(confident)).collect()
    assert {(r.cut_file, r.canon, r.on_s) for r in got} == {(str(k), "a", k + 100.0) for k in range(len(PEAKS))}


def test_votes_are_counted_once_for_offsets(spark, sf):
    from tidemark.plans import catalog

    plan = catalog.QUERIES["offset_fallback"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # raw rows alone: confident cuts are read from what the vote left


def test_raw_rows_of_other_cuts_change_no_offsets(confident):
    raw = confident.withColumns({"status": F.lit("ok"), "master_file": F.lit("a"), "offset_s": F.col("offset_s") + 100})
    some = confident.where("ord >= 2")
    later = raw.where("ord = 3").withColumns({"ord": F.lit(9).cast("long"), "offset_s": F.lit(7.0)})  # the last row counts, if it is ok
    failed = later.withColumns({"ord": F.lit(10).cast("long"), "offset_s": F.lit(8.0), "status": F.lit("no_corr")})
    got = provenance.offsets(some, raw.union(later).union(failed), provenance.canonical_channel(confident)).collect()
    assert {(r.cut_file, r.on_s) for r in got} == {("2", 102.0), ("3", 7.0), ("4", 104.0), ("5", 105.0)} and len(got) == 4
