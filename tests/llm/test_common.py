"""Shared folders, slices of batches, fresh names."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from tidemark.llm import common


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


def test_slices_are_bounded_in_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * 20 + ["y"] * 3000)], names=["t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(100)])))
    assert sum(p.num_rows for p in parts) == 3020 + 2920 and max(p.num_rows for p in parts) <= common.SLICE_ROWS
    big = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * 40)], names=["t"])
    assert max(p.num_rows for p in common.slices(iter([big]))) <= 4


def test_fresh_names_clash_with_none():
    assert common.fresh(["a", "B", "b_"], "b", "c", "c") == ["b__", "c", "c_"]


def test_folders_are_removed(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    common.remove(spark, f"file://{tmp_path}/t")
    assert not (tmp_path / "t").exists()
