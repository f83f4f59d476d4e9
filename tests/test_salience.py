"""Medians and runs of salience curves need each curve once."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.operators import islands


def curves() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(4)
    return {"even": rng.random(200).round(2), "odd": rng.random(201).round(2), "flat": np.ones(30), "one": np.ones(1), "spike": np.r_[np.zeros(20), 5.0]}


def test_events_are_those_of_the_kernel_from_one_pass(spark):
    made, read = curves(), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(f, i * 0.5, float(v)) for f, x in made.items() for i, v in enumerate(x)], "file_id string, time_s double, value double")

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = islands.salience_events(df.mapInArrow(count, df.schema), ["file_id"], 1.0, 0.6, 0.5).orderBy("file_id", "onset_s").collect()
    assert read.value == sum(map(len, made.values()))
    for f, x in made.items():
        want = dsp.curve_events(np.arange(len(x)) * 0.5, x, 1.0, 0.6, 0.5)
        assert np.allclose([(r.onset_s, r.offset_s, r.score) for r in rows if r.file_id == f], want), f
    limits = {r.file_id: r for r in islands.salience_threshold(df.select("file_id", F.col("time_s"), "value"), ["file_id"]).collect()}
    for f, x in made.items():
        assert np.isclose(limits[f].med, np.median(x)) and np.isclose(limits[f].mad, np.median(np.abs(x - np.median(x))))
    assert {r.file_id: r.dt for r in islands.frame_spacing(df, ["file_id"]).collect()} == {"even": 0.5, "odd": 0.5, "flat": 0.5, "one": 0.0, "spike": 0.5}
