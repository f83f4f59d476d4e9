"""The rendered recordings hold every user and every event, and so do the queries over them."""

import duckdb
import numpy as np
import pytest

from tidemark.plans import catalog


@pytest.fixture
def events(sf):
    rows = duckdb.sql(f"SELECT CAST(user_id AS VARCHAR), list(value ORDER BY value) FROM '{sf}/events.parquet' GROUP BY ALL").fetchall()
    return dict(rows)


def test_every_event_is_rendered(spark, sf, events):
    made = list(catalog._render(catalog._tones(spark, sf).toArrow().to_batches()))
    ids = [b.column(0)[0].as_py() for b in made]
    assert len(ids) == len(events) and set(ids) == set(events)
    for file_id, b in zip(ids, made, strict=True):
        x, v = b.column(2)[0].values.to_numpy(), events[file_id]
        assert b.num_rows == 1 and b.column(1)[0].as_py() == 16000 and len(x) == round(16000 * (0.4 + 1.4 * len(v)))
        for k, value in enumerate(v):
            a = int(16000 * (0.5 + 1.4 * k))
            top = np.abs(np.fft.rfft(x[a : a + 6400])).argmax() * 2.5
            assert abs(top - (2000 + 8 * value)) <= 2.5
            assert np.abs(x[a - 1600 : a]).max() < 0.05 < np.abs(x[a : a + 6400]).max()


def test_detectors_reach_every_event(spark, sf, events):
    rows = catalog.QUERIES["detect_spectral_entropy"](spark, sf).collect()
    assert {r.file_id for r in rows} == set(events) and {r.status for r in rows} == {"ok"}
    for file_id, v in events.items():
        spans = [(r.onset_s, r.offset_s) for r in rows if r.file_id == file_id]
        for k in range(len(v)):
            assert any(a < 0.9 + 1.4 * k and b > 0.5 + 1.4 * k for a, b in spans), (file_id, k)
    windows = catalog.QUERIES["score_windows"](spark, sf).collect()
    assert len(windows) == sum(max(1, round(16000 * (0.4 + 1.4 * len(v))) // 32000) for v in events.values())


def test_recordings_made_by_stretches_are_those_made_whole():
    import pyarrow as pa

    for file_id, v in (("7", [0.0, 3.25, 560.21]), ("none", []), ("long", [float(k) for k in range(120)])):
        batch = pa.RecordBatch.from_arrays([pa.array([file_id]), pa.array([v], pa.list_(pa.float64()))], names=["file_id", "v"])
        x = 0.003 * np.random.default_rng([len(file_id), *file_id.encode()]).standard_normal(round(16000 * (0.4 + 1.4 * len(v))))
        for k, value in enumerate(v):
            a = int(16000 * (0.5 + 1.4 * k))
            x[a : a + 6400] += 0.4 * np.sin(2 * np.pi * (2000 + 8 * value) * np.arange(6400) / 16000)
        assert np.array_equal(next(catalog._render([batch])).column(2)[0].values.to_numpy(), x.astype(np.float32))
