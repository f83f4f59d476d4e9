import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions import intervals as iv
from tidemark.operators import evalset, grid, islands, provenance
from tidemark.sources import audio, tables
from tidemark.streaming import windows

SR = 16000


def rendered(seconds, spans, seed=0):
    x = 0.003 * np.random.default_rng(seed).standard_normal(int(seconds * SR))
    for a, b in spans:
        t = np.arange(int(a * SR), int(b * SR))
        x[t] += 0.5 * np.sin(2 * np.pi * 3000 * t / SR)
    return x


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "audio" / "deep").mkdir(parents=True)
    (tmp_path / "audio" / "a b.wav").write_bytes(audio.wav_bytes(rendered(25, [(3.0, 3.4), (22.5, 23.0)]), SR))
    (tmp_path / "audio" / "deep" / "c.wav").write_bytes(audio.wav_bytes(rendered(6, [(1.0, 1.8)], 1), SR))
    (tmp_path / "audio" / "d.flac").write_bytes(b"fLaC....")
    return tmp_path


def test_catalogue_durations_decode(spark, folder):
    files = audio.catalogue(spark, str(folder / "audio"))
    assert {r.file_id for r in files.collect()} == {"a b", "c", "d"}
    got = {r.file_id: r for r in audio.durations(files).collect()}
    assert got["a b"].duration_s == 25.0 and got["d"].status == "unsupported_format" and got["d"].duration_s is None
    whole = {r.file_id: r for r in audio.decode(files, 8000).collect()}
    assert len(whole["c"].samples) == 48000 and whole["c"].sr == 8000
    (folder / "audio" / "deep" / "a b.wav").write_bytes(audio.wav_bytes(np.zeros(10), SR))
    with pytest.raises(ValueError):
        audio.catalogue(spark, str(folder / "audio"))


def test_region_and_clips(spark, folder):
    path = str(folder / "audio" / "deep" / "c.wav")
    x, _ = audio.read(path)
    part = audio.region(path, 5.5, 7.0, SR)
    assert len(part) == 24000 and np.array_equal(part[:8000], x[88000:96000]) and not part[8000:].any()
    wanted = spark.createDataFrame([("k", path, 1.0, 2.0)], "clip_id string, path string, t0 double, t1 double")
    out = audio.write_clips(audio.clips(wanted, SR), str(folder / "clips")).first()
    back, sr = audio.read(out.path)
    assert out.status == "ok" and sr == SR and np.abs(back - x[16000:32000]).max() < 1e-4


def test_selection_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 0.0, 1.0, 0.9, "d"), ("r2", 10.0, 11.5, 1e-9, "d")], "file_id string, onset_s double, offset_s double, score double, detector string")
    tables.write_selection_table(rows, str(tmp_path / "t"))
    got = {r.file_id: r for r in tables.selection_table(spark, str(tmp_path / "t")).collect()}
    assert got["r1"].score == 0.9 and got["r2"].score == 0.0 and got["r2"].offset_s == 11.5
    (tmp_path / "x.tsv").write_text("Filename\tonset\n" "a\t1\n")
    with pytest.raises(ValueError):
        tables.selection_table(spark, str(tmp_path / "x.tsv"))
    (tmp_path / "gt.tsv").write_text("onset\toffset\n0.5\t1\n")
    assert tables.selection_table(spark, str(tmp_path / "gt.tsv")).first().file_id == "gt.tsv"


def test_grid_files_and_selection(spark, tmp_path):
    rows = [("r-0", "r", 0.0, 10.0, 0, 0.0, 0.0), ("r-1", "r", 10.0, 20.0, 1, 2.0, 0.125), ("r-2", "r", 20.0, 30.0, 2, 3.0, 5.0), ("q-0", "q", 0.0, 10.0, 1, 1.0, 1234567.0)]
    df = spark.createDataFrame(rows, tables.GRID)
    tables.write_scored_grid(df, str(tmp_path / "g"))
    back = tables.scored_grid(spark, str(tmp_path / "g"))
    assert {r.seg_id: r.sum_score for r in back.collect()}["q-0"] == 1234570.0
    assert {r.seg_id for r in grid.select_top(back, 0.5, scope="global").collect()} == {"q-0", "r-2"}
    assert {r.seg_id for r in grid.select_top(back, 0.5).collect()} == {"q-0", "r-2"}
    assert {r.seg_id for r in grid.select_top(back, 0.01, "n_events", "global").collect()} == {"r-2"}
    tables.write_segments(back, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 4
    with pytest.raises(ValueError):
        grid.select_top(back, 0.5, scope="none")


def test_windows_of_short_recordings(spark):
    df = spark.createDataFrame([("a", 25.0), ("b", 4.0), ("c", 10.0)], "wav_id string, duration_s double")
    got = sorted((r.wav_id, r.start, r.end) for r in grid.grid_windows(df, 10.0).collect())
    assert got == [("a", 0.0, 10.0), ("a", 10.0, 20.0), ("b", 0.0, 4.0), ("c", 0.0, 10.0)]


def test_union_and_clip(spark):
    spans = spark.createDataFrame([("k", 3.0, 3.6), ("k", 0.0, 1.0), ("k", 3.5, 4.0)], "k string, onset_s double, offset_s double")
    assert sorted((r.onset_s, r.offset_s) for r in islands.interval_union(spans, ["k"]).collect()) == [(0.0, 1.0), (3.0, 4.0)]
    events = spark.createDataFrame([("m", 1.0, 1.4), ("m", 3.0, 3.6), ("m", 3.5, 4.0), ("m", 4.5, 9.0)], "master string, start_s double, end_s double")
    win = spark.createDataFrame([("w", "m", 0.5, 4.5)], "win_id string, master string, t0 double, t1 double")
    got = sorted((r.onset_s, r.offset_s) for r in evalset.events_in_windows(win, events).collect())
    assert np.allclose(got, [(0.5, 0.9), (2.5, 3.5)])


def test_bad_event_fails(spark):
    df = spark.createDataFrame([(2.0, 1.0)], "a double, b double")
    with pytest.raises(Exception, match="offset before onset"):
        df.select(iv.checked(F.col("a"), F.col("b"))).collect()


def test_flat_curve_and_single_frame(spark):
    rows = [("flat", float(k), 1.0) for k in range(5)] + [("one", 0.0, 3.0)]
    df = spark.createDataFrame(rows, "f string, time_s double, value double")
    t = {r.f: r for r in islands.salience_threshold(df, ["f"], 2.0).collect()}
    assert t["flat"].threshold == pytest.approx(1 + 2e-9)
    assert islands.salience_runs(df, ["f"], 0.0).where("f = 'one'").first().offset_s == 0.0


def test_consensus_by_hand(spark):
    schema = "species string, cut_file string, tape_id string, master_file string, offset_s double, end_s double, ncc_peak double, peak_ratio double, status string, ord long"
    rows = [
        ("s", "a", "t", "m1", 1.00, 2.0, 0.6, 2.0, "ok", 0), ("s", "a", "t", "m2", 1.04, 2.0, 0.9, 2.0, "ok", 1), ("s", "a", "t", "m3", 7.0, 8.0, 0.99, 2.0, "ok", 2),
        ("s", "b", "t", "m1", 1.0, 2.0, 0.7, 2.0, "ok", 0), ("s", "c", "t", "m1", 1.0, 2.0, 0.1, 2.0, "ok", 0), ("s", "d", "t", None, None, None, None, None, "no_master", 0),
        ("s", "e", "t", "m1", 1.0, 2.0, 0.7, 2.0, "ok", 0), ("s", "e", "t", "m2", 3.0, 2.0, 0.8, 2.0, "ok", 1),
    ]
    got = {r.cut_file: r for r in provenance.consensus(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "ok_single", "c": "no_match", "d": "no_master", "e": "no_consensus"}
    assert (got["a"].master_file, got["a"].n_agree, got["a"].n_qual, got["a"].n_chan) == ("m2", 2, 3, 3)
    assert got["c"].offset_s is None and got["e"].master_file == "m1"


def test_negatives_are_free_and_apart(spark):
    events = spark.createDataFrame([("m", 10.0, 20.0), ("m", 50.0, 52.0)], "master string, start_s double, end_s double")
    needs = spark.createDataFrame([("m", 100.0, 4), ("tiny", 5.0, 2)], "master string, total_s double, n int")
    got = sorted(r.t0 for r in evalset.draw_negatives(needs, events, 5.0, 1.0, 3).collect())
    assert len(got) == 4 and all(b - a >= 5 for a, b in zip(got, got[1:], strict=False))
    assert all(t + 6 <= 10 or t - 1 >= 20 for t in got) and all(t + 6 <= 50 or t - 1 >= 52 for t in got)
    assert got == sorted(r.t0 for r in evalset.draw_negatives(needs, events, 5.0, 1.0, 3).collect())


def test_labels_without_classes(spark):
    rows = [("a", "1", "2", "owl", None), ("b", "1", "2", None, ["7", "nocall", "jay"]), ("c", "2", "2", "owl", None), ("d", None, "2", "owl", None), ("e", "1", "2", "", None)]
    df = spark.createDataFrame(rows, "id string, start_time string, end_time string, ebird_code string, ebird_code_multilabel array<string>")
    assert sorted((r.id, r.code) for r in evalset.label_events(df).collect()) == [("a", "owl"), ("b", "jay")]


def test_streams(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:{s:02d}", float(d), 1.0 * s) for s, d in ((0, 5), (3, 4), (30, 2), (59, 1))]
    df = spark.createDataFrame(rows, "key string, t string, duration_s double, score double").select("key", F.to_timestamp("t").alias("ts"), "duration_s", "score")
    df.write.parquet(str(tmp_path / "in"))
    for name, out, n in (("w", windows.window_scores, 3), ("s", windows.stitched, 3)):
        q = out(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        batch = out(df)
        assert batch.count() == n
        if name == "w":
            assert spark.table(name).count() == batch.count()
    first = windows.stitched(df).orderBy("start").first()
    assert first.score == 3.0 and first.n == 2


def test_command_line(spark, folder, capsys):
    (folder / "audio" / "d.flac").unlink()
    (folder / "gt.tsv").write_text("file_id\tBegin Time (s)\tEnd Time (s)\na b\t3.0\t3.4\na b\t22.5\t23.0\nc\t1.0\t1.8\n")
    assert cli.main(["benchmark", "--audio-dir", str(folder / "audio"), "--gt", str(folder / "gt.tsv"), "--detectors", "spectral_entropy", "--out-dir", str(folder / "out")]) == 0
    got = spark.read.parquet(str(folder / "out" / "results"))
    assert got.count() == 2 and got.agg(F.max("recall")).first()[0] >= 2 / 3
    (folder / "wav.scp").write_text(f"r1 {folder}/audio/a b.wav\n\nr2 {folder}/audio/deep/c.wav\n")
    assert cli.main(["score", "--wav-scp", str(folder / "wav.scp"), "--out", str(folder / "scored"), "--detector", "spectral_entropy", "--target-sr", "0"]) == 0
    assert tables.scored_grid(spark, str(folder / "scored")).count() == 3
    assert cli.main(["select", "--scored", str(folder / "scored"), "--out-segments", str(folder / "seg")]) == 0
    assert spark.read.text(str(folder / "seg")).count() >= 1
    with pytest.raises(SystemExit):
        cli.main(["benchmark", "--audio-dir", str(folder / "out"), "--gt", str(folder / "gt.tsv")])


def test_build_clips_and_align(spark, folder):
    (folder / "HSN" / "soundscapes").mkdir(parents=True)
    (folder / "HSN" / "soundscapes" / "m1.wav").write_bytes((folder / "audio" / "a b.wav").read_bytes())
    (folder / "HSN" / "annotations.tsv").write_text("master_id\tstart_s\tend_s\tebird_code\nm1\t3.0\t3.4\tA\nm1\t22.5\t23\tB\nm9\t1\t2\tA\n")
    cli.main(["build-clips", "--dump", str(folder), "--config", "HSN", "--out", str(folder / "clips"), "--clip-s", "5", "--target-sr", "8000"])
    meta = spark.read.option("header", True).csv(str(folder / "clips" / "metadata.csv")).collect()
    assert sum(r.label == "event" for r in meta) == 2 and 1 <= sum(r.label == "none" for r in meta) <= 2
    for r in meta:
        assert len(audio.read(r.path)[0]) == 40000
    x, _ = audio.read(str(folder / "audio" / "a b.wav"))
    (folder / "master_tapes" / "sp" / "61025").mkdir(parents=True)
    (folder / "cut_tapes" / "sp" / "1961").mkdir(parents=True)
    (folder / "master_tapes" / "sp" / "61025" / "61025ch1.wav").write_bytes(audio.wav_bytes(x, SR))
    (folder / "cut_tapes" / "sp" / "1961" / "61025A1.wav").write_bytes(audio.wav_bytes(x[40_000:56_000], SR))
    (folder / "cut_tapes" / "sp" / "1961" / "99999A1.wav").write_bytes(audio.wav_bytes(x[:100], SR))
    cli.main(["align", "--data-root", str(folder), "--out", str(folder / "raw")])
    rows = {r.cut_file: r for r in spark.read.option("sep", "\t").option("header", True).csv(str(folder / "raw")).collect()}
    assert float(rows["61025A1.wav"].offset_s) == pytest.approx(2.5) and rows["99999A1.wav"].status == "no_master"
    cli.main(["consensus", "--raw", str(folder / "raw"), "--out", str(folder / "cons")])
    got = {r.cut_file: r.status for r in spark.read.option("sep", "\t").option("header", True).csv(str(folder / "cons")).collect()}
    assert got["61025A1.wav"] == "ok_single"
    cli.main(["align", "--data-root", str(folder), "--out", str(folder / "raw")])  # nothing is pending any more
    assert spark.read.option("sep", "\t").option("header", True).csv(str(folder / "raw")).count() == len(rows)
    ok = [("sp", "61025A1.wav", "61025", 1.0, "61025ch1.wav", 2.5, 3.5, 0.9, 3.0, "ok")]
    names = ("species", "cut_file", "tape_id", "cut_dur_s", "master_file", "offset_s", "end_s", "ncc_peak", "peak_ratio", "status")
    tables.write_table(spark.createDataFrame(ok, list(names)), str(folder / "confident"))
    cli.main(["build-tapes", "--confident", str(folder / "confident"), "--raw", str(folder / "confident"), "--root", str(folder), "--out", str(folder / "tapes"), "--clip-s", "5", "--target-sr", "8000"])
    meta = {r.label: r for r in spark.read.option("header", True).csv(str(folder / "tapes" / "metadata.csv")).collect()}
    assert set(meta) == {"event", "none"} and float(meta["event"].rel_off) - float(meta["event"].rel_on) == pytest.approx(1.0)
    assert len(audio.read(meta["none"].path)[0]) == 40000
