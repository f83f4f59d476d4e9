"""Command line: benchmark, score, select, align, consensus, build-clips, build-tapes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.intervals import master_name, safe_id
from tidemark.operators import alignment, detectors, evalset, grid, metrics, provenance
from tidemark.operators.matching import CollarMatcher, IoUMatcher
from tidemark.sources import audio, tables


def benchmark(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Detectors on a folder of recordings against a table of true events; a row per detector and matcher."""
    files = audio.catalogue(spark, a.audio_dir)
    if files.isEmpty():
        raise SystemExit(2)
    truth = tables.selection_table(spark, a.gt)
    names = sorted(detectors.REGISTRY) if a.detectors.strip().lower() == "all" else [n.strip() for n in a.detectors.split(",") if n.strip()]
    known = audio.durations(files).select("file_id", F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"))
    # a file that cannot be read is left out, as a header told
    readable = files.join(audio.durations(files).where("status = 'ok'").select("file_id"), "file_id", "left_semi")
    found = detectors.detect_files(readable, names, None, a.target_sr, a.chunk_s, a.overlap_s).persist()
    failed = found.where("status <> 'ok'").first()
    if failed:
        raise RuntimeError(f"{failed.detector} on {failed.file_id}: {failed.status}")
    rows = []
    for n in names:
        own = found.where(F.col("detector") == n)
        if a.out_dir:
            tables.write_selection_table(own, f"{a.out_dir}/preds/{n}")
        preds = own.select("file_id", "ord", "onset_s", "offset_s", "score")
        for m in (CollarMatcher(a.onset_collar, a.offset_collar, a.offset_fraction), IoUMatcher(a.iou_threshold)):
            rows.append(metrics.evaluate(preds, truth, m, known).select(F.lit(n).alias("detector"), "*"))
    out = tables.merged(rows)
    if a.out_dir:
        out.write.mode("overwrite").parquet(f"{a.out_dir}/results")
        tables.write_table(tables.result_text(spark.read.parquet(f"{a.out_dir}/results")), f"{a.out_dir}/results.tsv")
        found.unpersist()
        return spark.read.parquet(f"{a.out_dir}/results")
    return out


def score(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    listed = tables.recording_list(spark, a.wav_scp)
    rank = Window.partitionBy().orderBy("ord")
    if a.num_shards > 1:
        # the list of recordings is short: its order is all that this window sees
        listed = listed.withColumn("_k", F.row_number().over(rank) - 1).where(F.pmod("_k", F.lit(a.num_shards)) == a.shard_id)
    rate = a.target_sr if a.target_sr > 0 else None
    files = listed.select(F.col("wav_id").alias("file_id"), "path").repartition(max(1, spark.sparkContext.defaultParallelism))
    out = detectors.score_files(files, a.detector, a.window_s, rate)
    tables.write_scored_grid(out, a.out)
    return out


def select(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    kept = grid.select_top(tables.scored_grid(spark, a.scored), a.keep_frac, a.rank_by, a.scope)
    tables.write_segments(kept, a.out_segments)
    return kept


def align(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    masters = audio.corpus_tree(spark, a.data_root, "master_tapes").withColumnRenamed("folder", "tape_id")
    masters = masters.withColumns(master_name(F.col("file"))).withColumn("ord", F.monotonically_increasing_id())
    cuts = audio.corpus_tree(spark, a.data_root, "cut_tapes")
    cuts = cuts.withColumn("tape_id", F.substring("file", 1, 5)).withColumn("cut_base", F.regexp_replace("file", r"\.[^.]*$", ""))
    for name in ("species", "tape"):
        if getattr(a, name):
            cuts = cuts.where(F.col({"species": "species", "tape": "tape_id"}[name]) == getattr(a, name))
    again = not a.no_resume and tables.exists(spark, a.out)
    if again:
        done = tables.alignments(spark, a.out).select("species", F.col("cut_file").alias("file"))
        cuts = provenance.pending(cuts, done, ("species", "file"))
    if a.limit:
        cuts = cuts.limit(a.limit)
    # the channel rule asks for a cut's rate: headers tell it
    rates = audio.durations(cuts.select(F.col("path").alias("file_id"), "path")).select(F.col("file_id").alias("path"), F.coalesce("sr", F.lit(0)).alias("cut_sr"))
    cuts = cuts.join(rates, "path").withColumn("cut_file", F.col("file"))
    pairs = provenance.channels(cuts.select("species", "tape_id", "cut_base", "cut_file", "cut_sr", F.col("path").alias("cut_path")), masters.select("species", "tape_id", F.col("path").alias("master_file"), "stem", "prefers_high", "rank", "ord"))
    out = alignment.align_files(pairs, a.corr_rate, a.mode, a.env_rate)
    lost = provenance.orphans(cuts.select("species", "tape_id", "cut_base", "cut_file", "cut_sr"), masters.select("species", "tape_id", "stem"))
    out = tables.merged([out, lost.select("species", "cut_file", "tape_id", "cut_sr", "status")])
    tables.write_table(out, a.out, partition_by=("species",), mode="append" if again else "overwrite")
    return tables.alignments(spark, a.out)


def consensus(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = tables.alignments(spark, a.raw)
    if a.sweep:
        return provenance.consensus_sweep(rows, a.tol)
    out = provenance.consensus(rows, a.min_ncc, a.tol)
    if a.out:
        tables.write_table(out.drop("ord"), a.out)
    return out


def build_clips(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Positive clips around annotated events and as many event-free ones, with the truth within each."""
    events = tables.annotations(spark, f"{a.dump}/{a.config}/annotations.tsv").withColumnRenamed("master_id", "master")
    paths = audio.catalogue(spark, f"{a.dump}/{a.config}/soundscapes", first=True).withColumnRenamed("file_id", "master")
    known = audio.durations(paths.withColumnRenamed("master", "file_id")).where("status = 'ok'").select(F.col("file_id").alias("master"), F.col("duration_s").alias("total_s"))
    long = events.join(known.where(F.col("total_s") > a.clip_s), "master").withColumn("key", F.concat_ws("|", "master", "start_s", "end_s", "ebird_code"))
    anchors = evalset.stratified_cap(long, a.max_per_species, a.max_positives, "ebird_code", ["key"], a.seed)
    placed = evalset.place_clips(anchors.withColumn("onset_s", F.col("start_s")).withColumn("dur_s", F.col("end_s") - F.col("start_s")), a.clip_s, a.margin_s, "key", a.seed)
    placed = placed.withColumn("clip_id", F.concat(safe_id(F.col("master")), F.lit("__p"), F.substring(F.md5("key"), 1, 12))).withColumn("t1", F.col("t0") + a.clip_s).persist()
    spans = evalset.events_in_windows(placed.select(F.col("clip_id").alias("win_id"), "master", "t0", "t1"), events)
    needs = placed.groupBy("master", "total_s").agg((F.count("*") * a.neg_per_pos).cast("int").alias("n"))
    free = evalset.draw_negatives(needs, events, a.clip_s, a.margin_s, a.seed).withColumn("clip_id", F.concat(safe_id(F.col("master")), F.lit("__n"), F.lpad(F.col("k").cast("string"), 3, "0"))).withColumn("t1", F.col("t0") + a.clip_s)
    wanted = placed.select("clip_id", "master", "t0", "t1", F.lit("event").alias("label"), F.col("ebird_code").alias("species")).unionByName(free.select("clip_id", "master", "t0", "t1", F.lit("none").alias("label"), F.lit("").alias("species")))
    cut = audio.clips(wanted.join(paths, "master").select("clip_id", "path", "t0", "t1"), a.target_sr)
    written = audio.write_clips(cut.where("status = 'ok'"), f"{a.out}/clips")
    tables.write_truth(spans.withColumnRenamed("win_id", "file_id"), f"{a.out}/gt.tsv")
    share = evalset.density(spans, a.clip_s).withColumnRenamed("win_id", "clip_id")
    out = wanted.join(written, "clip_id").join(share, "clip_id", "left").fillna(0.0, ["density"])
    tables.write_table(out, f"{a.out}/metadata.csv", sep=",")
    _card(spark, a, f"Clips of {a.config}", wanted.withColumnRenamed("master", "recording"))
    placed.unpersist()
    return out


def _card(spark: SparkSession, a: argparse.Namespace, title: str, clips: DataFrame) -> None:
    """The data set's card, from its clips (label, species, recording)."""
    n = {r.label: r for r in clips.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("recording").alias("recordings"), F.countDistinct("species").alias("species")).collect()}
    some = lambda label, what: n[label][what] if label in n else 0
    facts = {
        "clips/*.wav": f"{some('event', 'n') + some('none', 'n')} mono clips of {a.clip_s:g} s at {a.target_sr} Hz", "gt.tsv": "event spans within the clips, in seconds", "metadata.csv": "one row per clip",
        "clips with events (label event)": f"{some('event', 'n')}, from {some('event', 'recordings')} recordings, {some('event', 'species')} species", "clips without (label none)": f"{some('none', 'n')}, from the same recordings",
    }
    notes = {
        "How it was made": [f"A clip is laid around an event at a place drawn from seed {a.seed}, {a.margin_s:g} s from its ends at least where it fits.", f"Clips without events keep {a.margin_s:g} s from every known event."],
        "What to mind": ["Clips without events may hold some that nobody marked, so precision is a lower bound.", f"What lies above {a.target_sr // 2} Hz is lost.", "Sources ask for attribution by their own terms."],
        "Scoring": [f"python -m tidemark.cli benchmark --audio-dir clips --gt gt.tsv --detectors all --target-sr {a.target_sr}"],
    }
    tables.write_card(spark, f"{a.out}/card", title, facts, notes)


def build_tapes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Clips from tapes: each confidently located cut on its tape's canonical channel, with the cut alone as truth,
    and event-free clips of the same tapes."""
    confident = tables.alignments(spark, a.confident).where("status = 'ok'")
    canon = provenance.canonical_channel(confident)
    located = provenance.offsets(confident, tables.alignments(spark, a.raw), canon).withColumn("master", F.concat_ws("/", F.lit(a.root), F.lit("master_tapes"), "species", "tape_id", "canon"))
    located = located.withColumn("off_s", F.col("on_s") + F.col("cut_dur_s"))
    known = audio.durations(located.select(F.col("master").alias("file_id"), F.col("master").alias("path")).distinct()).where("status = 'ok'").select(F.col("file_id").alias("master"), F.col("duration_s").alias("total_s"))
    wanted = located.where(F.col("cut_dur_s") <= a.max_event_s).join(known, "master").withColumn("key", F.concat_ws("|", "species", "cut_file"))
    placed = evalset.place_clips(wanted.withColumn("onset_s", F.col("on_s")).withColumn("dur_s", F.col("cut_dur_s")), a.clip_s, a.margin_s, "key", a.seed)
    # names carry the species: tapes of two species may share a number
    placed = placed.withColumn("clip_id", safe_id(F.concat_ws("_", "species", F.regexp_replace("cut_file", r"\.[^.]*$", "")))).withColumn("t1", F.col("t0") + a.clip_s).persist()
    events = located.select("master", F.col("on_s").alias("start_s"), F.col("off_s").alias("end_s"))
    needs = placed.groupBy("master", "total_s").agg((F.count("*") * a.neg_per_pos).cast("int").alias("n"))
    free = evalset.draw_negatives(needs, events, a.clip_s, a.margin_s, a.seed).join(placed.select("master", "species", "tape_id").distinct(), "master")
    free = free.withColumn("clip_id", safe_id(F.concat_ws("_", F.lit("neg"), "species", "tape_id", F.lpad(F.col("k").cast("string"), 2, "0")))).withColumn("t1", F.col("t0") + a.clip_s)
    columns = ("clip_id", "species", "tape_id", F.col("master").alias("path"), "t0", "t1")
    clips = placed.select(*columns, F.lit("event").alias("label"), "rel_on", "rel_off").unionByName(free.select(*columns, F.lit("none").alias("label")), allowMissingColumns=True)
    written = audio.write_clips(audio.clips(clips, a.target_sr).where("status = 'ok'"), f"{a.out}/clips")
    tables.write_truth(placed.select(F.col("clip_id").alias("file_id"), F.col("rel_on").alias("onset_s"), F.col("rel_off").alias("offset_s")), f"{a.out}/gt.tsv")
    out = clips.drop("path").join(written, "clip_id")
    tables.write_table(out, f"{a.out}/metadata.csv", sep=",")
    _card(spark, a, "Clips of tapes", clips.withColumnRenamed("path", "recording"))
    placed.unpersist()
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(work, **options):
        c = sub.add_parser(work.__name__.replace("_", "-"), help=work.__doc__)
        c.set_defaults(work=work)
        for name, default in options.items():
            flag = "--" + name.replace("_", "-")
            if default is ...:
                c.add_argument(flag, required=True)
            elif isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(default, type):
                c.add_argument(flag, type=default, default=None)
            else:
                c.add_argument(flag, type=type(default), default=default)

    command(benchmark, audio_dir=..., gt=..., detectors="all", out_dir=str, target_sr=int, chunk_s=float, overlap_s=0.0, onset_collar=0.2, offset_collar=0.2, offset_fraction=0.2, iou_threshold=0.5)
    command(score, wav_scp=..., out=..., detector="maad_roi", target_sr=48000, window_s=10.0, num_shards=1, shard_id=0)
    command(select, scored=..., out_segments=..., keep_frac=0.5, rank_by="sum_score", scope="per_recording")
    command(align, data_root=..., out=..., species=str, tape=str, limit=0, no_resume=False, mode="wave", env_rate=1000, corr_rate=48000)
    command(consensus, raw=..., min_ncc=0.5, tol=0.05, out=str, sweep=False)
    command(build_tapes, confident=..., raw=..., root=..., out=..., clip_s=10.0, max_event_s=6.0, margin_s=1.0, neg_per_pos=1, target_sr=48000, seed=0)
    command(build_clips, dump=..., config=..., out=..., clip_s=10.0, margin_s=1.0, neg_per_pos=1, target_sr=32000, max_positives=400, max_per_species=50, seed=0)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    a.work(spark, a).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
