"""WAV recordings: catalogue, header-only durations, decoding, byte-range regions, clips.

Paths stay in the rows; a task opens a file through its file system and reads the bytes it needs, so a recording of
hours is never a single binary row."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dsp

HELD = 16 << 20
EXTENSIONS = ("wav", "flac", "ogg", "aif", "aiff")


def catalogue(spark: SparkSession, folder: str, first: bool = False) -> DataFrame:
    """(file_id, path) of the audio files beneath folder, by base name; two files of one name are an error, or the first
    path in order is taken."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*EXTENSIONS)).withColumn("file_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    if first:
        return found.groupBy("file_id").agg(F.min("path").alias("path"))
    same = found.groupBy("file_id").count().where("count > 1").first()
    if same:
        raise ValueError(f"more than one recording is named {same.file_id!r}")
    return found.select("file_id", "path")


def corpus_tree(spark: SparkSession, root: str, kind: str = "master_tapes") -> DataFrame:
    """(species, folder, file, path) of <root>/<kind>/<species>/<folder>/*.wav."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").load(f"{root}/{kind}/*/*/*.wav").select(F.element_at(parts, -3).alias("species"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "path")


def header(stream) -> dict:
    """rate, channels, bits, float, data (first byte), frames of a RIFF file."""
    riff = stream.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("unsupported_format")
    out: dict = {}
    at = 12
    while len(head := stream.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        at += 8
        if name == b"fmt ":
            body = stream.read(size)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            if kind not in (1, 3) or bits % 8 or not channels:
                raise ValueError("unsupported_format")
            out |= {"rate": rate, "channels": channels, "bits": bits, "float": kind == 3}
        elif name == b"data" and out:
            return out | {"data": at, "frames": size // (out["channels"] * out["bits"] // 8)}
        else:
            stream.seek(at + size + size % 2)
        at += size + size % 2
        stream.seek(at)
    raise ValueError("no audio data")


def samples(raw: bytes, h: dict) -> np.ndarray:
    """Mono float32 in [-1, 1), the mean of the channels."""
    bits = h["bits"]
    if h["float"]:
        x = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32) / np.float32(2 ** (bits - 1))
    return x.reshape(-1, h["channels"]).mean(1, dtype=np.float32)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; local paths may hold blanks, which no URI may."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(?://)?", "", path)
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    store, own = _located(path)
    return store.open_input_file(own)


def read(path: str, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
    """Frames [first, last) of a file, and its rate."""
    with _open(path) as f:
        h = header(f)
        wide = h["channels"] * h["bits"] // 8
        last = h["frames"] if last is None else min(last, h["frames"])
        f.seek(h["data"] + first * wide)
        raw = f.read(max(0, last - first) * wide)
    return samples(raw[: len(raw) // wide * wide], h), h["rate"]


class Recording:
    """An open WAV file, read by spans of frames at its own rate or another one."""

    def __init__(self, path: str, rate: int | None = None) -> None:
        self.stream = _open(path)
        try:
            self.header = header(self.stream)
        except BaseException:
            self.stream.close()
            raise
        self.own = self.header["rate"]
        self.rate = rate or self.own
        self.frames = dsp.resampled_length(self.header["frames"], self.own, self.rate)

    def __enter__(self) -> Recording:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def raw(self, first: int, last: int) -> np.ndarray:
        wide = self.header["channels"] * self.header["bits"] // 8
        self.stream.seek(self.header["data"] + first * wide)
        got = self.stream.read(max(0, min(last, self.header["frames"]) - first) * wide)
        return samples(got[: len(got) // wide * wide], self.header)

    def read(self, first: int, last: int) -> np.ndarray:
        return dsp.resample_span(self.raw, self.header["frames"], self.own, self.rate, first, min(last, self.frames))


def region(path: str, t0: float, t1: float, rate: int) -> np.ndarray:
    """[t0, t1) seconds at a rate, zeros beyond the ends, exactly round((t1 - t0) * rate) samples."""
    with _open(path) as f:
        own = header(f)["rate"]
    x, _ = read(path, max(0, int(np.rint(t0 * own))), max(0, int(np.rint(t1 * own))))
    x = dsp.resample(x, own, rate)
    want = int(np.rint((t1 - t0) * rate))
    return np.pad(x, (0, max(0, want - len(x))))[:want]


def _each(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """One output row per input row from work(*values) -> tuple; errors become the status of a row of nulls. Rows go out
    in batches of HELD bytes at most, or one row that is larger."""
    names = [c.strip().split()[0] for c in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            rows, held = [], 0
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                try:
                    row = (*work(*values), "ok")
                except (ValueError, OSError, struct.error) as e:
                    row = (values[0], *[None] * (len(names) - 2), str(e) if str(e) == "unsupported_format" else f"error:{type(e).__name__}:{e}"[:120])
                rows.append(row)
                held += sum(v.nbytes for v in row if isinstance(v, np.ndarray))
                if held > HELD or len(rows) >= 1000:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return df.select(*columns).mapInArrow(run, schema)


def durations(files: DataFrame) -> DataFrame:
    """(file_id, sr, frames, duration_s, status) from headers alone."""

    def work(file_id, path):
        with _open(path) as f:
            h = header(f)
        return file_id, h["rate"], h["frames"], h["frames"] / h["rate"] if h["rate"] else 0.0

    return _each(files, ["file_id", "path"], "file_id string, sr int, frames long, duration_s double, status string", work)


def decode(files: DataFrame, target_sr: int | None = None) -> DataFrame:
    """(file_id, sr, samples, status); a file that cannot be read gives a row with its error and null samples."""

    def work(file_id, path):
        x, sr = read(path)
        if target_sr and target_sr != sr:
            x, sr = dsp.resample(x, sr, target_sr), target_sr
        return file_id, sr, x

    return _each(files, ["file_id", "path"], "file_id string, sr int, samples array<float>, status string", work)


def clips(wanted: DataFrame, rate: int) -> DataFrame:
    """wanted (clip_id, path, t0, t1) -> (clip_id, sr, samples, status)."""
    return _each(wanted, ["clip_id", "path", "t0", "t1"], "clip_id string, sr int, samples array<float>, status string", lambda c, p, a, b: (c, rate, region(p, a, b, rate)))


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV file."""
    data = np.clip(np.rint(np.asarray(x, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def write_clips(rows: DataFrame, folder: str) -> DataFrame:
    """rows (clip_id, sr, samples) -> <folder>/<clip_id>.wav; (clip_id, path, status) of each."""

    def work(clip_id, sr, x):
        store, path = _located(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{clip_id}.wav.tmp") as f:
            f.write(wav_bytes(np.array(x, np.float32), sr))
        store.move(f"{path}/{clip_id}.wav.tmp", f"{path}/{clip_id}.wav")
        return clip_id, f"{folder.rstrip('/')}/{clip_id}.wav"

    return _each(rows, ["clip_id", "sr", "samples"], "clip_id string, path string, status string", work)
