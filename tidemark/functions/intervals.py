"""Column functions on half-open intervals [onset_s, offset_s), names and clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(on: Column, off: Column) -> Column:
    return off - on


def overlap(on1: Column, off1: Column, on2: Column, off2: Column) -> Column:
    """Seconds in common, 0 if apart."""
    return F.greatest(F.lit(0.0), F.least(off1, off2) - F.greatest(on1, on2))


def iou(on1: Column, off1: Column, on2: Column, off2: Column) -> Column:
    """Intersection over union, 0 without overlap or union."""
    common = overlap(on1, off1, on2, off2)
    union = (off1 - on1) + (off2 - on2) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def checked(on: Column, off: Column) -> Column:
    """The offset; a row whose offset precedes its onset ends the job with an error."""
    return F.when(off < on, F.raise_error(F.concat(F.lit("offset before onset: "), off.cast("string"), F.lit(" < "), on.cast("string"))).cast("double")).otherwise(off)


def clipped(on: Column, off: Column, start: Column, length: Column) -> tuple[Column, Column, Column]:
    """Onset and offset within a clip that begins at start, and whether anything is left of the event there."""
    a, b = F.greatest(F.lit(0.0), on - start), F.least(length, off - start)
    return a, b, (off > start) & (on < start + length) & (b > a)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where it is not defined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def safe_id(name: Column) -> Column:
    """Anything but letters, digits, hyphen and underscore becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def recording_id(path: Column) -> Column:
    """Base name without its last extension, made safe; back slashes count as slashes."""
    base = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    return safe_id(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))


def config_name(region: Column, suffix: str = "_scape") -> Column:
    return F.when(region.endswith(suffix), region).otherwise(F.concat(region, F.lit(suffix)))


def segment_id(recording: Column, window: Column) -> Column:
    return F.concat(recording, F.lit("-"), F.lpad(window.cast("string"), 9, "0"))


# Channel suffix of a master file: kind, number, and the rate marker of the audible band.
_CHANNEL = r"(?i)\s*(ch|hi|h)\s*([0-9])\s*(44\s*k?hz)?\s*$"


def master_name(filename: Column) -> dict[str, Column]:
    """stem, kind, prefers_high and rank of a master file's name; a lower rank suits the audible band better."""
    name = F.regexp_replace(filename, r"(?i)\.wav$", "")
    kind = F.lower(F.regexp_extract(name, _CHANNEL, 1))
    marked = F.regexp_extract(name, _CHANNEL, 3) != ""
    rank = F.when((kind == "ch") & marked, 0).when(kind == "ch", 1).when(kind == "hi", 2).when(kind == "h", 3).otherwise(4)
    return {"stem": F.trim(F.regexp_replace(name, _CHANNEL, "")), "kind": kind, "prefers_high": kind.isin("hi", "h"), "rank": rank}


def tape_year(tape: Column) -> Column:
    return F.concat(F.lit("19"), F.substring(tape, 1, 2))


def correlation_rate(limit: Column, cut_rate: Column, master_rate: Column) -> Column:
    """Rate that two recordings are compared at; an unknown (0) cut rate does not count."""
    return F.least(limit, F.when(cut_rate > 0, cut_rate), master_rate).cast("int")


def placed(onset: Column, length: Column, total: Column, clip: float, margin: float, u: Column) -> tuple[Column, Column, Column]:
    """Start of a clip around an event, the event's onset within it, and its length there. u is uniform in [0, 1)."""
    d = F.least(length, F.lit(clip - 2 * margin))
    high = F.greatest(F.lit(margin), F.lit(clip - margin) - d)
    start = onset - (F.lit(margin) + u * (high - margin))
    start = F.least(F.greatest(start, F.lit(0.0)), F.greatest(F.lit(0.0), total - clip))
    return start, F.least(F.greatest(onset - start, F.lit(0.0)), F.lit(clip) - d), d


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
