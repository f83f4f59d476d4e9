"""License scans (operator 10): ordered signature rules.

A whole text becomes its words, lower-cased and joined by blanks. Four base phrases are looked up first. The rules of
license_rules are gated by their keywords: a rule's expression runs only if its keyword stands in the text (on word
limits at its start). A match ends before the blank behind its last word, so neighbours are found side by side.
Detections are ordered by priority, then length, then place; one whose interval lies inside that of an accepted one is
suppressed. A tree over starts holds the farthest end accepted so far, so n detections take n log n steps.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import as_bytes, map_columns, worker_state
from tidemark.llm.license_rules import RULES

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Letters of words stay (A-Z lower-cased, bytes of other characters as they are), anything else is a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Ends:
    """The farthest end of the intervals that start at or before a place."""

    def __init__(self, starts: list[int]) -> None:
        self.starts = sorted(set(starts))
        self.best = [-1] * (len(self.starts) + 1)  # a Fenwick tree of maxima

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start) + 1
        while k < len(self.best):
            self.best[k] = max(self.best[k], end)
            k += k & -k

    def farthest(self, start: int) -> int:
        k, out = bisect_left(self.starts, start) + 1, -1
        while k > 0:
            out = max(out, self.best[k])
            k -= k & -k
        return out


class Scanner:
    def __init__(self) -> None:
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]
        self.rules: dict[bytes, list[tuple[int, str, re.Pattern]]] = {}
        for label, priority, keyword, expression in RULES:
            self.rules.setdefault(b" " + keyword.encode(), []).append((priority, label, re.compile(b" (?:" + expression.encode() + b")(?= )")))

    def detections(self, line: bytes) -> list[tuple[int, int, int, str]]:
        """(priority, start, stop, label) of what stands after suppression; offsets into the line."""
        found = [(-priority, m.start() - m.end(), m.start(), m.end(), label) for keyword, rules in self.rules.items() if keyword in line for priority, label, rx in rules for m in rx.finditer(line)]
        kept, ends = [], Ends([a for _, _, a, _, _ in found])
        for priority, _, a, b, label in sorted(found):
            if ends.farthest(a) < b:
                kept.append((-priority, a, b, label))
                ends.add(a, b)
        return kept

    def scan(self, data: bytes) -> tuple:
        """n_words, n_base, first, last, base labels, labels, score."""
        words = data.translate(WORDS).split()
        line = b" " + b" ".join(words) + b" "
        base, places = set(), []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                base.add(label)
                places.append(at)
                at = line.find(phrase, at + 1)
        found = self.detections(line)
        labels = base | {label for *_, label in found}
        score = 1.0
        for priority, *_ in found:
            score *= 1 - priority / 100
        score = 1 - score * 0.5 ** len(places)
        first, last = (line.count(b" ", 0, min(places)), line.count(b" ", 0, max(places))) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    A null text is empty: no words, null places, empty labels, score 0. score is the chance that any detection holds,
    each being right with its priority in per cent (base phrases: one half), taken as independent. Repeated rows and
    null ids stay; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def make():
        scanner = worker_state(f"licenses-{len(RULES)}", Scanner)

        def work(keys: pa.Array, texts: pa.Array) -> dict:
            rows = [scanner.scan(x) for x in as_bytes(texts)]
            return {"doc_id": keys} | dict(zip(names, zip(*rows, strict=True) if rows else [[]] * 7, strict=True))

        return work

    return map_columns(docs, [key, text], f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)
