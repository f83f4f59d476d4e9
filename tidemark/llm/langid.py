"""Language ID (operator 5): sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (anything else is a blank, runs of blanks are one) are hashed to FEATURES columns.
Document frequencies are counted over all documents that may be learned from. The classifier is trained with
follow-the-regularised-leader (FTRL-proximal, elastic net) in one task on a bounded sample of them, SAMPLE different
documents per language at most, chosen by a hash of their id and text. Whole texts are counted where they are read: only
n-gram counts, FEATURES numbers a document at most, go to that task, so the bound holds in bytes too. A fifth of the
sample is kept back to fit the temperature of the final softmax.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import map_columns, slices, worker_state

FEATURES = 1 << 13
SAMPLE = 800  # different training documents per language
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
UNKNOWN = "und"
# Multipliers of the n-gram hash (odd, arbitrary).
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str) -> np.ndarray | None:
    """n-gram counts of a whole text, or None if it has no letter."""
    letters = worker_state("langid-letters", _letters)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(FEATURES, np.int64)
    shift = np.uint32(32 - 13)
    grams = c * MIX[0]
    for n in range(3):
        if n:
            # a rolling mix: the longer gram's hash from the shorter one's
            grams = (grams[:-1] * MIX[1]) ^ (c[n:] * MIX[2] + np.uint32(n))
        if len(grams):
            total += np.bincount((grams * MIX[0]) >> shift, minlength=FEATURES)
    return total


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the unit TF-IDF vector of some columns' counts."""
    x = (1 + np.log(count)) * idf[at]
    return at, x / np.linalg.norm(x)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, orders: list) -> np.ndarray:
    """Weights (size, classes) of a softmax after one pass over rows (columns, values, class) for each of orders:
    FTRL-proximal with per-coordinate rates and elastic net, rates and penalties as the constants above say."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for order in orders:
        for i in order:
            at, x, y = rows[i]
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def fit(documents: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> dict:
    """classes, weights (FEATURES + bias, classes), temperature; documents are (language, columns, counts)."""
    classes = sorted({y for y, _, _ in documents})
    rows = []
    for y, at, count in documents:
        at, x = weigh(at, count, idf)
        rows.append((np.append(at, FEATURES), np.append(x, 1.0), classes.index(y)))
    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    kept_back = [rows[i] for i in order[: len(rows) // 5]]
    train = [rows[i] for i in order[len(rows) // 5 :]] or rows
    w = ftrl(train, len(classes), FEATURES + 1, [rng.permutation(len(train)) for _ in range(EPOCHS)])
    logits = np.array([x @ w[at] for at, x, _ in kept_back]).reshape(len(kept_back), len(classes))
    truth = np.array([y for *_, y in kept_back], int)
    grid = np.geomspace(0.05, 20, 120)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).sum() for t in grid]
    temperature = float(grid[int(np.argmin(loss))]) if len(truth) else 1.0
    return {"classes": classes, "weights": w, "temperature": temperature, "idf": idf}


def sampled(known: DataFrame, most: int) -> DataFrame:
    """(lang, at, n): n-gram counts of at most `most` different documents (doc_id, text, lang) of each language, those
    of the least hashes. A document on many rows counts once; those without letters are left out."""
    # Only rows of the least hashes, some four times the sample, go on to be ranked: no language's rows meet in one
    # task. There are as many counts as languages, which the model holds anyway.
    mark = F.xxhash64("doc_id", "text")
    there = known.groupBy("lang").agg(F.approx_count_distinct(mark).alias("n")).collect()
    if not there:
        return known.select("lang", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<int>").alias("n")).limit(0)
    share = F.create_map(*(F.lit(x) for r in there for x in (r.lang, min(1.0, 4 * most / max(1, r.n)))))
    low = F.pmod(mark, F.lit(1 << 30)) <= F.element_at(share, F.col("lang")) * (1 << 30)
    rows = known.where(low).select("lang", mark.alias("mark"), "text")
    first = Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark")
    chosen = rows.select("lang", "mark").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            langs, marks, at, n = [], [], [], []
            for lang, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, mark) in seen or (c := counts(text)) is None:
                    continue
                seen.add((lang, mark))
                langs.append(lang)
                marks.append(mark)
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(marks, pa.int64()), pa.array(at, kind), pa.array(n, kind)], names=["lang", "mark", "at", "n"])

    # at most `most` marks per language: broadcast, so that no text is shuffled at all
    found = rows.join(F.broadcast(chosen), ["lang", "mark"], "left_semi").select("lang", "mark", "text").mapInArrow(counted, "lang string, mark long, at array<int>, n array<int>")
    return found.groupBy("lang", "mark").agg(F.first("at").alias("at"), F.first("n").alias("n")).drop("mark")


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> dict | None:
    """A model from documents with a text and a language, except those whose crc32(id) is divisible by five."""
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held.alias("held")).where("NOT held AND text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                if (c := counts(t)) is not None:
                    seen[:FEATURES] += c > 0
                    rows += 1
        seen[FEATURES] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1), pa.int32()), pa.array(seen)], names=["feature", "n"])

    df = np.zeros(FEATURES + 1)
    for r in known.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r.feature] = r.n
    if not df[FEATURES]:
        return None
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1

    def learn(sample: pa.Table) -> pa.Table:
        rows = zip(sample.column("lang").to_pylist(), sample.column("at").to_pylist(), sample.column("n").to_pylist(), strict=True)
        # the order of arrival must not matter
        documents = [(y, np.array(at), np.array(n)) for y, at, n in sorted(rows)]
        return pa.table({"model": pa.array([pickle.dumps(fit(documents, idf))], pa.binary())})

    found = sampled(known, SAMPLE).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


class Teller:
    """Texts to (language, probability)."""

    def __init__(self, model: dict | None) -> None:
        self.model = model

    def tell(self, text: str | None) -> tuple[str, float]:
        m = self.model
        c = counts(text) if m is not None and text else None
        if c is None:
            return UNKNOWN, 0.0
        at, x = weigh(found := np.flatnonzero(c), c[found], m["idf"])
        p = softmax((x @ m["weights"][at] + m["weights"][FEATURES]) / m["temperature"])
        k = int(p.argmax())
        return m["classes"][k], float(p[k])


def predict(docs: DataFrame, model: dict | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        teller = Teller(sent.value)

        def work(keys: pa.Array, texts: pa.Array) -> dict:
            said = [teller.tell(t) for t in texts.to_pylist()]
            return {"doc_id": keys, "lang_pred": [y for y, _ in said], "score": [p for _, p in said]}

        return work

    return map_columns(docs, [key, text], f"doc_id {kind}, lang_pred string, score double", make)


def told(docs: DataFrame, least: float, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is told with a probability of `least` or more.

    The model is learned from docs as in identify(). Texts that are null or have no letter go, as does every row if
    nothing can be learned; rows with null ids and repeated rows are judged like any other. Rows pass through their task
    once and are not shuffled; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, text, key, lang))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teller = Teller(sent.value)
        for batch in slices(batches):
            said = [teller.tell(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([y != UNKNOWN and p >= least for y, p in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs.

    held_out: crc32(doc_id) is divisible by five, or doc_id is null; such rows are never learned from, nor are rows
    without lang or text. A text that is null or has no letter is `und` with score 0, and so is every text if nothing
    can be learned. Repeated rows stay and are learned from once; other columns are ignored; an empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    out = predict(docs, train(docs, text, key, lang), text, key)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
