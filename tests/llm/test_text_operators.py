"""Operators 1, 2, 5, 9, 10 and the pipeline against plain code on small tables."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, license_rules, licenses, packing, pii, queries, simhash, warc

# --- 1 ----------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_base(text):
    out = []
    for order, (kind, rx) in enumerate(PLAIN.items()):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def pii_texts():
    rng = random.Random(1)
    parts = ["a@b.co", "_x@y.zz.q", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "5", " ", "-", "é", "😀", "a", "%", "\n", "000000000000", "+49 30 123456 7"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(600)]
    return [*out, None, "", "a@b.c@d.e", "1 " * 3000, "9" * 20_000, "x" * 50_000 + "@y.z", "a.b@" + "c." * 5000 + "d", "1.2.3.4.5.6.7.8", "+1" + "(" * 5000, "😀 a@b.cd 1.2.3.4"]


def test_base_spans(spark):
    rows = [(k, t, "x") for k, t in enumerate(pii_texts())] + [(None, "a@b.co", "x"), (1, pii_texts()[1], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    texts = {k: t for k, t, _ in rows}
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) or not want
    assert pii.find(df.limit(0)).count() == 0


def test_added_spans_and_redaction(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    clean = ["the internationalization-of-everything goes on", "A perfectly clean text of 1999 words, no. 12 and 3.", "see pages 100-200"]
    private = [f'Set token = "{key[k:] + key[:k]}" now' for k in range(20)] + [f"My SSN is 52{k % 10}-1{k % 9}-456{k % 10}, thanks." for k in range(20)] + ["write to jane [at] example [dot] com please", "call 415 555-0132, ok"] + [f"pay AKIA{key[k:k + 16].upper()} here" for k in range(12)] + [f"with password={key[k:k + 18]} or" for k in range(12)]
    df = spark.createDataFrame(list(enumerate(clean * 10 + private)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert all(not got[k].spans for k in range(30))
    assert all(got[k].spans.startswith("secret:") for k in range(30, 50)) and all(got[k].spans.startswith("ssn:") for k in range(50, 70))
    assert all(got[k].spans.startswith("secret:") for k in range(72, 96))
    out = {r.doc_id: r.text for r in pii.redact(df.union(spark.createDataFrame([(500, "ä a@b.co, +1 (017) 555-7713 😀 end"), (501, None)], df.schema))).collect()}
    assert out[500] == "ä [EMAIL], [PHONE] 😀 end" and out[501] is None and out[0] == clean[0] and out[30] == 'Set token = "[SECRET]" now'


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = pii.candidates(df, "text", "found")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 2 ----------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD", 3000)
    monkeypatch.setattr(warc, "ROLL", 600)
    rng = random.Random(2)
    rows = [(k, f"http://x/{k} é", "".join(rng.choice("<p>ab é\r\n") for _ in range(rng.randrange(300)))) for k in range(60)]
    rows += [(100 + k, None, rows[5][2]) for k in range(20)] + [(200, "u", None), (201, "u", ""), (202, "u\r\nWARC-Type: x", "\r\n\r\n"), (None, "u", rows[5][2]), (203, "u", "long " * 20_000), (7, "again", rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    warc.write(df, one)
    warc.write(df.repartition(3), two)
    names = sorted(p.name for p in (tmp_path / "one").glob("*.warc.gz"))
    assert len(names) > 3 and not (tmp_path / "one" / "_temporary").exists()
    assert [(p.name, p.read_bytes()) for p in sorted((tmp_path / "one").glob("*.gz"))] == [(p.name, p.read_bytes()) for p in sorted((tmp_path / "two").glob("*.gz"))]
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(top.get(h or "", -1), k)
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        response = k is None or top[h or ""] == k
        want.append((str(k), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""], (h or "") if response else None))
    got = warc.read(spark, one).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got), key=key) == sorted(want, key=key)
    first = next((tmp_path / "one").glob("*.gz")).read_bytes()
    assert zlib.decompress(first, 31).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_shards_of_uneven_ids(spark, monkeypatch):
    """One far id, ids in clumps, one id on many rows, rows without id: shards stay of a size and in order."""
    ids = [*range(400), 10**12, *range(10**15, 10**15 + 300), *[77] * 300, *[None] * 300]
    rows = [(i, f"{k:040x}"[-40:] if i not in (77, None) else hashlib.sha1(str(k).encode()).hexdigest(), 600) for k, i in enumerate(ids)]
    known = spark.createDataFrame(rows, "page_id long, sha1 string, n int")
    for parts in (1 << 18, 8):
        monkeypatch.setattr(warc, "PARTS", parts)
        shards = warc.limits(known, 20_000)
        at = shards.of(np.array([warc.NO_ID if i is None else i for i in ids]), [r[1] for r in rows])
        sizes = np.bincount(at, minlength=shards.count) * 1000
        size = math.isqrt(10_000 * 1000 * len(ids))  # of the bytes with heads
        assert at.min() >= 0 and at.max() < shards.count and sizes.max() <= 1.2 * size and shards.count <= 2 * 1000 * len(ids) / size
        order = sorted(range(len(ids)), key=lambda k: (warc.NO_ID if ids[k] is None else ids[k], rows[k][1]))
        assert list(at[order]) == sorted(at)
    assert warc.limits(known.limit(0), 20_000).count == 1


def test_a_second_attempt_leaves_the_same_files(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"page {k % 7}") for k in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    first = sorted(map(tuple, warc.write(df, folder, 2000, 500).collect()))
    before = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("*.gz")}
    rows = pa.table({"shard": pa.array([0], pa.int32()), "page_id": [0], "later": [True], "sha1": [hashlib.sha1(b"page 0").hexdigest()], "url": ["u"], "html": ["page 0"], "refers": pa.array([49], pa.int64())})
    list(warc._write(folder, 500)(iter(rows.slice(0, 0).to_batches())))  # an attempt that had no rows
    assert {p.name: p.read_bytes() for p in (tmp_path / "w").glob("*.gz")} == before and sorted(r[0] for r in first) == sorted(before)


def test_cut_archive_is_noticed(tmp_path):
    import io

    data = warc.record(1, "u", b"x" * 5000, None)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20])))


# --- 5 ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, "12 34 !?", "fr", "s"), (None, "the and of thing", None, "s")], df.schema)
    got = {r.doc_id: r for r in langid.identify(df.union(odd).withColumn("score", F.lit("x"))).collect()}
    rows = df.collect()
    assert len(got) == len(rows) + 4
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (5000, 5001, 5002))
    assert got[None].held_out and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df.limit(0)).count() == 0
    blank = langid.identify(df.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blank} == {"und"}


def test_labels_of_held_out_rows_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    wrong = df.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(d).collect())) for d in (df, wrong))
    assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b])


def test_ftrl_is_the_published_update(monkeypatch):
    """Against plain scalar code, one coordinate at a time."""
    monkeypatch.setattr(langid, "L1", 0.4)
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.permutation(12)[:4]), rng.random(4), int(rng.integers(3))) for _ in range(40)]
    orders = [rng.permutation(40) for _ in range(2)]
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, k):
        if abs(z[i][k]) <= langid.L1:
            return 0.0
        sign = 1 if z[i][k] > 0 else -1
        return -(z[i][k] - sign * langid.L1) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)

    for order in orders:
        for r in order:
            at, x, y = rows[r]
            w = {i: [weight(i, k) for k in range(3)] for i in at}
            logit = [sum(v * w[i][k] for i, v in zip(at, x)) for k in range(3)]
            e = [math.exp(v - max(logit)) for v in logit]
            for i, v in zip(at, x):
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA
                    z[i][k] += g - sigma * w[i][k]
                    n[i][k] += g * g
    want = [[weight(i, k) for k in range(3)] for i in range(12)]
    got = langid.ftrl(rows, 3, 12, orders)
    assert np.allclose(got, want, atol=1e-12) and (got == 0).any()


def test_sample_is_of_different_documents(spark):
    """One document on many rows neither fills the sample nor shrinks it, whatever its hash."""
    rows = [(k, f"document number {chr(97 + k % 26)}{chr(97 + k // 26)} says something", "en") for k in range(400)]
    for crowd in (3, 7, 11, 250):
        df = spark.createDataFrame(rows + [rows[crowd]] * 5000 + [(999, "12 34", "en")], "doc_id long, text string, lang string")
        assert langid.sampled(df, 60).count() == 60
        assert langid.sampled(df, 10_000).count() == 400
    # different texts under one id are different documents
    same = spark.createDataFrame([(1, t, "en") for _, t, _ in rows], "doc_id long, text string, lang string")
    assert langid.sampled(same, 60).count() == 60 and langid.sampled(same.limit(0), 60).count() == 0


def test_told_rows_pass_as_they_are(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(7000, None, "en"), (7001, "12 !", "en"), (None, "", None)], "doc_id long, text string, lang string")
    df = df.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("x")).withColumn("lang_pred", F.array(F.lit(1)))
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect() if r.doc_id is not None}
    kept = langid.told(df, 0.9)
    assert kept.columns == df.columns and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    want = sorted(str(r) for r in df.collect() if r.doc_id is not None and said[r.doc_id][0] != "und" and said[r.doc_id][1] >= 0.9)
    assert sorted(str(r) for r in kept.collect()) == want and 0 < len(want) < df.count()
    assert langid.told(df.limit(0), 0.5).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------------------


def test_every_placement_is_best_fit():
    """Each piece goes to a bin with the least room of all compatible bins, and to a new one only if there is none."""
    rng = random.Random(5)
    for capacity in (7, 16, 33):
        pieces = sorted(((rng.randrange(capacity + 1), rng.choice((0, 1, 1, 2, 4, 8)), rng.choice((0, 0, 1, 2, 4))) for _ in range(300)), key=lambda p: -p[0])
        bins, held = packing.Bins(capacity), {}
        for length, source, cluster in pieces:
            fits = [b["left"] for b in held.values() if b["left"] >= length and b["left"] > 0 and not b["sources"] & source and not b["clusters"] & cluster]
            k, start = bins.put(length, source, cluster)
            if fits:
                assert held[k]["left"] == min(fits) and not held[k]["sources"] & source and not held[k]["clusters"] & cluster
            else:
                assert k not in held
            b = held.setdefault(k, {"left": capacity, "sources": 0, "clusters": 0})
            assert start == capacity - b["left"]
            b["left"] -= length
            b["sources"] |= source
            b["clusters"] |= cluster


def test_copies_are_packed_in_proportion():
    start = time.process_time()
    out = list(packing.pack_shard([1] * 20_000, [300] * 20_000, [None] * 20_000, [7] * 20_000, 1024))
    assert len({b for *_, b, _ in out}) == 20_000 and time.process_time() - start < 20


def test_one_row_repeated_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 500)
    df = spark.range(50_000).select(F.lit(5).alias("doc_id"), F.lit("the same words").alias("text"), F.lit("s").alias("source"))
    got = packing.pack(df)
    shards = got.groupBy(F.substring_index("bin_id", "-", 1)).count()
    assert got.count() == got.select("bin_id").distinct().count() == 50_000 and shards.agg(F.max("count")).first()[0] < 800


def test_given_clusters_are_kept_apart(spark):
    rows = [(k, "two words", None, k % 3 if k < 60 else None) for k in range(90)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string, component_id int"), cluster="component_id").collect()
    own = {k: c for k, _, _, c in rows}
    for bin_id in {r.bin_id for r in got}:
        held = [own[r.doc_id] for r in got if r.bin_id == bin_id and own[r.doc_id] is not None]
        assert len(held) == len(set(held))
    assert len({r.bin_id for r in got}) == 20


def test_packing(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("w" + str(rng.randrange(50)) for _ in range(rng.choice((1, 5, 30, 70)))), rng.choice(("hot", "hot", "b", "c", None))) for k in range(200)]
    rows += [(300 + k, "same words here", None) for k in range(30)] + [(400, None, "b"), (401, "", "b"), (402, "long " * 350, None), (None, "no id", "c"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, bin_id string")
    got = packing.pack(df, capacity=64).collect()
    texts: dict = {}
    for k, t, s in rows:
        texts.setdefault(k, []).append((len((t or "").split()), s))
    words: dict = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    assert words == {k: sum(n for n, _ in v) for k, v in texts.items()}
    by_bin: dict = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
    same = {300 + k for k in range(30)}
    for own in by_bin.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= 64
        spans = sorted((r.start, r.start + r.n_words) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        sources = [texts[r.doc_id][0][1] for r in own if texts[r.doc_id][0][1]]
        assert len(sources) == len(set(sources)) and sum(r.doc_id in same for r in own) <= 1 and sum(r.doc_id == 402 for r in own) <= 1
    assert packing.pack(df.limit(0)).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_licenses(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    rng = random.Random(9)
    parts = ["GNU General Public License", "Apache", "License", "CC BY", "-NC 4.0", "MIT License", "mit license", "é", " ", " ", "/", "\n", "1", "MITlicense"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(400)] + [None, "", "MIT License mit LICENSE", "x " * 30_000 + "Apache License, Version 2.0", "MIT\x00License", "mit İ license"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "cc by", "x"), (0, texts[0], "y")], "doc_id long, text string, labels string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(texts[r.doc_id] or ""), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_rules_and_suppression():
    assert len(license_rules.RULES) > 200 and all(len(r) == 4 and 0 < r[1] < 100 for r in license_rules.RULES)
    s = licenses.Scanner()
    names = lambda t: [x[3] for x in s.detections(b" " + b" ".join(t.encode().translate(licenses.WORDS).split()) + b" ")]
    assert names("under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert names("GNU Lesser General Public License version 2.1") == ["lgpl-2.1"]
    assert names("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"]
    assert names("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert names("Licensed under the Apache License, Version 2.0") == ["apache-2.0"]
    assert names("we submit licenses of all kinds") == []
    for label, _, keyword, rx in license_rules.RULES:
        assert re.compile(rx), label
        assert keyword == keyword.lower()


# --- all together -----------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, sf).persist()
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    single = stage["near_duplicates"](spark, kept, sf).persist()
    assert single.columns == docs.columns and 0 < single.count() < kept.count()
    # all pairs of fingerprints, and the least id of what hangs together
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in kept.collect()}
    up = {k: k for k in prints}
    for a in sorted(prints):
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(up.values()))
    clean = stage["personal_data"](spark, single, sf)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert clean.where(F.col("text").rlike(PLAIN["email"])).count() == 0
    plan = corpus_pipeline.run(spark, sf)
    assert plan.select("doc_id").distinct().count() == single.count()


ODD = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 !?", None, None), (None, "the house of the river and the people", "en", "s"), (None, "the house of the river and the people", "en", "s"),
    (5, "le chat est sur la table avec une pomme rouge", "fr", None), (5, "the dog sleeps in the house near the river", "en", "s"), (5, "the dog sleeps in the house near the river", "en", "s"),
    (6, "write to jane@example.org or call " + "+1 415 555 0132, " * 3 + "the end of the text", "en", "s"), (7, "long text of words " * 30_000, "en", "s"),
]


def test_stages_with_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names, an empty table."""
    stage = dict(corpus_pipeline.STAGES)
    own = [(*r, len(r[1] or ""), "x", [k], "y", 1.5) for k, r in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, content array<int>, lang_pred string, score double"
    known = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 100").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    df = spark.createDataFrame(own, schema)
    both = known.unionByName(df, allowMissingColumns=True)
    said = stage["language"](spark, both, sf)
    assert said.columns == both.columns
    kept = sorted(str(r) for r in said.where("doc_id < 100 OR doc_id IS NULL").collect())
    assert kept == sorted(str(r) for r in df.collect() if r.text and any(c.isalpha() for c in r.text))
    single = stage["near_duplicates"](spark, df, sf)
    assert single.columns == df.columns
    # 1 and 2 are one group (no words), 3 is one of its own; equal rows are one, rows that only share an id are not
    assert sorted(str(r.doc_id) + (r.text or "")[:12] for r in single.collect()) == sorted(["1", "312 34 !?", "Nonethe house of", "5le chat est ", "5the dog slee", "6write to jan", "7long text of"])
    clean = stage["personal_data"](spark, df, sf)
    assert clean.columns == df.columns
    want = [r._replace() if hasattr(r, "_replace") else r for r in df.collect()]
    got = {(r.doc_id, (r.text or "")[:5], tuple(r.content)): r for r in clean.collect()}
    assert len(got) == len(want)
    for r in want:
        g = got[r.doc_id, (r.text or "")[:5], tuple(r.content)]
        assert (g.lang, g.source, g.spans, g.lang_pred, g.score) == (r.lang, r.source, r.spans, r.lang_pred, r.score)
        assert g.n_chars == (None if g.text is None else len(g.text))
        assert g.text == (r.text if r.doc_id != 6 else "write to [EMAIL] or call [PHONE], [PHONE], [PHONE], the end of the text")
    plan = stage["packing"](spark, df, sf).collect()
    assert sorted(str(r.doc_id) for r in plan if r.piece == 0) == sorted(str(r[0]) for r in ODD)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, df.limit(0), sf).count() == 0, name


def test_registered(spark):
    names = list(queries.QUERIES)
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(re.match(r"op(\d+)_", n)[1])) and len(names) == 14
    assert set(queries.ORACLE) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_of_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(tuple(map(str, r)) for r in rel.select(*(f'"{c}"' for c in df.columns)).fetchall())
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want
