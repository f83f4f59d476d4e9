"""Operators 7 and 8 against the tokenizers library."""

import hashlib
import json
import random
import struct
from collections import Counter

import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tidemark.llm import bpe, token_counts  # noqa: E402
from tidemark.llm.queries import tokenizer  # noqa: E402

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def texts():
    rng = random.Random(8)
    letters = [*map(chr, range(32, 127))] * 3 + [*map(chr, range(0x80, 0x250))] + list("ΣσςİßẞéЖ中한가ᄀ한٣½Ⅳ😀́̈\u0085  　​\x1c\x1f﻿౜Ᲊ՘͸Ɤ\t\n\r")
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)]
    parts = ["'", "s", "S", "'ll", " ", "  ", "\n", "1", "<|endoftext|>", "<|startoftext|>", "<|end", "É", "ΑΣ", "."]
    out += ["".join(rng.choice(parts) for _ in range(10)) for _ in range(800)]
    return [*out, "", " ", "a" * 3000, "don't we'LL they've", "<|endoftext|>", "word " * 4000]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = tokenizer(request.param)
    return bpe.load(path), tokenizers.Tokenizer.from_file(path)


def test_ids_and_decoding(both):
    codec, library = both
    encoder, decoder = bpe.Encoder(codec), bpe.Decoder(codec)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        packed, decoded = encoder.encode(t)
        assert list(struct.unpack(f"<{len(want)}I", packed)) == want, ascii(t)
        said = library.decode(want, skip_special_tokens=False)
        assert decoder.decode(want) == said and decoded.decode("utf-8", "replace") == said, ascii(t)


def test_small_cache_gives_the_same(both, monkeypatch):
    codec, _ = both
    plain = [bpe.Encoder(codec).encode(t) for t in texts()[:300]]
    monkeypatch.setattr(bpe, "CACHE", 3)
    tight = bpe.Encoder(codec)
    assert [tight.encode(t) for t in texts()[:300]] == plain


@pytest.mark.parametrize("words", [0, 7, 400])
def test_counts_by_table_and_cache(words):
    codec, library = bpe.load(tokenizer(FILES[0])), tokenizers.Tokenizer.from_file(tokenizer(FILES[0]))
    split = bpe.Splitter(codec)
    own = sorted({w for t in texts() for part in split.segments(t)[0] for w in split.pieces(part)})[:words]
    counter = token_counts.Counter(codec, (pa.array(own, pa.string()), bytes(len(bpe.merge(codec, w.encode())) for w in own)))
    for t in texts():
        n, held, hit = counter.count(t)
        assert n == len(library.encode(t, add_special_tokens=False).ids) and hit <= held, ascii(t)


def test_bounded_counters():
    """No count is short by more than the share that the bound allows, none is too great."""
    rng = random.Random(4)
    stream = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60_000)]
    found = token_counts.Frequent(200)
    for k in range(0, len(stream), 50):
        found.add(stream[k : k + 50])
    assert len(found.counts) <= 450
    for w, n in Counter(stream).items():
        assert n - len(stream) / 200 <= found.counts[w] <= n
    assert [w for w, _ in found.greatest(3)] == [w for w, _ in Counter(stream).most_common(3)]


def test_the_table_holds_the_corpus_s_frequent_words(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    got = token_counts.token_counts(df, tokenizer(FILES[0]), report=True).collect()
    assert sum(r.n_table for r in got) >= 0.9 * sum(r.n_pretokens for r in got)
    library = tokenizers.Tokenizer.from_file(tokenizer(FILES[0]))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in got} == want
    codec = bpe.load(tokenizer(FILES[0]))
    table = token_counts.frequent(df, lambda: codec, "text")
    assert max(table[1]) > 1 and all(n == len(bpe.merge(codec, w.encode())) for w, n in zip(table[0].to_pylist(), table[1], strict=True))
    monkeypatch.setattr(token_counts, "FREQUENT", 50)
    assert 0 < len(token_counts.frequent(df, lambda: codec, "text")[0]) <= 50
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, tokenizer(FILES[0])).collect()} == want


def test_files_of_one_size_keep_apart(spark, tmp_path):
    """Two tokenizer files of as many entries in one session: nothing that a worker keeps is shared between them."""
    path = tokenizer(FILES[1])
    spec = json.loads(open(path, encoding="utf-8").read())
    vocab = spec["model"]["vocab"]
    a, b = "hello</w>", "world</w>"
    vocab[a], vocab[b] = vocab[b], vocab[a]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string").repartition(1)
    for file in (path, str(tmp_path / "other.json"), path):
        want = tokenizers.Tokenizer.from_file(file).encode("hello world", add_special_tokens=False).ids
        assert bpe.encode(df, file, keep_ids=True).first().ids == want


@pytest.mark.parametrize("file", FILES)
def test_decoding_of_id_columns(spark, file):
    library = tokenizers.Tokenizer.from_file(tokenizer(file))
    rows = [(k, library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(["Hello wörld 😀!", "", "<|endoftext|> x", "a" * 500])] + [(9, None), (9, None), (None, library.encode("😀").ids[:1])]
    df = spark.createDataFrame([(k, i, "x") for k, i in rows], "doc_id long, ids array<int>, decoded string")
    want = sorted((str(k), str(None if i is None else library.decode(i, skip_special_tokens=False))) for k, i in rows)
    assert sorted((str(r.doc_id), str(r.decoded)) for r in bpe.decode(df, tokenizer(file)).collect()) == want
    assert bpe.decode(df.limit(0), tokenizer(file)).count() == 0


def test_in_spark(spark):
    rows = [(1, "Hello World", 0), (1, "Hello World", 1), (None, None, 2), (3, "", 3), (4, "x" * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")  # a column of a result's name
    lib = [tokenizers.Tokenizer.from_file(tokenizer(f)) for f in FILES]
    got = token_counts.token_counts(df, tokenizer(FILES[0]), limit=2).collect()
    want = sorted((str(k), len((t or "").encode()), len(lib[0].encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2) for r in got)
    for r in bpe.encode(df, tokenizer(FILES[1]), keep_ids=True).collect():
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.n_tokens == len(r.ids)
    none = df.limit(0)
    assert token_counts.token_counts(none, tokenizer(FILES[0])).count() == 0 and bpe.encode(none, tokenizer(FILES[1])).count() == 0
