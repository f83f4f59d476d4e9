"""Operators 3, 4 and 6 against brute force on small tables."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ann, components as parts, embed_dedup, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.vectors import balanced, nearest_cell, spherical_kmeans, unit


def components(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bound", [50_000, 0])
def test_components_of_a_path_a_star_and_noise(spark, bound, monkeypatch):
    monkeypatch.setattr(parts, "ONE_TASK", bound)
    rows = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0b é", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text_in_pieces():
    text = " ".join(str(k % 977) for k in range(70_000))
    words = text.encode().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("hot", [1024, 4])
def test_links_of_fingerprints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    fps = set(base)
    for x in base[:25]:
        for d in (1, 2, 3, 4, 5):
            y = x
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    crowd = base[0]
    fps |= {crowd ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))}
    fps = np.array(sorted(fps), np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 3]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {x: k for k, x in enumerate(fps.view(np.int64).tolist())}
    got = [(found[r.a], found[r.b]) for r in simhash.links(df).collect()]
    assert all(np.bitwise_count(fps[a] ^ fps[b]) <= 3 for a, b in got)
    assert components(len(fps), got) == components(len(fps), pairs)


def test_finer_masks_miss_no_partner():
    rng = np.random.default_rng(1)
    mask = 0b1011 << 30 | 0xFFF
    parts = simhash.finer(mask)
    assert len(parts) == 4 and all(p & mask == mask for p in parts)
    assert sum((p ^ mask).bit_count() for p in parts) == 64 - mask.bit_count()
    for _ in range(200):
        off = sum(1 << int(b) for b in set(rng.choice([b for b in range(64) if not mask >> b & 1], 3)))
        assert any(off & p == 0 for p in parts)


def test_documents(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(5, long), (3, long + " end"), (9, long.upper()), (4, None), (2, ""), (8, " \t "), (7, "one"), (7, "one"), (None, "one"), (1, "quite another text here"), (None, "alone in the world")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    want = sorted((str(rows[k][0]), f"{prints[k]:016x}", str(least[comp[k]])) for k in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def vectors(rng, n=160, dim=12):
    base = rng.standard_normal((n, dim))
    rows = []
    for k in range(n):
        x = base[k] if k % 4 else base[k // 8] + 0.12 * rng.standard_normal(dim)
        rows.append((k, [float(np.float32(v)) for v in x], k % 3))
    rows += [(200 + k, rows[1][1], rows[1][2]) for k in range(30)]
    rows += [(300, None, 1), (301, [0.0] * dim, 1), (302, [float("nan")] + [1.0] * (dim - 1), 1), (303, [None] + [1.0] * (dim - 1), 1), (304, rows[0][1], None), (305, [float("inf")] * dim, 0), (306, [], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize(("block", "cells"), [(4096, None), (8, 12)])
def test_embedding_links(spark, block, cells, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    if cells:
        monkeypatch.setattr(embed_dedup, "centroids", lambda x, rows, threshold: spherical_kmeans(x, cells))
    rows = vectors(np.random.default_rng(6))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, w int")
    good = [k for k, (_, x, lab) in enumerate(rows) if lab is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    pairs = []
    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    pairs.append((i, j))
    comp = components(len(rows), pairs)
    least = {c: min(rows[k][0] for k in range(len(rows)) if comp[k] == c) for c in comp}
    want = sorted((rows[k][0], sum(k in p for p in pairs), least[comp[k]]) for k in range(len(rows)))
    got = embed_dedup.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(v)) for v in (1 + k % 3) * rng.standard_normal(8)]) for k in range(90)]
    rows += [(100 + k, rows[20][1]) for k in range(40)] + [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<float>, score double")
    good = [(k, np.array(x)) for k, x in rows if k is not None and x and len(x) == 8 and np.isfinite(x).all() and any(x)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-(v * x).sum(), k) for k, x in good if k != q)[:20]
            want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(near)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, recall=1.0).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=1e-12)
    few = ann.nearest(df.where("vec_id < 5"), recall=1.0).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, k) for k in (1, 2, 3, 4)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall_with_production_parameters(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        hit += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
        total += 20
        assert len(got[ids[i]]) == 20
    assert hit / total >= 0.9


def test_centroid_graph_reaches_the_near_lists():
    rng = np.random.default_rng(1)
    c = rng.standard_normal((300, 16))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    graph = ann.CentroidGraph(c)
    graph.ratio = 1.2
    hit = total = 0
    for q in c[:40] + 0.2 * rng.standard_normal((40, 16)):
        q /= np.linalg.norm(q)
        d = np.sqrt(2 - 2 * c @ q)
        want = set(np.flatnonzero(d <= 1.2 * d.min()).tolist())
        hit += len(want & set(graph.lists(q).tolist()))
        total += len(want)
    assert hit / total > 0.95


def test_doubles_keep_their_precision(spark):
    rows = [(1, [1e300, 1e299], 0), (2, [1e300, 1e299], 0), (3, [1.0, 0.1], 0), (4, [1e-200, 1e-201], 0), (5, [-1.0, 5.0], 0), (6, [1.0 + 2**-40, 1.0], 1), (7, [1.0, 1.0], 1), (20, [1e-3, 2e-3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert all(got[k] == (3, 1) for k in (1, 2, 3, 4)) and got[5] == (0, 5)
    assert got[6] == got[7] == (2, 6)
    near = {r.vec_id: r.score for r in ann.nearest(df.where("vec_id > 2")).collect()}
    assert set(near) == {3, 4, 5, 6, 7} and near[6] == (1.0 + 2**-40) * 1e-3 + 2e-3 and near[6] > near[7] and near[4] == 1e-203 + 2e-204


def test_repeated_query_ids_are_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r.vec_id, round(r.score, 3)) for r in got) == [(1, 1, 0.9), (1, 2, 0.9), (2, 1, 0.1), (2, 2, 0.1)]


def test_splitting_into_chunks_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, [float(v) for v in rng.standard_normal(6)]) for k in range(300)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df, recall=1.0).collect()))
    monkeypatch.setattr(ann, "CHUNK", 7)
    assert sorted(map(tuple, ann.nearest(df, recall=1.0).collect())) == whole


def crowded(rng, n=6000, dim=32):
    centres = rng.standard_normal((60, dim))
    return unit(centres[rng.integers(0, 60, n)] + 0.35 * rng.standard_normal((n, dim)))


def test_lists_are_balanced():
    rng = np.random.default_rng(4)
    half = np.concatenate([unit(rng.standard_normal((4000, 16))), unit(rng.standard_normal(16) + 0.05 * rng.standard_normal((4000, 16)))])
    for x in (half, crowded(rng)):
        centres = balanced(x, 100)
        sizes = np.bincount(nearest_cell(x, centres), minlength=len(centres))
        assert sizes.max() <= 3 * len(x) / 100 and sizes.sum() == len(x)


def test_clustered_vectors_are_pruned(spark):
    x = crowded(np.random.default_rng(9))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and hit / 6000 >= 0.9
    assert ann.scanned(df) <= 0.1
