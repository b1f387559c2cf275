import base64
import gzip
import json

import numpy as np
import pytest

from docketry.llm import forest
from tests.conftest import rows


def pack(v):
    return base64.b64encode(gzip.compress(json.dumps(v).encode())).decode()


def exact(named, k):
    out = {}
    for a, x in named.items():
        x = np.array(x)
        scores = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), b) for b, y in named.items() if b != a)
        out[a] = [b for _, b in scores[:k]]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    named = {}
    for c in range(60):
        centre = rng.standard_normal(16)
        for i in range(7):
            named[f"v{c:02}_{i}"] = (centre + 0.15 * rng.standard_normal(16)).round(4).tolist()
    return named


def table_of(spark, named):
    return spark.createDataFrame([(k, pack(v)) for k, v in named.items()], "section_id string, embedding_compressed string")


def test_recall_of_close_neighbours(spark, clustered):
    vectors = forest.compressed_vectors(table_of(spark, clustered), "section_id", "embedding_compressed", 16)
    near = forest.neighbours(vectors, k=5, trees=4, leaf=40, probes=8)
    got = {}
    for r in near.collect():
        got.setdefault(r["id_a"], []).append(r["id_b"])
    truth = exact(clustered, 5)
    recall = sum(len(set(got[a]) & set(truth[a])) for a in truth) / sum(map(len, truth.values()))
    assert recall >= 0.95 and all(len(v) == 5 for v in got.values())


def test_threshold_keeps_ranks_and_queries_limit(spark, clustered):
    vectors = forest.compressed_vectors(table_of(spark, clustered), "section_id", "embedding_compressed", 16)
    whole = {(r["id_a"], r["id_b"]): r["rank"] for r in forest.neighbours(vectors, k=3, leaf=1000).collect()}
    close = {(r["id_a"], r["id_b"]): r["rank"] for r in forest.neighbours(vectors, k=3, leaf=1000, least_cosine=0.95).collect()}
    assert close and all(whole[p] == rank for p, rank in close.items())
    asked = spark.createDataFrame([("v00_0",), ("v01_1",), ("nobody",)], "q string")
    some = forest.neighbours(vectors, k=3, leaf=1000, queries=asked)
    assert {r["id_a"] for r in some.collect()} == {"v00_0", "v01_1"}
    truth = exact(clustered, 3)
    assert [r["id_b"] for r in some.filter("id_a = 'v00_0'").orderBy("rank").collect()] == truth["v00_0"]


def test_exhaustive_search_misses_nothing_at_any_size(spark, monkeypatch):
    """Far neighbours, many blocks: the index with its probes fixed misses some of them."""
    rng = np.random.default_rng(4)
    named = {f"r{i:04}": rng.standard_normal(16).round(4).tolist() for i in range(3000)}
    monkeypatch.setattr(forest, "HOME", 100)
    monkeypatch.setattr(forest, "HANDED", 200)
    vectors = forest.compressed_vectors(table_of(spark, named), "section_id", "embedding_compressed", 16)
    asked = spark.createDataFrame([(f"r{i:04}",) for i in range(0, 3000, 60)], "q string")
    matrix = np.array(list(named.values()))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    truth = {f"r{i:04}": [f"r{j:04}" for j in np.argsort(-(matrix @ matrix[i]))[1:6]] for i in range(0, 3000, 60)}

    def recall(**how):
        got = {}
        for r in forest.neighbours(vectors, k=5, queries=asked, **how).orderBy("id_a", "rank").collect():
            got.setdefault(r["id_a"], []).append(r["id_b"])
        assert len(got) == 50
        return sum(len(set(got[a]) & set(truth[a])) for a in got) / 250

    assert recall(exhaustive=True) == 1.0
    assert recall(trees=4, leaf=32, probes=8) < 0.9


def test_groups_closer_than_8_bits_tell(spark):
    rng = np.random.default_rng(6)
    named = {}
    for size in (30, 150):
        centre = rng.standard_normal(16)
        for i in range(size):
            named[f"g{size}_{i:03}"] = (centre + 0.01 * rng.standard_normal(16)).tolist()
    at = {name: i for i, name in enumerate(named)}
    unit = np.array(list(named.values()))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosines = unit @ unit.T - 2 * np.eye(len(named))
    truth = -np.sort(-cosines, axis=1)[:, :5]
    scaled = {f"{name}s": [3.7 * x for x in named[name]] for name in ("g30_000", "g150_000")}
    vectors = forest.compressed_vectors(table_of(spark, named), "section_id", "embedding_compressed", 16)
    for how in ({"leaf": 1000}, {"leaf": 1000, "least_cosine": 0.9}, {"queries": spark.createDataFrame([(n,) for n in named], "q string"), "exhaustive": True}):
        got = {}
        for r in forest.neighbours(vectors, k=5, **how).orderBy("id_a", "rank").collect():
            got.setdefault(r["id_a"], []).append(r["id_b"])
        assert np.allclose([[cosines[at[a], at[b]] for b in got[a]] for a in named], truth, rtol=0, atol=1e-8)
    both = forest.compressed_vectors(table_of(spark, named | scaled), "section_id", "embedding_compressed", 16)
    assert both.select("print").distinct().count() == len(named)


def test_copies_ties_and_unusable(spark):
    named = {f"c{i}": [1.0, 2.0, 3.0, 4.0] for i in range(9)} | {"far": [4.0, -3.0, 2.0, -1.0], "scaled": [2.0, 4.0, 6.0, 8.1]}
    data = [(k, pack(v)) for k, v in named.items()]
    data += [("c0", pack(named["c0"])), ("null", None), ("zero", pack([0, 0, 0, 0])), ("short", pack([1, 2, 3])), ("text", pack(["a", 1, 2, 3])), ("bool", pack([True, 1, 2, 3])), ("dict", pack({"a": 1})), ("raw", "[1,2,3,4]"), ("cut", pack([1, 2, 3, 4])[:-8]), ("", pack([1, 1, 1, 1])), (None, pack([1, 2, 2, 2]))]
    df = spark.createDataFrame(data, "section_id string, embedding_compressed string").selectExpr("*", "1 as id", "'x' as vector", "2 as print")
    vectors = forest.compressed_vectors(df, "section_id", "embedding_compressed", 4)
    assert sorted({r["id"] for r in vectors.collect()}) == sorted([*named, ""])
    got = {}
    for r in forest.neighbours(vectors, k=5).orderBy("id_a", "rank").collect():
        got.setdefault(r["id_a"], []).append(r["id_b"])
    assert got["c0"] == ["c1", "c2", "c3", "c4", "c5"] and got["c8"] == ["c0", "c1", "c2", "c3", "c4"] and len(got["far"]) == 5
    assert got["scaled"] == ["c0", "c1", "c2", "c3", "c4"]


def test_full_leaves_in_blocks_find_the_same(spark, clustered, monkeypatch):
    vectors = forest.compressed_vectors(table_of(spark, clustered), "section_id", "embedding_compressed", 16)
    asked = spark.createDataFrame([(n,) for n in list(clustered)[::9]], "q string")
    for how in ({"trees": 3, "leaf": 100, "probes": 5}, {"trees": 3, "leaf": 100, "probes": 5, "queries": asked}):
        want = rows(forest.neighbours(vectors, k=4, **how))
        with monkeypatch.context() as m:
            m.setattr(forest, "FULL", 25)
            assert rows(forest.neighbours(vectors, k=4, **how)) == want
            m.setattr(forest, "FULL_LEAVES", 1)
            assert rows(forest.neighbours(vectors, k=4, **how)) == want


def test_vectors_are_packed_without_loss():
    rng = np.random.default_rng(9)
    made = [rng.standard_normal(8).round(4), rng.standard_normal(8), rng.standard_normal(8).round(6), 1000 * rng.standard_normal(8).round(4), np.array([1e300, -1e-300, 0, 5e-324, 1, 2, 3, -0.0]), np.arange(8.0)]
    column = forest._packed(np.stack(made))
    assert (forest._vectors(column) == np.stack(made)).all() and len(column[0].as_py()) == 17 and len(column[1].as_py()) == 65
    assert (forest._vectors(column.take(np.array([1, 0, 1]))) == np.stack(made)[[1, 0, 1]]).all()


def test_recall_of_all_neighbours_in_clusters_for_a_part_of_the_work(spark):
    """Clusters of 30: nine in ten of all five neighbours, ten leaves of about 64 read for each vector."""
    rng = np.random.default_rng(12)
    named = {f"v{c:03}_{i:02}": (x + 0.25 * rng.standard_normal(32)).round(4).tolist() for c, x in enumerate(rng.standard_normal((140, 32))) for i in range(30)}
    vectors = forest.compressed_vectors(table_of(spark, named), "section_id", "embedding_compressed", 32)
    got = {}
    for r in forest.neighbours(vectors, k=5, trees=5, leaf=64, probes=10).collect():
        got.setdefault(r["id_a"], []).append(r["id_b"])
    truth = exact_matrix(named, 5)
    assert sum(len(set(got[a]) & set(truth[a])) for a in truth) / (5 * len(truth)) >= 0.9
    assert 10 * 2 * 64 < 0.5 * len(named)


def exact_matrix(named, k):
    names, unit = list(named), np.array(list(named.values()))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosines = unit @ unit.T - 2 * np.eye(len(names))
    return {a: [names[j] for j in np.argsort(-row)[:k]] for a, row in zip(names, cosines)}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "section_id string, embedding_compressed string")
    assert forest.neighbours(forest.compressed_vectors(none, "section_id", "embedding_compressed", 4)).count() == 0
    one = table_of(spark, {"a": [1.0, 2.0, 3.0, 4.0]})
    assert forest.neighbours(forest.compressed_vectors(one, "section_id", "embedding_compressed", 4)).count() == 0


def test_array_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [1.0, None])], "vec_id long, embedding array<float>")
    near = forest.neighbours(forest.array_vectors(df, "vec_id", "embedding", 2), k=1)
    assert rows(near.select("id_a", "id_b")) == [(1, 2), (2, 1), (3, 2)]


def test_queue_opens_own_leaves_first():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    f = forest.Forest.fit(x, 3, 5)
    values = f.values(x)
    own = f.leaves(values)
    tree, leaf = f.search(values, 9)
    for i in range(500):
        opened = list(zip(tree[i].tolist(), leaf[i].tolist()))
        assert len(set(opened)) == 9 and set(enumerate(own[i].tolist())) == set(opened[:3])
    every, leaves = f.search(values[:3], 3 << 5)
    assert all(len(set(zip(every[i].tolist(), leaves[i].tolist()))) == 96 for i in range(3))
