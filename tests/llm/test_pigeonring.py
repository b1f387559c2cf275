import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import components, pigeonring
from docketry.llm.components import connected
from docketry.llm.shingles import shingle_sets
from tests.conftest import rows

WORD = re.compile("[a-z0-9]+")


def sets(texts, k, least):
    out = {}
    for name, text in texts:
        w = WORD.findall((text or "").lower())
        if len(w) >= max(least, k):
            out[name] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def brute(texts, k, least, similarity):
    s = sets(texts, k, least)
    names = sorted(s)
    return sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(s[a] & s[b]) * 1000 >= round(similarity * 1000) * len(s[a] | s[b]))


def found(spark, texts, k=3, least=20, similarity=0.7, schema="section_id string, content string"):
    df = spark.createDataFrame(texts, schema)
    pairs, members = pigeonring.similar_pairs(df, "section_id", "content", similarity, k, least)
    return pairs, members


def noisy(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"x{rng.randrange(10**6)}"
        elif kind < 0.7:
            words.insert(at, f"y{rng.randrange(10**6)}")
        elif len(words) > 5:
            del words[at]
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for group in range(25):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25, 260)))
        for copy in range(rng.randrange(1, 6)):
            texts.append((f"d{group:02}_{copy}", noisy(rng, base, rng.randrange(0, 14))))
    return texts


@pytest.mark.parametrize("k,least,similarity", [(3, 20, 0.7), (5, 5, 0.8), (1, 1, 0.5)])
def test_pairs_equal_brute_force(spark, corpus, k, least, similarity):
    pairs, members = found(spark, corpus, k, least, similarity)
    assert rows(pigeonring.id_pairs(pairs, members)) == brute(corpus, k, least, similarity)


def test_hot_keys_in_blocks_lose_nothing(spark):
    keys = spark.createDataFrame([(i % 2, (1000 + i) << 17, i) for i in range(40)], "key long, print long, size int")
    hot = spark.createDataFrame([(0, 3)], "key long, blocks long")
    groups = {}
    for r in pigeonring.in_blocks(keys, hot).collect():
        groups.setdefault(r["key"], set()).add(r["size"])
    together = [frozenset((a, b)) for g in groups.values() for a in g for b in g if a < b]
    wanted = {frozenset((a, b)) for a in range(40) for b in range(a) if a % 2 == b % 2}
    assert set(together) == wanted
    assert len(groups) == 7 and max(map(len, groups.values())) <= 20


def test_full_bins_and_large_classes_give_the_same_pairs(spark, corpus, monkeypatch):
    texts = corpus + [(f"copy{i}", corpus[0][1]) for i in range(9)]
    want = brute(texts, 3, 20, 0.7)
    monkeypatch.setattr(pigeonring, "GROUP", 2)
    monkeypatch.setattr(pigeonring, "MEMBERS", 2)
    pairs, members = found(spark, texts)
    assert rows(pigeonring.id_pairs(pairs, members)) == want
    monkeypatch.setattr(pigeonring, "HOT_KEYS", 0)
    pairs, members = found(spark, texts)
    assert rows(pigeonring.id_pairs(pairs, members)) == want


def test_chains_prune_before_the_full_check(spark):
    """Texts share one rare opening and nothing else: only the chains can tell them apart."""
    rng = random.Random(8)
    texts = [(f"t{i}", "quick brown fox jumps over " + " ".join(f"v{rng.randrange(400)}" for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(texts, "section_id string, content string")
    left = {r["stage"]: r["pairs"] for r in pigeonring.pruning(df, "content", 0.3, 1, 5).collect()}
    assert 2 * left["position"] > 3 * left["chain7"] and left["chain1"] >= left["chain2"] >= left["chain7"] >= left["chain8"]
    without, _ = pigeonring.similar_pairs(df, "section_id", "content", 0.3, 1, 5, chain=0)
    with_, _ = pigeonring.similar_pairs(df, "section_id", "content", 0.3, 1, 5)
    assert rows(without) == rows(with_)


def test_nulls_copies_repeats_and_long_texts(spark):
    text = " ".join(f"t{i}" for i in range(40))
    long = " ".join(f"long{i % 5000}" for i in range(60_000))
    texts = [("a", text), ("b", text.upper() + "!"), ("a", text), ("c", None), ("d", ""), ("e", "too short"), (None, text), ("f", long), ("g", long + " tail"), ("h", "  \n ")]
    pairs, members = found(spark, texts)
    assert rows(pigeonring.id_pairs(pairs, members)) == [("a", "b"), ("f", "g")]
    groups = {r["id"]: r for r in pigeonring.groups(pairs, members).collect()}
    assert set(groups) == {"a", "b", "f", "g"}
    assert groups["a"]["group_id"] == groups["b"]["group_id"] and groups["a"]["copies"] == 2 and groups["a"]["links"] == 0
    assert groups["f"]["group_id"] == groups["g"]["group_id"] and groups["f"]["links"] == 1


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "section_id string, content string")
    pairs, members = pigeonring.similar_pairs(empty, "section_id", "content", 0.7, 3, 20)
    assert pigeonring.id_pairs(pairs, members).count() == 0 and pigeonring.groups(pairs, members).count() == 0
    text = " ".join(f"t{i}" for i in range(40))
    odd = spark.createDataFrame([("a", text, 1, "x", 2), ("b", text + " z", 1, "x", 2)], "section_id string, content string, print int, key string, id int")
    pairs, members = pigeonring.similar_pairs(odd, "section_id", "content", 0.7, 3, 20)
    assert rows(pigeonring.id_pairs(pairs, members)) == [("a", "b")]


def test_chain_test_never_prunes_a_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(20, 400))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        other = np.concatenate([base[: n - n // 8], rng.integers(0, 2**63, n // 8).astype(np.uint64)])
        hashes, offsets = np.concatenate([np.unique(base), np.unique(other)]), np.array([0, len(np.unique(base)), len(np.unique(base)) + len(np.unique(other))])
        rings = pigeonring._rings(offsets, hashes)
        h = len(np.setxor1d(base, other))
        for length in range(1, pigeonring.SEGMENTS + 1):
            assert len(pigeonring._chains(rings[:1], rings[1:], np.array([h]), length)[0]) == 1


def test_packed_counts_and_large_batches():
    for counts in ([0, 1, 255], [0, 256, 70], [0, 70_000, 2**32 - 1]):
        assert pigeonring._counts(pigeonring._packed(np.array(counts, np.int64))).tolist() == counts
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 70_000)], names=["t"])
    assert [len(p) for p in pigeonring.slices(batch)] == [65_536, 4_464]


@pytest.mark.parametrize("many", [1, components.MANY])
def test_components_with_hubs(spark, monkeypatch, many):
    monkeypatch.setattr(components, "MANY", many)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 2000) for i in range(300)] + [(399, 500), (500, 1000)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 702


def test_shingles_equal_words():
    texts = ["A b  c, d!", None, "", "a b c d", "İstanbul K 1 2 3", "one two"]
    d, o, h = shingle_sets(pa.array(texts), 3, 3)
    assert d.tolist() == [0, 3, 4]
    assert set(h[o[0] : o[1]].tolist()) == set(h[o[1] : o[2]].tolist())
    assert o[3] - o[2] == 4  # i stanbul k 1 2 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (200, 300), (50, 50)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[100] == got[101] == got[102] == 100 and got[300] == 200


def test_groups_have_a_row_for_every_id(spark):
    long = "one two three four five six seven eight"
    texts = [("a", long), ("b", long.upper()), ("s1", "Item 1. None"), ("s2", "item 1 none"), ("s3", "Other stub"), ("n", None), ("e", " \n"), ("p", "--"), ("a", None), ("s3", "Other stub"), (None, "x")]
    df = spark.createDataFrame(texts, "section_id string, content string")
    got = {r["id"]: r for r in pigeonring.similar_groups(df, "section_id", "content", 0.8, 5, 5).collect()}
    assert {i: (r["links"], r["copies"]) for i, r in got.items()} == {"a": (0, 2), "b": (0, 2), "s1": (0, 2), "s2": (0, 2), "s3": (0, 1), "n": (0, 3), "e": (0, 3), "p": (0, 3)}
    assert pigeonring.similar_groups(df, "section_id", "content", 0.8, 5, 5).count() == 8
    assert len({r["group_id"] for r in got.values()}) == 4 and got["s1"]["group_id"] == got["s2"]["group_id"]
