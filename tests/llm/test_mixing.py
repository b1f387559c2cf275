import math
import os

import pytest

from docketry.llm import byte_bpe, mixing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(byte_bpe.VOCABULARY), reason="no vocabulary here")


def sizes_of(spark, spec):
    data = [(i, s, t) for s, ts in spec.items() for i, t in ((hash_id(s, k), t) for k, t in enumerate(ts))]
    return spark.createDataFrame(data, "doc_id long, source string, tokens long")


def hash_id(source, k):
    return sum(map(ord, source)) * 100_000 + k


def targets_of(spark, data):
    return spark.createDataFrame(data, "source string, target_weight double, max_repeats int")


def test_shares_are_reached_within_caps(spark):
    spec = {"a": [10] * 3000, "b": [7] * 400, "c": [5] * 200}
    targets = targets_of(spark, [("a", 2.0, 1), (" B ", 1.0, 9), ("c", 1.0, 2), ("none", 1.0, 3)])
    sizes = sizes_of(spark, spec)
    plan = mixing.plan(sizes, targets)
    uses = mixing.mix(sizes, plan)
    got = {r["source"]: r for r in mixing.reached_shares(uses, plan).collect()}
    assert got["none"]["short"] and got["c"]["short"] and not got["a"]["short"]
    assert got["c"]["used_tokens"] == 2 * 1000 and got["none"]["used_tokens"] == 0
    total = 3000 * 10 + 400 * 7 + 1000
    assert abs(sum(r["used_tokens"] for r in got.values()) - total) <= 20
    assert all(r["most_uses"] <= r["max_repeats"] for r in got.values())
    # a and b keep the proportion of their targets
    assert abs(got["a"]["used_tokens"] / got["b"]["used_tokens"] - 2) < 0.01
    per = {(r["source"], r["uses"]) for r in uses.select("source", "uses").distinct().collect()}
    assert len({u for s, u in per if s == "b"}) <= 2
    again = mixing.mix(sizes, plan)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, uses.collect()))


def test_exponent_falls_when_caps_bind():
    rows = [dict(source="big", tokens=900, max_repeats=1, target_share=0.5), dict(source="small", tokens=60, max_repeats=5, target_share=0.3), dict(source="gone", tokens=40, max_repeats=1, target_share=0.2)]
    use, short, exponent = mixing.budgets(rows, 1000)
    assert short == {"gone"} and 0 <= exponent < 1 and use["gone"] == 40 and use["small"] <= 300 and use["big"] <= 900
    assert abs(sum(use.values()) - 1000) <= 3


def test_what_natural_shares_cannot_give_is_shared_anew():
    rows = [dict(source="a", tokens=500, max_repeats=1, target_share=0.3), dict(source="b", tokens=300, max_repeats=1, target_share=0.2), dict(source="c", tokens=100, max_repeats=9, target_share=0.02), dict(source="d", tokens=10, max_repeats=1, target_share=0.48)]
    use, short, exponent = mixing.budgets(rows, 1500)
    assert short == {"d"} and use["a"] == 500 and use["b"] == 300 and use["c"] == 690 and exponent == 1.0
    use, short, _ = mixing.budgets(rows, 5000)
    assert sum(use.values()) == 500 + 300 + 900 + 10  # everything there is
    assert mixing.budgets([], 0) == ({}, set(), 1.0)


def test_budget_is_filled_with_smaller_documents(spark):
    spec = {"a": [997, 613, 401, 350, 220, 90, 41, 17, 6, 3] * 7, "b": [50] * 300}
    sizes = sizes_of(spark, spec)
    targets = targets_of(spark, [("a", 0.41, 1), ("b", 0.59, 3)])
    plan = mixing.plan(sizes, targets, total_share=0.8)
    used = {r["doc_id"]: r["uses"] for r in mixing.mix(sizes, plan).collect()}
    budget = {r["source"]: r["budget"] for r in plan.collect()}
    every = {(r["doc_id"], r["source"]): r["tokens"] for r in sizes.collect()}
    for source in "ab":
        missing = budget[source] - sum(t * used.get(i, 0) for (i, s), t in every.items() if s == source)
        least = min((t for (i, s), t in every.items() if s == source and used.get(i, 0) == min(used.get(j, 0) for j, s2 in every if s2 == source)), default=0)
        assert 0 <= missing < least


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 50)
    sizes = sizes_of(spark, {"a": [10, 20, 30] * 500, "b": [8] * 600})
    plan = mixing.plan(sizes, targets_of(spark, [("a", 1.0, 1), ("b", 1.0, 4)]), total_share=0.7)
    for r in mixing.reached_shares(mixing.mix(sizes, plan), plan).collect():
        assert 0 <= r["budget"] - r["used_tokens"] < 30 and r["most_uses"] <= r["max_repeats"]


def test_entropy_plan(spark):
    sizes = sizes_of(spark, {"a": [10] * 900, "b": [10] * 90, "c": [10] * 10})
    targets = targets_of(spark, [("a", 1.0, 1), ("b", 5.0, 40), ("c", 9.0, 400), ("none", 1.0, 1)])
    plan = mixing.plan(sizes, targets, evenness=0.9)
    shares = [r["target_share"] for r in plan.collect()]
    assert abs(mixing.entropy(shares) - 0.9 * math.log(3)) < 1e-6
    got = {r["source"]: r for r in mixing.reached_shares(mixing.mix(sizes, plan), plan).collect()}
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.01 for r in got.values()) and got["none"]["used_tokens"] == 0


def test_temperature_meets_entropy():
    tokens = {"a": 900, "b": 90, "c": 10}
    shares = mixing.temperature_shares(tokens, 0.9 * math.log(3))
    assert abs(mixing.entropy(list(shares.values())) - 0.9 * math.log(3)) < 1e-6 and shares["a"] > shares["b"] > shares["c"]


def test_one_source_holds_most_and_ties(spark):
    spec = {"hot": [3] * 20_000, "cold": [3] * 20}
    sizes = sizes_of(spark, spec)
    plan = mixing.plan(sizes, targets_of(spark, [("hot", 1.0, 1), ("cold", 1.0, 50)]))
    uses = mixing.mix(sizes, plan)
    got = {r["source"]: r for r in mixing.reached_shares(uses, plan).collect()}
    assert got["cold"]["used_tokens"] == 50 * 60 and got["hot"]["used_tokens"] <= 60_000


@needs_vocabulary
def test_found_and_defined_cases(spark):
    docs = spark.createDataFrame([(1, "one two three", "A"), (2, None, "a "), (3, "", "b"), (4, "x", None), (5, "y", "other"), (6, "long " * 1000, "c")], "doc_id long, text string, source string")
    targets = targets_of(spark, [("a", 1.0, 1), ("b", 1.0, 5), ("C", 0.1, None), (None, 3.0, 1), ("d", None, 1)])
    sizes = mixing.document_sizes(docs, targets)
    assert sorted((r["doc_id"], r["source"]) for r in sizes.collect()) == [(1, "a"), (2, "a"), (3, "b"), (6, "c")]
    short = sorted(r["source"] for r in mixing.plan(sizes, targets).filter("short").collect())
    assert short == ["a", "b"]
    none = mixing.document_sizes(docs.limit(0), targets)
    plan = mixing.plan(none, targets)
    assert plan.filter("short").count() == 0 and plan.count() == 4
    uses = mixing.mix(none, plan)
    assert mixing.plan(none, targets.limit(0)).count() == 0
    assert uses.count() == 0 and mixing.reached_shares(uses, plan).count() == 4
