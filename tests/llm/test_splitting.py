import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import splitting
from tests.conftest import rows


def check(text, limit, overlap):
    parts = splitting.split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for a, b, _ in parts:
        assert 0 < b - a <= limit
    for (_, e, _), (s, e2, _) in zip(parts, parts[1:]):
        assert s == e - overlap and e2 > e
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!。é😀", min_size=1, max_size=900), st.integers(20, 120), st.integers(0, 10))
def test_pieces_cover_and_overlap(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_cuts_and_hard_ones():
    text = "\n\n".join("A sentence here. Another one follows it." for _ in range(40))
    assert {k for *_, k in check(text, 200, 20)[:-1]} <= {"blank_line", "sentence"}
    assert all(k == "hard" for *_, k in check("x" * 1000, 100, 10)[:-1])
    mixed = "word " * 30 + "y" * 300 + " word" * 30
    kinds = [k for *_, k in check(mixed, 100, 10)[:-1]]
    assert "hard" in kinds and "space" in kinds


def test_pieces_are_even():
    sizes = [b - a for a, b, _ in check("word " * 1700, 8000, 400)]
    assert len(sizes) == 2 and max(sizes) - min(sizes) < 200


def test_optimal_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice(["ab ", "c. ", "dd\n", "e", "\n\n"]) for _ in range(rng.randrange(30, 60)))
        limit, overlap = 40, 4
        if len(text) <= limit:
            continue
        places, kinds = splitting._boundaries(text, limit, overlap)
        n, count = len(text), -(-(len(text) - overlap) // (limit - overlap))
        even = (n + (count - 1) * overlap) / count
        options = dict(zip(places.tolist(), kinds.tolist()))

        def cost(start, end, n=n, even=even, options=options):
            return (0 if end == n else splitting.PENALTY[options[end]]) + splitting.IMBALANCE * ((end - start - even) / limit) ** 2

        best = {}
        for p in [*sorted(options), n]:
            tries = [cost(0, p)] if p <= limit else []
            tries += [best[q] + cost(q - overlap, p) for q in best if q < p and p - q + overlap <= limit]
            if tries:
                best[p] = min(tries)
        parts = check(text, limit, overlap)
        if n in best:
            assert abs(sum(cost(a, b) for a, b, _ in parts) - best[n]) < 1e-9


def test_table_forms(spark):
    long = "One sentence of some length. " * 500
    data = [(1, "a", long, 5, None), (2, "a", long, 5, None), (3, "b", "short", 0, 1), (4, "c", None, 0, 1), (5, None, long, 0, 1), (6, "d", "z" * 20_000, None, 7), (7, "e", "", 0, 0), (8, "f", "é" * 8000, 0, 1)]
    schema = "load_id long, chunk_id string, content string, start_position int, piece_no int"
    df = spark.createDataFrame(data, schema).selectExpr("*", "timestamp'2024-01-01' + make_interval(0,0,0,load_id) as ingested_at")
    got = splitting.oversized_chunks(df)
    assert sorted({r["chunk_id"] for r in got.collect()}) == ["a", "d"]
    a = got.filter("chunk_id = 'a'").orderBy("piece_no").collect()
    assert a[0]["start_position"] == 5 and a[0]["piece"] == long[: a[0]["piece_end"]] and a[-1]["piece_end"] == len(long)
    assert got.filter("chunk_id = 'd'").selectExpr("max(longest_run)").first()[0] == 20_000
    assert splitting.oversized_chunks(df.limit(0)).count() == 0
    short = splitting.pieces(df.filter("chunk_id = 'b'"), ["chunk_id"], keep_short=True)
    assert rows(short.select("chunk_id", "pieces", "piece"))[0] == ("b", 1, "short")
    with pytest.raises(ValueError):
        splitting.pieces(df, ["chunk_id"], limit=10, overlap=9)
