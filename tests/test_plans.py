import json

import pytest

from docketry.operators import retrieval
from docketry.plans import ingest
from docketry.plans.engine import NOTHING, Engine
from docketry.sources import feeds
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, FOLDER)


def test_search_modes(engine):
    found = engine.search("notes due and interest coverage", mode="text", k=5).collect()
    assert 0 < len(found) <= 5 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    only = engine.search("notes due", filing_types=["10-K"], mode="text", k=5).collect()
    assert {r["filing_type"] for r in only} <= {"10-K"}
    vector = [0.1] * 64
    assert len(engine.search(vector=vector, mode="semantic", k=3).collect()) == 3
    assert len(engine.search("notes due", vector, k=4).collect()) == 4
    assert engine.search(" ", mode="text").count() == 0
    with pytest.raises(ValueError):
        engine.search("x", mode="other")
    assert engine.search("notes due", mode="text", k=5) is engine.search("notes due", mode="text", k=5)


def test_similar_ask_and_stats(engine):
    one = engine.search("notes due", mode="text", k=1).first()["section_id"]
    near = engine.similar(one, 3).collect()
    assert all(r["section_id"] != one for r in near)
    asked = engine.ask("What is said about notes due in annual filings?", 3)
    assert asked["sources"] and asked["answer"].startswith("[1]") and engine.history[-1] is asked
    assert engine.ask("qqqq zzzz xxxx")["answer"] == NOTHING and len(engine.history) == 1
    assert engine.stats().count() == 6
    assert engine.sector_tickers("what is said of trees") == [] and len(engine.sector_tickers("how do banks and energy firms lend")) <= 5
    assert engine.usage()["queries"] == 2 and engine.usage()["failed"] == 1 and asked["types"] and asked["companies"]
    assert engine.insider(least_shares=0, k=5).count() == 5


def test_hybrid(spark):
    s = spark.createDataFrame([("a", 0.8), ("b", 0.5)], "k string, score double")
    t = spark.createDataFrame([("a", 1.0), ("c", 0.5)], "k string, score double")
    assert rows(retrieval.hybrid(s, t, "k")) == [("a", 1.0, "semantic,text"), ("b", 0.5, "semantic"), ("c", 0.6, "text")]


def test_feeds(spark):
    one = {"0": {"cik_str": 7, "ticker": "abc", "title": "A"}, "1": {"cik_str": 8, "ticker": "ABC", "title": "B"}}
    got = feeds.company_tickers(spark.createDataFrame([(json.dumps(one),)], "j string"), "j")
    assert rows(got) == [("ABC", "0000000008", "B")]
    feed = {"filings": {"recent": {"accessionNumber": ["1", "2"], "filingDate": ["2024-05-01", "2024-02-01"], "form": ["10-Q", "10-K"], "primaryDocument": ["q.htm", "k.htm"]}}}
    df = spark.createDataFrame([("x", json.dumps(feed))], "c string, j string")
    assert feeds.company_filings(df, "j", ["c"]).count() == 2
    kept = feeds.company_filings(df, "j", ["c"], ["10-k"]).collect()
    assert len(kept) == 1 and kept[0]["primaryDocument"] == "k.htm" and kept[0]["reportDate"] is None
    assert feeds.company_filings(df, "j", ["c"], limit=1).first()["form"] == "10-Q"
    v = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<double>")
    assert rows(v.select(feeds.decompress(feeds.compress("v")).alias("x"))) == [(None,), ([1.0, -2.5],)]
    assert rows(spark.createDataFrame([("zz",), (None,)], "t string").select(feeds.decompress("t"))) == [(None,), (None,)]
    assert rows(feeds.sector_companies(spark.createDataFrame([('{"a": ["x", "y"]}',)], "j string"), "j")) == [("a", "x"), ("a", "y")]


def test_ingest(spark, tmp_path):
    places = ingest.write_model(spark, FOLDER, str(tmp_path / "model"))
    assert spark.read.parquet(places["section"]).count() > 0
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 5), ("b", 0, 4), ("c", 3, 1)], "k string, v int, at int")
    assert rows(ingest.upsert(old, new, "k", ["at"]).select("k", "v")) == [("a", 2), ("b", 1), ("c", 3)]
    assert rows(ingest.upsert(None, new, "k", ["at"]).select("k", "v")) == [("a", 2), ("b", 0), ("c", 3)]
    assert ingest.duplicate_count(old.union(old), "k").count() == 2
    with pytest.raises(ValueError):
        ingest.clear(spark, places["company"])
    ingest.save_vocabulary(spark.createDataFrame([(0, "x", 2)], "term_id int, term string, df long"), 9, str(tmp_path / "v"))
    vocab, n = ingest.load_vocabulary(spark, str(tmp_path / "v"))
    assert n == 9 and vocab.count() == 1


def test_engine_helpers(spark, engine):
    ticker = engine.companies.first()["ticker"]
    assert engine.company(ticker)["ticker"] == ticker and engine.company("none") is None
    assert engine.sql("select count(*) as n from companies where ticker = :t", t=ticker).first()["n"] == 1
    assert all(engine.health().values())
    df, text = engine.report(["notes due", "qqqq"], 2)
    assert rows(df.select("question", "answered")) == [("notes due", True), ("qqqq", False)] and "1 of 2" in text


def test_structure_and_embedder(spark):
    from docketry.functions.embedder import hashing
    from docketry.operators import structure

    body = "word " * 40
    text = f"Item 1. Business\n{body}\nItem 1A: Risk   Factors\n{body}\nItem 2 Properties short"
    df = spark.createDataFrame([(1, text, "10-K"), (2, None, "10-K"), (3, text, "8-K")], "k int, t string, f string")
    got = structure.filing_sections(df, "k", "t", "f").orderBy("begin_at").collect()
    assert [(r["k"], r["section"], r["word_count"]) for r in got] == [(1, "Item 1", 43), (1, "Item 1A", 44)]
    assert all(text[r["begin_at"] : r["end_at"]].strip() == r["content"] for r in got)
    q = spark.createDataFrame([(1, f"Part I x Item 2. Management’s Discussion {body} Part II y Item 6 Exhibits {body}", "10-Q")], "k int, t string, f string")
    assert [r["section"] for r in structure.filing_sections(q, "k", "t", "f").orderBy("begin_at").collect()] == ["Part I Item 2", "Part II Item 6"]
    vectors = spark.createDataFrame([("revenue grew strongly",), ("revenue grew strongly",), (" ",), (None,)], "t string").select(hashing(16)("t").alias("v")).collect()
    assert vectors[0]["v"] == vectors[1]["v"] and len(vectors[0]["v"]) == 16 and vectors[2]["v"] is None and vectors[3]["v"] is None


def test_sections_of_all_forms(spark):
    from docketry.operators import structure

    for form, entries in structure.FORMS.items():
        body = "word " * 40
        text = "".join(f"{structure.heading(p)}\n{body}\n" for p in entries.values())
        got = structure.filing_sections(spark.createDataFrame([(1, text, form, 5)], "k int, t string, f string, begin_at int"), "k", "t", "f").orderBy("begin_at").collect()
        assert [r["section"] for r in got] == list(entries)
        assert "".join(text[r["begin_at"] : r["end_at"]] for r in got) == text
    words = " ".join(f"w{i}" for i in range(3000))
    got = structure.filing_sections(spark.createDataFrame([(1, words, "SC 13G"), (2, None, "4"), (3, "short", None)], "k int, t string, f string"), "k", "t", "f").orderBy("begin_at").collect()
    assert [r["section"] for r in got] == [f"Section {i}" for i in range(1, len(got) + 1)] and " ".join(r["content"] for r in got) == words
    assert all(5000 <= len(r["content"]) + 1 for r in got[:-1])


def test_preferred_sections_have_their_text(spark):
    from docketry.operators import structure

    body = "text " * 30
    text = f"Intro\nItem 1A. Risk Factors {body}\nItem 2. Properties {body}\nSignatures\n{body}"
    got = {r["section"]: r for r in structure.preferred_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()}
    assert got["risk_factors"]["content"] == f"Item 1A. Risk Factors {body}".strip() and got["properties"]["content"] == f"Item 2. Properties {body}".strip()
    assert text[got["properties"]["begin_at"] - 1 :].startswith("Item 2.") and got["properties"]["preference"] == 0


def test_whole_ingestion(spark, tmp_path):
    report = {r["table"]: r["rows"] for r in ingest.run(spark, FOLDER, str(tmp_path / "all")).collect()}
    assert set(report) == {"company", "filing", "section", "fact", "trade", "executive", "chunk", "vocabulary"} and all(n > 0 for n in report.values())
    assert report["trade"] == spark.read.parquet(str(tmp_path / "all" / "trade")).count()


def test_stream_reads_files_and_folders(spark, tmp_path):
    from docketry.streaming import events

    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert rows(events.stream_hourly(spark, str(tmp_path))) == rows(events.stream_hourly(spark, FOLDER))


def test_company_info(spark):
    feed = spark.createDataFrame([(json.dumps({"0": {"cik_str": 7, "ticker": "abc", "title": "A"}, "1": {"cik_str": 8, "ticker": "x", "title": "B"}}),)], "j string")
    subs = spark.createDataFrame([(json.dumps({"cik": "7", "name": "Alpha", "sic": "10", "exchanges": ["N"], "addresses": {}}),), ("{bad",), (None,)], "j string")
    got = rows(feeds.company_info(feeds.company_tickers(feed, "j"), feeds.company_submissions(subs, "j")).select("ticker", "cik", "name", "sic", "exchanges"))
    assert got == [("ABC", "0000000007", "Alpha", "10", ["N"]), ("X", "0000000008", "B", None, None)]


def test_facts_with_and_without_their_wrapper(spark):
    from docketry.operators.facts import flatten_facts

    bare = {"us-gaap": {"Revenues": {"units": {"USD": [{"val": 10, "form": "10-K", "filed": "2024-02-01", "frame": "CY2023"}, {"val": 11, "end": "2023-12-31"}]}}, "Assets": {"units": {}}}, "dei": {"Shares": {"units": {"shares": [{"val": 5}]}}}}
    df = spark.createDataFrame([(1, json.dumps(bare)), (2, json.dumps({"facts": bare})), (3, "{bad"), (4, None), (5, "{}")], "k int, j string")
    got = rows(flatten_facts(df, "j", ["k"]).select("k", "taxonomy", "concept", "unit", "value", "period", "frame", "form", "filed"))
    one = [("dei", "Shares", "shares", 5.0, None, None, None, None), ("us-gaap", "Revenues", "USD", 10.0, None, "CY2023", "10-K", "2024-02-01"), ("us-gaap", "Revenues", "USD", 11.0, "2023-12-31", None, None, None)]
    assert got == sorted([(k, *r) for k in (1, 2) for r in one], key=repr)


def test_process_documents(spark):
    body = "word " * 50
    df = spark.createDataFrame([(1, f"<p>Item 1. Business</p>{body}<b>Item 2. Properties</b> {body}", "10-K"), (2, "plain &amp; short", "10-K"), (3, None, "10-K")], "k int, t string, f string")
    got = ingest.process_documents(df, "k", "t", "f", 120, 10).orderBy("k", "section", "chunk_no").collect()
    assert {(r["k"], r["section"]) for r in got} == {(1, "Item 1"), (1, "Item 2"), (2, "10-k_content")}
    assert max(len(r["chunk"]) for r in got) <= 120 and len({r["chunk_id"] for r in got}) == len(got) and all(len(r["chunk_id"]) == 16 for r in got)
