import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm.sentences import sentences, split_sentences

CASES = {
    "plain": ["One here.", "Two there!", "Three?"],
    "abbreviations": ["Mr. Doe joined Acme Corp. as treasurer on Sept. 1, 2020.", "He met Dr. Roe."],
    "numbers": ["Net loss was $(255.8) million, or $.30 a share, under Rule 17b-5.", "It rose 1.5% vs. 2.5%."],
    "address": ["Details are at www.acme.example/ir/q14.html and in Form 10-K.", "Nothing material."],
    "acronym": ["The plant stands in the U.S. and abroad.", "The largest is in the U.S.", "Approx. 81 holders voted."],
    "hours": ["The call begins at 7 p.m. Eastern time.", "The lease ends at 11:59 p.m.", "The rest follows."],
    "initials": ["G. C. Doe and V. Roe own 7 shares (see Exhibit 8.5).", "Fine."],
    "quoted": ['"Demand held up. Costs fell by 8.1%," said Jane Doe.', "“Can we expand?” asked Dr. Roe.", 'The chair said, "Acme will keep it."', "Then all left."],
    "bracket": ["(All amounts are in thousands, except per-share data.)", "The board met (in Oct. and again in Dec.) twice."],
    "ellipsis": ["Why did sales fall so far... and will they return?", "Margins... narrowed."],
    "name": ["Zivvo! Foods, a brand of Acme, is sold here.", "It is good."],
    "de": ["Am 3. März 2021 beschloss der Vorstand der Acme AG den Verkauf.", "Die Acme GmbH & Co. KG liefert z. B. Bauteile.", "Sie kosten ca. 3 Tsd. Euro, d. h. wenig!", "„Wir rechnen damit. Mehr sage ich nicht“, erklärte Dr. Roe."],
    "fr": ["Le conseil a conclu : « Acme gardera sa filiale. »", "M. Roe est parti.", "Quelle sera la marge en 2020 ?", "Voir l’art. 5 et la p. 8."],
    "es": ["El consejo, ¿lo sabía?, aprobó la venta.", "La filial de EE. UU. cerró el año.", "¿Cuánto bajó?", "¡Mucho!", "La nota n.º 7 y el art. 7.3 lo explican."],
    "el": ["Θα διατηρηθεί το μέρισμα του 2024;", "«Η ζήτηση αντέχει. Το κόστος έπεσε», είπε ο κ. Roe.", "Η Acme Α.Ε. πούλησε π.χ. τη μονάδα."],
    "hi": ['डॉ. Roe ने कहा, "मांग स्थिर है। लागत घटी है", और बैठक समाप्त की।', "लाभ रु. ६८१ करोड़ रह गया।", "पूंजी बनी रही॥"],
    "ar": ["قال د. Roe: «الطلب مستقر. التكاليف أقل»، ثم غادر.", "هل ستستمر الشركة؟", "انخفض الربح."],
}


@pytest.mark.parametrize("name", CASES)
def test_joined_by_spaces(name):
    text = " ".join(CASES[name])
    assert [text[a:b] for a, b in sentences(text)] == CASES[name]


def test_scripts_without_spaces():
    ja = ["社長は「事業は堅調だ。増加も収まった。」と述べた。", "Acme社（以下「当社」という。）は事業を売却した。", "当社はAcme Co., Ltd.と契約を結んだ。", "監査役の意見は「異議はない。」", "配当は維持されるのか？", "主な要因は運賃の上昇である。"]
    zh = ["收入为59.1亿元，同比增长45.9%。", "董事长关于“需求稳定。运费有限。”的说法得到认可。", "财务总监说：“已经结束。”", "现金流仍然充足……但仍需关注！", "本公司与Acme Corp.签订了协议。"]
    for parts in (ja, zh):
        text = "".join(parts)
        assert [text[a:b] for a, b in sentences(text)] == parts
    th = ["รายได้เพิ่มขึ้นร้อยละ 3.7 ในปี 2025 เมื่อเทียบกับปีก่อน", "กำไรลดลงเพราะความต้องการ", "บริษัทขายธุรกิจให้แก่ Acme แล้ว"]
    text = " ".join(th)
    assert [text[a:b] for a, b in sentences(text)] == th


def test_blocks_lists_and_headings():
    text = "Item 9A. Risk Factors\n \nFirst line\nwraps here. Second.\n• one item. It goes\non here\n• two\n(a) three\n\nPART II. OTHER\r\n\r\nEnd without mark"
    assert [text[a:b] for a, b in sentences(text)] == ["Item 9A. Risk Factors", "First line\nwraps here.", "Second.", "• one item. It goes\non here", "• two", "(a) three", "PART II. OTHER", "End without mark"]


def test_missing_spaces_and_noise():
    text = "Costs won't recover.Excluding tax, it fell. See Dr. \U0001f680 Roe. M​r. Doe left."
    assert [text[a:b] for a, b in sentences(text)] == ["Costs won't recover.", "Excluding tax, it fell.", "See Dr. \U0001f680 Roe.", "M​r. Doe left."]


WORDS_AND_ADDRESSES = [
    ["He said no.", "She left the room."],
    ["She studied art.", "Then she left."],
    ["He wore a cap.", "Then he left."],
    ["See no. 5, art. 7 and No. A-12."],
    ["El art. 5 y la cap. IV de la ley.", "No hay más."],
    ["See https://www.example.com/investors/annual-reports/archive/2023/q4/Report.Final for details.", "Next one."],
    ["Ask " + "x" * 300 + "/page?name=1 today?", "Yes."],
    ["It fell" + " " * 100 + "in the U.S." + " " * 100 + "Treasury market.", "Rates rose."],
]


@pytest.mark.parametrize("parts", WORDS_AND_ADDRESSES)
def test_words_of_other_languages_and_long_reaches(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_greek_question_after_a_long_remark():
    text = "Θα το δούμε (USD 1,234,567,890.00 / 2024 / 12345);Θα δούμε."
    assert [text[a:b] for a, b in sentences(text)] == ["Θα το δούμε (USD 1,234,567,890.00 / 2024 / 12345);", "Θα δούμε."]
    assert len(sentences("One clause; another clause. Then β decays; it does.")) == 2


def test_index_of_the_cascade_leaves_out_only_rules_that_cannot_match(monkeypatch):
    from docketry.llm import sentences as module

    texts = [" ".join(parts) for parts in [*CASES.values(), *WORDS_AND_ADDRESSES]]
    texts += ["収入は「1.5億」。と述べた。Co.、Ltd.", "Rev.A.b.C. d.E!F? g;h…I ...j ...K", "x.html a.com b.Exe $.5 (.3 U.S.GAAP p.m.ET"]
    want = [sentences(t) for t in texts]
    whole = {}

    def plain(mark, word, spaced, following):
        if (mark, word) not in whole:
            whole[mark, word] = [(b, left, w, after, lang) for marks, b, left, w, after, _, words, lang in module._RULES if mark in marks and (words is None or word in words)]
        return whole[mark, word]

    monkeypatch.setattr(module, "_cascade", plain)
    assert [sentences(t) for t in texts] == want


def test_long_runs_take_linear_time():
    for text in ("a." * 50_000, "(" * 30_000 + "”" * 30_000, "x@y." * 20_000, "/a?" * 30_000, "\u200b." * 20_000 + "End. Now", "« " * 20_000 + "a. B" * 5_000):
        assert sentences(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\t。「」“”()«»;ไ\"'…é", max_size=80))
def test_cover_everything_once(text):
    spans = sentences(text)
    inside = [False] * len(text)
    last = 0
    for a, b in spans:
        assert last <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        last = b
        inside[a:b] = [True] * (b - a)
    assert all(inside[i] or c.isspace() for i, c in enumerate(text))


def test_table_forms(spark):
    data = [(1, "One. Two.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (5, "x" * 100_000, 5), (6, "One. Two.", 5), (7, "No end. " * 20_000, 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, start_pos int")
    got = split_sentences(df, with_text=True)
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {1: 2, 5: 1, 6: 2, 7: 20_000}
    assert split_sentences(df).dtypes == [("doc_id", "bigint"), ("start_pos", "int"), ("end_pos", "int")]
    assert split_sentences(df.limit(0)).count() == 0
