import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import byte_bpe

pytestmark = pytest.mark.skipif(not os.path.exists(byte_bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(os.path.realpath(byte_bpe.VOCABULARY)), "byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    return byte_bpe.encoder(byte_bpe.VOCABULARY), reference


CASES = ["", " ", "  \n ", "a  b", "x's 'sx ''s it're I'll'll we've 'd!", "'s", " 's", "a 're", "1'2", "tab\t x", "　全角 ", "ไทย ข้อความ", "مرحبا 123", "naïve café", "👨‍👩‍👧 x", "<|endoftext|>", "a b", "-----", "  lead", "trail  ", "\r\n\r\n x", "x" * 5000, "." * 900 + " " * 900 + "a", "²³ ½x", "́a"]


def test_cases_equal_reference(pair):
    code, reference = pair
    ids, begin = code.encode_batch(CASES)
    for i, text in enumerate(CASES):
        assert ids[begin[i] : begin[i + 1]].tolist() == reference.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" 'stmdrevl\n\t1a.")), st.characters(exclude_categories=["Cs", "Cn"])), max_size=25), min_size=1, max_size=6))
def test_round_trip_and_reference(pair, texts):
    code, reference = pair
    ids, begin = code.encode_batch(texts)
    for i, text in enumerate(texts):
        own = ids[begin[i] : begin[i + 1]].tolist()
        assert code.decode(own) == text
        assert own == reference.encode(text, add_special_tokens=False).ids


def test_scan_is_independent_of_grouping(pair):
    code, _ = pair
    text = "it's we're 'll''s don't x'" * 50
    whole, _ = code.encode_batch([text])
    parts, begin = code.encode_batch([text] * 7)
    assert all(parts[begin[i] : begin[i + 1]].tolist() == whole.tolist() for i in range(7))


def test_table_forms(spark, pair):
    code, _ = pair
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, " ", 9), (5, "long " * 300_000, 9)], "doc_id long, text string, ids int")
    got = byte_bpe.encode(df, offsets=True)
    assert got.columns == ["doc_id", "ids", "starts"] and dict(got.dtypes)["ids"] == "array<int>"
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["ids"] == [] and by[3]["ids"] == [] and by[4]["ids"] == [220] and by[1]["starts"] == [0, 1]
    assert code.decode(by[5]["ids"]) == "long " * 300_000 and got.count() == 6
    counts = {r["doc_id"]: r["tokens"] for r in byte_bpe.count_tokens(df, ["doc_id"]).collect()}
    assert counts[2] == 0 and counts[1] == 2 and counts[5] == len(by[5]["ids"])
    assert byte_bpe.encode(df.limit(0)).count() == 0
