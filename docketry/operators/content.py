"""Cleaning, judging, cutting and mining of filing text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.operators.graph import SECTION_SQL, latest_rows
from docketry.operators.structure import packed
from docketry.registry import query
from docketry.tables import table


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extents(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, place, heading, body, begin_at, end_at): stretches from each match to the next one.

    All match offsets come from the texts between matches, so no Python is needed.
    """
    heads, between = matches(F.col(text), pattern), F.split(F.col(text), pattern, -1)
    both = docs.filter(F.col(text).isNotNull()).select(key, F.length(text).alias("n"), heads.alias("h"), between.alias("b")).filter(F.size("h") > 0)
    begins = F.aggregate(
        F.sequence(F.lit(0), F.size("h") - 1), F.array(F.length(F.get("b", F.lit(0)))),
        lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(F.get("h", i)) + F.length(F.get("b", i + 1)))),
    )
    each = both.withColumn("at", begins).select(key, "n", "b", "at", F.posexplode("h").alias("i", "heading"))
    return each.select(key, (F.col("i") + 1).alias("place"), "heading", F.get("b", F.col("i") + 1).alias("body"), F.get("at", F.col("i")).alias("begin_at"), F.get("at", F.col("i") + 1).alias("end_at"))


def _spans(source: DataFrame, key: str, number: str, spans, chunk) -> DataFrame:
    """One row per span of each text (columns k and t): key, number, begin_at, end_at, chunk."""
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for no, (begin, end) in enumerate(spans(text), 1):
                    part = chunk(text[begin:end])
                    if part:
                        take.append(i)
                        rows.append((no, begin, end, part))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], names=[key, number, "begin_at", "end_at", "chunk"])

    return source.mapInArrow(run, f"`{key}` {kind}, {number} int, begin_at int, end_at int, chunk string")


def greedy_chunks(docs: DataFrame, key: str, text: str, limit: int = 5000) -> DataFrame:
    """(key, chunk_no, begin_at, end_at, chunk): words packed greedily; a chunk closes with the word
    that brings the sum of word lengths, one more for each, to the limit."""
    source = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return _spans(source, key, "chunk_no", lambda t: packed(t, limit), lambda t: " ".join(t.split()))


#: Characters at which a word ends, how far one is looked for.
WORD_ENDS, WORD_REACH = " \n\t.!?;", 100
_WORD_END = re.compile(f"[{re.escape(WORD_ENDS)}]")


def word_windows(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of overlapping windows whose ends are moved to the ends of words.

    A start is moved forward behind the next word end, an end backward behind the last one, both
    within WORD_REACH characters; where there is none they stay. A text within the limit is one.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    starts = [0]
    while starts[-1] + limit < n:
        at = starts[-1] + limit - overlap
        met = _WORD_END.search(text, at, min(n, at + WORD_REACH))
        at = met.end() if met else at
        starts.append(at if at > starts[-1] else starts[-1] + limit // 2)
    out = []
    for begin in starts:
        end = min(begin + limit, n)
        if end < n:
            low = max(0, end - WORD_REACH) + 1
            end = next((i + 1 for i in range(end, low - 1, -1) if text[i] in WORD_ENDS), end)
        out.append((begin, end))
    return out


def overlapping_chunks(docs: DataFrame, key: str, text: str, limit: int = 8000, overlap: int = 400) -> DataFrame:
    """(key, chunk_no, begin_at, end_at, chunk): ``word_windows`` without outer white space; chunk_no
    counts windows from 1, blank ones give no row."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    source = docs.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return _spans(source, key, "chunk_no", lambda t: word_windows(t, limit, overlap), str.strip)


def chunk_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)


#: Amounts after the names of figures.
FIGURES = {
    "revenue": [
        r"revenue[s]?\s*[:\-]?\s*\$?([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?",
        r"net\s+revenue[s]?\s*[:\-]?\s*\$?([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?",
        r"total\s+revenue[s]?\s*[:\-]?\s*\$?([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?",
    ],
    "net_income": [
        r"net\s+income\s*[:\-]?\s*\$?([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?",
        r"net\s+earnings\s*[:\-]?\s*\$?([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?",
    ],
}


def amounts(docs: DataFrame, key: str, text: str, figures: dict[str, list[str]] = FIGURES) -> DataFrame:
    """(key, figure, place, amount, unit): every amount after the names of a figure, pattern by
    pattern; overlapping patterns repeat an amount. Amounts have no commas; no unit is empty."""

    def found(figure: str, patterns: list[str]) -> Column:
        both = [F.arrays_zip(matches(F.col(text), "(?i)" + p, 1).alias("a"), matches(F.col(text), "(?i)" + p, 2).alias("u")) for p in patterns]
        return F.transform(F.concat(*both), lambda m, i: F.struct(F.lit(figure).alias("figure"), i.alias("place"), F.replace(m["a"], F.lit(","), F.lit("")).alias("amount"), m["u"].alias("unit")))

    every = F.concat(*(found(figure, patterns) for figure, patterns in figures.items()))
    return docs.filter(F.col(text).isNotNull()).select(key, F.inline(every))


#: Tables in markup, between bars and between tabs (letters, digits and white space only).
TABLES = [r"(?is)<table[^>]*>.*?</table>", r"\|[^\n]*\|", r"(?m)^[\p{L}\p{N}_\s]+\t[\p{L}\p{N}_\s]+$"]


def tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, place, table_id, content, word_count): tables by the kind of their marks."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    # Without its mark a pattern need not be tried.
    found = [F.when(t.contains(mark), matches(t, p)).otherwise(none) for mark, p in zip(["<", "|", "\t"], TABLES)]
    of_kind = lambda i: lambda x, j: F.struct(F.lit(i).alias("kind"), j.alias("place"), x.alias("content"))
    every = F.concat(*(F.transform(f, of_kind(i)) for i, f in enumerate(found)))
    each = docs.filter(t.isNotNull()).select(key, F.inline(every))
    return each.select(key, "kind", "place", F.concat_ws("_", F.lit("table"), F.col("kind").cast("string"), F.col("place").cast("string")).alias("table_id"), "content", F.size(tx.words(F.col("content"))).alias("word_count"))


HEADING = r"(?m)^(?:Item|ITEM|Note|NOTE|Part|PART) [0-9IVX]+[A-Z]?\.[^\n]*"


def _sections(spark, folder):
    return latest_rows(table(spark, folder, "filing_section"), "section_id", ["created_at"], "load_id")


@query("content_quality", f"""with {SECTION_SQL}, w as (select section_id, content, list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r]+'), lambda x: x <> '') as words from section_once)
    select section_id, len(words) >= 10 and len(list_distinct(words)) * 10 >= len(words) * 3 and length(regexp_replace(content, '\\P{{L}}', '', 'g')) * 2 >= length(content) as good from w""")
def content_quality(spark, folder):
    return _sections(spark, folder).select("section_id", tx.is_good_content(F.col("content")).alias("good"))


@query("long_sections", f"with {SECTION_SQL} select section_id, length(trim(content))::int as chars from section_once where length(trim(content)) > 100")
def long_sections(spark, folder):
    n = F.length(F.trim("content"))
    return _sections(spark, folder).filter(n > 100).select("section_id", n.alias("chars"))


@query("clean_text", """select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '[-_=]{4,}', ' ', 'g'), ' +', ' ', 'g')) as text from documents""")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query("compact_text", """select section_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'), '\\.{3,}', '...', 'g'), '-{3,}', '---', 'g'), 'table of contents', '', 'gi')) as content from filing_section where load_id is not null""")
def compact_text(spark, folder):
    return table(spark, folder, "filing_section").select("section_id", tx.compact(F.col("content")).alias("content"))


@query("snippets", f"with {SECTION_SQL} select section_id, case when length(content) > 200 then left(content, 200) || '...' else content end as snippet from section_once")
def snippets(spark, folder):
    return _sections(spark, folder).select("section_id", tx.snippet(F.col("content")).alias("snippet"))


@query("truncated_text", "select doc_id, case when strlen(text) > 500 then left(text, 500) else text end as text from documents")
def truncated_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.truncated(F.col("text"), 500).alias("text"))


@query("document_summary", f"""with {SECTION_SQL}, w as (select filing_id, section_id, section_type, chunk_index, length(coalesce(content, '')) as chars, len(list_filter(regexp_split_to_array(coalesce(content, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) as words from section_once)
    select filing_id, count(*) as sections, sum(words)::bigint as words, count(distinct section_type) as kinds, arg_max(section_id, (words, -coalesce(chunk_index, 1000000), section_id)) as longest, ((sum(chars) + count(*) - 1) // 4)::bigint as tokens from w group by 1""")
def document_summary(spark, folder):
    content = F.coalesce("content", F.lit(""))
    rows = _sections(spark, folder).select("filing_id", "section_id", "section_type", "chunk_index", F.length(content).alias("chars"), F.size(tx.words(content)).alias("words"))
    first = F.struct("words", -F.coalesce("chunk_index", F.lit(1000000)), "section_id")
    return rows.groupBy("filing_id").agg(F.count("*").alias("sections"), F.sum("words").alias("words"), F.countDistinct("section_type").alias("kinds"), F.max_by("section_id", first).alias("longest"), F.floor((F.sum("chars") + F.count("*") - 1) / 4).alias("tokens"))


@query("token_estimate", "select source, count(*) as documents, (sum(length(text)) // 4)::bigint as tokens, sum(greatest(1, length(text) // 4))::bigint as tokens_each from documents where text is not null group by source")
def token_estimate(spark, folder):
    n = F.length("text")
    return table(spark, folder, "documents").filter("text is not null").groupBy("source").agg(F.count("*").alias("documents"), F.floor(F.sum(n) / 4).alias("tokens"), F.sum(tx.at_least_one_token(n)).alias("tokens_each"))


@query("item_extents", f"""with h as (select doc_id, regexp_extract_all(text, '{HEADING}') as heads, regexp_split_to_array(text, '{HEADING}') as between from documents where text is not null)
    select doc_id, unnest(range(1, len(heads) + 1))::int as place, unnest(heads) as heading, unnest(list_transform(range(1, len(heads) + 1), lambda i: length(between[i + 1])))::int as body_chars from h where len(heads) > 0""")
def item_extents(spark, folder):
    return extents(table(spark, folder, "documents"), "doc_id", "text", HEADING).select("doc_id", "place", "heading", F.length("body").alias("body_chars"))


_W = "[^ \\t\\n\\r\\f\\v\\x1C-\\x1F\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query("greedy_chunks", f"""with recursive w as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from (select doc_id, regexp_extract_all(text, '{_W}') as words from documents where text is not null)),
    p as (select doc_id, i, word, sum(length(word) + 1) over (partition by doc_id order by i) as total, count(*) over (partition by doc_id) as n from w),
    c(doc_id, chunk_no, first, last, total, n) as (
        select doc_id, 1, 1::bigint, min(i) filter (total >= 1000 or i = n), min(total) filter (total >= 1000 or i = n), any_value(n) from p group by doc_id
        union all
        select p.doc_id, any_value(c.chunk_no) + 1, min(p.i), min(p.i) filter (p.total >= c.total + 1000 or p.i = p.n), min(p.total) filter (p.total >= c.total + 1000 or p.i = p.n), any_value(p.n) from c join p on p.doc_id = c.doc_id and p.i > c.last group by p.doc_id)
    select c.doc_id, chunk_no::int as chunk_no, string_agg(word, ' ' order by i) as chunk from c join p on p.doc_id = c.doc_id and p.i between c.first and c.last group by 1, 2""")
def greedy_chunks_query(spark, folder):
    return greedy_chunks(table(spark, folder, "documents"), "doc_id", "text", 1000).select("doc_id", "chunk_no", "chunk")


_ENDS = "[ \\n\\t.!?;]"


@query("overlapping_chunks", f"""with recursive d as (select load_id, content, length(content) as n from document_chunk where length(content) > 0),
    s(load_id, chunk_no, begin_at) as (
        select load_id, 1, 0::bigint from d
        union all
        select d.load_id, s.chunk_no + 1, begin_at + 1800 + length(regexp_extract(substring(content, begin_at + 1801, 100), '^[^ \\n\\t.!?;]*{_ENDS}')) from s join d using (load_id) where begin_at + 2000 < n),
    e as (select load_id, chunk_no, begin_at, content, n, case when begin_at + 2000 >= n then n else begin_at + 2000 end as stop, substring(content, begin_at + 1902, 100) as back from s join d using (load_id)),
    f as (select *, case when stop < n and regexp_matches(back, '{_ENDS}') then stop - 99 + length(regexp_extract(back, '(?s)^.*{_ENDS}')) else stop end as end_at from e),
    g as (select *, regexp_replace(regexp_replace(substring(content, begin_at + 1, end_at - begin_at), '^{_W.replace("[^", "[")}', ''), '{_W.replace("[^", "[")}$', '') as chunk from f)
    select load_id, chunk_no::int as chunk_no, begin_at::int as begin_at, end_at::int as end_at, chunk from g where chunk <> ''""")
def overlapping_chunks_query(spark, folder):
    return overlapping_chunks(table(spark, folder, "document_chunk"), "load_id", "content", 2000, 200)


@query("chunk_ids", "select load_id, left(md5(coalesce(metadata.accession_number || '_', '') || coalesce(section_type || '_', '') || coalesce(metadata.chunk_index::varchar, '')), 16) as id from document_chunk where metadata is not null and metadata.accession_number is not null and section_type is not null and metadata.chunk_index is not null")
def chunk_ids(spark, folder):
    rows = table(spark, folder, "document_chunk").filter("metadata.accession_number is not null and section_type is not null and metadata.chunk_index is not null")
    return rows.select("load_id", chunk_id(F.col("metadata.accession_number"), F.col("section_type"), F.col("metadata.chunk_index").cast("string")).alias("id"))


@query("table_rows", "select load_id, kind, unnest(range(len(r)))::int as place, unnest(r) as content from (" + " union all ".join(f"select load_id, {i} as kind, regexp_extract_all(content, '{p}') as r from document_chunk where content is not null" for i, p in enumerate(TABLES)) + ")")
def table_rows(spark, folder):
    return tables(table(spark, folder, "document_chunk"), "load_id", "content").select("load_id", "kind", "place", "content")


def _marked(i: int, name: str) -> str:
    return f"'<table class=\"t{i}\"><tr><td>' || {name} || '</td></tr></table>'" if i == 0 else f"'| ' || {name} || ' |'"


@query("tables_in_markup", f"""with t as (select load_id, replace(replace(replace(section_name, '|', ' '), '<', ' '), chr(10), ' ') as name, replace(replace(coalesce(section_type, ''), '|', ' '), chr(10), ' ') as kind from filing_section where section_name is not null)
    select load_id, kind_no as kind, place, 'table_' || kind_no || '_' || place as table_id, cell as content from (
    select load_id, 0 as kind_no, 0 as place, {_marked(0, 'name')} as cell from t union all select load_id, 1, 0, {_marked(1, 'name')} from t union all select load_id, 1, 1, {_marked(1, 'kind')} from t)""")
def tables_in_markup(spark, folder):
    """The names of all sections written as a table in markup and two lines between bars, and found again."""
    flat = lambda c, marks: F.translate(F.coalesce(F.col(c), F.lit("")), marks, " " * len(marks))
    name, kind = flat("section_name", "|<\n"), flat("section_type", "|\n")
    text = F.concat(F.lit('Before\n<table class="t0"><tr><td>'), name, F.lit("</td></tr></table>\nbetween\n| "), name, F.lit(" |\n| "), kind, F.lit(" |\nafter"))
    docs = table(spark, folder, "filing_section").filter("section_name is not null").select("load_id", text.alias("text"))
    return tables(docs, "load_id", "text").select("load_id", "kind", "place", "table_id", "content")


@query("amounts", "select load_id, figure, (row_number() over (partition by load_id, figure order by p, place) - 1)::int as place, amount, unit from (" + " union all ".join(
    f"select load_id, '{figure}' as figure, {i} as p, unnest(range(len(a))) as place, unnest(list_transform(a, lambda x: replace(x, ',', ''))) as amount, coalesce(unnest(u), '') as unit from (select load_id, regexp_extract_all(content, '(?i){p}', 1) as a, regexp_extract_all(content, '(?i){p}', 2) as u from filing_section where content is not null)"
    for figure, patterns in FIGURES.items() for i, p in enumerate(patterns)) + ")")
def amounts_query(spark, folder):
    return amounts(table(spark, folder, "filing_section"), "load_id", "content")


@query("clean_documents")
def clean_documents(spark, folder):
    """Documents without markup, entities, page numbers and rules, by the catalogue of noise."""
    return table(spark, folder, "documents").select("doc_id", tx.clean_document(F.col("text")).alias("text"))
