"""Terms of texts: counts, vocabulary, TF-IDF weights and ranked text search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.fixed import FINANCIAL_TERMS, STOP_WORDS, SYNONYMS
from docketry.functions.text import plain_ascii, terms
from docketry.operators.graph import SECTION_SQL, latest_rows
from docketry.registry import query
from docketry.session import cut
from docketry.tables import table


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): the terms of plain texts as codes into the batch's distinct words, in order."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    kept = pc.and_(pc.greater(pc.binary_length(flat), 2), pc.invert(pc.is_in(flat, value_set=_STOP)))
    rows = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))[kept.to_numpy(zero_copy_only=False)]
    coded = flat.filter(kept).dictionary_encode()
    return rows, coded.indices.to_numpy().astype(np.int64), coded.dictionary


_STOP = pa.array(sorted(set(STOP_WORDS)))


def _ids(rows: np.ndarray, code: np.ndarray, width: int, bigrams: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of words and, from ``width`` on, of pairs of neighbouring words."""
    if not bigrams or len(code) < 2:
        return rows, code
    near = np.flatnonzero(rows[1:] == rows[:-1])
    return np.concatenate([rows, rows[near]]), np.concatenate([code, width + code[near] * width + code[near + 1]])


def _named(ids: np.ndarray, words: pa.Array) -> pa.Array:
    """The terms that ids stand for."""
    width = max(len(words), 1)
    pair = np.maximum(ids - width, 0)
    second = pc.binary_join_element_wise(words.take(pa.array(pair // width)), words.take(pa.array(pair % width)), " ") if len(words) else words
    return pc.if_else(pa.array(ids < width), words.take(pa.array(np.where(ids < width, ids, 0))), second) if len(ids) else pa.array([], pa.string())


def _counts_of(rows: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, n) of the distinct terms of each row."""
    span = width + width * width
    both, n = np.unique(rows * span + ids, return_counts=True)
    return both // span, both % span, n


#: Texts that are counted together.
TOGETHER = 2000


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), plain_ascii(F.col(text)).alias("t"))


def term_counts(docs: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(key, term, n): how often each document has each term.

    A document is one row and is counted there, so nothing is shuffled. Null texts have no terms.
    """
    source = _texts(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, len(b), TOGETHER)):
            rows, code, words = _coded(batch.column(1))
            row, ids, n = _counts_of(*_ids(rows, code, len(words), bigrams), max(len(words), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), _named(ids, words), pa.array(n.astype(np.int64))], names=[key, "term", "n"])

    return source.mapInArrow(run, f"`{key}` {source.schema['k'].dataType.simpleString()}, term string, n long")


def document_frequencies(docs: DataFrame, text: str, bigrams: bool = True) -> DataFrame:
    """(term, df): in how many documents each term occurs; added up before the shuffle."""
    source = docs.withColumn("__one", F.lit(1))
    source = _texts(source, "__one", text).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, len(b), TOGETHER)):
            rows, code, words = _coded(batch.column(0))
            _, ids, _ = _counts_of(*_ids(rows, code, len(words), bigrams), max(len(words), 1))
            ids, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([_named(ids, words), pa.array(n.astype(np.int64))], names=["term", "n"])

    return source.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def is_financial(term: Column) -> Column:
    hit = F.lit(False)
    for t in FINANCIAL_TERMS:
        hit = hit | term.contains(t)
    return hit


def vocabulary(frequencies: DataFrame, documents: Column | int, min_df: int = 2, max_df: float = 0.95, most: int = 10_000) -> DataFrame:
    """(term_id, term, df) of (term, df): financial terms first, then by document frequency, then by term.

    Terms in fewer than ``min_df`` or more than ``max_df`` of the documents are left out.
    """
    df = frequencies.filter((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.lit(max_df) * documents)))
    # As a column: an expression in the order would be evaluated at every comparison.
    order = [F.desc("__fin"), F.desc("df"), F.asc("term")]
    # Take the best first (a bounded heap per task), then number the few that are left.
    best = df.withColumn("__fin", is_financial(F.col("term"))).orderBy(*order).limit(most)
    return best.withColumn("term_id", F.row_number().over(Window.orderBy(*order)) - 1).select("term_id", "term", "df")


#: Most terms of a vocabulary that is sent to all tasks; more is an error.
MOST_TERMS = 200_000


def tfidf(docs: DataFrame, key: str, text: str, vocab: DataFrame, documents: int, top: int | None = None, method: str = "tfidf") -> DataFrame:
    """(key, term, n, weight): the share of the term among the document's known terms times
    ln(N / df), rounded to six places; with ``method`` "bow" the weight is the count. ``top`` keeps
    the largest weights of each document, ties going to the smaller term.

    The vocabulary has a known bound (``most`` of ``vocabulary``) and goes to the texts, which
    stay put: a document is one row, so its total and its largest weights need no shuffle.
    """
    if method not in ("tfidf", "bow"):
        raise ValueError(f"unknown method {method!r}")
    known = [(r["term"], r["df"]) for r in vocab.select("term", "df").limit(MOST_TERMS + 1).collect()]
    if len(known) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    known.sort()
    sent = docs.sparkSession.sparkContext.broadcast(known)
    source = _texts(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_, df = pa.array([t for t, _ in sent.value], pa.string()), np.array([n for _, n in sent.value], np.int64)
        halves = [t.split(" ") for t, _ in sent.value]
        first = pa.array([h[0] for h in halves], pa.string())
        second = pa.array([h[1] if len(h) > 1 else None for h in halves], pa.string())
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, len(b), TOGETHER)):
            rows, code, words = _coded(batch.column(1))
            width = max(len(words), 1)
            # The vocabulary under this batch's ids, -1 for terms that it does not have.
            a, b = (pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy().astype(np.int64) for x in (first, second))
            single = second.is_null().to_numpy(zero_copy_only=False)
            ids = np.where(single, a, np.where((a >= 0) & (b >= 0), width + a * width + b, -1))
            order = np.argsort(ids, kind="stable")
            ranked = ids[order]
            row, term = _ids(rows, code, width, True)
            at = np.minimum(np.searchsorted(ranked, term), max(len(ranked) - 1, 0))
            hit = ranked[at] == term if len(ranked) else np.zeros(len(term), np.bool_)
            both, n = np.unique(row[hit] * max(len(known), 1) + order[at[hit]], return_counts=True)
            row, term = both // max(len(known), 1), both % max(len(known), 1)
            weight = n.astype(np.float64)
            if method == "tfidf":
                weight = np.round(n / np.bincount(row, n, len(batch))[row] * np.log(documents / df[term]), 6)
            if top is not None:
                order = np.lexsort((term, -weight, row))  # the vocabulary is sorted by term
                order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < top]
                row, term, n, weight = row[order], term[order], n[order], weight[order]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms_.take(pa.array(term)), pa.array(n.astype(np.int64)), pa.array(weight)], names=[key, "term", "n", "weight"])

    return source.mapInArrow(run, f"`{key}` {source.schema['k'].dataType.simpleString()}, term string, n long, weight double")


def sample_vocabulary(docs: DataFrame, key: str, text: str, most: int = 1000, least_chars: int = 100) -> tuple[DataFrame, int]:
    """(vocabulary, documents) fitted on the first ``most`` documents by key with more than
    ``least_chars`` characters; an empty vocabulary and 0 if there is none."""
    chosen = cut(docs.filter(F.length(F.trim(F.col(text))) > least_chars).orderBy(key).limit(most).select(key, text))
    n = chosen.count()
    return vocabulary(document_frequencies(chosen, text), n), n


def bm25_search(docs: DataFrame, key: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score, matched): BM25 of every document that has any of the words.

    One pass over the texts keeps each document's length and its hits only; that small table
    is cut and gives all statistics, which are over all documents with a text.
    """
    found = terms(F.col(text))
    base = cut(docs.filter(F.col(text).isNotNull()).select(key, found.alias("__w")).select(key, F.size("__w").alias("len"), F.filter("__w", lambda w: w.isin(*words)).alias("hits")))
    stats = base.agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"))
    hits = base.filter(F.size("hits") > 0)
    df = hits.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    each = hits.select(key, "len", "hits", F.explode(F.array_distinct("hits")).alias("term"))
    n = F.size(F.filter("hits", lambda w: w == F.col("term")))
    scored = each.select(key, "len", "term", n.alias("n")).join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def widened(words: list[str]) -> list[str]:
    """Query words, then the synonyms of their groups, first seen first; none is left out."""
    return list(dict.fromkeys([*words, *(s for word in words for group in SYNONYMS.values() if word in group for s in group)]))


def query_words(text: str) -> list[str]:
    """The words of a question as those of a text: lower-cased, longer than two, no stop words."""
    return list(dict.fromkeys(w for w in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split() if len(w) > 2 and w not in STOP_WORDS))


def fuzzy_terms(counts: DataFrame, words: list[str]) -> DataFrame:
    """(word, term, distance): corpus terms within min(2, length / 5) edits of a query word."""
    asked = counts.sparkSession.createDataFrame([(w, min(2, len(w) // 5)) for w in words], "word string, most int")
    known = counts.select("term").distinct()
    near = known.join(F.broadcast(asked), F.abs(F.length("term") - F.length("word")) <= F.col("most"))
    return near.withColumn("distance", F.levenshtein("term", "word")).filter(F.col("distance") <= F.col("most")).select("word", "term", "distance")


#: Most corpus terms near a question's words that are searched; more is an error, not a cut.
MOST_NEAR = 100_000


def fuzzy_search(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``bm25_search`` for the words and all corpus terms within their edit distance, so that
    misspelled words find what they mean; a near term counts as a term of its own."""
    near = [r["term"] for r in fuzzy_terms(term_counts(docs, key, text, bigrams=False), words).select("term").distinct().limit(MOST_NEAR + 1).collect()]
    if len(near) > MOST_NEAR:
        raise ValueError(f"more than {MOST_NEAR} terms are near these words")
    return bm25_search(docs, key, text, list(dict.fromkeys([*words, *sorted(near)])))


QUESTION = "revenue growth and debt risk"


def _sections(spark, folder):
    return latest_rows(table(spark, folder, "filing_section"), "section_id", ["created_at"], "load_id").select("section_id", "ticker", "filing_type", "section_type", "content")


def _counts(spark, folder, bigrams=True):
    return term_counts(_sections(spark, folder), "section_id", "content", bigrams)


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_FIN_SQL = "(" + " or ".join(f"contains(term, '{t}')" for t in FINANCIAL_TERMS) + ")"
_COUNT_SQL = f"""with {SECTION_SQL},
    w as (select section_id, list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 2 and not list_contains([{_list(STOP_WORDS)}], w)) as words from section_once where content is not null),
    f as (select section_id, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as features from w),
    counts as (select section_id, term, count(*) as n from (select section_id, unnest(features) as term from f) group by 1, 2),
    uni as (select section_id, term, n from counts where not contains(term, ' ')),
    docs as (select count(*) as documents from w),
    vocab as (select row_number() over (order by fin desc, df desc, term) - 1 as term_id, term, df from (
        select term, count(*) as df, {_FIN_SQL} as fin from counts group by term) where df >= 2 and df <= floor(0.95 * (select documents from docs)) qualify row_number() over (order by fin desc, df desc, term) <= 10000)"""


@query("term_counts", f"{_COUNT_SQL} select section_id, term, n from counts")
def term_counts_query(spark, folder):
    return _counts(spark, folder)


@query("document_frequency", f"{_COUNT_SQL} select term, count(*) as df from counts group by term")
def document_frequency(spark, folder):
    return document_frequencies(_sections(spark, folder), "content")


def _vocabulary(spark, folder):
    docs = _sections(spark, folder).filter("content is not null").count()
    return vocabulary(document_frequencies(_sections(spark, folder), "content"), docs), docs


@query("tfidf_vocabulary", f"{_COUNT_SQL} select term_id, term, df from vocab")
def tfidf_vocabulary(spark, folder):
    return _vocabulary(spark, folder)[0]


@query("tfidf_scores", f"""{_COUNT_SQL} select c.section_id, c.term, round(n / sum(n) over (partition by c.section_id) * ln((select documents from docs) / v.df), 6) as weight from counts c join vocab v on c.term = v.term""")
def tfidf_scores(spark, folder):
    vocab, docs = _vocabulary(spark, folder)
    return tfidf(_sections(spark, folder), "section_id", "content", vocab, docs).select("section_id", "term", "weight")


@query("bag_of_words", f"""{_COUNT_SQL} select c.section_id, c.term, n::double as weight from counts c join vocab v on c.term = v.term""")
def bag_of_words(spark, folder):
    vocab, docs = _vocabulary(spark, folder)
    return tfidf(_sections(spark, folder), "section_id", "content", vocab, docs, method="bow").select("section_id", "term", "weight")


_SAMPLE_SQL = _COUNT_SQL.replace("where content is not null),", "where length(trim(content)) > 100 order by section_id limit 500),", 1)


@query("sample_vocabulary", f"{_SAMPLE_SQL} select term_id, term, df from vocab")
def sample_vocabulary_query(spark, folder):
    """The vocabulary of the first 500 sections of more than 100 characters."""
    return sample_vocabulary(_sections(spark, folder), "section_id", "content", 500)[0]


@query("tfidf_top_features", f"""{_COUNT_SQL}, s as (select c.section_id, c.term, round(n / sum(n) over (partition by c.section_id) * ln((select documents from docs) / v.df), 6) as weight from counts c join vocab v on c.term = v.term)
    select section_id, term, weight from s qualify row_number() over (partition by section_id order by weight desc, term) <= 10""")
def tfidf_top_features(spark, folder):
    vocab, docs = _vocabulary(spark, folder)
    return tfidf(_sections(spark, folder), "section_id", "content", vocab, docs, top=10).select("section_id", "term", "weight")


@query("vocabulary_stats", f"""{_COUNT_SQL} select count(*) as terms, count(*) filter (not contains(term, ' ')) as unigrams, count(*) filter (contains(term, ' ')) as bigrams, count(*) filter ({_FIN_SQL}) as financial,
    round(avg(df), 6) as mean_df, max(df) as max_df, min(df) as min_df from vocab""")
def vocabulary_stats(spark, folder):
    two = F.col("term").contains(" ")
    return _vocabulary(spark, folder)[0].agg(F.count("*").alias("terms"), F.count_if(~two).alias("unigrams"), F.count_if(two).alias("bigrams"), F.count_if(is_financial(F.col("term"))).alias("financial"), F.round(F.avg("df"), 6).alias("mean_df"), F.max("df").alias("max_df"), F.min("df").alias("min_df"))


_WANTED = widened(query_words(QUESTION))
_BM25_SQL = f"""{_COUNT_SQL}, lengths as (select section_id, len(words) as len from w), hits as (select u.* from uni u where term in ({_list(_WANTED)})),
    dfs as (select term, count(*) as df from hits group by term), stats as (select count(*) as docs, avg(len) as mean_len from lengths),
    bm25 as (select h.section_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / mean_len))) as score, count(*) as matched
    from hits h join dfs using (term) join lengths using (section_id), stats group by 1)"""


def bm25_scores(spark, folder, words: list[str]) -> DataFrame:
    return bm25_search(_sections(spark, folder), "section_id", "content", words)


@query("text_search", f"{_BM25_SQL} select section_id, round(score, 6) as score, matched from bm25 order by score desc, section_id limit 20")
def text_search(spark, folder):
    found = bm25_scores(spark, folder, _WANTED).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "section_id").limit(20).select("section_id", "score", "matched")


MISSPELLED = "revenues grwth debtt"
_MISSPELLED = query_words(MISSPELLED)
_NEAR_SQL = f"""{_COUNT_SQL}, q(word, most) as (values {', '.join(f"('{w}', {min(2, len(w) // 5)})" for w in _MISSPELLED)}),
    near as (select distinct term from (select distinct term from uni), q where abs(length(term) - length(word)) <= most and levenshtein(term, word) <= most),
    lengths as (select section_id, len(words) as len from w), hits as (select u.* from uni u where term in (select term from near)),
    dfs as (select term, count(*) as df from hits group by term), stats as (select count(*) as docs, avg(len) as mean_len from lengths)
    select h.section_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) as score, count(*) as matched
    from hits h join dfs using (term) join lengths using (section_id), stats group by 1"""


@query("fuzzy_search", _NEAR_SQL)
def fuzzy_search_query(spark, folder):
    """Sections for a misspelled question."""
    found = fuzzy_search(_sections(spark, folder), "section_id", "content", _MISSPELLED)
    return found.select("section_id", F.round("score", 6).alias("score"), "matched")


@query("fuzzy_terms", f"""{_COUNT_SQL}, q(word, most) as (values {', '.join(f"('{w}', {min(2, len(w) // 5)})" for w in _WANTED)})
    select word, term, levenshtein(term, word) as distance from (select distinct term from uni), q where abs(length(term) - length(word)) <= most and levenshtein(term, word) <= most""")
def fuzzy_terms_query(spark, folder):
    return fuzzy_terms(_counts(spark, folder, bigrams=False), _WANTED)


def batch_search(counts: DataFrame, documents: int, questions: DataFrame, question: str, text: str, key: str, k: int = 5) -> DataFrame:
    """(question, key, score, rank): the ``k`` best documents for every question by summed idf.

    Questions meet documents by their terms only; each pair is scored by the terms it shares.
    """
    asked = questions.select(F.col(question).alias("question"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    # No side has a known bound, so the joins are left to the statistics at run time.
    wanted = counts.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    known = asked.join(df, "term").withColumn("idf", F.log(F.lit(documents) / F.col("df")))
    scored = wanted.join(known, "term").groupBy("question", key).agg(F.round(F.sum("idf"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


@query("batch_text_search", f"""{_COUNT_SQL}, q as (select distinct section_name as question from filing_section where section_name is not null),
    a as (select distinct question, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9\\s]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: length(w) > 2 and not list_contains([{_list(STOP_WORDS)}], w))) as term from q),
    d as (select term, count(*) as df from uni where term in (select term from a) group by 1),
    s as (select question, section_id, round(sum(ln((select documents from docs) / df)), 6) as score from a join uni using (term) join d using (term) group by 1, 2)
    select question, section_id, score, row_number() over (partition by question order by score desc, section_id)::int as rank from s qualify rank <= 5""")
def batch_text_search(spark, folder):
    """The best sections for every section name read as a question."""
    questions = table(spark, folder, "filing_section").filter("section_name is not null").select("section_name").distinct()
    docs = _sections(spark, folder).filter("content is not null").count()
    return batch_search(_counts(spark, folder, bigrams=False), docs, questions, "section_name", "section_name", "section_id")
