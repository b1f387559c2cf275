"""Queries through the engine and the stored model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.functions import vectors, xbrl
from docketry.operators import graph, insider, terms
from docketry.plans import ingest
from docketry.plans.engine import Engine
from docketry.registry import query
from docketry.session import shared_folder
from docketry.sources.feeds import sector_companies
from docketry.tables import table

_ASKED = "notes due and interest coverage"
_WORDS = terms.widened(terms.query_words(_ASKED))
_CHOSEN_SQL = terms._COUNT_SQL.replace("with ", f"with {graph.COMPANY_SQL}, {graph.FILING_SQL}, ", 1).replace(
    "from section_once where content is not null",
    "from section_once where content is not null and filing_id in (select filing_id from filing_once where filing_type in ('10-K', '10-Q') and filing_date between date '2019-01-01' and date '2023-12-31' and ticker in (select ticker from company_once))",
)
_ENGINE_SQL = f"""{_CHOSEN_SQL}, lengths as (select section_id, len(words) as len from w), hits as (select u.* from uni u where term in ({terms._list(_WORDS)})),
    dfs as (select term, count(*) as df from hits group by term), stats as (select count(*) as docs, avg(len) as mean_len from lengths),
    bm25 as (select h.section_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / mean_len))) as score from hits h join dfs using (term) join lengths using (section_id), stats group by 1)
    select b.section_id, f.ticker, f.filing_type, f.filing_date, round(score, 6) as score, case when length(content) > 200 then left(content, 200) || '...' else content end as snippet
    from bm25 b join section_once s using (section_id) join filing_once f on s.filing_id = f.filing_id order by b.score desc, b.section_id limit 15"""


@query("engine_search", _ENGINE_SQL)
def engine_search(spark, folder):
    """Text search with filters on type and date; filters come before scores."""
    found = Engine(spark, folder).search(_ASKED, filing_types=["10-K", "10-Q"], dates=("2019-01-01", "2023-12-31"), mode="text", k=15)
    return found.select("section_id", "ticker", "filing_type", "filing_date", "score", "snippet")


@query("answer_metadata", f"select count(*) as sources, count(distinct ticker) as companies, array_to_string(list_sort(list(distinct filing_type)), ',') as types from ({_ENGINE_SQL})")
def answer_metadata(spark, folder):
    """Companies and filing types behind an answer."""
    return engine_search(spark, folder).agg(F.count("*").alias("sources"), F.countDistinct("ticker").alias("companies"), F.array_join(F.sort_array(F.collect_set("filing_type")), ",").alias("types"))


@query("parameterised_statement", f"{graph.MODEL_SQL} select c.sector, count(*) as filings from filing_once f join company_once c on f.ticker = c.ticker where f.filing_type = '8-K' and f.filing_date >= date '2021-01-01' group by 1")
def parameterised_statement(spark, folder):
    text = "select c.sector, count(*) as filings from filings f join companies c on f.ticker = c.ticker where f.filing_type = :kind and f.filing_date >= :start group by c.sector"
    return Engine(spark, folder).sql(text, kind="8-K", start="2021-01-01")


@query("point_lookup", f"with {graph.COMPANY_SQL} select ticker, name, cik, sector, industry, sic from company_once where ticker = (select min(ticker) from company)")
def point_lookup(spark, folder):
    known = Engine(spark, folder).companies
    return known.filter(F.col("ticker") == known.agg(F.min("ticker")).first()[0])


@query("stored_vocabulary", f"{terms._COUNT_SQL} select term_id, term, df from vocab")
def stored_vocabulary(spark, folder):
    """The vocabulary written to the shared folder and loaded again."""
    vocabulary, documents = terms._vocabulary(spark, folder)
    place = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    ingest.save_vocabulary(vocabulary, documents, place)
    return ingest.load_vocabulary(spark, place)[0]


@query("sector_lists", f"with {graph.COMPANY_SQL} select sector, ticker from company_once where sector is not null")
def sector_lists(spark, folder):
    """Lists of tickers by sector, written as one object a sector and read back."""
    known = graph.companies(table(spark, folder, "company")).filter("sector is not null")
    lists = known.groupBy("sector").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"))
    return sector_companies(lists.select(F.to_json(F.create_map("sector", "tickers")).alias("j")), "j")


@query("form_types", "select doc_id, case when contains(upper(text), 'FORM 3') then '3' when contains(upper(text), 'FORM 4') then '4' when contains(upper(text), 'FORM 5') then '5' else '4' end as form_type from documents where text is not null")
def form_types(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", insider.form_type(F.col("text")).alias("form_type"))


@query("figure_texts", "select transaction_id, shares::decimal(38,2)::double as figure from insider_transaction where shares is not null")
def figure_texts(spark, folder):
    """Figures written with commas, dollar signs and brackets for negative ones, and read back."""
    shown = F.concat(F.lit("$"), F.format_number(F.abs(F.col("shares").cast("decimal(38,2)")), 2))
    text = F.when(F.col("shares") < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return table(spark, folder, "insider_transaction").filter("shares is not null").select("transaction_id", (xbrl.figure_text(text) + 0.0).alias("figure"))


@query("same_length_cosine", """with q as (select embedding::double[] as v from embeddings where vec_id = 0)
    select vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as whole, 0.0::double as half from embeddings, q""")
def same_length_cosine(spark, folder):
    """Cosines with one vector and with its first half; lengths that differ give 0."""
    rows = table(spark, folder, "embeddings")
    q = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    both = rows.crossJoin(F.broadcast(q.limit(1)))
    return both.select("vec_id", F.round(vectors.cosine_same_length(F.col("embedding"), F.col("q")), 6).alias("whole"), vectors.cosine_same_length(F.col("embedding"), F.slice("q", 1, 32)).alias("half"))
