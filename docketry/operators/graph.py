"""Companies, filings and sections as tables of nodes and edges: upserts, joins, roll-ups.

Repeated deliveries keep their key; the latest one counts. Edges between filings of one
company are never spread out as pairs: their numbers follow from counts per company and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.registry import query
from docketry.session import spread
from docketry.tables import table


def latest(df: DataFrame, key: str, by: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the one with the largest ``by`` columns (a map-side combining aggregate)."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*by)).alias("__row")).select(key, "__row.*")


def latest_rows(df: DataFrame, key: str, by: list[str], unique: str) -> DataFrame:
    """Whole rows, one per key: the one with the largest ``by`` columns, ties going to the larger ``unique``.

    Only key, ``by`` and ``unique``, which names a row, are grouped. The few rows that lose are
    taken away by an anti-join, so texts and vectors of all others stay where they are as long as
    the losers are few enough to be sent around (left to the statistics at run time).
    """
    order = F.struct(*by, unique)
    narrow = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(unique).alias("__unique"), order.alias("__order"))
    best = narrow.groupBy("__key").agg(F.max("__order").alias("__best"), F.count("*").alias("__n")).filter("__n > 1")
    losers = narrow.join(best, "__key").filter("__order < __best").select(F.col("__unique").alias(unique))
    return spread(df.filter(F.col(key).isNotNull()), unique).join(losers, unique, "left_anti")


def companies(df: DataFrame) -> DataFrame:
    """Upsert by ticker, last write wins; equal times go to the larger name, then sector."""
    return latest(df, "ticker", ["updated_at", "created_at", "name", "sector"], ["name", "cik", "sector", "industry", "sic"])


def filings(df: DataFrame, known: DataFrame) -> DataFrame:
    """Upsert by filing_id; filings of unknown companies are dropped."""
    once = latest(df, "filing_id", ["acceptance_ts", "filing_date"], ["accession_number", "ticker", "filing_type", "filing_date", "report_date"])
    return once.join(known.select("ticker"), "ticker", "left_semi")


def sections(df: DataFrame, most_chars: int | None = None) -> DataFrame:
    """Sections with an embedding, once each, whole or cut to ``most_chars`` characters."""
    chosen = df.filter(F.col("embedding_compressed").isNotNull())
    once = latest_rows(chosen, "section_id", ["created_at"], "load_id").select("section_id", "filing_id", "section_type", "section_name", "content", "chunk_index")
    return once if most_chars is None else once.withColumn("content", F.substring("content", 1, most_chars))


#: Which filing types give context to which: (source type, target type, relation).
CONTEXT_RULES = (
    [("10-K", "10-Q", "ANNUAL_TO_QUARTERLY")]
    + [("8-K", t, "MATERIAL_EVENT_CONTEXT") for t in ("10-K", "10-Q", "DEF 14A")]
    + [("DEF 14A", t, "GOVERNANCE_CONTEXT") for t in ("10-K", "10-Q")]
    + [(s, t, "INSIDER_TRADING_CONTEXT") for s in ("3", "4", "5") for t in ("10-K", "10-Q", "DEF 14A")]
)


def context_counts(filings_: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(ticker, rel, edges): edges between filings of a company, from counts per type.

    Each filing of a source type links to each filing of a target type of its company. With
    ``stored`` (ticker, filing_type) only types in it are sources, and targets of annual reports.
    """
    rules = filings_.sparkSession.createDataFrame(CONTEXT_RULES, "src_type string, dst_type string, rel string")
    per_type = filings_.filter("ticker is not null and filing_type is not null").groupBy("ticker", "filing_type").agg(F.count("*").alias("n"))
    src = per_type.select("ticker", F.col("filing_type").alias("src_type"), F.col("n").alias("n_src")).join(F.broadcast(rules), "src_type")
    dst = per_type.select("ticker", F.col("filing_type").alias("dst_type"), F.col("n").alias("n_dst"))
    if stored is not None:
        src = src.join(stored.select("ticker", F.col("filing_type").alias("src_type")), ["ticker", "src_type"], "left_semi")
        both = src.join(stored.select("ticker", F.col("filing_type").alias("dst_type")), ["ticker", "dst_type"], "left_semi").filter("rel = 'ANNUAL_TO_QUARTERLY'")
        src = src.filter("rel <> 'ANNUAL_TO_QUARTERLY'").unionByName(both)
    return src.join(dst, ["ticker", "dst_type"]).groupBy("ticker", "rel").agg(F.sum(F.col("n_src") * F.col("n_dst")).alias("edges"))


def context_degrees(filings_: DataFrame) -> DataFrame:
    """(filing_id, rel, targets): the number of filings that a filing links to, per relation."""
    rules = filings_.sparkSession.createDataFrame(CONTEXT_RULES, "filing_type string, dst_type string, rel string")
    per_type = filings_.filter("ticker is not null").groupBy("ticker", F.col("filing_type").alias("dst_type")).agg(F.count("*").alias("n"))
    reach = per_type.join(F.broadcast(rules), "dst_type").groupBy("ticker", "filing_type", "rel").agg(F.sum("n").alias("targets"))
    return filings_.select("filing_id", "ticker", "filing_type").join(reach, ["ticker", "filing_type"]).select("filing_id", "rel", "targets")


def sector_edges(companies_: DataFrame) -> DataFrame:
    """Directed edges between companies of one sector; the company table is a small dimension."""
    side = companies_.filter("sector is not null").select("ticker", "sector")
    return side.select(F.col("ticker").alias("src"), "sector").join(side.select(F.col("ticker").alias("dst"), "sector"), "sector").filter("src <> dst").select("src", "dst", F.lit("SAME_SECTOR").alias("rel"))


def url(cik: Column, accession: Column, document: Column) -> Column:
    """Address of a document in the public archive."""
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.lpad(cik, 10, "0"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def _model(spark, folder):
    known = companies(table(spark, folder, "company"))
    return known, filings(table(spark, folder, "filing"), known)


COMPANY_SQL = "company_once as (select * from company where ticker is not null qualify row_number() over (partition by ticker order by updated_at desc nulls last, created_at desc nulls last, name desc nulls last, sector desc nulls last) = 1)"
FILING_SQL = "filing_once as (select * from filing where filing_id is not null and ticker in (select ticker from company) qualify row_number() over (partition by filing_id order by acceptance_ts desc nulls last, filing_date desc nulls last) = 1)"
SECTION_SQL = "section_once as (select * from filing_section where section_id is not null qualify row_number() over (partition by section_id order by created_at desc nulls last, load_id desc) = 1)"
MODEL_SQL = f"with {COMPANY_SQL}, {FILING_SQL}, {SECTION_SQL}"
_RULES_SQL = "rules(src_type, dst_type, rel) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CONTEXT_RULES) + ")"


def sections_once(spark, folder, *keep):
    return latest_rows(table(spark, folder, "filing_section"), "section_id", ["created_at"], "load_id").select("section_id", *keep)


@query("company_upsert", f"with {COMPANY_SQL} select ticker, name, cik, sector, industry, sic from company_once")
def company_upsert(spark, folder):
    return companies(table(spark, folder, "company"))


@query("filing_upsert", f"{MODEL_SQL} select filing_id, accession_number, ticker, filing_type, filing_date, report_date from filing_once")
def filing_upsert(spark, folder):
    return _model(spark, folder)[1].select("filing_id", "accession_number", "ticker", "filing_type", "filing_date", "report_date")


@query("section_append", """
    select section_id, filing_id, section_type, chunk_index, substring(content, 1, 4000) as content from filing_section
    where embedding_compressed is not null and section_id is not null and filing_id in (select filing_id from filing)
    qualify row_number() over (partition by section_id order by created_at desc nulls last, load_id desc) = 1""")
def section_append(spark, folder):
    known = table(spark, folder, "filing").select("filing_id")
    return sections(table(spark, folder, "filing_section")).join(known, "filing_id", "left_semi").select("section_id", "filing_id", "section_type", "chunk_index", "content")


@query("fact_append", "select x.accession_number, x.concept, x.value, x.unit, x.period from xbrl_fact x where exists (select 1 from filing f where f.accession_number = x.accession_number)")
def fact_append(spark, folder):
    known = table(spark, folder, "filing").select("accession_number")
    return table(spark, folder, "xbrl_fact").join(known, "accession_number", "left_semi").select("accession_number", "concept", "value", "unit", "period")


@query("executive_table", "select executive_name, company_ticker, max(executive_title) as executive_title, count(*) as deliveries from insider_transaction where executive_name is not null group by 1, 2")
def executive_table(spark, folder):
    rows = table(spark, folder, "insider_transaction").filter("executive_name is not null")
    return rows.groupBy("executive_name", "company_ticker").agg(F.max("executive_title").alias("executive_title"), F.count("*").alias("deliveries"))


@query("duplicate_keys", "select 'company' as label, ticker as key, count(*) as copies from company group by ticker having count(*) > 1 union all select 'filing', filing_id, count(*) from filing group by filing_id having count(*) > 1 union all select 'section', section_id, count(*) from filing_section group by section_id having count(*) > 1")
def duplicate_keys(spark, folder):
    parts = [("company", "company", "ticker"), ("filing", "filing", "filing_id"), ("section", "filing_section", "section_id")]
    out = None
    for label, name, key in parts:
        part = table(spark, folder, name).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("copies")).filter("copies > 1").select(F.lit(label).alias("label"), "key", "copies")
        out = part if out is None else out.unionByName(part)
    return out


@query("section_join_filter", f"""{MODEL_SQL}
    select s.section_id, c.ticker, c.name as company_name, f.filing_type, f.filing_date, s.section_type from section_once s
    join filing_once f on s.filing_id = f.filing_id join company_once c on f.ticker = c.ticker
    where f.filing_type in ('10-K', '10-Q') and f.filing_date between date '2020-01-01' and date '2023-12-31' and lower(s.section_type) in ('liquidity', 'risk_factors', 'governance')""")
def section_join_filter(spark, folder):
    known, filed = _model(spark, folder)
    filed = filed.filter(F.col("filing_type").isin("10-K", "10-Q") & F.col("filing_date").between("2020-01-01", "2023-12-31"))
    parts = sections_once(spark, folder, "filing_id", "section_type").filter(F.lower("section_type").isin("liquidity", "risk_factors", "governance"))
    joined = parts.join(filed, "filing_id").join(known.select("ticker", F.col("name").alias("company_name")), "ticker")
    return joined.select("section_id", "ticker", "company_name", "filing_type", "filing_date", "section_type")


@query("year_filter", "select filing_id, ticker, filing_date from filing where year(filing_date) in (2022, 2024)")
def year_filter(spark, folder):
    return table(spark, folder, "filing").filter(F.year("filing_date").isin(2022, 2024)).select("filing_id", "ticker", "filing_date")


@query("complete_filings", "select filing_id, accession_number, primary_document from filing where coalesce(accession_number, '') <> '' and coalesce(primary_document, '') <> '' and coalesce(film_number, '') <> ''")
def complete_filings(spark, folder):
    full = None
    for name in ("accession_number", "primary_document", "film_number"):
        part = F.coalesce(F.col(name), F.lit("")) != ""
        full = part if full is None else full & part
    return table(spark, folder, "filing").filter(full).select("filing_id", "accession_number", "primary_document")


@query("document_urls", f"""with {COMPANY_SQL} select f.filing_id, 'https://www.sec.gov/Archives/edgar/data/' || lpad(c.cik, 10, '0') || '/' || replace(f.accession_number, '-', '') || '/' || f.primary_document as url
    from filing f join company_once c on f.ticker = c.ticker""")
def document_urls(spark, folder):
    known = companies(table(spark, folder, "company")).select("ticker", "cik")
    return table(spark, folder, "filing").join(known, "ticker").select("filing_id", url(F.col("cik"), F.col("accession_number"), F.col("primary_document")).alias("url"))


@query("sector_edges", f"with {COMPANY_SQL} select a.ticker as src, b.ticker as dst, 'SAME_SECTOR' as rel from company_once a join company_once b on a.sector = b.sector and a.ticker <> b.ticker")
def sector_edges_query(spark, folder):
    return sector_edges(companies(table(spark, folder, "company")))


@query("competitor_counts", f"with {COMPANY_SQL} select sector, count(*) as companies, count(*) * (count(*) - 1) as edges from company_once where sector is not null group by sector")
def competitor_counts(spark, folder):
    known = companies(table(spark, folder, "company")).filter("sector is not null")
    return known.groupBy("sector").agg(F.count("*").alias("companies")).withColumn("edges", F.col("companies") * (F.col("companies") - 1))


@query("filing_edge_counts", f"""{MODEL_SQL}, {_RULES_SQL}
    select a.ticker, r.rel, count(*) as edges from filing_once a join rules r on a.filing_type = r.src_type join filing_once b on b.ticker = a.ticker and b.filing_type = r.dst_type group by 1, 2""")
def filing_edge_counts(spark, folder):
    return context_counts(_model(spark, folder)[1])


@query("filing_edge_degrees", f"""{MODEL_SQL}, {_RULES_SQL}
    select a.filing_id, r.rel, count(*) as targets from filing_once a join rules r on a.filing_type = r.src_type join filing_once b on b.ticker = a.ticker and b.filing_type = r.dst_type group by 1, 2""")
def filing_edge_degrees(spark, folder):
    return context_degrees(_model(spark, folder)[1])


@query("relation_totals", f"""{MODEL_SQL}, {_RULES_SQL}
    select r.rel, count(*) as edges from filing_once a join rules r on a.filing_type = r.src_type join filing_once b on b.ticker = a.ticker and b.filing_type = r.dst_type group by 1""")
def relation_totals(spark, folder):
    return context_counts(_model(spark, folder)[1]).groupBy("rel").agg(F.sum("edges").alias("edges"))


@query("filings_per_company", f"{MODEL_SQL} select c.ticker, c.name, c.sector, count(*) as filings from company_once c join filing_once f on c.ticker = f.ticker group by 1, 2, 3")
def filings_per_company_of(spark, folder):
    known, filed = _model(spark, folder)
    counts = filed.groupBy("ticker").agg(F.count("*").alias("filings"))
    return counts.join(known, "ticker").select("ticker", "name", "sector", "filings")


@query("sector_coverage", f"with {COMPANY_SQL} select sector, count(*) as companies from company_once group by sector")
def sector_coverage(spark, folder):
    return companies(table(spark, folder, "company")).groupBy("sector").agg(F.count("*").alias("companies"))


@query("type_coverage", f"{MODEL_SQL} select filing_type, count(*) as filings, count(distinct ticker) as companies from filing_once group by filing_type")
def type_coverage(spark, folder):
    return _model(spark, folder)[1].groupBy("filing_type").agg(F.count("*").alias("filings"), F.countDistinct("ticker").alias("companies"))


@query("embedded_by_type", f"with {SECTION_SQL} select section_type, count(*) as sections, count(embedding_compressed) as embedded from section_once group by section_type")
def embedded_by_type(spark, folder):
    return sections_once(spark, folder, "section_type", "embedding_compressed").groupBy("section_type").agg(F.count("*").alias("sections"), F.count("embedding_compressed").alias("embedded"))


@query("embedded_by_filing_type", f"with {SECTION_SQL} select filing_type, count(*) as sections from section_once where embedding_compressed is not null group by 1")
def embedded_by_filing_type(spark, folder):
    return sections_once(spark, folder, "filing_type", "embedding_compressed").filter("embedding_compressed is not null").groupBy("filing_type").agg(F.count("*").alias("sections"))


@query("creation_gates", f"""{MODEL_SQL}, ok as (select distinct ticker, filing_type from filing_once where filing_id in (select filing_id from section_once where embedding_compressed is not null)), {_RULES_SQL}
    select a.ticker, r.rel, count(*) as edges from filing_once a join rules r on a.filing_type = r.src_type join filing_once b on b.ticker = a.ticker and b.filing_type = r.dst_type
    where exists (select 1 from ok where ok.ticker = a.ticker and ok.filing_type = r.src_type) and (r.rel <> 'ANNUAL_TO_QUARTERLY' or exists (select 1 from ok where ok.ticker = a.ticker and ok.filing_type = r.dst_type)) group by 1, 2""")
def creation_gates(spark, folder):
    """Edges that are made only where sections of the source type were stored, and of the target
    type too for annual to quarterly."""
    filed = _model(spark, folder)[1]
    stored = sections(table(spark, folder, "filing_section")).select("filing_id").distinct()
    ok = filed.join(stored, "filing_id", "left_semi").select("ticker", "filing_type").distinct()
    return context_counts(filed, ok)


@query("system_stats", f"""{MODEL_SQL}, {_RULES_SQL} select 'company' as label, count(distinct ticker) as nodes from company union all select 'filing', count(distinct filing_id) from filing
    union all select 'section', count(distinct section_id) from filing_section union all select 'fact', count(*) from xbrl_fact union all select 'executive', count(distinct executive_name) from insider_transaction
    union all select 'relationship', (select count(*) from filing_once a join rules r on a.filing_type = r.src_type join filing_once b on b.ticker = a.ticker and b.filing_type = r.dst_type)
    + (select 2 * coalesce(sum(n * (n - 1)), 0) from (select count(*) as n from company_once where sector is not null group by sector))
    + (select count(*) from filing_once) + (select count(*) from section_once where filing_id in (select filing_id from filing_once)) + (select count(*) from xbrl_fact where accession_number in (select accession_number from filing_once))""")
def system_stats(spark, folder):
    """Always one row per label, also for empty tables."""
    parts = [("company", "company", "ticker"), ("filing", "filing", "filing_id"), ("section", "filing_section", "section_id"), ("executive", "insider_transaction", "executive_name")]
    out = table(spark, folder, "xbrl_fact").agg(F.count("*").alias("nodes")).select(F.lit("fact").alias("label"), "nodes")
    for label, name, key in parts:
        out = out.unionByName(table(spark, folder, name).agg(F.countDistinct(key).alias("nodes")).select(F.lit(label).alias("label"), "nodes"))
    return out.unionByName(relationship_count(spark, folder).select(F.lit("relationship").alias("label"), "nodes"))


def relationship_count(spark, folder) -> DataFrame:
    """(nodes): all edges of the model: context between filings, sector and competitor edges (each
    way), and what belongs to companies and filings; all from counts, no edge is listed."""
    known, filed = _model(spark, folder)
    parts = [
        context_counts(filed).select("edges"),
        known.filter("sector is not null").groupBy("sector").agg((2 * F.count("*") * (F.count("*") - 1)).alias("edges")).select("edges"),
        filed.agg(F.count("*").alias("edges")),
        sections_once(spark, folder, "filing_id").join(filed.select("filing_id"), "filing_id", "left_semi").agg(F.count("*").alias("edges")),
        table(spark, folder, "xbrl_fact").select("accession_number").join(filed.select("accession_number"), "accession_number", "left_semi").agg(F.count("*").alias("edges")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("nodes"))


@query("filing_summary", f"""{MODEL_SQL},
    s as (select filing_id, count(distinct section_id) as sections, array_to_string(list_sort(list(distinct section_type) filter (section_type is not null)), ',') as section_types from section_once group by 1),
    x as (select accession_number, count(*) as facts, array_to_string(list_slice(list_sort(list(distinct concept) filter (concept is not null)), 1, 10), ',') as concepts from xbrl_fact group by 1)
    select f.filing_id, f.ticker, f.filing_type, coalesce(s.sections, 0) as sections, coalesce(s.section_types, '') as section_types, coalesce(x.facts, 0) as facts, coalesce(x.concepts, '') as concepts
    from filing_once f left join s on f.filing_id = s.filing_id left join x on f.accession_number = x.accession_number""")
def filing_summary(spark, folder):
    filed = _model(spark, folder)[1]
    # Children are aggregated first, so that the two joins never multiply rows.
    s = sections_once(spark, folder, "filing_id", "section_type").groupBy("filing_id").agg(F.count("*").alias("sections"), F.array_join(F.sort_array(F.collect_set("section_type")), ",").alias("section_types"))
    x = table(spark, folder, "xbrl_fact").groupBy("accession_number").agg(F.count("*").alias("facts"), F.array_join(F.slice(F.sort_array(F.collect_set("concept")), 1, 10), ",").alias("concepts"))
    joined = filed.join(s, "filing_id", "left").join(x, "accession_number", "left")
    zero, none = F.lit(0), F.lit("")
    return joined.select("filing_id", "ticker", "filing_type", F.coalesce("sections", zero).alias("sections"), F.coalesce("section_types", none).alias("section_types"), F.coalesce("facts", zero).alias("facts"), F.coalesce("concepts", none).alias("concepts"))


@query("sector_rollup", f"{MODEL_SQL} select c.sector, f.ticker, count(*) as filings, grouping(c.sector, f.ticker) as level from filing_once f join company_once c on f.ticker = c.ticker group by rollup (c.sector, f.ticker)")
def sector_rollup(spark, folder):
    known, filed = _model(spark, folder)
    joined = filed.join(known.select("ticker", "sector"), "ticker")
    return joined.rollup("sector", "ticker").agg(F.count("*").alias("filings"), F.grouping_id().cast("bigint").alias("level"))


@query("type_year_cube", f"{MODEL_SQL} select filing_type, year(filing_date) as filing_year, count(*) as filings, grouping(filing_type, year(filing_date)) as level from filing_once group by cube (filing_type, year(filing_date))")
def type_year_cube(spark, folder):
    filed = _model(spark, folder)[1].select("filing_type", F.year("filing_date").alias("filing_year"))
    return filed.cube("filing_type", "filing_year").agg(F.count("*").alias("filings"), F.grouping_id().cast("bigint").alias("level"))


@query("readiness", f"""{MODEL_SQL}, t as (select ticker, list_sort(list(distinct filing_type) filter (filing_type in ('10-K', '10-Q', '8-K'))) as have from filing_once group by ticker)
    select count(*) as companies, count(*) filter (len(have) = 3) as ready, count(*) filter (len(have) = 3) >= 0.8 * count(*) as is_ready from t""")
def readiness(spark, folder):
    wanted = F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K"))
    have = _model(spark, folder)[1].groupBy("ticker").agg(F.size(F.array_intersect(F.collect_set("filing_type"), wanted)).alias("n"))
    return have.agg(F.count("*").alias("companies"), F.count_if(F.col("n") == 3).alias("ready")).withColumn("is_ready", F.col("ready") >= 0.8 * F.col("companies"))


@query("collection_summary", f"""{MODEL_SQL}, t as (select ticker, count(*) as filings, count(distinct filing_type) as types from filing_once group by ticker), k as (select count(distinct filing_type) as types from filing_once)
    select count(*) as companies, sum(filings)::bigint as filings, any_value(k.types) as types, count(*) >= 10 and sum(filings) >= 200 and any_value(k.types) >= 8 as complete, count(*) filter (t.types >= 2) >= 0.7 * count(*) as processed from t, k""")
def collection_summary(spark, folder):
    """Companies, filings and types collected against their targets (10, 200 and 8), and whether
    seven in ten companies have filings of at least two types."""
    filed = _model(spark, folder)[1]
    types = filed.agg(F.countDistinct("filing_type").alias("types"))
    per = filed.groupBy("ticker").agg(F.count("*").alias("filings"), F.countDistinct("filing_type").alias("own"))
    total = per.agg(F.count("*").alias("companies"), F.sum("filings").alias("filings"), F.count_if(F.col("own") >= 2).alias("__several")).crossJoin(F.broadcast(types))
    complete = (F.col("companies") >= 10) & (F.col("filings") >= 200) & (F.col("types") >= 8)
    return total.select("companies", "filings", "types", complete.alias("complete"), (F.col("__several") >= 0.7 * F.col("companies")).alias("processed"))


@query("documents_by_source", "select lower(trim(source)) as source, count(*) as documents, count(distinct ticker) as companies, count(*) filter (text is null or text = '') as blank, max(n_chars) as longest from documents group by 1")
def documents_by_source(spark, folder):
    rows = table(spark, folder, "documents").withColumn("source", F.lower(F.trim("source")))
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("ticker").alias("companies"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("blank"), F.max("n_chars").alias("longest"))


def coverage_plan(requirements: DataFrame) -> DataFrame:
    """Adds estimated_filings, the number of companies times that of filing types, to (question, companies, filing_types)."""
    return requirements.withColumn("estimated_filings", F.size("companies") * F.size("filing_types"))


def requirement_coverage(requirements: DataFrame, collected: DataFrame, share: float = 0.8) -> DataFrame:
    """(question, companies_found, companies_needed, types_found, types_needed, ready): what of each
    question's companies and filing types is among the collected filings; ready with ``share`` of
    the companies and all types."""
    c = requirements.select("question", F.explode("companies").alias("ticker")).join(collected.select("ticker").distinct(), "ticker", "left_semi").groupBy("question").agg(F.countDistinct("ticker").alias("companies_found"))
    t = requirements.select("question", F.explode("filing_types").alias("filing_type")).join(collected.select("filing_type").distinct(), "filing_type", "left_semi").groupBy("question").agg(F.countDistinct("filing_type").alias("types_found"))
    zero = F.lit(0)
    rows = requirements.select("question", F.size("companies").alias("companies_needed"), F.size("filing_types").alias("types_needed")).join(c, "question", "left").join(t, "question", "left")
    rows = rows.withColumns({"companies_found": F.coalesce("companies_found", zero), "types_found": F.coalesce("types_found", zero)})
    ready = (F.col("companies_found") >= F.col("companies_needed") * share) & (F.col("types_found") >= F.col("types_needed"))
    return rows.select("question", "companies_found", "companies_needed", "types_found", "types_needed", ready.alias("ready"))


def _requirements(spark, folder) -> DataFrame:
    """A question a sector: its companies and three filing types."""
    known = companies(table(spark, folder, "company")).filter("sector is not null")
    types = F.array(*map(F.lit, ["10-K", "10-Q", "SC 13G"]))
    return known.groupBy(F.col("sector").alias("question")).agg(F.sort_array(F.collect_set("ticker")).alias("companies")).withColumn("filing_types", types)


@query("coverage_plan", f"with {COMPANY_SQL} select sector as question, (count(distinct ticker) * 3)::int as estimated_filings from company_once where sector is not null group by 1")
def coverage_plan_query(spark, folder):
    return coverage_plan(_requirements(spark, folder)).select("question", "estimated_filings")


@query("requirement_coverage", f"""{MODEL_SQL}, r as (select sector as question, ticker from company_once where sector is not null)
    select question, count(*) filter (ticker in (select ticker from filing_once)) as companies_found, count(*)::int as companies_needed,
    (select count(distinct filing_type) from filing_once where filing_type in ('10-K', '10-Q', 'SC 13G')) as types_found, 3 as types_needed,
    count(*) filter (ticker in (select ticker from filing_once)) >= 0.8 * count(*) and (select count(distinct filing_type) from filing_once where filing_type in ('10-K', '10-Q', 'SC 13G')) >= 3 as ready from r group by 1""")
def requirement_coverage_query(spark, folder):
    return requirement_coverage(_requirements(spark, folder), _model(spark, folder)[1])
