"""Caps per group, budgets and orders: window functions with total orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.text import tokens_of_length
from docketry.operators.graph import MODEL_SQL, _model, sections_once
from docketry.registry import query
from docketry.tables import table


def first_per_group(df: DataFrame, group: list[str], order: list, n, most: int | None = None) -> DataFrame:
    """The first ``n`` rows (a number or a column) of each group.

    With a number, or with ``most`` as the largest value of the column, Spark prunes by rank
    before the shuffle, so a group that holds most rows sends only a few from each task.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if most is not None:
        ranked = ranked.filter(F.col("__rank") <= most)
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def within_budget(df: DataFrame, group: list[str], order: list, cost, budget: int) -> DataFrame:
    """Rows of each group as long as their running cost stays within the budget.

    The running cost never falls, so this keeps exactly the rows before the first overflow.
    """
    running = F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running_cost", running).filter(F.col("running_cost") <= budget)


def caps_table(spark, caps: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(caps.items()), "filing_type string, cap int")


def _values(caps: dict[str, int]) -> str:
    return "caps(filing_type, cap) as (values " + ", ".join(f"('{k}', {v})" for k, v in caps.items()) + ")"


@query("filing_caps", f"""{MODEL_SQL}, {_values(fixed.FILING_CAPS)}
    select filing_id, f.ticker, f.filing_type, filing_date from filing_once f join caps c on f.filing_type = c.filing_type
    qualify row_number() over (partition by f.ticker, f.filing_type order by filing_date desc nulls last, filing_id) <= max(c.cap) over (partition by f.ticker, f.filing_type)""")
def filing_caps(spark, folder):
    filed = _model(spark, folder)[1].join(F.broadcast(caps_table(spark, fixed.FILING_CAPS)), "filing_type")
    return first_per_group(filed, ["ticker", "filing_type"], [F.desc_nulls_last("filing_date"), "filing_id"], F.col("cap"), max(fixed.FILING_CAPS.values())).select("filing_id", "ticker", "filing_type", "filing_date")


@query("section_caps", f"""{MODEL_SQL}, {_values(fixed.SECTION_CAPS)}
    select s.section_id, s.filing_id, f.filing_type from section_once s join filing_once f on s.filing_id = f.filing_id left join caps c on f.filing_type = c.filing_type
    qualify row_number() over (partition by s.filing_id order by s.chunk_index nulls last, s.section_id) <= max(coalesce(c.cap, 3)) over (partition by s.filing_id)""")
def section_caps(spark, folder):
    filed = _model(spark, folder)[1].join(F.broadcast(caps_table(spark, fixed.SECTION_CAPS)), "filing_type", "left").select("filing_id", "filing_type", F.coalesce("cap", F.lit(3)).alias("cap"))
    joined = sections_once(spark, folder, "filing_id", "chunk_index").join(filed, "filing_id")
    return first_per_group(joined, ["filing_id"], [F.asc_nulls_last("chunk_index"), "section_id"], F.col("cap"), max(3, *fixed.SECTION_CAPS.values())).select("section_id", "filing_id", "filing_type")


@query("type_limits", f"""{MODEL_SQL} select filing_id, ticker, filing_type from (
    select *, row_number() over (partition by ticker, filing_type order by filing_date desc nulls last, filing_id) as n from filing_once where filing_type in ('10-K', '10-Q', '8-K')) where n <= 3
    qualify row_number() over (partition by ticker order by filing_date desc nulls last, filing_id) <= 10""")
def type_limits(spark, folder):
    """A company's 10 filings over 3 types: at most 10 // 3 of each, then the latest."""
    filed = _model(spark, folder)[1].filter(F.col("filing_type").isin("10-K", "10-Q", "8-K"))
    order = [F.desc_nulls_last("filing_date"), "filing_id"]
    return first_per_group(first_per_group(filed, ["ticker", "filing_type"], order, 3), ["ticker"], order, 10).select("filing_id", "ticker", "filing_type")


@query("token_budget_context", f"""{MODEL_SQL} select filing_id, section_id, running_cost::bigint as running_cost from (
    select s.filing_id, s.section_id, sum(length(coalesce(s.content, '')) // 4) over (partition by s.filing_id order by s.chunk_index nulls last, s.section_id rows unbounded preceding) as running_cost from section_once s) where running_cost <= 500""")
def token_budget_context(spark, folder):
    parts = sections_once(spark, folder, "filing_id", "chunk_index", "content").withColumn("cost", tokens_of_length(F.length(F.coalesce("content", F.lit("")))))
    return within_budget(parts, ["filing_id"], [F.asc_nulls_last("chunk_index"), "section_id"], F.col("cost"), 500).select("filing_id", "section_id", "running_cost")


@query("section_extents", f"""{MODEL_SQL} select section_id, filing_id, begin_at::bigint as begin_at, coalesce(lead(begin_at) over (partition by filing_id order by begin_at, chunk_index nulls last, section_id), whole)::bigint as end_at from (
    select section_id, filing_id, chunk_index, sum(n) over (partition by filing_id order by chunk_index nulls last, section_id rows unbounded preceding) - n as begin_at, sum(n) over (partition by filing_id) as whole
    from (select *, length(coalesce(content, '')) as n from section_once))""")
def section_extents(spark, folder):
    """Where each section begins and ends if a filing's sections are laid end to end."""
    own = sections_once(spark, folder, "filing_id", "chunk_index", "content").withColumn("n", F.length(F.coalesce("content", F.lit(""))))
    w = Window.partitionBy("filing_id").orderBy(F.asc_nulls_last("chunk_index"), "section_id")
    begin = own.withColumn("begin_at", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("whole", F.sum("n").over(Window.partitionBy("filing_id")))
    after = F.lead("begin_at").over(Window.partitionBy("filing_id").orderBy("begin_at", F.asc_nulls_last("chunk_index"), "section_id"))
    return begin.select("section_id", "filing_id", "begin_at", F.coalesce(after, "whole").alias("end_at"))


@query("importance_order", """select section_id, filing_id, importance from (select section_id, filing_id, case lower(section_type) when 'risk_factors' then 10 when 'mda' then 9 when 'business' then 8 when 'liquidity' then 7 when 'governance' then 5 else 1 end as importance, load_id, chunk_index
    from filing_section where section_id is not null qualify row_number() over (partition by section_id order by created_at desc nulls last, load_id desc) = 1)
    qualify row_number() over (partition by filing_id order by importance desc, chunk_index nulls last, section_id) <= 5""")
def importance_order(spark, folder):
    """The five most important sections of a filing; equal ones in order of place."""
    kind = F.lower("section_type")
    score = F.when(kind == "risk_factors", 10).when(kind == "mda", 9).when(kind == "business", 8).when(kind == "liquidity", 7).when(kind == "governance", 5).otherwise(1)
    rows = sections_once(spark, folder, "filing_id", "chunk_index", "section_type").withColumn("importance", score)
    return first_per_group(rows, ["filing_id"], [F.desc("importance"), F.asc_nulls_last("chunk_index"), "section_id"], 5).select("section_id", "filing_id", "importance")


@query("latest_facts", """select accession_number, ticker, concept, value, filed from xbrl_fact where value is not null and concept is not null
    qualify row_number() over (partition by ticker, concept order by filed desc nulls last, accession_number desc nulls last, value desc, unit desc nulls last, period desc nulls last) = 1""")
def latest_facts(spark, folder):
    facts = table(spark, folder, "xbrl_fact").filter("value is not null and concept is not null")
    order = [F.desc_nulls_last("filed"), F.desc_nulls_last("accession_number"), F.desc("value"), F.desc_nulls_last("unit"), F.desc_nulls_last("period")]
    return first_per_group(facts, ["ticker", "concept"], order, 1).select("accession_number", "ticker", "concept", "value", "filed")


@query("type_sets", """select filing_type from filing where filing_type is not null intersect select form from xbrl_fact where form is not null""")
def type_sets(spark, folder):
    """Set operation: the types that occur both as filings and as forms of facts."""
    a = table(spark, folder, "filing").filter("filing_type is not null").select("filing_type")
    return a.intersect(table(spark, folder, "xbrl_fact").filter("form is not null").select(F.col("form").alias("filing_type")))


@query("untraded_companies", "select distinct ticker from company where ticker is not null except select company_ticker from insider_transaction")
def untraded_companies(spark, folder):
    known = table(spark, folder, "company").filter("ticker is not null").select("ticker").distinct()
    return known.join(table(spark, folder, "insider_transaction").select(F.col("company_ticker").alias("ticker")), "ticker", "left_anti")
