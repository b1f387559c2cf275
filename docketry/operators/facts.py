"""Structured financial facts: cleaning, concept search, vectors and flattening of nested facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import xbrl
from docketry.functions.fixed import CONCEPT_CATEGORIES
from docketry.registry import query
from docketry.tables import table

FACT = T.StructType([T.StructField(n, t) for n, t in [("val", T.DoubleType()), ("start", T.StringType()), ("end", T.StringType()), ("form", T.StringType()), ("filed", T.StringType()), ("frame", T.StringType())]])
TAXONOMIES = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT)))])))
COMPANY_FACTS = T.StructType([T.StructField("facts", TAXONOMIES)])


def flatten_facts(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per fact of nested company facts (taxonomy, concept, unit, fact), under ``facts`` or bare.

    Invalid JSON gives no rows; a concept without units and a unit without facts give none.
    """
    parsed = rows.select(*keep, F.coalesce(F.from_json(column, COMPANY_FACTS)["facts"], F.from_json(column, TAXONOMIES)).alias("j"))
    taxonomies = parsed.select(*keep, F.explode("j").alias("taxonomy", "concepts"))
    concepts = taxonomies.select(*keep, "taxonomy", F.explode("concepts").alias("concept", "c"))
    units = concepts.select(*keep, "taxonomy", "concept", F.explode("c.units").alias("unit", "facts"))
    return units.select(*keep, "taxonomy", "concept", "unit", F.explode("facts").alias("f")).select(*keep, "taxonomy", "concept", "unit", F.col("f.val").alias("value"), F.col("f.end").alias("period"), "f.frame", "f.form", "f.filed")


def concept_search(facts: DataFrame, filings: DataFrame, wanted: list[str], k: int = 50) -> DataFrame:
    """Filings that report any of the concepts, with the share of them found, latest first."""
    hits = facts.withColumn("concept", xbrl.bare_concept(F.col("concept"))).filter(F.col("concept").isin(*wanted))
    found = hits.groupBy("accession_number").agg(F.sort_array(F.collect_set("concept")).alias("c"), F.countDistinct("concept", "value", "unit").alias("values"))
    once = filings.groupBy("accession_number").agg(F.max_by(F.struct("ticker", "filing_type", "filing_date"), F.struct("acceptance_ts", "filing_id")).alias("f"))
    joined = found.join(once, "accession_number").select("accession_number", "f.ticker", "f.filing_type", "f.filing_date", F.array_join("c", ",").alias("concepts"), "values", F.round(F.size("c") / len(wanted), 6).alias("relevance"))
    return joined.orderBy(F.desc("filing_date"), "accession_number").limit(k)


_BARE = "regexp_replace({0}, '^(?:us-gaap:|dei:|ifrs-full:|srt:)', '', 'i')"
_CATEGORY = "case when concept is null then null " + " ".join("when " + " or ".join(f"contains(lower({_BARE.format('concept')}), '{k}')" for k in keys) + f" then '{label}'" for label, keys in CONCEPT_CATEGORIES.items()) + " else 'other' end"
_WANTED = ["Assets", "Revenues", "NetIncomeLoss"]


@query("facts_clean", f"""select accession_number, {_BARE.format('concept')} as concept, {_CATEGORY} as category, round(case when abs(coalesce(value, 0)) >= 1 then sign(value) * log10(abs(value)) / 10 else coalesce(value, 0.0) end, 6) as scaled,
    case when period is null then null when contains(period, '/') then 'duration' else 'instant' end as period_kind, case when contains(period, '/') then left(split_part(period, '/', 1), 10) end as period_start,
    left(case when contains(period, '/') then split_part(period, '/', 2) else period end, 10) as period_end from xbrl_fact""")
def facts_clean(spark, folder):
    c = F.col
    return table(spark, folder, "xbrl_fact").select("accession_number", xbrl.bare_concept(c("concept")).alias("concept"), xbrl.category(xbrl.bare_concept(c("concept"))).alias("category"), F.round(xbrl.scaled(c("value")), 6).alias("scaled"), xbrl.period_kind(c("period")).alias("period_kind"), xbrl.period_start(c("period")).alias("period_start"), xbrl.period_end(c("period")).alias("period_end"))


@query("category_totals", f"select {_CATEGORY} as category, count(*) as facts, count(distinct {_BARE.format('concept')}) as concepts, max(value) as largest from xbrl_fact group by 1")
def category_totals(spark, folder):
    bare = xbrl.bare_concept(F.col("concept"))
    return table(spark, folder, "xbrl_fact").groupBy(xbrl.category(bare).alias("category")).agg(F.count("*").alias("facts"), F.countDistinct(bare).alias("concepts"), F.max("value").alias("largest"))


@query("concept_search", f"""with h as (select accession_number, {_BARE.format('concept')} as concept, value, unit from xbrl_fact), w as (select * from h where concept in ('Assets', 'Revenues', 'NetIncomeLoss')),
    g as (select accession_number, list_sort(list(distinct concept)) as c, count(distinct case when value is not null and unit is not null then (concept, value, unit) end) as values from w group by 1),
    o as (select * from filing where accession_number is not null qualify row_number() over (partition by accession_number order by acceptance_ts desc nulls last, filing_id desc) = 1)
    select g.accession_number, ticker, filing_type, filing_date, array_to_string(c, ',') as concepts, values, round(len(c) / 3, 6) as relevance from g join o on g.accession_number = o.accession_number order by filing_date desc, g.accession_number limit 50""")
def concept_search_query(spark, folder):
    return concept_search(table(spark, folder, "xbrl_fact"), table(spark, folder, "filing"), _WANTED)


@query("facts_flattened", "select accession_number, concept, unit, value, form from xbrl_fact where accession_number is not null and concept is not null and unit is not null")
def facts_flattened(spark, folder):
    """All facts of a filing nested as delivered by the public feed (taxonomy, concept, unit) and read back."""
    rows = table(spark, folder, "xbrl_fact").filter("accession_number is not null and concept is not null and unit is not null")
    fact = F.struct(F.col("value").alias("val"), F.col("period").alias("end"), "form", F.col("filed").cast("string").alias("filed"), "frame")
    units = rows.groupBy("accession_number", "concept", "unit").agg(F.collect_list(fact).alias("facts"))
    concepts = units.groupBy("accession_number", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "facts"))).alias("units"))
    filed = concepts.groupBy("accession_number").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("c"))
    nested = F.struct(F.create_map(F.lit("us-gaap"), F.col("c")).alias("facts"))
    return flatten_facts(filed.select("accession_number", F.to_json(nested).alias("j")), "j", ["accession_number"]).select("accession_number", "concept", "unit", "value", "form")


_SCALED = "case when abs(coalesce(value, 0)) >= 1 then sign(value) * log10(abs(value)) / 10 else coalesce(value, 0.0) end"


def _vector_sql() -> str:
    """The 100 numbers of a fact as SQL expressions over columns of xbrl_fact."""
    names = list(CONCEPT_CATEGORIES)
    end = "try_strptime(left(case when contains(period, '/') then split_part(period, '/', 2) else period end, 10), '%Y-%m-%d')"
    unit = "(('0x' || left(md5(lower(case when length(unit) > 0 then unit else 'usd' end)), 8))::bigint % 20 % 10)"
    letters = "greatest(length(regexp_replace(lower(concept), '\\P{L}', '', 'g')), 1)"
    count = lambda part: f"((length(concept) - length(replace(lower(concept), '{part}', ''))) / {float(len(part))})"
    slots = [f"case when kind = '{n}'{' or kind = ' + chr(39) + 'other' + chr(39) if i == 0 else ''} then 1.0 else 0.0 end" for i, n in enumerate(names)]
    slots += ["0.0"] * (10 - len(names)) + [f"({_SCALED}) * {0.8 ** i!r}" for i in range(5)] + ["0.0"] * 5
    slots += [f"case when {unit} = {i} then 0.5 else 0.0 end" for i in range(10)] + ["0.0"] * 5
    slots += [f"case when month({end}) = {m} then 1.0 else 0.0 end" for m in range(1, 13)] + [f"coalesce((year({end}) - 2000) / 50.0, 0.0)", "0.0", "0.0"]
    slots += ["least(length(concept) / 100.0, 1.0)"] + [f"{count(chr(97 + i))} / {letters}" for i in range(26)]
    slots += [f"least({count(pair)} / 5.0, 1.0)" for pair in xbrl.BIGRAMS] + [f"case when contains(lower(concept), '{t}') then 1.0 else 0.0 end" for t in xbrl.TAXONOMIES] + ["0.0"] * 8
    return "[" + ", ".join(f"({x})::double" for x in slots) + "]"


_VECTOR_SQL = f"v as (select *, case when concept is not null then {_vector_sql()} end as vector from (select *, {_CATEGORY} as kind from xbrl_fact))"
rounded = lambda v: F.transform(v, lambda x: F.round(x, 6) + 0.0)


@query("fact_vectors", f"with {_VECTOR_SQL} select accession_number, concept, list_transform(vector, lambda x: round(x, 6) + 0.0) as vector from v")
def fact_vectors(spark, folder):
    c = F.col
    return table(spark, folder, "xbrl_fact").select("accession_number", "concept", rounded(xbrl.fact_vector(c("concept"), c("value"), c("period"), c("unit"))).alias("vector"))


@query("text_categories", "select load_id, " + ", ".join("round((" + " + ".join(f"contains(lower(content), '{k}')::int" for k in keys) + f") / {float(len(keys))}, 6) as {label}" for label, keys in CONCEPT_CATEGORIES.items()) + " from filing_section where content is not null")
def text_categories(spark, folder):
    rows = table(spark, folder, "filing_section").filter("content is not null")
    return rows.select("load_id", *(F.round(c, 6).alias(n) for n, c in xbrl.category_ratios(F.col("content")).items()))


_KEYWORD_SQL = "k(keyword, v) as (values " + ", ".join(f"('{k}', {xbrl.keyword_vector(k)!r}::double[])" for k in xbrl.KEYWORDS) + ")"
_RATIOS = ", ".join("(" + " + ".join(f"contains(lower(content), '{k}')::int" for k in keys) + f") / {float(len(keys))}" for keys in CONCEPT_CATEGORIES.values())


@query("text_vectors", f"""with {_KEYWORD_SQL}, s as (select load_id, content from filing_section), f as (select load_id, unnest(v) as x, unnest(range(100)) as i from s join k on contains(lower(content), keyword)),
    m as (select load_id, i, avg(x) as x from f group by 1, 2), g as (select load_id, list(round(x, 5) + 0.0 order by i) as vector from m group by 1)
    select load_id, case when content is null then null when g.vector is not null then g.vector else list_transform(list_concat([{_RATIOS}, least(length(content) / 1000.0, 1.0)]::double[], [{", ".join(["0.0"] * (99 - len(CONCEPT_CATEGORIES)))}]::double[]), lambda x: round(x, 5) + 0.0) end as vector from s left join g using (load_id)""")
def text_vectors(spark, folder):
    return table(spark, folder, "filing_section").select("load_id", F.transform(xbrl.text_vector(F.col("content")), lambda x: F.round(x, 5) + 0.0).alias("vector"))


@query("filing_vector_weights", f"""select accession_number, count(*) as facts, round(sum(abs({_SCALED}) + 0.1), 6) as weight, round(sum({_SCALED} * (abs({_SCALED}) + 0.1)) / sum(abs({_SCALED}) + 0.1), 6) as mean_scaled
    from xbrl_fact where concept is not null group by 1""")
def filing_vector_weights(spark, folder):
    """The first value slot of each filing's weighted mean vector, with the weights' sum."""
    rows = table(spark, folder, "xbrl_fact").filter("concept is not null").select("accession_number", xbrl.scaled(F.col("value")).alias("s"))
    w = F.abs("s") + 0.1
    return rows.groupBy("accession_number").agg(F.count("*").alias("facts"), F.round(F.sum(w), 6).alias("weight"), F.round(F.sum(F.col("s") * w) / F.sum(w), 6).alias("mean_scaled"))


def filing_vectors(facts: DataFrame) -> DataFrame:
    """(accession_number, vector): the mean of a filing's fact vectors, weighted by value size.

    Elements are aggregated by place, so no task holds a filing's vectors together.
    """
    c = F.col
    rows = facts.filter("concept is not null").select("accession_number", (F.abs(xbrl.scaled(c("value"))) + 0.1).alias("w"), F.posexplode(xbrl.fact_vector(c("concept"), c("value"), c("period"), c("unit"))).alias("i", "x"))
    means = rows.groupBy("accession_number", "i").agg((F.sum(c("x") * c("w")) / F.sum("w")).alias("x"))
    return means.groupBy("accession_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


@query("filing_vectors", f"""with {_VECTOR_SQL}, e as (select accession_number, abs({_SCALED}) + 0.1 as w, unnest(vector) as x, unnest(range(100)) as i from v where concept is not null),
    m as (select accession_number, i, sum(x * w) / sum(w) as x from e group by 1, 2) select accession_number, list(round(x, 5) + 0.0 order by i) as vector from m group by 1""")
def filing_vectors_query(spark, folder):
    return filing_vectors(table(spark, folder, "xbrl_fact")).select("accession_number", F.transform("vector", lambda x: F.round(x, 5) + 0.0).alias("vector"))
