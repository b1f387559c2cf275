"""Ingestion as one job per table: deduplicate, gate, cut, write.

Plain Parquet has no merge, so an upsert reads the old table, unions the delivery, keeps the
latest row per key and writes to a new place; the caller then switches over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import clean as clean_text
from docketry.functions.text import compact
from docketry.operators import content, graph, insider, structure, terms
from docketry.registry import query
from docketry.session import shared_folder
from docketry.tables import table


def upsert(old: DataFrame | None, new: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The latest row per key of both; of equal ones a new row wins over an old one."""
    both = new.withColumn("__new", F.lit(1)) if old is None else old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    keep = [c for c in new.columns if c != key]
    return graph.latest(both, key, [*by, "__new"], keep)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: what a unique constraint would refuse."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def write_model(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Write companies, filings and sections; sections by filing type, clustered by ticker."""
    known = graph.companies(table(spark, folder, "company"))
    filed = graph.filings(table(spark, folder, "filing"), known)
    parts = graph.sections(table(spark, folder, "filing_section")).join(filed.select("filing_id", "ticker", "filing_type", "filing_date"), "filing_id")
    places = {name: f"{out.rstrip('/')}/{name}" for name in ("company", "filing", "section")}
    known.write.mode("errorifexists").parquet(places["company"])
    filed.repartitionByRange("filing_type", "ticker").sortWithinPartitions("ticker", "filing_date").write.mode("errorifexists").parquet(places["filing"])
    # Range partitions over (type, ticker, section) split hot tickers; no file holds a whole one.
    parts.repartitionByRange("filing_type", "ticker", "section_id").sortWithinPartitions("ticker").write.partitionBy("filing_type").mode("errorifexists").parquet(places["section"])
    return places


def clear(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Overwrite a table with nothing; refused unless confirmed."""
    if not confirm:
        raise ValueError("set confirm to clear a table")
    df = spark.read.parquet(path)
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def save_vocabulary(vocab: DataFrame, documents: int, path: str) -> None:
    vocab.withColumn("documents", F.lit(documents)).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    saved = spark.read.parquet(path)
    first = saved.select("documents").first()
    return saved.drop("documents"), first[0] if first else 0


def process_documents(docs: DataFrame, key: str, text: str, form: str, limit: int = 8000, overlap: int = 400, by: str = "headings") -> DataFrame:
    """(key, section, section_no, chunk_no, begin_at, end_at, chunk_id, chunk): raw texts cleaned, cut
    into sections and then into overlapping windows that end with words.

    Sections are those under the headings of the form, generic ones for other forms, or with
    ``by`` "preferred" those of the preferred patterns. A text without any is one section, named
    by its form.
    """
    if by not in ("headings", "preferred"):
        raise ValueError(f"unknown way {by!r}")
    clean = docs.select(key, F.coalesce(F.col(form), F.lit("unknown")).alias("form"), compact(clean_text(F.col(text))).alias("__t"))
    if by == "headings":
        named = structure.filing_sections(clean, key, "__t", "form").select(key, "section", "section_no", "content")
    else:
        named = structure.preferred_sections(clean, key, "__t").select(key, "section", F.lit(1).alias("section_no"), "content")
    rest = clean.join(named.select(key).distinct(), key, "left_anti").filter(F.length("__t") > 0)
    rest = rest.select(key, F.concat(F.lower("form"), F.lit("_content")).alias("section"), F.lit(1).alias("section_no"), F.col("__t").alias("content"))
    each = named.unionByName(rest).withColumn("__k", F.struct(key, "section", "section_no"))
    k = F.col("__k")
    windows = content.overlapping_chunks(each, "__k", "content", limit, overlap)
    number = content.chunk_id(k[key].cast("string"), k["section"], k["section_no"].cast("string"), (F.col("chunk_no") - 1).cast("string"))
    return windows.select(k[key].alias(key), k["section"].alias("section"), k["section_no"].alias("section_no"), "chunk_no", "begin_at", "end_at", number.alias("chunk_id"), "chunk")


def store(rows: DataFrame, place: str) -> int:
    """Write a table and return how many rows it has."""
    rows.write.mode("errorifexists").parquet(place)
    return rows.sparkSession.read.parquet(place).count()


def run(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """(table, rows): the whole ingestion. Writes the model (companies, filings, sections), facts of
    known filings, executives and valid trades of known companies, the raw documents as chunks, the
    vocabulary of the sections, and reports what was stored."""
    out = out.rstrip("/")
    places = write_model(spark, folder, out)
    stored = {name: spark.read.parquet(place).count() for name, place in places.items()}
    trades = insider.trades(table(spark, folder, "insider_transaction"), spark.read.parquet(places["company"]))
    known = spark.read.parquet(places["filing"]).select("accession_number")
    stored["fact"] = store(table(spark, folder, "xbrl_fact").join(known, "accession_number", "left_semi"), f"{out}/fact")
    stored["trade"] = store(trades, f"{out}/trade")
    stored["executive"] = store(spark.read.parquet(f"{out}/trade").groupBy("executive_name").agg(F.count("*").alias("trades")), f"{out}/executive")
    chunks = process_documents(table(spark, folder, "documents").withColumn("form", F.lit(None).cast("string")), "doc_id", "text", "form")
    stored["chunk"] = store(chunks, f"{out}/chunk")
    sections = spark.read.parquet(places["section"])
    documents = sections.filter("content is not null").count()
    save_vocabulary(terms.vocabulary(terms.document_frequencies(sections, "content"), documents), documents, f"{out}/vocabulary")
    stored["vocabulary"] = spark.read.parquet(f"{out}/vocabulary").count()
    return spark.createDataFrame(list(stored.items()), "table string, rows bigint")


@query("ingestion", f"""{graph.MODEL_SQL}, s as (select distinct section_id from filing_section join filing_once using (filing_id) where embedding_compressed is not null and section_id is not null)
    select 'company' as "table", count(*) as rows from company_once union all select 'filing', count(*) from filing_once union all select 'section', count(*) from s
    union all select 'fact', count(*) from xbrl_fact where accession_number in (select accession_number from filing_once)""")
def ingestion(spark, folder):
    """The whole run into the shared folder; its report on companies, filings, sections and facts."""
    report = run(spark, folder, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    return report.filter(F.col("table").isin("company", "filing", "section", "fact"))


@query("processed_documents")
def processed_documents(spark, folder):
    """Every document cleaned and cut, read as a filing without headings."""
    docs = table(spark, folder, "documents").withColumn("form", F.lit("other"))
    return process_documents(docs, "doc_id", "text", "form").drop("chunk")
