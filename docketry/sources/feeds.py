"""Readers of the public feeds as landed files, and the vector codec.

The feeds are read from files that a fetcher has landed; Spark does the rest. Fetching itself
(one session per partition, a pause between requests) belongs to whoever lands them.
"""

from __future__ import annotations

import base64
import gzip
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.registry import query
from docketry.tables import table

TICKER = T.StructType([T.StructField("cik_str", T.StringType()), T.StructField("ticker", T.StringType()), T.StructField("title", T.StringType())])
#: The parallel arrays of a company's filing index.
INDEX = ["accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "act", "form", "fileNumber", "filmNumber", "items", "primaryDocument", "primaryDocDescription"]
RECENT = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in INDEX])
ABOUT = ["sic", "sicDescription", "stateOfIncorporation", "fiscalYearEnd"]
SUBMISSIONS = T.StructType([T.StructField("cik", T.StringType()), T.StructField("name", T.StringType()), *(T.StructField(n, T.StringType()) for n in ABOUT), T.StructField("exchanges", T.ArrayType(T.StringType())), T.StructField("filings", T.StructType([T.StructField("recent", RECENT)]))])


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files as texts, e.g. landed filings."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def company_tickers(feed: DataFrame, column: str) -> DataFrame:
    """(ticker, cik, title) of an object of objects; tickers upper-cased, cik padded to 10; of
    several entries for a ticker the last of the object counts."""
    entries = feed.select(F.monotonically_increasing_id().alias("__file"), F.posexplode(F.map_values(F.from_json(column, T.MapType(T.StringType(), TICKER)))).alias("place", "e"))
    rows = entries.select(F.upper("e.ticker").alias("ticker"), F.lpad("e.cik_str", 10, "0").alias("cik"), F.col("e.title").alias("title"), "__file", "place").filter("ticker is not null")
    return rows.groupBy("ticker").agg(F.max_by(F.struct("cik", "title"), F.struct("__file", "place")).alias("e")).select("ticker", "e.cik", "e.title")


def company_submissions(feed: DataFrame, column: str) -> DataFrame:
    """(cik, name, sic, sicDescription, stateOfIncorporation, fiscalYearEnd, exchanges) of companies'
    submissions, ciks padded to 10; texts that cannot be read give no rows, of several for a cik
    the largest by name counts."""
    read = feed.select(F.from_json(column, SUBMISSIONS).alias("s")).filter("s.cik is not null").select(F.lpad("s.cik", 10, "0").alias("cik"), "s.name", *(f"s.{n}" for n in ABOUT), "s.exchanges")
    rest = ["name", *ABOUT, "exchanges"]
    return read.groupBy("cik").agg(F.max(F.struct(*rest)).alias("s")).select("cik", "s.*")


def company_info(tickers: DataFrame, submissions: DataFrame) -> DataFrame:
    """What is known of every company of the ticker feed; the name falls back to the feed's title."""
    return tickers.join(submissions, "cik", "left").select("ticker", "cik", F.coalesce("name", "title").alias("name"), *ABOUT, "exchanges")


def company_filings(feed: DataFrame, column: str, keep: list[str], types: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """One row per filing from parallel arrays; missing arrays give nulls. Types compare upper-cased,
    dates are inclusive; ``limit`` keeps the first ones of each feed in its own order."""
    recent = feed.select(*keep, F.from_json(column, SUBMISSIONS)["filings"]["recent"].alias("r"))
    none = F.array().cast("array<string>")
    zipped = F.arrays_zip(*(F.coalesce(F.col(f"r.{n}"), none).alias(n) for n in INDEX))
    rows = recent.select(*keep, F.posexplode(zipped).alias("place", "f")).select(*keep, "place", "f.*")
    if types:
        rows = rows.filter(F.col("form").isin(*(t.upper() for t in types)))
    if start:
        rows = rows.filter(F.col("filingDate") >= start)
    if end:
        rows = rows.filter(F.col("filingDate") <= end)
    if limit is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keep).orderBy("place"))).filter(F.col("__n") <= limit).drop("__n")
    return rows


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decompress(texts: pd.Series) -> pd.Series:
    """A vector from base64 of gzip of a JSON array; null where it cannot be read."""

    def one(text: str | None) -> list[float] | None:
        try:
            found = json.loads(gzip.decompress(base64.b64decode(text, validate=True)))
            return [float(x) for x in found] if isinstance(found, list) else None
        except (ValueError, TypeError, OSError, EOFError):
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def compress(vectors: pd.Series) -> pd.Series:
    """The reverse of ``decompress``, the same bytes for the same vector."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(gzip.compress(json.dumps([float(x) for x in v]).encode(), mtime=0)).decode())


def sector_companies(lists: DataFrame, column: str) -> DataFrame:
    """(sector, ticker) from an object of lists."""
    return lists.select(F.explode(F.from_json(column, T.MapType(T.StringType(), T.ArrayType(T.StringType())))).alias("sector", "tickers")).select("sector", F.explode("tickers").alias("ticker"))


@query("feed_tickers", "select upper(ticker) as ticker, max(lpad(cik, 10, '0')) as cik from company where cik is not null group by 1")
def feed_tickers(spark, folder):
    """The ticker feed, written from the companies and read back."""
    rows = table(spark, folder, "company").filter("cik is not null").groupBy("ticker").agg(F.max("cik").alias("cik"))
    feed = rows.select(F.to_json(F.create_map(F.lit("0"), F.struct(F.col("cik").alias("cik_str"), "ticker"))).alias("j"))
    return company_tickers(feed, "j").select("ticker", "cik")


@query("feed_filings", """select ticker, accession_number, filing_type as form, filing_date::varchar as filing_date from filing where ticker is not null and upper(filing_type) in ('10-K', '10-Q') and filing_date >= date '2020-01-01'""")
def feed_filings(spark, folder):
    """The filings of each company and month as one index of parallel arrays, read back through its filters."""
    rows = table(spark, folder, "filing").filter("ticker is not null")
    listed = F.array_sort(F.collect_list(F.struct("filing_id", "acceptance_ts", "accession_number", F.col("filing_date").cast("string").alias("filing_date"), "filing_type", "primary_document")))
    month = rows.groupBy("ticker", F.trunc("filing_date", "month").alias("month")).agg(listed.alias("l"))
    part = lambda c: F.transform("l", lambda x: x[c])
    recent = F.struct(part("accession_number").alias("accessionNumber"), part("filing_date").alias("filingDate"), part("filing_type").alias("form"), part("primary_document").alias("primaryDocument"))
    feed = month.select("ticker", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("j"))
    return company_filings(feed, "j", ["ticker"], ["10-k", "10-q"], "2020-01-01").select("ticker", F.col("accessionNumber").alias("accession_number"), "form", F.col("filingDate").alias("filing_date"))


@query("company_info", """with c as (select ticker, max(lpad(cik, 10, '0')) as cik, max(name) as name, max(sic) as sic from company where cik is not null group by 1)
    select upper(ticker) as ticker, cik, name, case when sic is not null then sic end as sic from c""")
def company_info_query(spark, folder):
    """Tickers and submissions (of companies with a sic code), written as feeds and joined again."""
    rows = table(spark, folder, "company").filter("cik is not null").groupBy("ticker").agg(F.max("cik").alias("cik"), F.max("name").alias("name"), F.max("sic").alias("sic"))
    tickers = company_tickers(rows.select(F.to_json(F.create_map(F.lit("0"), F.struct(F.col("cik").alias("cik_str"), "ticker", F.col("name").alias("title")))).alias("j")), "j")
    submissions = company_submissions(rows.filter("sic is not null").select(F.to_json(F.struct("cik", "name", "sic")).alias("j")), "j")
    return company_info(tickers, submissions).select("ticker", "cik", "name", "sic")


@query("codec_roundtrip")
def codec_roundtrip(spark, folder):
    """(load_id, size, same): the size of each readable vector and whether it survives the codec."""
    v = table(spark, folder, "filing_section").select("load_id", decompress("embedding_compressed").alias("v")).filter("v is not null")
    return v.select("load_id", F.size("v").alias("size"), "v", compress("v").alias("packed")).select("load_id", "size", (decompress("packed") == F.col("v")).alias("same"))
