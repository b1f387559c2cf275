from pyspark.sql import functions as F

from docketry.operators import skew
from tests.conftest import rows

SCHEMA = "load_id long, section_id string, ticker string, filing_type string, content string, day int, `__salt` int"


def sections(spark, data):
    return spark.createDataFrame([(i, *d, 0) for i, d in enumerate(data)], SCHEMA).selectExpr("*", "timestamp'2024-01-01' + make_interval(0,0,0,day) as created_at")


def test_salted_equals_plain(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id", F.lit(1).alias("__salt"), F.lit(2).alias("__hot"))
    plain = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"), F.max("id").alias("m"))
    salted = skew.salted_aggregate(df, ["k"], {"n": F.count("*"), "s": F.sum("id"), "m": F.max("id")}, {"n": F.sum("n"), "s": F.sum("s"), "m": F.max("m")}, ["id"])
    assert rows(plain.select("k", "n", "s", "m")) == rows(salted.select("k", "n", "s", "m"))


def test_heavy_keys_are_few(spark):
    df = spark.range(1000).select((F.col("id") % 200).alias("k"))
    assert skew.heavy_keys(df, ["k"], 0.01).count() == 0
    assert skew.heavy_keys(df.withColumn("k", F.lit(1)), ["k"], 0.01).count() == 1


def test_keys_clean_and_share_counts_all_sections(spark):
    data = [("s1", " zq-a ", "10 - k", "a", 1), ("s1", "ZQA", "10-K", "a", 2), ("s2", "zq a", "10K", "b", 1), ("s3", None, "10-K", "c", 1), ("s4", "", "8-K", "d", 1), ("s5", "B", "8-k", "e", 1), (None, "B", "8-K", "f", 1)]
    assert rows(skew.section_keys(sections(spark, data), 0.4)) == [("ZQA", "10K")]
    assert rows(skew.section_keys(sections(spark, data), 0.2)) == [("B", "8K"), ("ZQA", "10K")]
    assert rows(skew.section_keys(sections(spark, data), 0.41)) == []


def test_report(spark):
    data = [("s1", "a", "10-K", "one two", 1), ("s1", "A", "10-K", "one two three", 2), ("s2", "a", "10-K", None, 9), ("s3", "a", "10-K", "  ", 9), ("s4", None, "10-K", "x", 1)]
    assert rows(skew.section_report(sections(spark, data))) == [("A", "10K", 3, 3, "s3")]
    assert skew.section_report(sections(spark, data).limit(0)).count() == 0 and skew.section_keys(sections(spark, data).limit(0)).count() == 0
