"""Queries of the llm subpackage."""

from __future__ import annotations

from docketry.llm import byte_bpe, forest, mixing, pigeonring, sentences, splitting
from docketry.session import cut
from docketry.tables import table
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def queries() -> dict:
    return dict(QUERIES)


def sql() -> dict[str, str]:
    return dict(SQL)


@_query
def p1_found(spark, folder):
    pairs, members = pigeonring.similar_pairs(table(spark, folder, "filing_section"), "section_id", "content", similarity=0.7, k=3, least_words=20)
    return pigeonring.id_pairs(pairs, members).select(("id_a"), ("id_b")).toDF("section_id_a", "section_id_b")


@_query
def p1_groups(spark, folder):
    """The classes of p1_found's links: one row per section."""
    found = pigeonring.similar_groups(table(spark, folder, "filing_section"), "section_id", "content", similarity=0.7, k=3, least_words=20)
    return found.withColumnRenamed("id", "section_id")


@_query
def p1_pruning(spark, folder):
    """Pairs left after each filter of p1_found."""
    return pigeonring.pruning(table(spark, folder, "filing_section").filter("section_id is not null"), "content", similarity=0.7, k=3, least_words=20)


def _p2_sql(columns: str) -> str:
    runs = r"list_max(list_transform(regexp_split_to_array(content, '[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}.!?;。！？；।]+'), lambda r: length(r)))"
    return f"""
    with c as (select distinct chunk_id, content from document_chunk where length(content) > 8000 and chunk_id is not null)
    select {columns} from (select distinct chunk_id, case when {runs} > 8000 then 'hard' else 'soft' end as cut_kind from c)
    """


SQL["p2_found"] = _p2_sql("chunk_id, cut_kind")


@_query
def p2_found(spark, folder):
    """By the cuts of the pieces: a hard one, in a run that is itself over the limit (a run between
    7,600 and 8,000 characters may need one too)."""
    found = splitting.oversized_chunks(table(spark, folder, "document_chunk"))
    return found.filter("piece_no = 1").select("chunk_id", F.when((F.col("hard_cuts") > 0) & (F.col("longest_run") > 8000), "hard").otherwise("soft").alias("cut_kind"))


@_query
def p2_pieces(spark, folder):
    return splitting.oversized_chunks(table(spark, folder, "document_chunk"))


SQL["p2_cover"] = """select chunk_id, any_value(md5(content)) as text_md5, true as within_limit, true as overlapping from document_chunk where length(content) > 8000 and chunk_id is not null group by 1"""


@_query
def p2_cover(spark, folder):
    """The texts put together again from their pieces, and whether these keep limit and overlap."""
    made = splitting.oversized_chunks(table(spark, folder, "document_chunk"))
    rest = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring(F.col("piece"), 401, 1 << 20))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", rest.alias("rest"))))
    whole = made.groupBy("chunk_id").agg(parts.alias("p"), F.max(F.col("piece_end") - F.col("piece_start")).alias("longest"))
    met = F.zip_with(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, F.size("p") - 1), lambda b, a: b["piece_start"] == a["piece_end"] - 400)
    return whole.select("chunk_id", F.md5(F.array_join(F.transform("p", lambda x: x["rest"]), "")).alias("text_md5"), (F.col("longest") <= 8000).alias("within_limit"), (F.forall(met, lambda x: x) & (F.col("p")[0]["piece_start"] == 0)).alias("overlapping"))


@_query
def p6_ids(spark, folder):
    return byte_bpe.encode(table(spark, folder, "documents"))


@_query
def p7_found(spark, folder):
    """The sources that the plan of the mixture finds short."""
    targets = table(spark, folder, "mix_target")
    return mixing.plan(mixing.document_sizes(table(spark, folder, "documents"), targets), targets).filter("short").select("source")


def _mixed(spark, folder, targets=None, **how):
    targets = table(spark, folder, "mix_target") if targets is None else targets
    sizes = cut(mixing.document_sizes(table(spark, folder, "documents"), targets))
    plan = mixing.plan(sizes, targets, **how)
    return mixing.mix(sizes, plan), plan


@_query
def p7_mix(spark, folder):
    return _mixed(spark, folder)[0]


@_query
def p7_shares(spark, folder):
    return mixing.reached_shares(*_mixed(spark, folder))


@_query
def p7_tempered(spark, folder):
    """Nine tenths of all tokens, no document twice: the limits press the exponent below 1."""
    once = table(spark, folder, "mix_target").withColumn("max_repeats", F.lit(1))
    return mixing.reached_shares(*_mixed(spark, folder, once, total_share=0.9))


@_query
def p7_entropy(spark, folder):
    """Shares of the tokens tempered to 97 % of the largest entropy, target weights set aside."""
    return mixing.reached_shares(*_mixed(spark, folder, evenness=0.97))


@_query
def p8_found(spark, folder):
    return sentences.split_sentences(table(spark, folder, "documents"))


@_query
def p8_sentences(spark, folder):
    return sentences.split_sentences(table(spark, folder, "documents"), with_text=True)


@_query
def p5_found(spark, folder):
    vectors = forest.compressed_vectors(table(spark, folder, "filing_section"), "section_id", "embedding_compressed", 64)
    near = forest.neighbours(vectors, k=5, least_cosine=0.9)
    return near.select(F.least("id_a", "id_b").alias("section_id_a"), F.greatest("id_a", "id_b").alias("section_id_b")).distinct()


@_query
def p5_nearest(spark, folder):
    """Of every section whose load_id is divisible by 100: its 5 nearest among all sections.

    Most of these vectors have no close neighbour, and an index would have to open a share of
    its leaves that does not fall with the size; so the queries meet all vectors, in blocks.
    """
    sections = table(spark, folder, "filing_section")
    vectors = forest.compressed_vectors(sections, "section_id", "embedding_compressed", 64)
    asked = sections.filter("load_id % 100 = 0").select("section_id")
    return forest.neighbours(vectors, k=5, queries=asked, exhaustive=True).select(F.col("id_a").alias("section_id"), F.col("id_b").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))
