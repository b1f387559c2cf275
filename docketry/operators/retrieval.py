"""Filtered vector search, hybrid ranking, batch neighbours and vector aggregates.

Filters come before scoring and limits, every order ends with a key. A query vector is one
row that is sent to the scan; scoring is a projection, so a search is one scan and a bounded
top-k, whatever the size of the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.vectors import combine, cosine, dot, doubles
from docketry.operators import terms as text_terms
from docketry.operators.graph import latest_rows
from docketry.registry import query
from docketry.tables import table


def in_list(column: str | Column, wanted: list | None) -> Column:
    """IN, where no list or an empty one filters nothing."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isin(*wanted) if wanted else F.lit(True)


def vector_search(vectors: DataFrame, question: DataFrame, vector: str, key: str, score=cosine, k: int = 10, least: float | None = None) -> DataFrame:
    """The ``k`` best rows for the one vector in ``question`` (column q), best first."""
    scored = vectors.crossJoin(F.broadcast(question)).withColumn("score", F.round(score(F.col(vector), F.col("q")), 6)).drop("q")
    scored = scored.filter("score is not null") if least is None else scored.filter(F.col("score") > least)
    return scored.orderBy(F.desc("score"), key).limit(k)


def hybrid(semantic: DataFrame, text: DataFrame, key: str, semantic_weight: float = 1.0, text_weight: float = 1.2) -> DataFrame:
    """(key, score, methods): the mean of both weighted scores where both found a row, else the one."""
    s = semantic.select(key, (F.col("score") * semantic_weight).alias("s"))
    t = text.select(key, (F.col("score") * text_weight).alias("t"))
    both = s.join(t, key, "full_outer")
    score = F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), (F.col("s") + F.col("t")) / 2).otherwise(F.coalesce("s", "t"))
    methods = F.concat_ws(",", F.when(F.col("s").isNotNull(), "semantic"), F.when(F.col("t").isNotNull(), "text"))
    return both.select(key, F.round(score, 4).alias("score"), methods.alias("methods"))


#: Most queries that are sent to all tasks; more meet their groups by a shuffle, in so many parts.
MOST_QUERIES, SALTS = 10_000, 32


def nearest_within_group(vectors: DataFrame, queries: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """The ``k`` nearest rows of its own group for each query row."""
    asked = queries.select(F.col(key).alias("query_id"), group, F.col(vector).alias("q"))
    if asked.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        scored = vectors.join(F.broadcast(asked), group)
    else:
        # Rows of a group are spread over salts, and each of its queries visits all of them.
        salted = asked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = vectors.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [group, "__salt"]).drop("__salt")
    scored = scored.filter(F.col(key) != F.col("query_id"))
    scored = scored.select("query_id", key, F.round(cosine(F.col(vector), F.col("q")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def vector_means(vectors: DataFrame, group: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(group, position, mean, weighted_mean, largest): element-wise aggregates of a group's vectors."""
    weight = F.lit(1.0) if weight is None else weight
    parts = vectors.select(group, weight.alias("w"), F.posexplode(doubles(F.col(vector))).alias("position", "x"))
    total = F.sum("w")
    return parts.groupBy(group, "position").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.sum(F.col("x") * F.col("w")) / F.nullif(total, F.lit(0.0)), 6).alias("weighted_mean"), F.round(F.max("x"), 6).alias("largest"))


def _question(spark, folder, vec_id=0):
    return table(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


_Q = "(select embedding::double[] from embeddings where vec_id = 0)"
_COS = "list_cosine_similarity(embedding::double[], {q})"


@query("semantic_topk_dot", f"select vec_id, label, round(list_dot_product(embedding::double[], {_Q}), 6) as score from embeddings order by score desc, vec_id limit 10")
def semantic_topk_dot(spark, folder):
    return vector_search(table(spark, folder, "embeddings"), _question(spark, folder), "embedding", "vec_id", dot).select("vec_id", "label", "score")


@query("semantic_topk_cosine", f"select vec_id, label, round({_COS.format(q=_Q)}, 6) as score from embeddings order by score desc, vec_id limit 10")
def semantic_topk_cosine(spark, folder):
    return vector_search(table(spark, folder, "embeddings"), _question(spark, folder), "embedding", "vec_id").select("vec_id", "label", "score")


@query("semantic_filtered_threshold", f"select vec_id, label, round({_COS.format(q=_Q)}, 6) as score from embeddings where label in (1, 3, 5, 7) and round({_COS.format(q=_Q)}, 6) > 0.1 order by score desc, vec_id limit 20")
def semantic_filtered_threshold(spark, folder):
    chosen = table(spark, folder, "embeddings").filter(in_list("label", [1, 3, 5, 7]))
    return vector_search(chosen, _question(spark, folder), "embedding", "vec_id", k=20, least=0.1).select("vec_id", "label", "score")


@query("similar_excluding", f"select vec_id, round({_COS.format(q=_Q)}, 6) as score from embeddings where vec_id <> 0 order by score desc, vec_id limit 5")
def similar_excluding(spark, folder):
    return vector_search(table(spark, folder, "embeddings").filter("vec_id <> 0"), _question(spark, folder), "embedding", "vec_id", k=5).select("vec_id", "score")


@query("batch_nearest_by_label", """select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) desc, e.vec_id) as rank
    from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 100 = 0 qualify rank <= 5""")
def batch_nearest_by_label(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return nearest_within_group(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "label", "embedding", 5).select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("vector_aggregates", "select label, position::int as position, round(avg(x), 6) as mean, round(sum(x * w) / sum(w), 6) as weighted_mean, round(max(x), 6) as largest from (select label, 1.0 / (1 + vec_id % 7) as w, unnest(embedding::double[]) as x, unnest(range(64)) as position from embeddings) group by 1, 2")
def vector_aggregates(spark, folder):
    return vector_means(table(spark, folder, "embeddings"), "label", "embedding", 1.0 / (1 + F.col("vec_id") % 7))


@query("ensemble_combine", """select vec_id, position::int as position, round((a / na * 0.5 + coalesce(b / nb, 0) * 0.3) / 0.8, 6) as x from (
    select vec_id, unnest(embedding::double[]) as a, unnest(list_concat((embedding::double[])[1:32], list_transform(range(32), lambda i: 0.0::double))) as b, unnest(range(64)) as position,
    sqrt(list_dot_product(embedding::double[], embedding::double[])) as na, sqrt(list_dot_product((embedding::double[])[1:32], (embedding::double[])[1:32])) as nb from embeddings)""")
def ensemble_combine(spark, folder):
    """Two models: the whole vector and its first half, padded with zeros."""
    both = combine([(F.col("embedding"), 0.5), (F.slice("embedding", 1, 32), 0.3)])
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(both).alias("position", "x")).select("vec_id", "position", F.round("x", 6).alias("x"))


@query("hybrid_rank", f"""{text_terms._BM25_SQL},
    chunks as (select chunk_id, section_type, embedding from document_chunk where embedding is not null and chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, load_id desc) = 1),
    q as (select embedding::double[] as v from chunks order by chunk_id limit 1),
    sem as (select section_type, max(round(list_cosine_similarity(embedding::double[], v), 6)) as score from chunks, q where section_type is not null and len(embedding) = len(v) group by 1),
    txt as (select section_type, max(round(score, 6)) as score from bm25 join section_once using (section_id) where section_type is not null group by 1)
    select coalesce(s.section_type, t.section_type) as section_type, round(case when s.score is not null and t.score is not null then (s.score + t.score * 1.2) / 2 when s.score is not null then s.score else t.score * 1.2 end, 4) as score,
    concat_ws(',', case when s.score is not null then 'semantic' end, case when t.score is not null then 'text' end) as methods from sem s full join txt t on s.section_type = t.section_type""")
def hybrid_rank(spark, folder):
    """Section types by their best vector hit among chunks and their best text hit among sections."""
    chunks = latest_rows(table(spark, folder, "document_chunk").filter("embedding is not null"), "chunk_id", ["ingested_at"], "load_id").select("chunk_id", "section_type", "embedding")
    q = chunks.orderBy("chunk_id").limit(1).select(F.col("embedding").alias("q"))
    scored = chunks.crossJoin(F.broadcast(q)).filter("section_type is not null and size(embedding) = size(q)")
    semantic = scored.groupBy("section_type").agg(F.max(F.round(cosine(F.col("embedding"), F.col("q")), 6)).alias("score"))
    found = text_terms.bm25_scores(spark, folder, text_terms._WANTED).join(text_terms._sections(spark, folder).select("section_id", "section_type"), "section_id")
    text = found.filter("section_type is not null").groupBy("section_type").agg(F.max(F.round("score", 6)).alias("score"))
    return hybrid(semantic, text, "section_type")
