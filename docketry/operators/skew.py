"""Per-key aggregation when a few keys hold most rows: two-stage salted aggregation.

Heavy keys are those with at least ``heavy_share`` of all rows; there can be at most
``1 / heavy_share`` of them, which bounds the broadcast list. Rows of a heavy key get a
salt from a hash of their own values (deterministic, so a lost task repeats the same
work); partial results per (key, salt) are then merged by key. Light keys get salt 0.
Null keys are ordinary keys. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.tables import table
from docketry.registry import query


def heavy_keys(df: DataFrame, keys: list[str], heavy_share: float) -> DataFrame:
    """Keys with at least ``heavy_share`` of all rows (at most ``1 / heavy_share`` rows)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("__n") >= heavy_share * F.col("__total")).select(*keys)


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    salt_by: list[str],
    salts: int = 32,
    heavy_share: float = 0.01,
) -> DataFrame:
    """``partial`` aggregates per (key, salt), then ``merge`` aggregates of those per key.

    ``merge`` refers to the names in ``partial``. ``salt_by`` names the columns whose hash
    gives the salt.
    """
    def free(name: str) -> str:
        while name in df.columns or name in partial:
            name += "_"
        return name

    salt, is_hot = free("__salt"), free("__hot")
    own = {k: free(f"__heavy_{k}") for k in keys}
    hot = heavy_keys(df, keys, heavy_share).select(*(F.col(k).alias(own[k]) for k in keys), F.lit(True).alias(is_hot))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(own[k]))
        match = same if match is None else match & same
    salted = df.join(F.broadcast(hot), match, "left").withColumn(
        salt, F.when(F.col(is_hot), F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    first = salted.groupBy(*keys, salt).agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))


#: White space of Unicode and hyphens (ASCII, Unicode hyphen, non-breaking hyphen, soft hyphen).
SPACES_AND_HYPHENS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}\x{2010}\x{2011}\x{00AD}-]"


def clean_key(column: str) -> Column:
    """Upper-cased without white space and hyphens; empty becomes null."""
    return F.nullif(F.upper(F.regexp_replace(column, SPACES_AND_HYPHENS, "")), F.lit(""))


def distinct_sections(sections: DataFrame, *more: str) -> DataFrame:
    """The sections once per (section_id, ticker, filing_type) with clean keys."""
    return sections.select("section_id", clean_key("ticker").alias("ticker"), clean_key("filing_type").alias("filing_type"), *more)


def section_keys(sections: DataFrame, least_share: float = 0.01) -> DataFrame:
    """(ticker, filing_type) keys that hold at least ``least_share`` of all distinct section_ids.

    Sections whose ticker or filing_type is null or empty form no key but count in the total.
    """
    seen = distinct_sections(sections).filter("section_id is not null").repartition("section_id").dropDuplicates(["section_id", "ticker", "filing_type"])
    total = seen.groupBy("section_id").agg(F.lit(1).alias("one")).agg(F.count("*").alias("total"))
    counts = salted_aggregate(
        seen.filter("ticker is not null and filing_type is not null"),
        ["ticker", "filing_type"],
        {"part": F.count("*")},
        {"sections": F.sum("part")},
        ["section_id"],
    )
    return counts.crossJoin(F.broadcast(total)).filter(F.col("sections") >= least_share * F.col("total")).select("ticker", "filing_type")


def section_report(sections: DataFrame) -> DataFrame:
    """Distinct sections, word total (of the content) and latest section of every key.

    Repeated loads of a section count once, by the latest created_at (ties: load_id).
    """
    chosen = sections.filter("section_id is not null").select(
        "section_id", "load_id", "created_at", clean_key("ticker").alias("ticker"), clean_key("filing_type").alias("filing_type"),
        F.size(F.filter(F.split(F.coalesce("content", F.lit("")), r"(?U)\s+"), lambda w: w != "")).alias("words"),
    )
    once = chosen.groupBy("section_id").agg(F.max_by(F.struct("created_at", "ticker", "filing_type", "words"), F.struct("created_at", "load_id")).alias("s")).select("section_id", "s.*")
    return salted_aggregate(
        once.filter("ticker is not null and filing_type is not null"),
        ["ticker", "filing_type"],
        {"n": F.count("*"), "w": F.sum("words"), "last": F.max(F.struct("created_at", "section_id"))},
        {"sections": F.sum("n"), "words": F.sum("w"), "latest_section": F.max("last")["section_id"]},
        ["section_id"],
    )


_CLEAN = r"nullif(upper(regexp_replace({0}, '[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{001C}}-\x{{001F}}\x{{2010}}\x{{2011}}\x{{00AD}}-]', '', 'g')), '')"


@query(
    "p4_found",
    f"""
    with s as (select distinct section_id, {_CLEAN.format('ticker')} as ticker, {_CLEAN.format('filing_type')} as filing_type from filing_section where section_id is not null),
    t as (select count(distinct section_id) as total from s)
    select ticker, filing_type from s, t where ticker is not null and filing_type is not null
    group by ticker, filing_type, total having count(*) >= 0.01 * total
    """,
)
def p4_found(spark, folder):
    return section_keys(table(spark, folder, "filing_section"))


@query(
    "p4_report",
    f"""
    with r as (select section_id, created_at, load_id, {_CLEAN.format('ticker')} as ticker, {_CLEAN.format('filing_type')} as filing_type,
        len(list_filter(regexp_split_to_array(coalesce(content, ''), '[\\s\\x{{000B}}\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> '')) as words
        from filing_section where section_id is not null),
    o as (select * from r qualify row_number() over (partition by section_id order by created_at desc nulls last, load_id desc) = 1)
    select ticker, filing_type, count(*) as sections, sum(words)::bigint as words, arg_max(section_id, (created_at, section_id)) as latest_section
    from o where ticker is not null and filing_type is not null group by ticker, filing_type
    """,
)
def p4_report(spark, folder):
    return section_report(table(spark, folder, "filing_section"))
