"""Rule-based understanding of questions, for one question or for a table of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.registry import query
from docketry.tables import table

# Words in a question that name filing types; the default if none does.
TYPE_WORDS = [
    (["10-k", "annual", "yearly"], ["10-K"]),
    (["10-q", "quarterly"], ["10-Q"]),
    (["8-k", "material event", "acquisition"], ["8-K"]),
    (["proxy", "compensation", "governance", "def 14a"], ["DEF 14A"]),
    (["insider", "trading", "ownership"], ["3", "4", "5"]),
]
DEFAULT_TYPES = ["10-K", "10-Q"]
YEARS = ["2024", "2023", "2022", "2021"]
# Words that set the kind of a question, in this order.
KIND_WORDS = [("comparison", ["compare", "versus", "vs", "comparison"]), ("temporal", ["trend", "over time", "evolution", "change"]), ("cross-sector", ["industry", "sector", "across companies"])]
COMMON_WORDS = ["what", "where", "when", "which", "companies", "company", "filings", "information"]


# Words that show a sector, and those of the wider analysis that name filing types and
# the kind of a question; there a question without any may be about all types.
SECTOR_WORDS = [
    ("technology", ["tech", "technology", "software", "hardware", "ai", "cloud"]),
    ("finance", ["bank", "banking", "financial", "finance", "credit", "loan"]),
    ("healthcare", ["healthcare", "pharma", "pharmaceutical", "medical", "drug"]),
    ("energy", ["energy", "oil", "gas", "petroleum", "renewable"]),
]
ANALYSIS_TYPE_WORDS = [
    (["annual", "yearly", "comprehensive", "10-k"], ["10-K"]),
    (["quarterly", "quarter", "10-q"], ["10-Q"]),
    (["material", "event", "announcement", "8-k"], ["8-K"]),
    (["proxy", "shareholder", "governance", "def 14a"], ["DEF 14A"]),
    (["insider", "trading", "ownership", "forms"], ["3", "4", "5"]),
]
ANALYSIS_KINDS = [("comparison", ["compare", "comparison", "versus", "vs", "difference", "similar"]), ("analysis", ["analyze", "analysis", "trend", "pattern", "insight", "examine"])]
#: Most companies of a sector that stand for it in a question.
SECTOR_COMPANIES = 5


@dataclass(frozen=True)
class Question:
    text: str
    tickers: list[str] = field(default_factory=list)
    filing_types: list[str] = field(default_factory=list)
    years: list[str] = field(default_factory=list)
    kind: str = "single"
    keywords: list[str] = field(default_factory=list)


def _any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _joined(parts: list[Column]) -> Column:
    return F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())


def read_questions(questions: DataFrame, text: str) -> DataFrame:
    """Adds filing_types, years, kind and keywords; null questions give nulls."""
    low = F.lower(F.col(text))
    none = F.array().cast("array<string>")
    types = _joined([F.when(_any(low, words), F.array(*map(F.lit, names))).otherwise(none) for words, names in TYPE_WORDS])
    years = _joined([F.when(low.contains(y), F.array(F.lit(y))).otherwise(none) for y in YEARS])
    kind = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, words in KIND_WORDS:
        kind = kind.when(_any(low, words), F.lit(name))
    keywords = F.filter(F.split(low, r"[ \t\n\r]+"), lambda w: (F.length(w) > 3) & ~w.isin(*COMMON_WORDS))
    return questions.withColumns({
        "filing_types": F.when(low.isNotNull(), F.when(F.size(types) > 0, types).otherwise(F.array(*map(F.lit, DEFAULT_TYPES)))),
        "years": F.when(low.isNotNull(), years), "kind": kind.otherwise("single"), "keywords": keywords,
    })


def read_question(text: str, tickers: list[str]) -> Question:
    """One question about the companies that it names (see ``named_in``).

    A single company makes the question single whatever else it says; a company named in
    several ways counts once.
    """
    low = text.lower()
    types = [t for words, found in TYPE_WORDS if any(w in low for w in words) for t in found] or DEFAULT_TYPES
    tickers = list(dict.fromkeys(tickers))
    kind = "single" if len(tickers) == 1 else next((k for k, words in KIND_WORDS if any(w in low for w in words)), "single")
    keywords = [w for w in low.split() if len(w) > 3 and w not in COMMON_WORDS]
    return Question(text, tickers, types, [y for y in YEARS if y in low], kind, keywords)


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with single spaces between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def named_in(text: str, companies: DataFrame) -> DataFrame:
    """(ticker) of the companies whose name or ticker is among the words of one question; a filter
    over the company table, whatever its size."""
    said = plain_words(F.lit(text))
    hit = F.lit(False)
    for column in ("name", "ticker"):
        words = plain_words(F.col(column))
        hit = hit | (F.coalesce(said.contains(words), F.lit(False)) & (F.length(words) > 2))
    return companies.filter(hit).select("ticker").distinct()


def question_companies(questions: DataFrame, key: str, text: str, companies: DataFrame) -> DataFrame:
    """(key, ticker): the companies that each question of a table names, by name or by ticker.

    The runs of words of a question meet the names by equality; runs are as long as the longest
    name, so nothing is compared with everything.
    """
    both = companies.select("ticker", F.explode(F.array("name", "ticker")).alias("n")).select("ticker", F.trim(plain_words(F.col("n"))).alias("run")).filter("run <> ''").distinct()
    longest = both.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 0
    if not longest:
        return questions.select(key, F.lit(None).cast("string").alias("ticker")).limit(0)
    words = questions.filter(F.col(text).isNotNull()).select(key, F.split(F.trim(plain_words(F.col(text))), " ").alias("w"))
    runs = F.flatten(F.array(*(_runs(n) for n in range(1, longest + 1))))
    return words.select(key, F.explode(F.array_distinct(F.array_compact(runs))).alias("run")).join(both, "run").select(key, "ticker").distinct()


def _runs(n: int) -> Column:
    """All runs of n words of the list w."""
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))


def analyze_questions(questions: DataFrame, text: str) -> DataFrame:
    """Adds filing_types (maybe none, which means all), kind (comparison before analysis before
    single) and sector_focus (the first sector with a word in the question); null questions give nulls."""
    low = F.lower(F.col(text))
    none = F.array().cast("array<string>")
    types = _joined([F.when(_any(low, words), F.array(*map(F.lit, names))).otherwise(none) for words, names in ANALYSIS_TYPE_WORDS])
    kind = sector = F.when(low.isNull(), F.lit(None).cast("string"))
    for name, words in ANALYSIS_KINDS:
        kind = kind.when(_any(low, words), F.lit(name))
    for name, words in SECTOR_WORDS:
        sector = sector.when(_any(low, words), F.lit(name))
    return questions.withColumns({"filing_types": F.when(low.isNotNull(), types), "kind": kind.otherwise("single"), "sector_focus": sector})


def _sql_any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


def _types_sql() -> str:
    parts = [f"case when {_sql_any(w)} then [{', '.join(repr(x) for x in n)}] else [] end" for w, n in TYPE_WORDS]
    return "array_to_string(flatten([" + ", ".join(parts) + "]), ',')"


@query("question_context", f"""with q as (select doc_id, lower(text) as low from documents where text is not null)
    select doc_id, coalesce(nullif({_types_sql()}, ''), '10-K,10-Q') as filing_types, array_to_string(flatten([{', '.join(f"case when contains(low, '{y}') then ['{y}'] else [] end" for y in YEARS)}]), ',') as years,
    case {' '.join(f"when {_sql_any(w)} then '{k}'" for k, w in KIND_WORDS)} else 'single' end as kind,
    len(list_filter(regexp_split_to_array(low, '[ \\t\\n\\r]+'), lambda w: length(w) > 3 and w not in ({', '.join(repr(w) for w in COMMON_WORDS)})))::int as keywords from q""")
def question_context(spark, folder):
    """Every document read as if it were a question."""
    found = read_questions(table(spark, folder, "documents").filter("text is not null").select("doc_id", "text"), "text")
    return found.select("doc_id", F.array_join("filing_types", ",").alias("filing_types"), F.array_join("years", ",").alias("years"), "kind", F.size("keywords").alias("keywords"))


_ANALYSIS_TYPES_SQL = "array_to_string(flatten([" + ", ".join(f"case when {_sql_any(w)} then [{', '.join(repr(x) for x in n)}] else [] end" for w, n in ANALYSIS_TYPE_WORDS) + "]), ',')"


@query("question_analysis", f"""with q as (select doc_id, lower(text) as low from documents)
    select doc_id, {_ANALYSIS_TYPES_SQL} as filing_types, case when low is null then null {' '.join(f"when {_sql_any(w)} then '{k}'" for k, w in ANALYSIS_KINDS)} else 'single' end as kind,
    case {' '.join(f"when {_sql_any(w)} then '{k}'" for k, w in SECTOR_WORDS)} end as sector_focus from q where low is not null""")
def question_analysis(spark, folder):
    """Every document read as if it were a question."""
    found = analyze_questions(table(spark, folder, "documents").filter("text is not null").select("doc_id", "text"), "text")
    return found.select("doc_id", F.array_join("filing_types", ",").alias("filing_types"), "kind", "sector_focus")


_PLAIN = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query("question_companies", f"""with d as (select doc_id, {_PLAIN.format('text')} as said from documents where text is not null), c as (select distinct ticker, run from (select ticker, {_PLAIN.format('name')} as run from company union all select ticker, {_PLAIN.format('ticker')} from company) where length(run) > 2)
    select distinct doc_id, ticker from d join c on contains(said, run) where ticker is not null""")
def question_companies_query(spark, folder):
    """The companies that every document names."""
    return question_companies(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "company").filter("ticker is not null"))
