"""The engine: one object that answers searches and questions over a folder of tables.

Every method returns a DataFrame or collects a bounded result (at most ``k`` rows). Filters
come before scores and limits. Plans of searches are kept, so asking again costs no analysis.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import snippet, tokens_of_length
from docketry.functions.vectors import cosine
from docketry.operators import facts, graph, insider, ranking, retrieval
from docketry.operators import terms as text_terms
from docketry.plans.questions import SECTOR_COMPANIES, SECTOR_WORDS, Question, named_in, read_question
from docketry.sources.feeds import decompress
from docketry.tables import table

#: Most companies that a question may name; more is an error.
MOST_NAMED = 1000
NOTHING = "No relevant sections were found for this question."


def extractive_answer(question: Question, rows: list) -> str:
    """The default answer: the best snippets with their sources."""
    return "\n".join(f"[{i}] {r['ticker']} {r['filing_type']} {r['filing_date']}: {r['snippet']}" for i, r in enumerate(rows, 1))


class Engine:
    def __init__(self, spark: SparkSession, folder: str, answer: Callable[[Question, list], str] = extractive_answer) -> None:
        self.spark, self.folder, self.answer = spark, folder, answer
        self.history: list[dict] = []
        self._log: list[tuple[float, bool]] = []
        self._plans: dict[tuple, DataFrame] = {}

    @cached_property
    def companies(self) -> DataFrame:
        return graph.companies(table(self.spark, self.folder, "company"))

    @cached_property
    def filings(self) -> DataFrame:
        return graph.filings(table(self.spark, self.folder, "filing"), self.companies)

    @cached_property
    def sections(self) -> DataFrame:
        rows = graph.latest_rows(table(self.spark, self.folder, "filing_section"), "section_id", ["created_at"], "load_id").select("section_id", "filing_id", "section_type", "content", "embedding_compressed")
        filed = self.filings.join(self.companies.select("ticker", F.col("name").alias("company_name")), "ticker")
        return rows.join(filed, "filing_id")

    def _filtered(self, tickers, filing_types, dates, section_types) -> DataFrame:
        rows = self.sections.filter(retrieval.in_list("ticker", tickers) & retrieval.in_list("filing_type", filing_types))
        if dates:
            rows = rows.filter(F.col("filing_date").between(*dates))
        return rows.filter(retrieval.in_list(F.lower("section_type"), [t.lower() for t in section_types])) if section_types else rows

    def search(self, text: str | None = None, vector: list[float] | None = None, tickers=None, filing_types=None, dates=None, section_types=None, mode: str = "hybrid", k: int = 10, least: float | None = None) -> DataFrame:
        """Sections by vector, by text or by both, best first, at most ``k``."""
        if mode not in ("semantic", "text", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        key = (text, tuple(vector or ()), *(tuple(x or ()) for x in (tickers, filing_types, dates, section_types)), mode, k, least)
        if key not in self._plans:
            self._plans[key] = self._search(text, vector, tickers, filing_types, dates, section_types, mode, k, least)
        return self._plans[key]

    def _search(self, text, vector, tickers, filing_types, dates, section_types, mode, k, least) -> DataFrame:
        rows = self._filtered(tickers, filing_types, dates, section_types)
        found = []
        if mode != "text" and vector:
            q = F.array(*(F.lit(float(x)) for x in vector))
            scored = rows.filter("embedding_compressed is not null").withColumn("v", decompress("embedding_compressed")).filter(F.size("v") == len(vector))
            scored = scored.select("section_id", cosine(F.col("v"), q).alias("score"))
            found.append(scored.filter(F.col("score") > least) if least is not None else scored)
        if mode != "semantic" and text and text.strip():
            words = text_terms.widened(text_terms.query_words(text))
            found.append(text_terms.bm25_search(rows, "section_id", "content", words).select("section_id", "score"))
        if not found:
            return rows.limit(0).select("section_id", "ticker", "filing_type", "filing_date", "section_type", F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
        best = found[0] if len(found) == 1 else retrieval.hybrid(found[0], found[1], "section_id")
        top = best.orderBy(F.desc("score"), "section_id").limit(k)
        return rows.join(F.broadcast(top.select("section_id", "score")), "section_id").select("section_id", "ticker", "filing_type", "filing_date", "section_type", F.round("score", 6).alias("score"), snippet(F.col("content")).alias("snippet")).orderBy(F.desc("score"), "section_id")

    def similar(self, section_id: str, k: int = 5) -> DataFrame:
        """The nearest other sections of one section."""
        one = self.sections.filter(F.col("section_id") == section_id).select(decompress("embedding_compressed").alias("q")).limit(1)
        others = self.sections.filter(F.col("section_id") != section_id).select("section_id", "ticker", decompress("embedding_compressed").alias("v")).filter("v is not null")
        return retrieval.vector_search(others, one, "v", "section_id", k=k).drop("v")

    def concepts(self, wanted: list[str], k: int = 50) -> DataFrame:
        return facts.concept_search(table(self.spark, self.folder, "xbrl_fact"), table(self.spark, self.folder, "filing"), wanted, k)

    def insider(self, tickers=None, executives=None, kinds=None, dates=None, least_shares: float = 0, k: int = 50) -> DataFrame:
        rows = table(self.spark, self.folder, "insider_transaction").withColumn("transaction_type", insider.transaction_name(F.col("transaction_type")))
        rows = rows.filter(retrieval.in_list("company_ticker", tickers) & retrieval.in_list("executive_name", executives) & retrieval.in_list("transaction_type", kinds))
        rows = rows.filter(F.col("filing_date").between(*dates)) if dates else rows
        rows = rows.filter(F.abs("shares") >= least_shares) if least_shares else rows
        return rows.withColumn("value", F.col("shares") * F.col("price")).orderBy(F.desc("filing_date"), "transaction_id").limit(k)

    def stats(self) -> DataFrame:
        return graph.system_stats(self.spark, self.folder)

    def context(self, found: DataFrame, budget: int = 12_000) -> DataFrame:
        """The best rows whose snippets fit the token budget together."""
        return ranking.within_budget(found, [], [F.desc("score"), "section_id"], tokens_of_length(F.length("snippet")), budget)

    def read(self, text: str) -> Question:
        """The question with the companies it names; the names stay in their table."""
        named = named_in(text, self.companies).orderBy("ticker").limit(MOST_NAMED + 1).collect()
        if len(named) > MOST_NAMED:
            raise ValueError(f"the question names more than {MOST_NAMED} companies")
        return read_question(text, [r["ticker"] for r in named])

    def sector_tickers(self, text: str) -> list[str]:
        """The first tickers of the sector that has a word of its own in the question; none without one."""
        said = f" {re.sub(r'[^a-z0-9]+', ' ', text.lower())} "
        focus = next((sector for sector, words in SECTOR_WORDS if any(f" {w} " in said for w in words)), None)
        if focus is None:
            return []
        return [r["ticker"] for r in self.companies.filter(F.lower("sector") == focus).select("ticker").orderBy("ticker").limit(SECTOR_COMPANIES).collect()]

    def ask(self, text: str, k: int = 20) -> dict:
        """Read the question, search, answer from at most ``k`` rows and remember."""
        began = time.perf_counter()
        question = self.read(text)
        tickers = question.tickers or self.sector_tickers(text)
        found = self.search(text, tickers=tickers or None, filing_types=question.filing_types, mode="text", k=k).collect()
        answer = self.answer(question, found) if found else NOTHING
        result = {
            "question": question, "answer": answer, "sources": [r["section_id"] for r in found],
            "companies": sorted({r["ticker"] for r in found if r["ticker"]}), "types": sorted({r["filing_type"] for r in found if r["filing_type"]}),
        }
        self._log.append((time.perf_counter() - began, bool(found)))
        if found:
            self.history.append(result)
        return result

    def usage(self) -> dict[str, float]:
        """Questions asked so far, answered and not, total and average seconds."""
        n, seconds, ok = len(self._log), sum(s for s, _ in self._log), sum(ok for _, ok in self._log)
        return {"queries": n, "ok": ok, "failed": n - ok, "seconds": seconds, "average": seconds / n if n else 0.0}

    def sql(self, text: str, **values) -> DataFrame:
        """A parameterised statement over the tables of the model."""
        for name in ("companies", "filings", "sections"):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=values)

    def company(self, ticker: str) -> dict | None:
        row = self.companies.filter(F.col("ticker") == ticker).first()
        return row.asDict() if row else None

    def health(self) -> dict[str, bool]:
        """Which tables can be read."""
        out = {}
        for name in ("company", "filing", "filing_section", "xbrl_fact", "insider_transaction"):
            try:
                out[name] = bool(table(self.spark, self.folder, name).columns)
            except Exception:  # a missing table is a finding, not an error
                out[name] = False
        return out

    def report(self, questions: list[str], k: int = 5) -> tuple[DataFrame, str]:
        """Ask all questions; one row each and a text with the averages."""
        found = [(q, self.ask(q, k)) for q in questions]
        rows = [(q, bool(r["sources"]), len(r["question"].tickers), len(r["sources"])) for q, r in found]
        df = self.spark.createDataFrame(rows, "question string, answered boolean, companies int, sources int")
        total = df.agg(F.count_if("answered").alias("answered"), F.coalesce(F.avg("companies"), F.lit(0.0)).alias("companies"), F.coalesce(F.avg("sources"), F.lit(0.0)).alias("sources")).first()
        lines = [f"# Evaluation\n\n{total['answered']} of {len(rows)} questions answered; on average {total['companies']:.1f} companies and {total['sources']:.1f} sources.\n"]
        lines += [f"## {q}\n\n{r['answer']}\n" for q, r in found]
        return df, "\n".join(lines)
