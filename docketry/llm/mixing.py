"""Mixing sources to target weights under a cap on repetition, by temperature mixing.

Sizes are tokens. Of ``total`` tokens (by default all tokens of the sources, each document
once) a source should give its target share: its target weight's, or, without weights, its share
of the tokens to a power ``a`` that is bisected to a target entropy. Sources that cannot, even
with every document used ``max_repeats`` times, are short and give all they can. What they leave
open is shared among the others with tempered weights ``q_s(a) ~ p_s * (w_s / p_s) ** a`` where
p_s is the source's share of the tokens and w_s its target share: exponent 1 keeps the target's
proportions, exponent 0 the natural ones. The largest exponent within the repetition limits is
found by bisection; if not even exponent 0 is within them, the sources over their limit give all
they can and the rest is shared anew, until nothing is open or nobody has anything left.

The weights become documents by budgeted block permutations: a source is used in whole
rounds, and for the last part of a round its documents, permuted by hash into blocks of about
BLOCK_DOCUMENTS, are taken block by block up to the budget. The block in which the budget ends
is walked document by document, passing over those that no longer fit, so what is missing is
less than the smallest document left in it.

Defined cases: sources compare trimmed and lower-cased; null and other sources are not mixed;
a source without documents has 0 tokens; null texts have 0 tokens; several target rows of one
source: the largest weight counts; a null or negative weight is 0, a null cap is 1.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.byte_bpe import VOCABULARY, count_tokens
from docketry.session import spread

#: Documents of a block, about.
BLOCK_DOCUMENTS = 20_000
#: Most target sources; each is one row on the driver. More is an error.
MOST_SOURCES = 10_000


def clean_source(column: str):
    """Trimmed (white space of Unicode) and lower-cased."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def targets_table(targets: DataFrame) -> DataFrame:
    clean = targets.select(clean_source("source").alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
    return clean.filter("source is not null").groupBy("source").agg(F.max("w").alias("target_weight"), F.max_by("r", "w").alias("max_repeats"))


def document_sizes(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source is in the targets."""
    wanted = targets_table(targets).select("source")
    chosen = spread(documents.select("doc_id", clean_source("source").alias("source"), "text"), "doc_id").join(F.broadcast(wanted), "source", "left_semi")
    return count_tokens(chosen, ["doc_id", "source"], "text", vocabulary)


def source_totals(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry per target source: tokens, documents, target_weight and max_repeats."""
    tokens = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = targets_table(targets).join(tokens, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))})
    found = [r.asDict() for r in rows.limit(MOST_SOURCES + 1).collect()]
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    return sorted(found, key=lambda r: r["source"])


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def bisect(test, low: float, high: float, steps: int = 60) -> float:
    """The largest value in [low, high] for which ``test`` holds, if it holds at ``low``."""
    if test(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if test(middle) else (low, middle)
    return low


def temperature_shares(tokens: dict[str, int], target_entropy: float) -> dict[str, float]:
    """Shares ~ p ** a with the exponent bisected to the target entropy (a in [0, 1])."""
    total = sum(tokens.values())

    def at(a: float) -> dict[str, float]:
        raw = {s: (t / total) ** a for s, t in tokens.items() if t}
        z = sum(raw.values())
        return {s: x / z for s, x in raw.items()}

    return at(bisect(lambda a: entropy(list(at(a).values())) >= target_entropy, 0.0, 1.0)) if total else {}


def budgets(rows: list[dict], total: float) -> tuple[dict[str, int], set[str], float]:
    """(tokens to use of each source, sources that are short, exponent)."""
    cap = {r["source"]: r["tokens"] * r["max_repeats"] for r in rows}
    # Exponent 1: whoever cannot give its share there is short.
    short = {r["source"] for r in rows if cap[r["source"]] < r["target_share"] * total}
    use = {s: cap[s] if s in short else 0 for s in cap}
    rest = [r for r in rows if r["source"] not in short and r["tokens"] and r["target_share"] > 0]
    exponent = 1.0
    while rest:
        left = total - sum(use.values())
        if left <= 0:
            break
        own = sum(r["tokens"] for r in rest)

        def at(a: float) -> dict[str, float]:
            raw = {r["source"]: r["tokens"] / own * (r["target_share"] / (r["tokens"] / own)) ** a for r in rest}
            z = sum(raw.values())
            return {s: x / z * left for s, x in raw.items()}

        exponent = bisect(lambda a: all(x <= cap[s] for s, x in at(a).items()), 0.0, 1.0)
        share = at(exponent)
        over = {s for s, x in share.items() if x > cap[s]}
        use.update({s: min(int(share[s]), cap[s]) for s in (over or share)})
        rest = [r for r in rest if over and r["source"] not in over]
    return use, short, exponent


def plan(sizes: DataFrame, targets: DataFrame, total_share: float = 1.0, evenness: float | None = None) -> DataFrame:
    """One row per target source: its budget as whole rounds and a part of a round.

    ``total_share`` of all tokens is to be used in all. With ``evenness`` the target weights are
    set aside: the shares are tempered to that part of the largest possible entropy.
    """
    rows = source_totals(sizes, targets)
    total = total_share * sum(r["tokens"] for r in rows)
    weights = {r["source"]: r["target_weight"] for r in rows}
    if evenness is not None:
        tokens = {r["source"]: r["tokens"] for r in rows if r["tokens"]}
        weights = temperature_shares(tokens, evenness * math.log(max(len(tokens), 1)))
    weight = sum(weights.values())
    for r in rows:
        r["target_share"] = weights.get(r["source"], 0.0) / weight if weight else 0.0
    use, short, exponent = budgets(rows, total)
    planned = []
    for r in rows:
        budget = use[r["source"]]
        rounds = min(budget // r["tokens"], r["max_repeats"]) if r["tokens"] else 0
        part = budget - rounds * r["tokens"] if rounds < r["max_repeats"] else 0
        planned.append((r["source"], float(r["target_share"]), int(r["tokens"]), int(r["documents"]), int(budget), int(rounds), int(part), int(r["max_repeats"]), r["source"] in short, float(exponent)))
    return sizes.sparkSession.createDataFrame(planned, "source string, target_share double, tokens bigint, documents bigint, budget bigint, rounds bigint, part bigint, max_repeats int, short boolean, exponent double")


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """The documents of an ending block in their order, each taken if it still fits."""
    block = block.sort_values(["__h", "doc_id"], kind="stable")
    room, taken = int(block["__room"].iloc[0]), []
    for size in block["tokens"].tolist():
        fits = 0 < room and size <= room
        room -= size if fits else 0
        taken.append(fits)
    return block.assign(__extra=[int(t) for t in taken])[["doc_id", "source", "tokens", "rounds", "__extra"]]


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, uses) of every document used. ``sizes`` is read more than once; cut it first."""
    order = F.xxhash64("doc_id", F.lit(seed))
    blocks = F.ceil(F.greatest(F.col("documents"), F.lit(1)) / BLOCK_DOCUMENTS)
    placed = sizes.withColumn("__h", order).join(F.broadcast(plan.select("source", "rounds", "part", blocks.alias("__blocks"))), "source")
    placed = placed.withColumn("__block", F.pmod(F.shiftright("__h", 20), F.col("__blocks"))).drop("__blocks")
    totals = placed.groupBy("source", "__block").agg(F.sum("tokens").alias("__size"), F.first("part").alias("__part"))
    upto = F.sum("__size").over(Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0))
    # One row a source: the block in which its budget ends, and what is left for it there.
    ends = totals.withColumn("__end", upto).filter(F.col("__end") > F.col("__part")).groupBy("source").agg(F.min(F.struct("__block", (F.col("__part") - F.col("__end") + F.col("__size")).alias("__room"))).alias("__e"))
    ends = ends.select("source", F.col("__e.__block").alias("__last"), F.col("__e.__room").alias("__room"))
    placed = placed.join(F.broadcast(ends), "source", "left")
    # A block has about BLOCK_DOCUMENTS documents, whatever the size of its source.
    ending = placed.filter((F.col("__block") == F.col("__last")) & (F.col("part") > 0)).select("doc_id", "source", "tokens", "rounds", "__h", "__room")
    first = ending.groupBy("source").applyInPandas(_fill, f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, source string, tokens {sizes.schema['tokens'].dataType.simpleString()}, rounds long, __extra int")
    others = placed.filter(F.col("__last").isNull() | (F.col("__block") != F.col("__last")) | (F.col("part") <= 0))
    others = others.withColumn("__extra", ((F.col("part") > 0) & F.coalesce(F.col("__block") < F.col("__last"), F.lit(True))).cast("int"))
    columns = ["doc_id", "source", "tokens", "rounds", "__extra"]
    return first.unionByName(others.select(columns)).select("doc_id", "source", "tokens", (F.col("rounds") + F.col("__extra")).cast("int").alias("uses")).filter("uses > 0")


def reached_shares(uses: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and reached share of every source, with tokens, rounds and the cap."""
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    rows = plan.join(got, "source", "left").withColumns({"used_tokens": F.coalesce("used_tokens", F.lit(0)), "most_uses": F.coalesce("most_uses", F.lit(0))})
    every = rows.agg(F.sum("used_tokens").alias("__all"))
    return rows.crossJoin(F.broadcast(every)).select("source", "target_share", F.coalesce(F.try_divide(F.col("used_tokens"), F.col("__all")), F.lit(0.0)).alias("reached_share"), "tokens", "budget", "used_tokens", "most_uses", "max_repeats", "short", "exponent")
