"""Functions over structured financial facts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.fixed import CONCEPT_CATEGORIES

CATEGORIES = list(CONCEPT_CATEGORIES.items())
#: Prefixes of taxonomies.
PREFIXES = ["us-gaap:", "dei:", "ifrs-full:", "srt:"]


def category(concept: Column) -> Column:
    name = F.lower(concept)
    out = F.when(concept.isNull(), F.lit(None).cast("string"))
    for label, keys in CATEGORIES:
        hit = F.lit(False)
        for k in keys:
            hit = hit | name.contains(k)
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit("other"))


def bare_concept(concept: Column) -> Column:
    """Without the taxonomy's prefix, whatever its case."""
    return F.regexp_replace(concept, "(?i)^(?:" + "|".join(PREFIXES) + ")", "")


def scaled(value: Column) -> Column:
    """Sign times a tenth of log10 of the size for sizes from 1; smaller values as they are; null is 0."""
    v = F.coalesce(value, F.lit(0.0))
    return F.when(F.abs(v) >= 1, F.signum(v) * F.log10(F.abs(v)) / 10).otherwise(v)


def figure_text(text: Column) -> Column:
    """A number written with commas, dollar signs or brackets for negatives; null if it is none."""
    plain = F.trim(F.regexp_replace(text, "[,$]", ""))
    return F.regexp_replace(plain, r"^\((.*)\)$", "-$1").try_cast("double")


def period_kind(period: Column) -> Column:
    return F.when(period.isNull(), F.lit(None).cast("string")).when(period.contains("/"), "duration").otherwise("instant")


def period_start(period: Column) -> Column:
    return F.when(period.contains("/"), F.substring(F.split_part(period, F.lit("/"), F.lit(1)), 1, 10))


def period_end(period: Column) -> Column:
    return F.substring(F.when(period.contains("/"), F.split_part(period, F.lit("/"), F.lit(2))).otherwise(period), 1, 10)


def period_code(end: Column) -> Column:
    """Twelve month slots and the year as (year - 2000) / 50; zeros where there is no date."""
    date = F.try_to_date(end, "yyyy-MM-dd")
    months = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.when(m == F.month(date), 1.0).otherwise(0.0))
    return F.concat(months, F.array(F.coalesce((F.year(date) - 2000) / 50.0, F.lit(0.0))))


#: Pairs of letters that are counted, and words that show a taxonomy.
BIGRAMS = ["in", "on", "er", "an", "re", "ed", "nd", "ou", "ea", "ti"]
TAXONOMIES = ["gaap", "dei", "us", "ifrs", "sec"]


def name_code(concept: Column) -> Column:
    """Length over 100 (at most 1), the share of each letter among the letters, a fifth of the
    number of each common pair of letters (at most 1) and the taxonomies named."""
    name = F.lower(F.coalesce(concept, F.lit("")))
    letters = F.greatest(F.length(F.regexp_replace(name, r"\P{L}", "")), F.lit(1))
    count = lambda part: (F.length(name) - F.length(F.replace(name, F.lit(part), F.lit("")))) / len(part)
    return F.array(
        F.least(F.length(name) / 100.0, F.lit(1.0)), *(count(chr(97 + i)) / letters for i in range(26)),
        *(F.least(count(pair) / 5.0, F.lit(1.0)) for pair in BIGRAMS), *(F.when(name.contains(t), 1.0).otherwise(0.0) for t in TAXONOMIES),
    )


def unit_slot(unit: Column) -> Column:
    """One of ten places for a unit, by a hash of its name; no unit is US dollars."""
    digest = F.md5(F.lower(F.when(F.length(unit) > 0, unit).otherwise("usd")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 20 % 10).cast("int")


def _zeros(n: int) -> Column:
    return F.array(*([F.lit(0.0)] * n))


#: Length of a fact vector.
WIDTH = 100


def fact_vector(concept: Column, value: Column, period: Column, unit: Column | None = None) -> Column:
    """A fact as 100 numbers: categories from place 0 (other as the first), decaying values from 10,
    a half at the unit's place from 20, period code from 35, name code from 50, zeros elsewhere."""
    names = [label for label, _ in CATEGORIES]
    kind = category(bare_concept(concept))
    slots = F.array(*(F.when((kind == n) | ((kind == "other") if i == 0 else F.lit(False)), 1.0).otherwise(0.0) for i, n in enumerate(names)))
    size = F.array(*(scaled(value) * (0.8**i) for i in range(5)))
    place = unit_slot(F.lit(None).cast("string") if unit is None else unit)
    units = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == place, 0.5).otherwise(0.0))
    parts = [slots, _zeros(10 - len(names)), size, _zeros(5), units, _zeros(5), period_code(period_end(period)), _zeros(2), name_code(concept), _zeros(8)]
    return F.when(concept.isNotNull(), F.concat(*parts))


KEYWORDS = list(dict.fromkeys(k for _, keys in CATEGORIES for k in keys))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, not at every place where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_concepts(text: Column) -> Column:
    """The known keywords within a text, in their fixed order."""
    return _with(F.lower(text), lambda low: F.filter(F.array(*(F.lit(k) for k in KEYWORDS)), lambda k: low.contains(k)))


def category_ratios(text: Column) -> dict[str, Column]:
    """The share of each category's keywords that a text contains."""
    low = F.lower(text)
    out = {}
    for label, keys in CATEGORIES:
        hits = F.lit(0)
        for k in keys:
            hits = hits + F.when(low.contains(k), 1).otherwise(0)
        out[label] = hits / float(len(keys))
    return out


def keyword_vector(keyword: str) -> list[float]:
    """The fact vector of a keyword with value 1, no date and no unit, as a constant."""
    label = next(name for name, keys in CATEGORIES if any(k in keyword for k in keys))
    out = [0.0] * WIDTH
    out[[name for name, _ in CATEGORIES].index(label)] = 1.0
    out[20 + int(hashlib.md5(b"usd").hexdigest()[:8], 16) % 20 % 10] = 0.5
    letters = max(sum(c.isalpha() for c in keyword), 1)
    code = [min(len(keyword) / 100.0, 1.0), *(keyword.count(chr(97 + i)) / letters for i in range(26)), *(min(keyword.count(p) / 5.0, 1.0) for p in BIGRAMS), *(1.0 if t in keyword else 0.0 for t in TAXONOMIES)]
    out[50 : 50 + len(code)] = code
    return out


def text_vector(text: Column) -> Column:
    """The mean of the vectors of the concepts named in a text, each with value 1 and no date;
    without any, the category ratios and the length over 1000 (at most 1), padded with zeros."""
    known = F.create_map(*(c for k in KEYWORDS for c in (F.lit(k), F.array(*map(F.lit, keyword_vector(k))))))
    zeros = F.array_repeat(F.lit(0.0), WIDTH)

    def mean(found: Column) -> Column:
        total = F.aggregate(found, zeros, lambda acc, k: F.zip_with(acc, F.element_at(known, k), lambda a, b: a + b))
        return F.when(F.size(found) > 0, _with(F.size(found), lambda n: F.transform(total, lambda x: x / n)))

    plain = F.concat(F.array(*category_ratios(text).values(), F.least(F.length(text) / 1000.0, F.lit(1.0))), F.array_repeat(F.lit(0.0), WIDTH - len(CATEGORIES) - 1))
    return F.when(text.isNotNull(), F.coalesce(_with(text_concepts(text), mean), plain))
