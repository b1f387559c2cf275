"""Text functions as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketry.functions.fixed import STOP_WORDS

def plain_ascii(text: Column) -> Column:
    """Lower-cased, everything but ASCII letters, digits and white space replaced by spaces."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")


def terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words of ASCII letters and digits, longer than two, without stop words."""
    plain = plain_ascii(text)
    # IN over literals becomes a hash look-up; array_contains would walk the list per word.
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(F.split(plain, r"[\s]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def with_bigrams(words: Column) -> Column:
    """Words followed by pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def tokens_of_length(chars: Column) -> Column:
    """Rough token count: a quarter of the characters, rounded down."""
    return F.floor(chars / 4).cast("bigint")


def at_least_one_token(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), tokens_of_length(chars))


def snippet(text: Column, chars: int = 200) -> Column:
    """The first characters, with ``...`` only if there are more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def is_good_content(text: Column) -> Column:
    """At least 10 words, 30 % of them distinct, and half of the characters letters."""
    w = words(F.lower(text))
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return (F.size(w) >= 10) & (F.size(F.array_distinct(w)) * 10 >= F.size(w) * 3) & (letters * 2 >= F.length(text))


#: What is replaced by a space when a raw document is cleaned, in this order.
CLEANING = [r"(?is)<(script|style)\b.*?</\1\s*>", r"<[^>]+>", r"&[A-Za-z]+;|&#[0-9]+;", r"[ \t\r\n]+", r"[-_=]{4,}"]


def strip(text: Column) -> Column:
    """Without space characters of Unicode at both ends."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


def clean(text: Column) -> Column:
    """Markup, entities and runs of white space or rules replaced by single spaces, trimmed."""
    for pattern in CLEANING:
        text = F.regexp_replace(text, pattern, " ")
    return strip(F.regexp_replace(text, " +", " "))


#: Noise of documents, each replaced by a space, in this order.
NOISE = [r"<[^>]+>", r"&[a-zA-Z]+;", r"\s+", r"\n\s*\n\s*\n+", r"Table\s+of\s+Contents.*?(?=Item\s+\d)", r"Page\s+\d+\s+of\s+\d+", r"\*{3,}", r"-{3,}", r"_{3,}"]


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_document(text: Column, least: int = 10) -> Column:
    """Entities read, noise replaced, white space single; empty if no more than ``least`` characters are left."""
    plain = F.when(text.contains("&"), _unescaped(text)).otherwise(text)
    for pattern in [*NOISE, r"\s+"]:
        plain = F.regexp_replace(plain, "(?imU)" + pattern, " ")
    plain = F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(plain) > least, plain).when(plain.isNotNull(), F.lit(""))


def compact(text: Column) -> Column:
    """Runs of dots and dashes shortened to three, runs of white space to one space."""
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    text = F.regexp_replace(text, r"\.{3,}", "...")
    text = F.regexp_replace(text, r"-{3,}", "---")
    return strip(F.regexp_replace(text, "(?i)table of contents", ""))


def truncated(text: Column, most_bytes: int) -> Column:
    """Texts of more than ``most_bytes`` UTF-8 bytes cut to that many characters."""
    return F.when(F.octet_length(text) > most_bytes, F.substring(text, 1, most_bytes)).otherwise(text)
