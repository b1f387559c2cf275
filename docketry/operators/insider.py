"""Insider transactions: cleaning, forms as XML and as text, and activity summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.fixed import TITLES, TRANSACTION_CODES
from docketry.operators.skew import clean_key
from docketry.registry import query
from docketry.tables import table

BUYS = ["Purchase", "Award/Grant"]
SELLS = ["Sale", "Disposition"]
MONEY = "decimal(38,2)"


def iso_date(text: Column) -> Column:
    """A date written Y-m-d or m/d/Y, with or without leading zeros; null if it is none."""
    return F.coalesce(F.try_to_date(text, "yyyy-M-d"), F.try_to_date(text, "M/d/yyyy"))


def transaction_name(code: Column) -> Column:
    """The name of an upper-case code; anything else stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in TRANSACTION_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def standard_title(title: Column) -> Column:
    """By the whole title, else by the first known title within it, else as it is."""
    low = F.lower(F.trim(title))
    out = F.when(title.isNull(), F.lit(None).cast("string"))
    for short, long in TITLES.items():
        out = out.when(low == short, F.lit(long))
    for short, long in TITLES.items():
        out = out.when(low.contains(short), F.lit(long))
    return out.otherwise(title)


def is_valid(name: Column, ticker: Column, date: Column, shares: Column, price: Column) -> Column:
    """Name and ticker given, a Y-m-d date, shares within 0 to 1e8 and price within 0 to 1e4."""
    given = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(ticker, F.lit("")) != "")
    dated = F.try_to_date(date, "yyyy-M-d").isNotNull()
    return given & dated & F.coalesce(shares.between(0, 1e8) & price.between(0, 1e4), F.lit(False))


def trades(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Valid transactions of known companies, as they are appended; executives are keyed by name."""
    c = F.col
    chosen = rows.filter(is_valid(c("executive_name"), c("company_ticker"), c("transaction_date"), c("shares"), c("price")))
    chosen = chosen.join(known.select(c("ticker").alias("company_ticker")).distinct(), "company_ticker", "left_semi")
    return chosen.select("transaction_id", "executive_name", "company_ticker", iso_date(c("transaction_date")).alias("traded"), transaction_name(c("transaction_type")).alias("transaction_type"), "shares", "price", "accession_number")


def value_of(shares: Column, price: Column) -> Column:
    return F.round(shares * price, 2).cast(MONEY)


def by_executive(rows: DataFrame) -> DataFrame:
    kind = transaction_name(F.col("transaction_type"))
    return rows.filter("executive_name is not null").groupBy("executive_name").agg(
        F.count("*").alias("transactions"), F.sum(F.abs("shares").cast(MONEY)).alias("shares"), F.sum(F.abs(value_of(F.col("shares"), F.col("price")))).alias("value"),
        F.count_if(kind.isin(*BUYS)).alias("purchases"), F.count_if(kind.isin(*SELLS)).alias("sales"),
    )


def by_company(rows: DataFrame) -> DataFrame:
    """Per company (cleaned ticker): bought shares count for, sold ones against the net."""
    kind = transaction_name(F.col("transaction_type"))
    signed = F.when(kind.isin(*BUYS), F.col("shares")).when(kind.isin(*SELLS), -F.col("shares")).otherwise(F.lit(0.0))
    return rows.withColumn("ticker", clean_key("company_ticker")).filter("ticker is not null").groupBy("ticker").agg(
        F.count("*").alias("transactions"), F.countDistinct("executive_name").alias("executives"), F.sum(value_of(F.col("shares"), F.col("price"))).alias("value"),
        F.sum(signed.cast(MONEY)).alias("net_shares"), F.max("filing_date").alias("last_filed"),
    )


# ---- forms as XML

#: In this order, wherever they stand in the form.
XML_PATHS = ["nonDerivativeTransaction", "derivativeTransaction", "transaction"]
_XML_FIELDS = ["executive_name", "executive_title", "company_ticker", "transaction_date", "shares", "price", "code"]


_XML_ROWS = "array<struct<part:int,place:int," + ",".join(f"{f}:string" for f in _XML_FIELDS) + ">>"


def _xml_rows(content):
    """The texts of every transaction element, each read within its element; None if malformed."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(content.strip())
    except ElementTree.ParseError:
        return None

    def text(element, name: str) -> str:
        found = None if element is None else next((e for e in element.iter(name) if e is not element), None)
        if found is None:
            return ""
        value = found.find("value")
        return (found if value is None else value).text or ""

    owner, issuer = next(root.iter("reportingOwner"), None), next(root.iter("issuer"), None)
    form = (text(owner, "rptOwnerName"), text(owner, "officerTitle"), text(issuer, "issuerTradingSymbol"))
    fields = ["transactionDate", "transactionShares", "transactionPricePerShare", "transactionCode"]
    return [
        (part, place, *form, *(text(element, f) for f in fields))
        for part, path in enumerate(XML_PATHS) for place, element in enumerate(root.iter(path), 1)
    ]


def xml_transactions(forms: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Transactions of ownership forms in XML, one row each, non-derivative ones first.

    The first owner and the first issuer count. A field is its ``value`` child or itself, within
    its own transaction; missing figures are 0, missing texts empty, an unreadable figure drops
    the row. Malformed forms are read as plain text (part 3). Forms that are no ownership
    documents give no rows.
    """
    xml = forms.filter(is_xml(content)).withColumn("__t", F.udf(_xml_rows, _XML_ROWS, useArrow=True)(F.col(content)))
    each = xml.filter("__t is not null").select(*keep, F.inline("__t"))
    figure = lambda c: F.when(F.col(c) == "", F.lit(0.0)).otherwise(F.col(c).try_cast("double")).alias(c)
    read = each.select(
        *keep, "part", "place", F.trim("executive_name").alias("executive_name"), standard_title(F.trim("executive_title")).alias("executive_title"),
        F.upper(F.trim("company_ticker")).alias("company_ticker"), "transaction_date", figure("shares"), figure("price"), transaction_name(F.col("code")).alias("transaction_type"),
    )
    parties = ["executive_name", "executive_title", "company_ticker"]
    named = text_parties(xml.filter("__t is null").withColumn("__content", F.col(content)), "__content", [*keep, "__content"])
    plain = text_transactions(named, "__content", [*keep, *parties]).select(
        *keep, F.lit(3).alias("part"), "place", *parties, F.coalesce(F.col("transaction_date").cast("string"), F.lit("")).alias("transaction_date"), "shares", "price", "transaction_type",
    )
    return read.unionByName(plain).filter("shares is not null and price is not null")


def form_type(text: Column) -> Column:
    """Form 3 before 4 before 5, whatever the case; 4 if none is named."""
    up = F.upper(text)
    return F.when(up.contains("FORM 3"), "3").when(up.contains("FORM 4"), "4").when(up.contains("FORM 5"), "5").otherwise("4")


#: Fixed value: a transaction line has a date, a code, shares and a price, in this order.
LINE = r"(?i)(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}).*?([PSAGFMXDBCEIHJKLOUV]).*?([\d,]+(?:\.\d+)?).*?(\$?[\d,]+(?:\.\d+)?)"


def text_transactions(forms: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Transactions of forms in plain text: every match of LINE, in order."""
    groups = [F.regexp_extract_all(content, F.lit(LINE), F.lit(i)) for i in range(1, 5)]
    each = forms.select(*keep, F.posexplode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ["d", "c", "s", "p"])))).alias("place", "t"))
    plain = lambda c: F.regexp_replace(c, "[,$]", "").try_cast("double")
    return each.select(*keep, (F.col("place") + 1).alias("place"), iso_date(F.col("t.d")).alias("transaction_date"), transaction_name(F.col("t.c")).alias("transaction_type"), plain(F.col("t.s")).alias("shares"), plain(F.col("t.p")).alias("price"))


def as_xml(rows: DataFrame) -> DataFrame:
    """(transaction_id, content): flat rows written as ownership documents."""
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return rows.select("transaction_id", F.concat(
        F.lit("<ownershipDocument><issuer><issuerTradingSymbol>"), safe("company_ticker"), F.lit("</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>"), safe("executive_name"),
        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><officerTitle>"), safe("executive_title"), F.lit("</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTransaction><transactionDate><value>"),
        safe("transaction_date"), F.lit("</value></transactionDate><transactionCoding><transactionCode>"), safe("transaction_type"), F.lit("</transactionCode></transactionCoding><transactionShares><value>"),
        safe("shares"), F.lit("</value></transactionShares><transactionPricePerShare>"), safe("price"), F.lit("</transactionPricePerShare></nonDerivativeTransaction></ownershipDocument>"),
    ).alias("content"))


def as_filings(rows: DataFrame) -> DataFrame:
    """(accession_number, content): all rows of a filing in one ownership document, options among
    the derivative ones, in order of their ids. Null fields are left out, so are prices of gifts;
    owner and issuer are those of the first row."""
    safe = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def element(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"<{name}><value>"), value, F.lit(f"</value></{name}>")), F.lit(""))

    kind = F.when(F.col("security_type") == "Option", "derivativeTransaction").otherwise("nonDerivativeTransaction")
    priced = F.when(F.coalesce(F.col("transaction_type"), F.lit("")) != "Gift", safe("price"))
    body = F.concat(
        F.lit("<"), kind, F.lit(">"), element("transactionDate", safe("transaction_date")), element("transactionShares", safe("shares")),
        element("transactionPricePerShare", priced), element("transactionCode", safe("transaction_type")), F.lit("</"), kind, F.lit(">"),
    )
    head = F.concat(
        F.lit("<ownershipDocument><issuer>"), element("issuerTradingSymbol", safe("company_ticker")), F.lit("</issuer><reportingOwner>"),
        element("rptOwnerName", safe("executive_name")), element("officerTitle", safe("executive_title")), F.lit("</reportingOwner>"),
    )
    listed = F.array_sort(F.collect_list(F.struct("transaction_id", body.alias("body"), head.alias("head"))))
    forms = rows.filter("accession_number is not null").groupBy("accession_number").agg(listed.alias("listed"))
    return forms.select("accession_number", F.concat(F.col("listed")[0]["head"], F.array_join("listed.body", ""), F.lit("</ownershipDocument>")).alias("content"))


def as_texts(rows: DataFrame) -> DataFrame:
    """(accession_number, content): all rows of a filing in one form in plain text, in order of their
    ids; figures as plain decimals, owner and issuer those of the first row."""
    plain = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("decimal(38,4)").cast("string"), r"\.?0+$", ""), F.lit(""))
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat_ws(" ", given("transaction_date"), given("transaction_type"), plain("shares"), F.concat(F.lit("$"), plain("price")))
    head = F.concat(F.lit("FORM 4\nReporting person: "), given("executive_name"), F.lit("\nTitle: "), given("executive_title"), F.lit("\nTrading symbol: "), given("company_ticker"), F.lit(" \n"))
    listed = F.array_sort(F.collect_list(F.struct("transaction_id", line.alias("line"), head.alias("head"))))
    forms = rows.filter("accession_number is not null").groupBy("accession_number").agg(listed.alias("listed"))
    return forms.select("accession_number", F.concat(F.col("listed")[0]["head"], F.array_join("listed.line", "\n"), F.lit("\n")).alias("content"))


# ---- SQL twins

_NAME = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in TRANSACTION_CODES.items()) + " else {0} end"
_KIND = _NAME.format("transaction_type")
_TITLE = "case when {0} is null then null " + " ".join(f"when lower(trim({{0}})) = '{k}' then '{v}'" for k, v in TITLES.items()) + " " + " ".join(f"when contains(lower(trim({{0}})), '{k}') then '{v}'" for k, v in TITLES.items()) + " else {0} end"
_DATE = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%m/%d/%Y'))::date"
_VALUE = "round(shares * price, 2)::decimal(38,2)"
_BUY, _SELL = "('Purchase', 'Award/Grant')", "('Sale', 'Disposition')"


def _rows(spark, folder):
    return table(spark, folder, "insider_transaction")


@query("insider_search", f"""select transaction_id, executive_name, company_ticker, {_KIND} as transaction_type, shares, price, round(shares * price, 2) as value from insider_transaction
    where {_KIND} in ('Purchase', 'Sale') and filing_date between date '2020-01-01' and date '2024-12-31' and abs(shares) >= 1000 order by filing_date desc, transaction_id limit 50""")
def insider_search(spark, folder):
    kind = transaction_name(F.col("transaction_type"))
    rows = _rows(spark, folder).withColumn("transaction_type", kind).filter(F.col("transaction_type").isin("Purchase", "Sale") & F.col("filing_date").between("2020-01-01", "2024-12-31") & (F.abs("shares") >= 1000))
    return rows.orderBy(F.desc("filing_date"), "transaction_id").limit(50).select("transaction_id", "executive_name", "company_ticker", "transaction_type", "shares", "price", F.round(F.col("shares") * F.col("price"), 2).alias("value"))


@query("insider_by_executive", f"""select executive_name, count(*) as transactions, sum(abs(shares)::decimal(38,2)) as shares, sum(abs({_VALUE})) as value,
    count(*) filter ({_KIND} in {_BUY}) as purchases, count(*) filter ({_KIND} in {_SELL}) as sales from insider_transaction where executive_name is not null group by 1""")
def insider_by_executive(spark, folder):
    return by_executive(_rows(spark, folder))


@query("insider_top_executives", f"""select executive_name, count(*) as transactions, sum(abs({_VALUE})) as value from insider_transaction where executive_name is not null group by 1 having value is not null order by value desc, executive_name limit 5""")
def insider_top_executives(spark, folder):
    return by_executive(_rows(spark, folder)).filter("value is not null").orderBy(F.desc("value"), "executive_name").limit(5).select("executive_name", "transactions", "value")


@query("insider_by_company", f"""select upper(regexp_replace(company_ticker, '[\\s-]', '', 'g')) as ticker, count(*) as transactions, count(distinct executive_name) as executives, sum({_VALUE}) as value,
    sum((case when {_KIND} in {_BUY} then shares when {_KIND} in {_SELL} then -shares else 0 end)::decimal(38,2)) as net_shares, max(filing_date) as last_filed
    from insider_transaction where nullif(regexp_replace(company_ticker, '[\\s-]', '', 'g'), '') is not null group by 1""")
def insider_by_company(spark, folder):
    return by_company(_rows(spark, folder))


@query("insider_types", f"select {_KIND} as transaction_type, form_type, count(*) as transactions from insider_transaction group by 1, 2")
def insider_types(spark, folder):
    return _rows(spark, folder).groupBy(transaction_name(F.col("transaction_type")).alias("transaction_type"), "form_type").agg(F.count("*").alias("transactions"))


@query("insider_clean", f"""select transaction_id, executive_name, {_TITLE.format('executive_title')} as title, {_DATE.format('transaction_date')} as traded, {_KIND} as transaction_type from insider_transaction""")
def insider_clean(spark, folder):
    return _rows(spark, folder).select("transaction_id", "executive_name", standard_title(F.col("executive_title")).alias("title"), iso_date(F.col("transaction_date")).alias("traded"), transaction_name(F.col("transaction_type")).alias("transaction_type"))


@query("insider_valid", """select transaction_id, coalesce(executive_name, '') <> '' and coalesce(company_ticker, '') <> '' and try_strptime(transaction_date, '%Y-%m-%d') is not null and coalesce(shares between 0 and 1e8 and price between 0 and 1e4, false) as valid from insider_transaction""")
def insider_valid(spark, folder):
    c = F.col
    return _rows(spark, folder).select("transaction_id", is_valid(c("executive_name"), c("company_ticker"), c("transaction_date"), c("shares"), c("price")).alias("valid"))


@query("form_xml", f"""select transaction_id, coalesce(trim(executive_name), '') as executive_name, {_TITLE.format("coalesce(trim(executive_title), '')")} as executive_title, coalesce(upper(trim(company_ticker)), '') as company_ticker,
    coalesce(transaction_date, '') as transaction_date, coalesce(shares, 0.0) as shares, coalesce(price, 0.0) as price, coalesce({_KIND}, '') as transaction_type from insider_transaction""")
def form_xml(spark, folder):
    """Flat rows written as XML forms and read back."""
    return xml_transactions(as_xml(_rows(spark, folder)), "content", ["transaction_id"]).drop("part", "place")


@query("form_xml_filings", f"""with r as (select *, case when security_type = 'Option' then 1 else 0 end as part from insider_transaction where accession_number is not null),
    o as (select *, first_value(coalesce(trim(executive_name), '')) over f as owner, first_value(coalesce(upper(trim(company_ticker)), '')) over f as symbol from r window f as (partition by accession_number order by transaction_id))
    select accession_number, part, row_number() over (partition by accession_number, part order by transaction_id) as place, owner as executive_name, symbol as company_ticker, coalesce(transaction_date, '') as transaction_date,
    coalesce(shares, 0.0) as shares, case when transaction_type = 'Gift' then 0.0 else coalesce(price, 0.0) end as price, coalesce({_KIND}, '') as transaction_type from o""")
def form_xml_filings(spark, folder):
    """Whole filings of several transactions of both kinds, fields left out, read back."""
    return xml_transactions(as_filings(_rows(spark, folder)), "content", ["accession_number"]).drop("executive_title")


@query("form_text", f"""select transaction_id, 1 as place, {_DATE.format('transaction_date')} as transaction_date, {_KIND} as transaction_type, shares, price from insider_transaction
    where regexp_matches(transaction_date, '^([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$') and length(transaction_type) = 1 and contains('PSAGFMXDBCEIHJKLOUV', upper(transaction_type)) and shares >= 0 and price >= 0 and shares < 1e7 and price < 1e6 and shares = floor(shares)""")
def form_text(spark, folder):
    """Flat rows written as lines of a text form and read back."""
    c = F.col
    rows = _rows(spark, folder).filter("length(transaction_type) = 1 and shares >= 0 and price >= 0 and shares < 1e7 and price < 1e6 and shares = floor(shares)")
    line = F.concat_ws(" ", c("transaction_date"), c("transaction_type"), F.concat(F.format_number(c("shares").cast("bigint"), 0)), F.concat(F.lit("$"), c("price").cast("string")))
    return text_transactions(rows.select("transaction_id", line.alias("content")), "content", ["transaction_id"])


# ---- owners and issuers named in plain text

# Patterns of a name, a title, a symbol and a company; the first that matches counts.
NAME_PATTERNS = [
    r"name[:\s]*([A-Z][a-zA-Z\s,\.]+?)(?:\n|title|officer)",
    r"reporting\s+person[:\s]*([A-Z][a-zA-Z\s,\.]+?)(?:\n|title)",
    r"insider[:\s]*([A-Z][a-zA-Z\s,\.]+?)(?:\n|title)",
]
TITLE_PATTERNS = [
    r"title[:\s]*([A-Za-z\s,\.]+?)(?:\n|date|transaction)",
    r"officer[:\s]*([A-Za-z\s,\.]+?)(?:\n|date|transaction)",
    r"position[:\s]*([A-Za-z\s,\.]+?)(?:\n|date|transaction)",
]
SYMBOL_PATTERNS = [
    r"ticker[:\s]*([A-Z]{1,5})(?:\s|\n|symbol)",
    r"symbol[:\s]*([A-Z]{1,5})(?:\s|\n|exchange)",
    r"trading\s+symbol[:\s]*([A-Z]{1,5})",
]
COMPANY_PATTERNS = [
    r"company[:\s]*([A-Z][a-zA-Z\s,\.&]+?)(?:\n|ticker|symbol)",
    r"issuer[:\s]*([A-Z][a-zA-Z\s,\.&]+?)(?:\n|ticker|symbol)",
    r"corporation[:\s]*([A-Z][a-zA-Z\s,\.&]+?)(?:\n|ticker)",
]


def _first_of(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches found, trimmed; empty if none does."""
    tries = [F.nullif(F.trim(F.regexp_extract(text, "(?i)" + p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*tries, F.lit(""))


def text_parties(forms: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Owner, title, symbol and company of forms in plain text; what is not named is empty."""
    t = F.col(content)
    return forms.select(
        *keep, _first_of(t, NAME_PATTERNS).alias("executive_name"), standard_title(_first_of(t, TITLE_PATTERNS)).alias("executive_title"),
        F.upper(_first_of(t, SYMBOL_PATTERNS)).alias("company_ticker"), _first_of(t, COMPANY_PATTERNS).alias("company_name"), form_type(t).alias("form_type"),
    )


def is_xml(content: str) -> Column:
    return F.col(content).rlike(r"^\s*<\?xml") | F.col(content).contains("<ownershipDocument>")


def form_transactions(forms: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Transactions of ownership forms of any kind, one row each: ownership documents as XML,
    malformed ones and all other texts as plain text (part 3).

    Null texts and texts without a transaction line give no rows; a text that names no date that
    can be read has an empty one.
    """
    columns = [*keep, "part", "place", "executive_name", "executive_title", "company_ticker", "transaction_date", "shares", "price", "transaction_type"]
    plain = text_parties(forms.filter(F.col(content).isNotNull() & ~is_xml(content)).withColumn("__content", F.col(content)), "__content", [*keep, "__content"])
    lines = text_transactions(plain, "__content", [*keep, "executive_name", "executive_title", "company_ticker"]).filter("shares is not null and price is not null")
    lines = lines.withColumns({"part": F.lit(3), "transaction_date": F.coalesce(F.col("transaction_date").cast("string"), F.lit(""))})
    return xml_transactions(forms, content, keep).select(columns).unionByName(lines.select(columns))


@query("form_parties", """select transaction_id, executive_name, company_ticker from insider_transaction
    where regexp_full_match(executive_name, '[A-Z][a-z]+ [A-Z][a-z]+') and regexp_full_match(company_ticker, '[A-Z]{1,5}')""")
def form_parties(spark, folder):
    """Owners and symbols written into a text form and found again."""
    rows = _rows(spark, folder).filter(F.col("executive_name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$") & F.col("company_ticker").rlike("^[A-Z]{1,5}$"))
    form = F.concat(F.lit("Form 4\nReporting person: "), "executive_name", F.lit("\nTrading symbol: "), "company_ticker", F.lit(" \n"))
    return text_parties(rows.select("transaction_id", form.alias("content")), "content", ["transaction_id"]).select("transaction_id", "executive_name", "company_ticker")


@query("form_transactions")
def form_transactions_query(spark, folder):
    """All filings written as forms, half of them in XML and half in plain text, and read back."""
    rows = _rows(spark, folder)
    as_text = F.pmod(F.xxhash64("accession_number"), F.lit(2)) == 0
    forms = as_filings(rows.filter(~as_text)).unionByName(as_texts(rows.filter(as_text)))
    return form_transactions(forms, "content", ["accession_number"])


@query("trade_append", f"""select transaction_id, executive_name, company_ticker, {_DATE.format('transaction_date')} as traded, {_KIND} as transaction_type, shares, price, accession_number from insider_transaction
    where coalesce(executive_name, '') <> '' and company_ticker in (select ticker from company) and try_strptime(transaction_date, '%Y-%m-%d') is not null and coalesce(shares between 0 and 1e8 and price between 0 and 1e4, false)""")
def trade_append(spark, folder):
    return trades(_rows(spark, folder), table(spark, folder, "company"))


@query("insider_totals", f"""select count(*) as transactions, count(distinct executive_name) as executives, round(avg(abs(shares)), 4) as mean_shares, count(*) filter ({_KIND} in {_BUY}) as purchases, count(*) filter ({_KIND} in {_SELL}) as sales, sum(abs({_VALUE})) as value from insider_transaction""")
def insider_totals(spark, folder):
    kind = transaction_name(F.col("transaction_type"))
    return _rows(spark, folder).agg(
        F.count("*").alias("transactions"), F.countDistinct("executive_name").alias("executives"), F.round(F.avg(F.abs("shares")), 4).alias("mean_shares"),
        F.count_if(kind.isin(*BUYS)).alias("purchases"), F.count_if(kind.isin(*SELLS)).alias("sales"), F.sum(F.abs(value_of(F.col("shares"), F.col("price")))).alias("value"),
    )
