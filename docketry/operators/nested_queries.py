"""Queries of the nested-record operator over ownership_raw."""

from docketry.operators import nested
from docketry.registry import query
from docketry.tables import table


#: The latest valid forms, their transactions, and the lines with what their figures may be in.
_LINES_SQL = """with v as (select record_id, accession_number, received_at, payload::json as j from ownership_raw where accession_number is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
    l as (select * from v qualify row_number() over (partition by accession_number order by received_at desc nulls last, record_id desc) = 1),
    p as (select accession_number, unnest(['nd', 'nd', 'd', 'd']) as txn_kind, unnest([j->'nonDerivativeTable'->'transactions', j->'nonDerivativeTransaction', j->'derivativeTable'->'transactions', j->'derivativeTransaction']) as x from l),
    n as (select accession_number, txn_kind, case json_type(x) when 'ARRAY' then json_extract(x, '$[*]') when 'OBJECT' then [x] else [] end as items from p),
    t as (select accession_number, txn_kind, unnest(items) as item, unnest(range(1, len(items) + 1)) as txn_no from n),
    f as (select *, case json_type(item->'fills') when 'ARRAY' then json_extract(item->'fills', '$[*]') when 'OBJECT' then [item->'fills'] else [] end as fills from t where json_type(item) = 'OBJECT'),
    w as (select accession_number, txn_kind, txn_no, 0 as fill_no, item from f where len(fills) = 0 union all select accession_number, txn_kind, txn_no, unnest(range(1, len(fills) + 1)), unnest(fills) from f),
    c as (select accession_number, txn_kind, txn_no, fill_no, what, """ + "unnest([" + ", ".join(f"item->'{n}'" for n in nested.SHARES) + ", " + ", ".join(f"item->'amounts'->'{n}'" for n in nested.SHARES) + f"]) as x, unnest(range({2 * len(nested.SHARES)})) as rank from w, (select 'shares' as what) union all select accession_number, txn_kind, txn_no, fill_no, 'price', unnest([" + ", ".join(f"item->'{n}'" for n in nested.PRICES) + ", " + ", ".join(f"item->'amounts'->'{n}'" for n in nested.PRICES) + f"]), unnest(range({2 * len(nested.PRICES)})) from w)"
_UNWRAPPED = "".join(f", u{i} as (select * replace (case when json_type(x) = 'OBJECT' and json_type(x->'value') is not null and json_type(x->'value') <> 'ARRAY' then x->'value' else x end as x) from {'c' if i == 0 else f'u{i - 1}'})" for i in range(6))


_PLAIN = "trim(regexp_replace(x->>'$', '[$,]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
_FIGURES = f""", g as (select *, {_PLAIN} as plain, case when json_type(x) in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then true when json_type(x) = 'VARCHAR' then regexp_full_match({_PLAIN}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') else false end as ok from u5),
    q as (select accession_number, txn_kind, txn_no::int as txn_no, fill_no::int as fill_no, arg_min(plain, rank) filter (ok and what = 'shares')::double as shares, arg_min(plain, rank) filter (ok and what = 'price')::double as price from g group by 1, 2, 3, 4)"""
_TRADES_SQL = _LINES_SQL + _UNWRAPPED + _FIGURES


@query("p3_found", f"{_TRADES_SQL} select accession_number, txn_kind, txn_no, fill_no from q where shares is not null and price is not null")
def p3_found(spark, folder):
    rows = nested.ownership_rows(table(spark, folder, "ownership_raw"))
    return nested.trades(rows).select("accession_number", "txn_kind", "txn_no", "fill_no")


@query("p3_trades", f"{_TRADES_SQL} select * from q where shares is not null and price is not null")
def p3_trades(spark, folder):
    return nested.trades(nested.ownership_rows(table(spark, folder, "ownership_raw")))


@query("p3_transactions")
def p3_transactions(spark, folder):
    return nested.transactions_table(nested.ownership_rows(table(spark, folder, "ownership_raw")))


@query("p3_fills")
def p3_fills(spark, folder):
    return nested.fills_table(nested.ownership_rows(table(spark, folder, "ownership_raw")))


_FORMS_SQL = _LINES_SQL.split("    p as (")[0].rstrip().rstrip(",")


@query("p3_filings", f"""{_FORMS_SQL} select accession_number, record_id, j->>'form' as form, j->'issuer'->>'tradingSymbol' as issuer_ticker, j->'issuer'->>'name' as issuer_name,
    case json_type(j->'reportingOwners') when 'ARRAY' then json_array_length(j->'reportingOwners') when 'OBJECT' then 1 else 0 end::int as owner_entries from l""")
def p3_filings(spark, folder):
    return nested.filings_table(nested.ownership_rows(table(spark, folder, "ownership_raw")))


@query("p3_owners", f"""{_FORMS_SQL}, o as (select accession_number, case json_type(j->'reportingOwners') when 'ARRAY' then json_extract(j->'reportingOwners', '$[*]') when 'OBJECT' then [j->'reportingOwners'] else [] end as items from l),
    e as (select accession_number, unnest(items) as x, unnest(range(1, len(items) + 1))::int as owner_no from o)
    select accession_number, owner_no, x->>'name' as owner_name, x->'relationship'->>'officerTitle' as officer_title, x->'relationship'->>'isDirector' as is_director from e where json_type(x) = 'OBJECT'""")
def p3_owners(spark, folder):
    return nested.owners_table(nested.ownership_rows(table(spark, folder, "ownership_raw")))
