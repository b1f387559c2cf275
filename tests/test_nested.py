import json

from docketry.operators import nested
from tests.conftest import rows


def forms(spark, payloads):
    data = [(i, acc, at, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, (acc, at, p) in enumerate(payloads)]
    return spark.createDataFrame(data, "record_id long, accession_number string, received int, payload string, node_id string").selectExpr("*", "timestamp'2024-01-01' + make_interval(0,0,0,received) as received_at")


def trades(spark, payloads):
    return rows(nested.trades(nested.ownership_rows(forms(spark, payloads))))


def test_places_kinds_fills_and_figures(spark):
    payload = {
        "nonDerivativeTable": {"transactions": [{"shares": 5, "price": "1.5"}, None, {"amounts": {"shares": {"value": {"value": " $1,000 "}}, "pricePerShare": 2}}, {"shares": "N/A", "price": 1}, {"shares": True, "price": 1}]},
        "derivativeTransaction": {"transactionShares": "7", "transactionPricePerShare": {"value": "8", "footnoteIds": ["F1"]}, "fills": [], "underlying": {"shares": 1, "price": 1}},
        "derivativeTable": {"holdings": [{"shares": 1, "price": 1}]},
    }
    assert trades(spark, [("a", 1, payload)]) == [("a", "d", 1, 0, 7.0, 8.0), ("a", "nd", 1, 0, 5.0, 1.5), ("a", "nd", 3, 0, 1000.0, 2.0)]


def test_fills(spark):
    payload = {"nonDerivativeTransaction": [
        {"shares": 1, "price": 1, "fills": [None, {"shares": 2, "price": 3}, {"shares": 2}]},
        {"shares": 1, "price": 1, "fills": {"shares": "4", "price": ".5"}},
        {"shares": 1, "price": 1, "fills": None},
        {"shares": 1, "price": 1, "fills": [None]},
        {"price": 1, "fills": [{"shares": {"value": 6}, "price": {"value": "1e5"}}]},
    ]}
    assert trades(spark, [("a", 1, payload)]) == [("a", "nd", 1, 2, 2.0, 3.0), ("a", "nd", 2, 1, 4.0, 0.5), ("a", "nd", 3, 0, 1.0, 1.0)]


def test_latest_valid_delivery_counts(spark):
    one = {"nonDerivativeTransaction": [{"shares": 1, "price": 1}]}
    two = {"nonDerivativeTransaction": [{"shares": 2, "price": 2}]}
    got = trades(spark, [("a", 1, one), ("a", 5, two), ("a", 9, '{"broken'), ("a", 8, "[1]"), ("a", 7, None), ("b", 3, two), ("b", 3, one), (None, 1, one), ("c", 1, "{}"), ("d", 1, '{"x": NaN}'), ("d", 0, one)])
    assert got == [("a", "nd", 1, 0, 2.0, 2.0), ("b", "nd", 1, 0, 1.0, 1.0), ("d", "nd", 1, 0, 1.0, 1.0)]


def test_tables_link_by_keys(spark):
    payload = {"form": "4", "issuer": {"tradingSymbol": "ZQ", "name": "Acme"}, "reportingOwners": [{"name": "Jane", "relationship": {"officerTitle": "CFO"}}, None, {"name": "Joe"}], "nonDerivativeTransaction": [{"shares": 1, "price": 1, "fills": [{"shares": 1, "price": 1}]}]}
    shredded = nested.ownership_rows(forms(spark, [("a", 1, payload)]))
    assert rows(nested.filings_table(shredded)) == [("a", 0, "4", "ZQ", "Acme", 3)]
    assert rows(nested.owners_table(shredded)) == [("a", 1, "Jane", "CFO", None), ("a", 3, "Joe", None, None)]
    joined = nested.fills_table(shredded).join(nested.transactions_table(shredded).select("node_id", "txn_no"), "node_id")
    assert joined.count() == 1
    ids = {r["node_id"] for r in shredded.collect()}
    assert all(r["parent_id"] in ids or r["parent_id"] == "" for r in shredded.collect())


def test_figures_wherever_the_plan_puts_them(spark):
    """Lists, cycles and notes under the names of figures in one form change nothing in another."""
    odd = {"nonDerivativeTransaction": [{"shares": [1, 2], "price": 3}, {"shares": {"shares": 4}, "price": 3}, {"shares": {"footnoteIds": ["F1"]}, "price": 3}, {"amounts": [{"shares": 1, "price": 1}]}, 7, "x"]}
    good = {"nonDerivativeTransaction": [{"shares": 1, "amounts": {"shares": 9, "price": {"value": "2"}}}, {"amounts": {"shares": "N/A", "transactionShares": 5, "price": [1], "pricePerShare": 6}}], "derivativeTransaction": [{"shares": 1, "price": 1, "fills": [{"amounts": {"shares": 2, "price": 3}}]}]}
    assert trades(spark, [("a", 1, odd), ("b", 1, good)]) == [("b", "d", 1, 1, 2.0, 3.0), ("b", "nd", 1, 0, 1.0, 2.0), ("b", "nd", 2, 0, 5.0, 6.0)]
    plan = nested.inlining_plan(nested.schema_graph(forms(spark, [("b", 1, {**good, "x": {"shares": {"note": 1}}})]), "payload"))
    assert "amounts" in plan.tables and not {"shares", "transactionShares", "pricePerShare"} & plan.tables and "price" in plan.tables


def test_plan_finds_repeated_shared_and_recursive(spark):
    df = spark.createDataFrame([(json.dumps({"a": {"x": {"k": 1}}, "b": {"x": {"k": 2}}, "list": [{"v": 1}], "tree": {"child": {"child": {"n": 1}}}, "one": {"deep": {"er": 1}}}),)], "p string")
    plan = nested.inlining_plan(nested.schema_graph(df, "p"))
    assert {"x", "list", "child"} <= plan.tables and not {"a", "one", "deep"} & plan.tables
    got = {r["node_id"]: r for r in nested.shred(df, "p", [], plan).collect()}
    assert got["$"]["columns"]["one.deep.er"] == "n:1" and got["$.list[1]"]["columns"]["v"] == "n:1" and got["$.tree.child.child"]["parent_id"] == "$.tree.child"


def test_empty_table_and_large_payload(spark):
    empty = forms(spark, [("a", 1, None)]).limit(0)
    assert nested.trades(nested.ownership_rows(empty)).count() == 0
    many = {"nonDerivativeTransaction": [{"shares": i, "price": 1} for i in range(20_000)]}
    assert nested.trades(nested.ownership_rows(forms(spark, [("a", 1, many)]))).count() == 20_000
