"""Deeply nested JSON records to related flat tables, by shared inlining.

The schema graph of all payloads is inferred by Spark (nodes are key names, edges are
parent key to child key, marked when the child repeats). From the graph a plan follows:

* keys that repeat, and objects that are reached from several parent keys or that lie on a
  cycle, become tables of their own; scalars in such tables are in a ``value`` column;
* every other descendant is inlined into its nearest table under a dotted column name, and so is
  a key that is a scalar somewhere and elsewhere an object of notes;
* an object whose only data is a ``value`` (with any notes beside it) is a wrapped scalar:
  it is unwrapped as often as needed and inlined.

Each row holds its own node id and the node id and table of its parent (the foreign key),
its 1-based place in its list (a node id names a place only within a list), and its inlined columns as ``MAP<STRING,STRING>``. Scalars
keep their JSON kind as a prefix: ``n:`` number (text as delivered), ``s:`` string,
``b:`` boolean. A column ``#name`` counts the entries of a child list, nulls included.

Defined cases: null, invalid or non-object payloads give no rows; a bare object where a
list is expected is place 1; null list entries keep their place and give no row; repeated
keys in one object keep the last; the constants NaN and Infinity make a payload invalid.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import cut

ROOT = "$"
#: Bound of the schema graph that reaches the driver; more key pairs than this is an error.
MAX_EDGES = 20_000


class _Number(str):
    """A JSON number as delivered."""


def _constant(name: str) -> None:
    raise ValueError(name)


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, or None if there is no valid one."""
    if text is None:
        return None
    try:
        found = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_constant)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _unwrap(item: object) -> object:
    while isinstance(item, dict) and "value" in item and not isinstance(item["value"], list):
        item = item["value"]
    return item


def _scalar(item: object) -> str | None:
    if isinstance(item, bool):
        return f"b:{str(item).lower()}"
    if isinstance(item, _Number):
        return f"n:{item}"
    return None if item is None else f"s:{item}"


@dataclass(frozen=True)
class Plan:
    """Which nodes are tables; everything else is inlined."""

    tables: frozenset[str]


def _edges(item: dict, parent: str, found: set[tuple[str, str, str]]) -> None:
    """Adds (parent key, child key, what the child is): list, object, scalar or null."""
    stack = [(item, parent)]
    while stack:
        node, name = stack.pop()
        for key, child in node.items():
            child = _unwrap(child)
            if isinstance(child, list):
                found.add((name, key, "list"))
                entries = [_unwrap(e) for e in child]
                stack.extend((e, key) for e in entries if isinstance(e, dict))
                stack.extend(({key: e}, key) for e in entries if isinstance(e, list))
            elif isinstance(child, dict):
                found.add((name, key, "object"))
                stack.append((child, key))
            else:
                found.add((name, key, "null" if child is None else "scalar"))


def survey(records: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """One row (valid true, keys) for every valid payload, and the edges (parent, child, what) of the
    payloads' schema graph, each once a task; both from one reading of the payloads."""
    chosen = records.select(*keys, payload)
    types = [chosen.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str, str]] = set()
        names = ["valid", *keys, "parent", "child", "what"]
        for batch in batches:
            good = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                if (item := parse_object(text)) is not None:
                    good.append(i)
                    _edges(item, ROOT, found)
            index = pa.array(good, pa.int64())
            none = pa.nulls(len(good), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(good), pa.bool_()), *(batch.column(k).take(index) for k in range(len(keys))), none, none, none], names=names)
            kinds = [batch.column(k).type for k in range(len(keys))]
        if found:
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(rows), pa.bool_()), *(pa.nulls(len(rows), t) for t in kinds), *(pa.array([r[c] for r in rows], pa.string()) for c in range(3))], names=names)

    return chosen.mapInArrow(run, ", ".join(["valid boolean", *(f"`{k}` {t}" for k, t in zip(keys, types)), "parent string, child string, what string"]))


def schema_graph(payloads: DataFrame, column: str) -> DataFrame:
    """Distinct edges (parent, child, what) of the payloads' schema graph."""
    return survey(payloads, column, []).filter("not valid").select("parent", "child", "what").distinct()


def inlining_plan(graph: DataFrame, declared: Iterable[str] = (), max_edges: int = MAX_EDGES) -> Plan:
    """Decide the tables from the schema graph (driver side, bounded by ``max_edges``) and from the
    keys that are declared as lists, which a given delivery may hold as bare objects only."""
    edges = [tuple(r) for r in graph.limit(max_edges + 1).collect()]
    if len(edges) > max_edges:
        raise ValueError(f"the schema graph has more than {max_edges} edges")
    parents: dict[str, set[str]] = {}
    below: dict[str, set[str]] = {}
    kinds: dict[str, set[str]] = {}
    for parent, child, what in edges:
        parents.setdefault(child, set()).add(parent)
        below.setdefault(parent, set()).add(child)
        kinds.setdefault(child, set()).add(what)

    def recursive(name: str) -> bool:
        seen, stack = set(), list(below.get(name, ()))
        while stack:
            node = stack.pop()
            if node == name:
                return True
            if node not in seen:
                seen.add(node)
                stack.extend(below.get(node, ()))
        return False

    repeated = {n for n, what in kinds.items() if "list" in what}
    objects = {n for n, what in kinds.items() if "object" in what and "scalar" not in what}
    shared = {n for n in objects if len(parents[n]) > 1 or recursive(n)}
    return Plan(frozenset({ROOT} | set(declared) | repeated | shared))


SHRED_COLUMNS = "node_table string, node_id string, parent_table string, parent_id string, parent_key string, position int, columns map<string,string>"


def _shred(item: dict, plan: Plan) -> Iterator[tuple]:
    stack: list[tuple[dict | object, str, str, str, str, str, int]] = [(item, ROOT, ROOT, "", "", "", 1)]
    while stack:
        node, table, node_id, parent_table, parent_id, parent_key, position = stack.pop()
        columns: dict[str, str] = {}
        if not isinstance(node, dict):
            if (text := _scalar(node)) is not None:
                columns["value"] = text
            yield table, node_id, parent_table, parent_id, parent_key, position, columns
            continue
        inline = [(node, "")]
        while inline:
            part, prefix = inline.pop()
            for key, child in part.items():
                child = _unwrap(child)
                if key in plan.tables:
                    entries = child if isinstance(child, list) else [] if child is None else [child]
                    if isinstance(child, (list, dict)) or entries:
                        columns[f"#{prefix}{key}"] = str(len(entries))
                    for place, entry in enumerate(entries, 1):
                        entry = _unwrap(entry)
                        if isinstance(entry, list):
                            entry = {key: entry}
                        if entry is not None:
                            within = f"[{place}]" if isinstance(child, list) else ""
                            stack.append((entry, key, f"{node_id}.{prefix}{key}{within}", table, node_id, f"{prefix}{key}", place))
                elif isinstance(child, dict):
                    inline.append((child, f"{prefix}{key}."))
                elif (text := _scalar(child)) is not None:
                    columns[f"{prefix}{key}"] = text
        yield table, node_id, parent_table, parent_id, parent_key, position, columns


def shred(records: DataFrame, payload: str, keys: list[str], plan: Plan) -> DataFrame:
    """One row per table node of every valid payload, with the ``keys`` columns of its record."""
    chosen = records.select(*keys, payload)
    types = [chosen.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, take = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                if (item := parse_object(text)) is not None:
                    for row in _shred(item, plan):
                        rows.append(row)
                        take.append(i)
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(index) for k in range(len(keys))]
                + [pa.array([r[c] for r in rows], pa.string()) for c in range(5)]
                + [pa.array([r[5] for r in rows], pa.int32()), pa.array([list(r[6].items()) for r in rows], pa.map_(pa.string(), pa.string()))],
                names=[*keys, "node_table", "node_id", "parent_table", "parent_id", "parent_key", "position", "columns"],
            )

    return chosen.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, types)), SHRED_COLUMNS]))


def figure(column: Column) -> Column:
    """The figure in a kept scalar: a JSON number, or a string that is a plain decimal
    number once ``$``, ``,`` and outer spaces are removed; else null."""
    text = F.regexp_replace(F.substring(column, 3, 1 << 30), r"[$,]", "")
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    plain = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    return F.when(column.startswith("n:"), F.substring(column, 3, 1 << 30).try_cast("double")).when(column.startswith("s:") & plain, text.try_cast("double"))


LISTS = {"transactions", "nonDerivativeTransaction", "derivativeTransaction", "fills", "reportingOwners"}
SHARES = ["shares", "transactionShares"]
PRICES = ["price", "pricePerShare", "transactionPricePerShare"]


def ownership_rows(records: DataFrame) -> DataFrame:
    """Shredded rows of the latest valid form of every accession number.

    Only the row with the latest ``received_at`` among the valid ones counts (ties: the
    larger record_id); rows without an accession number have no key and are left out. Payloads
    are read twice: once for the schema graph and for which ones are valid, and once, without
    those that a later delivery replaces, to be shredded.
    """
    records = records.filter(F.col("accession_number").isNotNull())
    seen = cut(survey(records, "payload", ["record_id", "accession_number", "received_at"]))
    plan = inlining_plan(seen.filter("not valid").select("parent", "child", "what").distinct(), LISTS)
    valid = seen.filter("valid").select("accession_number", "record_id", F.struct("received_at", "record_id").alias("__order"))
    best = valid.groupBy("accession_number").agg(F.max("__order").alias("__best"), F.count("*").alias("__n")).filter("__n > 1")
    replaced = valid.join(best, "accession_number").filter("__order < __best").select("record_id")
    return shred(records.join(replaced, "record_id", "left_anti"), "payload", ["record_id", "accession_number", "received_at"], plan)


def filings_table(rows: DataFrame) -> DataFrame:
    """One row per form: its key, form type and issuer."""
    c = F.col("columns")
    bare = lambda name: F.substring(c[name], 3, 1 << 30)
    return rows.filter(F.col("node_table") == ROOT).select("accession_number", "record_id", bare("form").alias("form"), bare("issuer.tradingSymbol").alias("issuer_ticker"), bare("issuer.name").alias("issuer_name"), F.coalesce(c["#reportingOwners"].cast("int"), F.lit(0)).alias("owner_entries"))


def owners_table(rows: DataFrame) -> DataFrame:
    """One row per reporting owner, linked by accession_number and place."""
    c = F.col("columns")
    bare = lambda name: F.substring(c[name], 3, 1 << 30)
    own = rows.filter(F.col("node_table").isin("reportingOwners", "reportingOwner") & (F.col("parent_table") == ROOT))
    return own.select("accession_number", F.col("position").alias("owner_no"), bare("name").alias("owner_name"), bare("relationship.officerTitle").alias("officer_title"), bare("relationship.isDirector").alias("is_director"))


#: The node id of a transaction or of one of its fills, of its amounts, or of a figure in either that
#: is a table of its own; holdings and underlying securities never match, nor do lists of figures.
TRADE_PATH = (
    r"^(\$\.(nonDerivative|derivative)(?:Table(?:\[1\])?\.transactions|Transaction)(?:\[([0-9]+)\])?(\.fills(?:\[([0-9]+)\])?)?)"
    rf"(\.amounts)?(?:\.({'|'.join([*SHARES, *PRICES])}))?$"
)


def _figure_of(names: list[str]) -> Column:
    """(rank, figure) of the best figure in a row: names in their order, direct ones before those in amounts."""
    c, far = F.col("columns"), F.when(F.col("__amounts") != "", 100).otherwise(0)
    pairs = [(far + i, c[n]) for i, n in enumerate(names)] + [(F.lit(100 + i), c[f"amounts.{n}"]) for i, n in enumerate(names)]
    pairs += [(far + i, F.when(F.col("__leaf") == n, c["value"])) for i, n in enumerate(names)]
    kept = F.filter(F.array(*(F.struct(rank.alias("rank"), text.alias("text")) for rank, text in pairs)), lambda p: p["text"].isNotNull())
    read = F.transform(kept, lambda p: F.struct(p["rank"].alias("rank"), figure(p["text"]).alias("x")))
    return F.array_min(F.filter(read, lambda p: p["x"].isNotNull()))


def lines(rows: DataFrame) -> DataFrame:
    """One row per transaction object and per fill object: node_id, its transaction's node id, kind
    (``nd`` or ``d``), places, fill entries and its own figures, wherever the plan has put them.

    What belongs to a line shares its path, so its rows are merged by one grouping, which is
    mostly done before the shuffle because a form's rows lie together.
    """
    part = lambda i: F.regexp_extract("node_id", TRADE_PATH, i)
    own = rows.filter(F.col("node_id").rlike(TRADE_PATH)).withColumns({"__path": part(1), "__amounts": part(6), "__leaf": part(7)})
    itself = (F.col("__amounts") == "") & (F.col("__leaf") == "")
    found = own.groupBy("accession_number", "record_id", "__path").agg(
        F.max(F.when(itself, F.coalesce(F.col("columns")["#fills"].cast("int"), F.lit(0)))).alias("fill_entries"),
        F.min(_figure_of(SHARES)).alias("__shares"), F.min(_figure_of(PRICES)).alias("__price"),
    ).withColumnRenamed("__path", "node_id")
    place = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(1))
    return found.filter("fill_entries is not null").select(
        "accession_number", "record_id", "node_id", F.regexp_replace("node_id", r"\.fills(?:\[[0-9]+\])?$", "").alias("transaction_id"), F.when(part(2) == "nonDerivative", "nd").otherwise("d").alias("txn_kind"),
        place(3).alias("txn_no"), F.when(part(4) == "", 0).otherwise(place(5)).alias("fill_no"), "fill_entries", F.col("__shares.x").alias("shares"), F.col("__price.x").alias("price"),
    )


def transactions_table(rows: DataFrame) -> DataFrame:
    """One row per transaction object: kind (``nd`` or ``d``), place, figures and fill entries."""
    return lines(rows).filter("fill_no = 0").select("accession_number", "record_id", "node_id", "txn_kind", "txn_no", "fill_entries", "shares", "price")


def fills_table(rows: DataFrame) -> DataFrame:
    """One row per fill object, linked to its transaction by node ids, with its figures."""
    return lines(rows).filter("fill_no > 0").select("accession_number", "record_id", F.col("transaction_id").alias("node_id"), "fill_no", "shares", "price")


def trades(rows: DataFrame) -> DataFrame:
    """The traded lines of all forms: each fill, or the transaction itself (fill_no 0) where
    it has no fill entries; only lines whose own shares and price are both figures."""
    traded = lines(rows).filter("(fill_no > 0 or fill_entries = 0) and shares is not null and price is not null")
    return traded.select("accession_number", "txn_kind", "txn_no", "fill_no", "shares", "price")
