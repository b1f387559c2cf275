"""Command line: ``python -m docketry search|status|ask|ingest|fit|clear|test FOLDER ...``."""

from __future__ import annotations

import argparse

from docketry.operators import graph, terms
from docketry.plans import ingest
from docketry.plans.engine import Engine
from docketry.session import local_session, ship
from docketry.tables import table


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docketry")
    parser.add_argument("command", choices=["search", "status", "ask", "ingest", "fit", "clear", "test"])
    parser.add_argument("folder")
    parser.add_argument("text", nargs="?", default="")
    parser.add_argument("--out", help="where ingest and fit write, what clear empties")
    parser.add_argument("--confirm", action="store_true")
    parser.add_argument("--types", nargs="*")
    parser.add_argument("--tickers", nargs="*")
    parser.add_argument("-k", type=int, default=10)
    given = parser.parse_args(args)
    if given.command in ("ingest", "fit", "clear") and not given.out:
        parser.error(f"{given.command} needs --out")
    spark = local_session()
    ship(spark)
    engine = Engine(spark, given.folder)
    if given.command == "status":
        graph.filings_per_company_of(spark, given.folder).orderBy("filings", ascending=False).show(5)
        engine.stats().show(truncate=False)
    elif given.command == "search":
        engine.search(given.text, tickers=given.tickers, filing_types=given.types, mode="text", k=given.k).show(given.k, truncate=80)
    elif given.command == "ask":
        print(engine.ask(given.text, given.k)["answer"])
    elif given.command == "ingest":
        ingest.run(spark, given.folder, given.out).show(truncate=False)
    elif given.command == "fit":
        sections = graph.sections_once(spark, given.folder, "content")
        vocabulary, documents = terms.sample_vocabulary(sections, "section_id", "content")
        ingest.save_vocabulary(vocabulary, documents, given.out)
    elif given.command == "clear":
        ingest.clear(spark, given.out, given.confirm)
    else:
        health = engine.health()
        print(health)
        table(spark, given.folder, "filing_section").limit(1).collect()
        raise SystemExit(0 if all(health.values()) else 1)


if __name__ == "__main__":
    main()
