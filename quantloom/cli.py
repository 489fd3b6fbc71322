"""Command line: list the queries, or run one and write its rows."""

from __future__ import annotations

import argparse

from .plans import catalog, experiment
from .session import session
from .sources.runs import DEFAULTS, RunStore, load_config, smoke
from .sources.sinks import write_csv, write_json, write_parquet


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quantloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the panel queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(catalog.QUERIES))
    run.add_argument("tables")
    run.add_argument("--out", help="folder for the result; without it the first rows are shown")
    run.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    whole = sub.add_parser("experiment", help="features, training, books and statistics over a folder of tables, kept in a run store")
    whole.add_argument("tables")
    whole.add_argument("store")
    whole.add_argument("--config", help="TOML or JSON file; without it the defaults")
    whole.add_argument("--smoke", action="store_true", help="a small run of the same kind")
    for name, what in (("report", "the report of a stored run"), ("runs", "the runs of a store")):
        one = sub.add_parser(name, help=what)
        one.add_argument("store")
        if name == "report":
            one.add_argument("key")
    chosen = parser.parse_args(argv)
    if chosen.command in ("experiment", "report", "runs"):
        store = RunStore(session(), chosen.store)
        if chosen.command == "runs":
            for m in store.runs():
                print(m["key"], m["name"], m["finished"])
            return
        if chosen.command == "report":
            print(experiment.report(store, chosen.key))
            return
        config = load_config(chosen.config) if chosen.config else DEFAULTS
        print(experiment.run(session(), chosen.tables, smoke(config) if chosen.smoke else config, store))
        return
    if chosen.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    rows = catalog.QUERIES[chosen.query](session(), chosen.tables)
    if chosen.out:
        {"parquet": write_parquet, "csv": write_csv, "json": write_json}[chosen.format](rows, chosen.out)
    else:
        rows.show(20, truncate=False)


if __name__ == "__main__":
    main()
