"""Command line: ``python -m tributary run|etl|query|graph|plan|ddl ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tributary import sinks
from tributary.plans import etl
from tributary.plans.session import Config, LineageSession
from tributary.schemas import schema
from tributary.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tributary")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "plan"):
        c = sub.add_parser(name, help="analyse a folder of SQL scripts" if name == "run" else "show the tasks of a run")
        c.add_argument("scripts")
        c.add_argument("--config", help="JSON; comments allowed")
        c.add_argument("--run-id", default="r1")
        if name == "run":
            c.add_argument("--out", required=True)
    c = sub.add_parser("etl", help="analyse repository exports")
    c.add_argument("exports")
    c.add_argument("--out", required=True)
    for name in ("query", "graph"):
        c = sub.add_parser(name)
        c.add_argument("results", help="what run wrote")
        c.add_argument("node", help="[database.]schema.object[.column]")
        if name == "query":
            c.add_argument("--direction", choices=("upstream", "downstream", "both"), default="upstream")
        else:
            c.add_argument("--format", choices=("dot", "graphml", "json"), default="dot")
            c.add_argument("--columns", action="store_true")
    sub.add_parser("ddl", help="print the tables' DDL")
    a = p.parse_args(argv)
    if a.command == "ddl":
        print(sinks.all_ddl())
        return
    spark = SparkSession.builder.appName("tributary").getOrCreate()
    if a.command in ("run", "plan"):
        raw = files.read_json(a.config) if a.config else {}
        config = Config(run_id=a.run_id, **{k: v for k, v in raw.items() if k in Config.__dataclass_fields__})
        session = LineageSession.from_scripts(spark, files.read_scripts(spark, a.scripts), config)
        if a.command == "plan":
            session.plan().show(1000, False)
            return
        session.run_all()
        session.save(a.out)
        session.tables["Summary"].show(100, False)
    elif a.command == "etl":
        for name, df in etl.run(etl.read_exports(spark, a.exports)).items():
            sinks.write_table(df, a.out, name)
    else:
        session = LineageSession(spark, spark.createDataFrame([], files.ENTRY))
        rows = spark.read.parquet(f"{a.results}/Collapsed")
        session.tables["Collapsed"] = rows.select(*[f.name for f in schema("Collapsed")])
        if a.command == "query":
            session.query(a.node, a.direction).show(1000, False)
        else:
            print(session.graph(a.node, a.format, a.columns))


if __name__ == "__main__":
    main()
