"""Sinks: Parquet and CSV tables, DDL, JDBC, graph text."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, TimestampType

from tributary.schemas import DDL, schema

#: Columns of a table that may be long; others are keys and have a bound (fixed values).
LONG_TEXT = {"Expression", "Note", "Path", "Template", "Holes", "Errors", "SqlText", "ParseError", "Modules", "TopKinds", "Example", "Name"}
SQL_TYPES = {StringType: "nvarchar(512)", IntegerType: "int", LongType: "bigint", DoubleType: "float", BooleanType: "bit", TimestampType: "datetime2(3)"}
GRAPH_NODES = 50_000


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Parquet below ``path/table``, in folders of server and database where the table has them."""
    keys = [c for c in ("Server", "Database") if c in df.columns]
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{table}")


def write_csv(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("compression", "gzip" if compress else "none").csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, batch: int = 10_000) -> None:
    df.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties or {})


def ddl(table: str, existing: set[str] | None = None, owner: str = "dbo") -> str:
    """CREATE TABLE, or ALTERs for the columns an existing table lacks."""
    column = lambda f: f"[{f.name}] {'nvarchar(max)' if isinstance(f.dataType, StringType) and f.name in LONG_TEXT else SQL_TYPES[type(f.dataType)]} NULL"
    fields = list(schema(table))
    if existing:
        have = {e.lower() for e in existing}
        return "\n".join(f"ALTER TABLE [{owner}].[{table}] ADD {column(f)};" for f in fields if f.name.lower() not in have)
    return f"CREATE TABLE [{owner}].[{table}] (\n  " + ",\n  ".join(map(column, fields)) + "\n);"


def all_ddl() -> str:
    index = lambda t, n, *c: f"CREATE INDEX [IX_{t}_{n}] ON [dbo].[{t}] ({', '.join(f'[{x}]' for x in c)});"
    extra = [index("Collapsed", "Source", "SourceDatabase", "SourceSchema", "SourceObject", "SourceColumn"), index("Collapsed", "Target", "TargetDatabase", "TargetSchema", "TargetObject", "TargetColumn"), index("ColumnLineage", "Module", "Server", "Database", "ModuleSchema", "ModuleName"), index("ObjectLineage", "Object", "ObjectDatabase", "ObjectSchema", "ObjectName")]
    return "\n".join([ddl(t) for t in DDL] + extra)


def workbook_layout(counts: dict[str, int], full_limit: int = 3_000_000, per_sheet: int = 900_000) -> dict[str, int]:
    """Sheets for each table in a workbook: large runs keep summaries only, long tables are split."""
    lineage = {"ColumnLineage", "ObjectLineage", "Collapsed", "Statements", "CatalogDeps", "Query"}
    small = sum(counts.values()) <= full_limit
    return {t: max(1, -(-n // per_sheet)) for t, n in counts.items() if small or t not in lineage}


def graph_text(edges: DataFrame, fmt: str = "dot") -> str:
    """A sub-graph ``(src, dst, kind, module)`` as dot, graphml or json; for graphs that people look at."""
    rows = edges.orderBy("src", "dst").limit(GRAPH_NODES + 1).collect()
    if len(rows) > GRAPH_NODES:
        raise ValueError(f"more than {GRAPH_NODES} edges; take fewer hops")
    nodes = sorted({n for r in rows for n in (r.src, r.dst)})
    if fmt == "json":
        return json.dumps({"nodes": nodes, "edges": [{"from": r.src, "to": r.dst, "kind": r.kind, "module": r.module} for r in rows]}, ensure_ascii=False)
    if fmt == "graphml":
        body = [f'<node id="{escape(n, {chr(34): "&quot;"})}"/>' for n in nodes]
        body += [f'<edge source="{escape(r.src, {chr(34): "&quot;"})}" target="{escape(r.dst, {chr(34): "&quot;"})}"><data key="kind">{escape(r.kind or "")}</data></edge>' for r in rows]
        return '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="edge" attr.name="kind" attr.type="string"/><graph edgedefault="directed">' + "".join(body) + "</graph></graphml>"
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "digraph lineage {\n  rankdir=LR;\n" + "".join(f"  {quote(r.src)} -> {quote(r.dst)} [label={quote(r.kind or '')}];\n" for r in rows) + "}\n"
