"""Lineage runs: plan, prepass, analysis, merging, queries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import sinks
from tributary.durable import materialize
from tributary.names import fold, fold_column, node_key, parse_address, split_name
from tributary.operators import closure, tables
from tributary.plans import lookup
from tributary.schemas import DDL, schema
from tributary.sources import files
from tributary.tsql.analyze import DEFAULTS, analyze, facts
from tributary.tsql.model import Catalog, Column, Entry

MODULE_TYPES = ("Procedure", "View", "ScalarFunction", "InlineTvf", "MsTvf", "Trigger", "JobStep", "Script", "ClrModule")
FEW, SMALL = 20_000, 8_000_000  # objects and characters up to which a catalog goes to all tasks whole
VERSION = "1"  # of the analysis; a change re-analyses all modules
UNREAD = ("Quarantined", "NoDefinition(CLR)", "NoDefinition(Encrypted)", "DefinitionSizeLimit", "Error")
ROW_TABLES = ("ColumnLineage", "ObjectLineage", "DynamicSql", "Unresolved", "Statements", "Modules")


@dataclass
class Config:
    run_id: str = "r1"
    settings: dict = field(default_factory=dict)
    archive_patterns: list[str] = field(default_factory=list)
    max_call_depth: int = 8
    max_collapse_depth: int = 32
    max_query_hops: int = 10
    max_query_rows: int = 500_000
    graph_hops: int = 3
    dedup: bool = True
    config_tables: dict[str, int] = field(default_factory=dict)  # schema.table.column to how many values to read
    linked_servers: dict[str, list] = field(default_factory=dict)  # linked name to [server, default database]
    include_databases: list[str] = field(default_factory=lambda: ["*"])
    exclude_databases: list[str] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=list)  # modules whose name contains one of these
    exclude_schemas: list[str] = field(default_factory=list)


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a row is a text to parse, so small tables are worth many tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


_built: dict = {}


def _catalog(shared: tuple, patterns: list[str]) -> tuple[Catalog, dict]:
    """The catalog with tables that code creates, and literals by procedure and parameter; built once in a worker."""
    if _built.get("of") is not shared:
        rows, known = shared
        catalog, args = files.catalog_of(rows, patterns), {}
        for kind, server, database, name, param, values, _ in known:
            parts = split_name(name)
            s = parts[-2] if len(parts) > 1 else "dbo"
            if kind == "table" and catalog.get(server, database, s, parts[-1]) is None:
                cols = [Column(*c) for c in json.loads(values[0])] if values else None
                catalog.add(Entry(server, database, s, parts[-1], "Table", cols, overlay=True))
            elif kind == "arg" and (e := catalog.get(server, database, s, parts[-1])) is not None:
                p = e.params[int(param[1:]) - 1] if param[1:].isdigit() and int(param[1:]) <= len(e.params) else param
                args.setdefault(e.obj.key, {}).setdefault(fold(p), []).extend(values)
        _built.update(of=shared, value=(catalog, args))
    return _built["value"]


class LineageSession:
    """A run over catalog entries. Up to ``FEW`` objects the catalog without definitions goes to all tasks, a larger one is
    joined to the modules that ask for its objects; definitions are read where they are analysed, but for views and
    inline functions, whose shapes others need."""

    def __init__(self, spark: SparkSession, entries: DataFrame, config: Config | None = None, deps: DataFrame | None = None, previous: dict[str, DataFrame] | None = None, data: dict[str, DataFrame] | None = None):
        self.spark, self.config, self.deps, self.previous = spark, config or Config(), deps, previous
        self.entries = materialize(self._scanned(entries), "entries")
        self.data = data or {}  # configuration tables by schema.table
        self.tables: dict[str, DataFrame] = {}
        self.tasks: dict[str, str] = {"prepass": "pending", "analyze": "pending", "merge": "pending"}

    def _scanned(self, entries: DataFrame) -> DataFrame:
        """Entries of the databases to scan, without the modules to leave out."""
        c = self.config
        rows = files.filter_databases(entries, c.include_databases, c.exclude_databases, c.archive_patterns)
        if not (c.exclude_names or c.exclude_schemas):
            return rows
        module = F.col("type").isin(*MODULE_TYPES)
        kept = files.filter_modules(rows.where(module), c.exclude_names, c.exclude_schemas)
        return rows.where(~module).unionByName(kept)

    @classmethod
    def from_scripts(cls, spark: SparkSession, batches: DataFrame, config: Config | None = None, extra: list[Entry] = (), **more) -> LineageSession:
        rows = files.entries(_spread(batches))
        if extra:
            rows = spark.createDataFrame([files.pack(e) for e in extra], files.ENTRY).unionByName(rows)
        return cls(spark, rows, config, **more)

    # plan

    def plan(self) -> DataFrame:
        """Two tasks for each database, prepass first, large databases first within a phase."""
        size = self.entries.groupBy("server", "database").agg(F.sum(F.length(F.coalesce("definition", F.lit("")))).alias("DefinitionBytes"), F.count("*").alias("Objects"))
        phases = self.spark.createDataFrame([(1, "prepass"), (2, "analyze")], "Phase int, Kind string")
        both = size.join(F.broadcast(phases))  # two rows
        return both.select("Phase", "Kind", F.concat_ws("__", "server", "database").alias("Id"), F.col("server").alias("Server"), F.col("database").alias("Database"), "DefinitionBytes", F.when(F.col("Kind") == "prepass", self.tasks["prepass"]).otherwise(self.tasks["analyze"]).alias("Status")).orderBy("Phase", F.desc("DefinitionBytes"), "Id")

    def status(self) -> dict[str, str]:
        return dict(self.tasks)

    # analysis

    def _slim(self) -> DataFrame:
        """Catalog without the definitions nobody else needs."""
        return self.entries.where("type <> 'Script'").withColumn("definition", F.when(F.col("type").isin("View", "InlineTvf"), F.col("definition")))

    def _whole(self, facts: DataFrame) -> tuple | None:
        """Catalog and facts where they are few, else none."""
        slim, size = self._slim(), lambda *c: F.coalesce(F.sum(sum((F.length(F.coalesce(x, F.lit(""))) for x in c), F.lit(0))), F.lit(0))
        n = [slim.agg(F.count("*"), size(F.col("definition"), F.col("columns"))).first(), facts.agg(F.count("*"), size(F.array_join("values", ""))).first()]
        if n[0][0] + n[1][0] > FEW or n[0][1] + n[1][1] > SMALL:
            return None
        return sorted((r.asDict() for r in slim.collect()), key=lambda r: r["source"] or ""), [tuple(r) for r in facts.collect()]

    def prepass(self) -> dict:
        """Literals passed to parameters, and tables that code creates."""

        def run(frames):
            for f in frames:
                out = []
                for r in f.to_dict("records"):
                    e = files.unpack(r)
                    calls, made = facts(e)
                    for callee, p, v in calls:
                        out.append(("arg", e.server, e.database, callee, p, v))
                    for name, columns in made:
                        out.append(("table", e.server, e.database, ".".join(name), None, None if columns is None else json.dumps([[c.name, c.type, c.identity, c.computed] for c in columns])))
                yield pd.DataFrame(out, columns=["kind", "server", "database", "name", "param", "value"])

        mods = self.entries.where(F.col("type").isin(*MODULE_TYPES) & F.col("definition").isNotNull())
        rows = _spread(mods).mapInPandas(run, "kind string, server string, database string, name string, param string, value string")
        found = rows.distinct().groupBy("kind", "server", "database", "name", "param").agg(F.slice(F.array_sort(F.collect_set("value")), 1, 32).alias("values"), F.count("*").alias("n"))
        found = materialize(found, "facts")
        self.tasks["prepass"] = "done"
        return {"facts": found}

    def signature(self) -> str:
        """Hash of what module text alone doesn't say: settings, and the shapes of all objects."""
        c = self.config
        shapes = self.entries.where("type <> 'Script'").select(F.concat_ws(".", "server", "database", "schema", "name").alias("name"), F.concat_ws("|", "type", "columns", F.when(F.col("type").isin("View", "InlineTvf", "Synonym"), F.concat_ws("|", "definition", F.concat_ws(".", "target")))).alias("shape"))
        return tables.engine_signature(shapes, VERSION, json.dumps([c.settings, c.linked_servers], sort_keys=True, default=str), json.dumps(c.archive_patterns))

    def _same_engine(self) -> bool:
        """Whether the previous run saw the same settings and shapes; a run without a signature is taken at its word."""
        old = self.previous.get("Summary")
        signs = [] if old is None else [r[0] for r in old.select("EngineSignature").where("EngineSignature is not null").distinct().limit(2).collect()]
        return not signs or signs == [self.signature()]

    def _config_values(self) -> dict[str, list[str]]:
        """Values of the configuration columns that were asked for, for names that come from tables."""
        out = {}
        for column, most in self.config.config_tables.items():
            table, _, name = column.rpartition(".")
            if table in self.data:
                out[fold(column)] = files.config_values(self.data[table], name, most)
        return out

    def analyze(self, prepass: dict | None = None) -> dict[str, DataFrame]:
        """Rows of all tables from all modules; modules a previous run answers are taken from there."""
        known = (prepass or self.prepass())["facts"]
        whole, config = self._whole(known), self.config
        settings, patterns, run_id = DEFAULTS | config.settings | {"config_values": self._config_values(), "linked_servers": config.linked_servers}, config.archive_patterns, config.run_id
        mods = self.entries.where(F.col("type").isin(*MODULE_TYPES)).withColumn("DefinitionHash", tables.definition_hash(F.coalesce("definition", F.lit(""))))
        by = ["Server", "Database", "ModuleSchema", "ModuleName"]
        named = mods.withColumnsRenamed({"server": "Server", "database": "Database", "schema": "ModuleSchema", "name": "ModuleName"})
        reused = None
        if self.previous is not None and self._same_engine():
            reused, named = tables.split_reusable(named, self.previous["Modules"], by)
        todo = named.withColumnsRenamed({"Server": "server", "Database": "database", "ModuleSchema": "schema", "ModuleName": "name"})

        def one(catalog, e, r, args):
            row, more, first = analyze(catalog, e, {"args": args}, settings, run_id)
            row |= {"DefinitionHash": r["DefinitionHash"]}
            out = [("Modules", json.dumps(row))]
            out += [(t, json.dumps(x)) for t, xs in more.items() for x in xs]
            return out + [("ResultSet", json.dumps({"Server": e.server, "Database": e.database, "Schema": e.schema, "Object": e.name, "Ordinal": i + 1, "Name": n})) for i, n in enumerate(first)]

        todo = todo.select(*[c.split()[0] for c in files.ENTRY.split(", ")], "DefinitionHash")
        if whole is None:
            raw = lookup.analysed(todo, lookup.index(self._slim(), known), lookup.literals(known), patterns, _spread, one)
        else:
            shared = self.spark.sparkContext.broadcast(whole)

            def run(frames):
                catalog, args = _catalog(shared.value, patterns)
                for f in frames:
                    out = [x for r in f.to_dict("records") for x in one(catalog, files.unpack(r), r, args)]
                    yield pd.DataFrame(out, columns=["table", "payload"])

            raw = materialize(_spread(todo).mapInPandas(run, "table string, payload string"), "analysis")
        part = lambda t, s: raw.where(F.col("table") == t).select(F.from_json("payload", s).alias("r")).select("r.*")
        for t in ROW_TABLES:
            self.tables[t] = part(t, schema(t))
            if reused is not None and t in self.previous:
                kept = tables.restore_rows(self.previous[t], reused, by, run_id)
                self.tables[t] = self.tables[t].unionByName(kept.withColumn("Reused", F.lit(True)) if t == "Modules" else kept)
        if self.deps is not None:  # what can't be read refers to what the server's catalog says it does
            by = ["Server", "Database", "ModuleSchema", "ModuleName"]
            unread = self.tables["Modules"].where(F.col("ParseStatus").isin(*UNREAD)).select("RunId", *by, "ModuleType")
            ref = {"StatementNo": F.lit(0), "StatementType": F.lit("CATALOG"), "Line": F.lit(0), "Action": F.lit("References"), "ObjectServer": F.col("ReferencedServer"), "ObjectDatabase": F.col("ReferencedDatabase"), "ObjectSchema": F.col("ReferencedSchema"), "ObjectName": F.col("ReferencedName"), "ObjectType": F.lit("Unresolved"), "Provenance": F.lit("Catalog"), "Confidence": F.lit("Medium"), "Note": F.lit("")}
            rows = self.deps.join(unread, by)
            rows = rows.select(*[(ref[f.name] if f.name in ref else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema("ObjectLineage")])
            self.tables["ObjectLineage"] = self.tables["ObjectLineage"].unionByName(rows)
        self.tables["ResultSets"] = part("ResultSet", "Server string, Database string, Schema string, Object string, Ordinal int, Name string")
        self.tasks["analyze"] = "done"
        return self.tables

    # merging

    def triggers(self) -> DataFrame:
        parent = F.col("parent")
        return self.entries.where("type = 'Trigger' and parent is not null").select(F.col("server").alias("Server"), F.col("database").alias("Database"), F.when(F.size(parent) > 1, F.element_at(parent, -2)).otherwise("dbo").alias("ParentSchema"), F.element_at(parent, -1).alias("ParentName"), F.col("schema").alias("TriggerSchema"), F.col("name").alias("TriggerName"), F.col("events").alias("Events"), F.lit(False).alias("Disabled"))

    def merge(self) -> dict[str, DataFrame]:
        """Deduplicate, propagate effects, collapse, check against catalog dependencies, summarise."""
        t, c = self.tables, self.config
        for name in tables.DEDUPED:
            if c.dedup:
                t[name] = tables.concat_parts([t[name]], name)
        extra = closure.interprocedural(t["ObjectLineage"], self.triggers(), c.max_call_depth)
        t["Collapsed"] = closure.collapse(t["ColumnLineage"], t["ObjectLineage"], t["ResultSets"], c.max_collapse_depth)
        t["ObjectLineage"] = materialize(t["ObjectLineage"].unionByName(extra.select(*t["ObjectLineage"].columns)), "object-lineage")
        missed = None
        if self.deps is not None:
            by = ["Server", "Database", "ModuleSchema", "ModuleName"]
            deps = self.deps.withColumn("name_key", F.upper("ReferencedName"))
            seen = t["ObjectLineage"].select(*by, F.upper("ObjectName").alias("name_key"))
            t["CatalogDeps"] = tables.cross_check(deps, seen, [*by, "name_key"]).drop("name_key")
            missed = t["CatalogDeps"].where("not FoundInAnalysis")
            t["Unresolved"] = t["Unresolved"].unionByName(missed.select(F.lit(c.run_id).alias("RunId"), *by, F.lit(0).alias("StatementNo"), F.lit(0).alias("Line"), F.lit("CatalogDepMissed").alias("Kind"), F.lit("warning").alias("Severity"), F.col("ReferencedName").alias("Name"), F.lit("").alias("Note")))
        who = ["RunId", "Server", "Database"]
        t["Summary"] = tables.summary(t["Modules"], t["DynamicSql"], t["Unresolved"]).withColumn("EngineSignature", F.lit(self.signature())).select(*[f.name for f in schema("Summary")])
        t["TopIssues"] = tables.top_issues(t["Unresolved"], [*who, "ModuleSchema", "ModuleName"]).join(t["Modules"].select(*who, "ModuleSchema", "ModuleName", "ParseStatus"), [*who, "ModuleSchema", "ModuleName"], "left")
        t["UnresolvedByKind"] = tables.unresolved_by_kind(t["Unresolved"], who)
        self.tasks["merge"] = "done"
        return t

    def run_all(self) -> dict[str, DataFrame]:
        self.analyze(self.prepass())
        return self.merge()

    # queries

    def _address(self, text: str) -> DataFrame:
        """Nodes of Collapsed that an address means: of its server and database where it names them."""
        c = self.tables["Collapsed"]
        both = [c.select(*[F.col(s + x).alias(x) for x in ("Server", "Database", "Schema", "Object", "Column")]) for s in ("Source", "Target")]
        nodes = both[0].unionByName(both[1]).distinct()
        known = {r.Database for r in nodes.select("Database").distinct().collect()} | {r.database for r in self.entries.select("database").distinct().collect()}
        a = parse_address(text, known)
        same = [fold_column(F.col(x)) == fold(a[x.lower()]) for x in ("Server", "Database", "Schema", "Object", "Column") if a[x.lower()] is not None]
        return nodes.where(reduce(lambda x, y: x & y, same)).drop("Server").distinct()

    def query(self, address: str, direction: str = "upstream") -> DataFrame:
        """Ends of walks from a node, ``upstream``, ``downstream`` or ``both``."""
        return closure.query_terminals(self.tables["Collapsed"], self._address(address), direction, self.config.max_query_hops, self.config.max_query_rows).withColumn("RunId", F.lit(self.config.run_id)).select(*[f.name for f in schema("Query")])

    def graph(self, address: str, fmt: str = "dot", columns: bool = False) -> str:
        c = self.tables["Collapsed"]
        cols = ("Database", "Schema", "Object", "Column") if columns else ("Database", "Schema", "Object")
        name = lambda s: F.concat_ws(".", *[F.col(s + x) for x in cols])
        e = c.select(name("Source").alias("src"), name("Target").alias("dst"), F.col("FlowKind").alias("kind"), F.concat_ws(".", "ModuleSchema", "ModuleName").alias("module"))
        starts = self._address(address).select(F.concat_ws(".", *cols).alias("node"))
        return sinks.graph_text(closure.subgraph(e, starts, self.config.graph_hops), fmt)

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            if name in DDL:
                sinks.write_table(df, path, name)


def module_key(df: DataFrame) -> DataFrame:
    return df.withColumn("module", node_key(*[F.col(c) for c in closure.MODULE_KEY]))


def register(spark: SparkSession) -> None:
    """``tsql_edges(text)`` as a table function: column edges of one batch with no catalog."""
    from pyspark.sql.functions import udtf

    class ColumnEdges:
        def eval(self, text: str):
            for e in files.entries_of("batch", 1, text):
                if e.definition:
                    _, rows, _ = analyze(Catalog(files.entries_of("batch", 1, text)), e)
                    for r in rows["ColumnLineage"]:
                        yield r["SourceObject"], r["SourceColumn"], r["TargetObject"], r["TargetColumn"], r["FlowKind"], r["Confidence"]

    spark.udtf.register("tsql_edges", udtf(ColumnEdges, returnType="SourceObject string, SourceColumn string, TargetObject string, TargetColumn string, FlowKind string, Confidence string"))
