"""Offline sources: SQL script folders, catalog tables, CSV parts, configuration and plans."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.schemas import schema
from tributary.tsql.analyze import normalise
from tributary.tsql.model import Catalog, Column, Entry
from tributary.tsql.parser import parse

GO = r"(?im)^[ \t]*GO(?:[ \t]+\d+)?[ \t]*(?:--[^\n]*)?\r?$"
SERVER = DATABASE = "FILES"
ENTRY = "server string, database string, schema string, name string, type string, columns string, params array<string>, definition string, target array<string>, parent array<string>, events string, source string"
#: Type codes of a server's catalog (fixed values).
TYPE_CODES = {"U": "Table", "V": "View", "P": "Procedure", "PC": "ClrModule", "FN": "ScalarFunction", "IF": "InlineTvf", "TF": "MsTvf", "FS": "ClrModule", "FT": "ClrModule", "TR": "Trigger", "SN": "Synonym", "SO": "Sequence", "ET": "External", "X": "External"}


def split_batches(text: str) -> list[str]:
    return [b for b in re.split(GO, text.removeprefix("\ufeff")) if b.strip()]


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, batch, text)``: scripts under ``path`` cut at GO, in the order of their names."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(path)
    cut = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), GO)).alias("batch", "text"))
    return cut.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), (F.col("batch") + 1).alias("batch"), "text")


def read_script_table(rows: DataFrame, name: str, text: str) -> DataFrame:
    """Batches from a table of whole scripts."""
    cut = rows.select(F.col(name).cast("string").alias("file"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), GO)).alias("batch", "text"))
    return cut.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("file", (F.col("batch") + 1).alias("batch"), "text")


def entries_of(file: str, batch: int, text: str, server: str = SERVER, database: str = DATABASE) -> list[Entry]:
    """Catalog entries of one batch: tables and synonyms it creates, the module it is, or a script."""
    statements, _, _, _ = parse(normalise(text))
    two = lambda n: (n[-2] if len(n) > 1 and n[-2] else "dbo", n[-1])
    out: list[Entry] = []
    heads = [s for s in statements if s.kind in ("procedure", "view", "function", "trigger")]
    if heads and len([s for s in statements if s.kind != "noop"]) == 1:
        s = heads[0]
        kind = {"procedure": "Procedure", "view": "View", "trigger": "Trigger"}.get(s.kind) or ("InlineTvf" if s.inline else "MsTvf" if s.table_var else "ScalarFunction")
        e = Entry(server, database, *two(s.name), kind, params=[p.name for p in s.params or []], definition=text)
        if s.table_var:
            e.columns = [Column(c.name) for c in s.columns]
        if s.kind == "trigger":
            e.table, e.events = s.table, s.events
        return [e]
    for s in statements:
        if s.kind == "create_table" and not s.name[-1].startswith("#"):
            out.append(Entry(server, database, *two(s.name), "Table", [Column(c.name, c.type or "", bool(c.identity), bool(c.computed), (c.type or "").lower() in ("rowversion", "timestamp")) for c in s.columns]))
        elif s.kind == "create_synonym":
            out.append(Entry(server, database, *two(s.name), "Synonym", target=s.target))
    if not statements or any(s.kind not in ("create_table", "noop") for s in statements):
        out.append(Entry(server, database, "file", f"{file}#{batch}", "Script", definition=text))
    return out


def pack(e: Entry) -> tuple:
    columns = None if e.columns is None else json.dumps([[c.name, c.type, c.identity, c.computed, c.rowversion] for c in e.columns])
    return (e.server, e.database, e.schema, e.name, e.type, columns, e.params, e.definition, e.target, e.table, e.events, e.source)


def unpack(r) -> Entry:
    columns = None if r["columns"] is None else [Column(*c) for c in json.loads(r["columns"])]
    lists = lambda v: None if v is None else list(v)
    return Entry(r["server"], r["database"], r["schema"], r["name"], r["type"], columns, list(r["params"] if r["params"] is not None else []), r["definition"] or "", target=lists(r["target"]), table=lists(r["parent"]), events=r["events"] or "", source=r["source"] or "")


def entries(batches: DataFrame) -> DataFrame:
    """Catalog entries of all batches, parsed where the batches are."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for file, batch, text in zip(f["file"], f["batch"], f["text"], strict=True):
                for e in entries_of(file, int(batch), text):
                    e.source = f"{file}#{int(batch):08d}"
                    rows.append(pack(e))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return batches.mapInPandas(run, ENTRY)


def entries_of_catalog(objects: DataFrame, columns: DataFrame, modules: DataFrame, params: DataFrame, triggers: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Entries from a server's catalog tables (see ``cat_*`` in the README); type codes become names."""
    key = ["server", "database", "object_id"]
    kind = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    cols = columns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("column_id", "name", "type_name", "is_identity", "is_computed"))).alias("c"))
    cols = cols.select(*key, F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: F.to_json(F.array(x["name"], x["type_name"], x["is_identity"].cast("string"), x["is_computed"].cast("string")))), ","), F.lit("]")).alias("columns"))
    cols = cols.withColumn("columns", F.regexp_replace(F.regexp_replace("columns", '"true"', "true"), '"false"', "false"))
    ps = params.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("parameter_id", "name"))), lambda x: x["name"]).alias("params"))
    out = objects.join(cols, key, "left").join(ps, key, "left").join(modules.select(*key, "definition"), key, "left")
    out = out.join(triggers.select(*key, F.array("parent_schema", "parent_name").alias("parent"), "events"), key, "left").join(synonyms.select(*key, F.split("base_object_name", r"\.").alias("target")), key, "left")
    return out.select("server", "database", "schema", "name", kind[F.trim("type_code")].alias("type"), "columns", F.coalesce("params", F.array().cast("array<string>")).alias("params"), "definition", "target", "parent", "events", F.lit("").alias("source"))


def entries_of_job_steps(steps: DataFrame) -> DataFrame:
    """Entries from ``(server, database, job, step_id, command)``; filter steps first."""
    text = lambda s: F.lit(s)
    none = {"columns": "string", "target": "array<string>", "parent": "array<string>"}
    values = {"schema": text("job"), "name": F.concat_ws("#", "job", F.col("step_id").cast("string")), "type": text("JobStep"), "params": F.array().cast("array<string>"), "definition": F.col("command"), "events": text(""), "source": F.concat_ws("#", "job", F.lpad(F.col("step_id").cast("string"), 8, "0"))}
    return steps.select(*[(values.get(c) if c in values else F.lit(None).cast(none[c]) if c in none else F.col(c)).alias(c) for c in (x.split()[0] for x in ENTRY.split(", "))])


def entries_of_tables(spark: SparkSession, tables: dict[str, DataFrame], schema_name: str = "dbo") -> list[Entry]:
    """Entries from the schemas of data frames."""
    return [Entry(SERVER, DATABASE, schema_name, n, "Table", [Column(f.name, f.dataType.simpleString()) for f in df.schema]) for n, df in tables.items()]


def catalog_of(rows, archive_patterns: list[str] | None = None) -> Catalog:
    return Catalog([unpack(r) for r in rows], archive_patterns)


def filter_databases(df: DataFrame, include: list[str], exclude: list[str], archive_patterns: list[str] = ()) -> DataFrame:
    """Databases to scan: those included (``*`` for all) but for excluded ones and archives."""
    up = F.upper("database")
    out = df if "*" in include else df.where(up.isin([x.upper() for x in include]))
    out = out.where(~up.isin([x.upper() for x in exclude]))
    for p in archive_patterns:
        out = out.where(~F.col("database").rlike(f"(?i){p}") | (F.upper(F.regexp_extract("database", f"(?i){p}", 1)) == up))
    return out


def filter_modules(df: DataFrame, name_contains: list[str] = (), schemas: list[str] = ()) -> DataFrame:
    out = df.where(~F.upper("schema").isin([s.upper() for s in schemas])) if schemas else df
    for part in name_contains:
        out = out.where(~F.contains(F.upper("name"), F.lit(part.upper())))
    return out


def filter_job_steps(df: DataFrame, exclude_databases: list[str] = ()) -> DataFrame:
    return df.where((F.upper("subsystem") == "TSQL") & ~F.upper(F.coalesce("database", F.lit(""))).isin([d.upper() for d in exclude_databases]))


def config_values(df: DataFrame, column: str, most: int) -> list[str]:
    """Distinct values of a configuration table's column, ``most`` at most."""
    return [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(most).collect()]


def read_csv_part(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A part written as CSV (or .csv.gz): columns by header name, missing ones null, any order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = {c.lower(): c for c in raw.columns}
    return raw.select(*[(F.col(names[f.name.lower()]) if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def read_json(path: str) -> dict:
    """Configuration with comments and trailing commas."""
    text = Path(path).read_text(encoding="utf-8-sig")
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
