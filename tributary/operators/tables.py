"""Set-oriented operators over the row tables: concatenation, summaries, incremental reuse, checks, views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.names import fold_column
from tributary.schemas import ERRORS, INFOS

DEDUPED = ("ColumnLineage", "ObjectLineage")


def concat_parts(parts: list[DataFrame], table: str | None = None, dedup: bool = True) -> DataFrame:
    """Union by name of part tables; lineage tables lose rows that are equal in all columns."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.dropDuplicates() if dedup and (table is None or table in DEDUPED) else out


def ratio(part: Column, whole: Column) -> Column:
    """Rounded to four places; one where there is nothing to divide."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / F.when(whole == 0, 1).otherwise(whole), 4))


def summary(modules: DataFrame, dynamic: DataFrame, unresolved: DataFrame, missed: DataFrame | None = None) -> DataFrame:
    """Per database: modules by status, edges, and how much was parsed, bound and resolved."""
    by = ["RunId", "Server", "Database"]
    status = F.col("ParseStatus")
    count = lambda c: F.count_if(c).cast("int")
    m = modules.groupBy(*by).agg(
        F.count("*").cast("int").alias("Modules"),
        count(status == "Parsed").alias("Parsed"),
        count(status == "ParsedWithHoles").alias("ParsedWithHoles"),
        count(status == "Quarantined").alias("Quarantined"),
        count(status.startswith("NoDefinition")).alias("NoDefinition"),
        count(status.isin("Error", "Timeout", "DefinitionSizeLimit")).alias("Errors"),
        *[F.sum(c).cast("int").alias(c) for c in ("Statements", "ColumnEdges", "ObjectEdges", "UnresolvedNames", "ElapsedMs")],
        count(F.col("Reused")).alias("ReusedModules"),
    )
    d = dynamic.groupBy(*by).agg(F.count("*").cast("int").alias("DynamicSites"), count(F.col("Status").isin("Exact", "Executor")).alias("DynamicResolved"))
    u = (missed if missed is not None else unresolved.where("Kind = 'CatalogDepMissed'")).groupBy(*by).agg(F.count("*").cast("int").alias("CatalogDepsMissed"))
    out = m.join(d, by, "left").join(u, by, "left").na.fill(0, ["DynamicSites", "DynamicResolved", "CatalogDepsMissed"])
    out = out.withColumn("ParseRate", ratio(F.col("Parsed") + F.col("ParsedWithHoles"), F.col("Modules") - F.col("NoDefinition")))
    out = out.withColumn("BindRate", ratio(F.col("ColumnEdges") + F.col("ObjectEdges"), F.col("ColumnEdges") + F.col("ObjectEdges") + F.col("UnresolvedNames")))
    return out.withColumn("DynamicResolutionRate", ratio(F.col("DynamicResolved"), F.col("DynamicSites")))


def severity_of(kind: Column) -> Column:
    return F.when(kind.isin(*ERRORS), "error").when(kind.isin(*INFOS), "info").otherwise("warning")


def top_issues(unresolved: DataFrame, by: list[str], kinds: int = 5, limit: int | None = 5000) -> DataFrame:
    """Per module: issues, errors, warnings and its most frequent kinds as ``kind=n; kind=n``."""
    per = unresolved.groupBy(*by, "Kind").agg(F.count("*").alias("n"), F.count_if(F.col("Severity") == "error").alias("e"), F.count_if(F.col("Severity") == "warning").alias("w"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "Kind")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= kinds, F.struct("r", F.concat("Kind", F.lit("="), F.col("n").cast("string")).alias("t"))))), lambda x: x["t"]), "; ")
    out = ranked.groupBy(*by).agg(F.sum("n").alias("Issues"), F.sum("e").alias("Errors"), F.sum("w").alias("Warnings"), text.alias("TopKinds"))
    return out.orderBy(F.desc("Errors"), F.desc("Issues"), *by).limit(limit) if limit else out


def unresolved_by_kind(unresolved: DataFrame, by: list[str]) -> DataFrame:
    """Per kind: how many, how many distinct names (case apart), and the first name in order."""
    return unresolved.groupBy(*by, "Kind").agg(F.count("*").alias("Count"), F.countDistinct(fold_column(F.col("Name"))).alias("DistinctNames"), F.min("Name").alias("Example"))


def definition_hash(text: Column) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, 32))


def engine_signature(shapes: DataFrame, *settings: str) -> str:
    """Hash of settings and of all object shapes ``(name, shape)``: a change re-analyses the whole database.

    Shapes are hashed one by one and the hashes' sorted list once more, in two levels, so no long text is built.
    """
    level = shapes.select(F.sha2(F.concat_ws("\x1f", "name", "shape"), 256).alias("h")).groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    total = level.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")).first()["h"]  # at most 4096 hashes
    return level.sparkSession.range(1).select(definition_hash(F.lit("\x1f".join([*settings, total or ""])))).first()[0]


def split_reusable(modules: DataFrame, previous: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Modules that a previous run answers (same hash, no error or timeout then), and the rest."""
    fine = previous.where(~F.col("ParseStatus").isin("Error", "Timeout")).select(*by, "DefinitionHash").distinct()
    return modules.join(fine, [*by, "DefinitionHash"], "left_semi"), modules.join(fine, [*by, "DefinitionHash"], "left_anti")


def restore_rows(previous: DataFrame, reused: DataFrame, by: list[str], run_id: str) -> DataFrame:
    """Rows of reused modules from the previous run, without what merging adds anew."""
    rows = previous.join(reused.select(*by).distinct(), by, "left_semi").withColumn("RunId", F.lit(run_id))
    if "Provenance" in rows.columns:
        rows = rows.where(~F.col("Provenance").isin("Interprocedural", "Trigger"))
    if "Kind" in rows.columns:
        rows = rows.where("Kind <> 'CatalogDepMissed'")
    return rows.select(*previous.columns)


def cross_check(deps: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Catalog dependencies with ``FoundInAnalysis``: whether analysis of the module met the name."""
    met = seen.select(*on).distinct().withColumn("hit", F.lit(True))
    return deps.join(met, on, "left").withColumn("FoundInAnalysis", F.coalesce("hit", F.lit(False))).drop("hit")


def match_patterns(patterns: DataFrame, names: DataFrame, cap: int | None = 50) -> DataFrame:
    """``(pattern, name)`` for LIKE patterns, at most ``cap`` names of each, first in order.

    Patterns with a literal start meet only names with that start, by equality of its first three characters;
    the others are few and are broadcast below Spark's size bound.
    """
    p = patterns.select("pattern").distinct().withColumn("lead", F.upper(F.regexp_extract("pattern", "^([^%_]*)", 1)))
    n = names.select("name").distinct()
    led, free = p.where(F.length("lead") >= 3), p.where(F.length("lead") < 3)
    like = F.expr("upper(name) LIKE upper(pattern)")
    hit = led.withColumn("k", F.substring("lead", 1, 3)).join(n.withColumn("k", F.upper(F.substring("name", 1, 3))), "k").where(like).select("pattern", "name")
    hit = hit.unionByName(free.join(n, like).select("pattern", "name"))
    if cap:
        hit = hit.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("name"))).where(F.col("r") <= cap).drop("r")
    return hit


def decode_entities(text: Column) -> Column:
    """HTML entities decoded, if there are any and the text has no raw angle bracket."""
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit(">")), text).otherwise(out)


def latest_run(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the last run of each group."""
    last = rows.groupBy(*by).agg(F.max("RunId").alias("RunId"))
    return rows.join(last, [*by, "RunId"], "left_semi")


def nodes(edges: DataFrame) -> DataFrame:
    """All nodes of an edge table, once."""
    part = lambda s: edges.select(*[F.col(s + c).alias(c) for c in ("Server", "Database", "Schema", "Object", "ObjectType", "Column") if s + c in edges.columns])
    return part("Source").unionByName(part("Target"), allowMissingColumns=True).distinct()


def object_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges between objects."""
    return edges.select(*[F.col(s + c) for s in ("Source", "Target") for c in ("Server", "Database", "Schema", "Object")], "FlowKind").distinct()


def views(session, tables: dict[str, DataFrame]) -> None:
    """Register the query layer over stored tables as temporary views."""
    by = ["Server", "Database"]
    latest = {k: latest_run(v, by) for k, v in tables.items() if {"RunId", *by} <= set(v.columns)}
    latest["Modules"].select("RunId", *by).distinct().createOrReplaceTempView("vw_LatestRun")
    latest["Collapsed"].createOrReplaceTempView("vw_ColumnEdges")
    latest["ColumnLineage"].createOrReplaceTempView("vw_ColumnEdgesDetail")
    object_edges(latest["Collapsed"]).createOrReplaceTempView("vw_ObjectEdges")
    nodes(latest["Collapsed"]).createOrReplaceTempView("vw_Nodes")
