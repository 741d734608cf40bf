"""Registered queries of the lineage operators over the star-schema tables, and their SQL.

Foreign keys serve as column edges, conversations as calls, events as runs and issues: graphs with cycles of
depth and skew of their own, for which plain SQL gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import corpus
from tributary.functions import dialect
from tributary.operators import closure, tables
from tributary.plans import etl, session
from tributary.schemas import schema
from tributary.sources import files


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(df: DataFrame, source: tuple, target: tuple, kind, conf, module: str = "load") -> DataFrame:
    """ColumnLineage rows; ``source`` and ``target`` are (type, object prefix, id column)."""
    values = {"RunId": F.lit("r1"), "Server": F.lit("S"), "Database": F.lit("D"), "ModuleSchema": F.lit("dbo"), "ModuleName": F.lit(module), "ModuleType": F.lit("Procedure"), "FlowKind": kind, "Confidence": conf, "Provenance": F.lit("Static")}
    for side, (type_, prefix, key) in (("Source", source), ("Target", target)):
        values |= {side + "Server": F.lit("S"), side + "Database": F.lit("D"), side + "Schema": F.lit("dbo"), side + "ObjectType": F.lit(type_), side + "Object": F.concat(F.lit(prefix), F.col(key).cast("string")), side + "Column": F.lit("k")}
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema("ColumnLineage")])


def _fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region → nation (view) → customer (temp) → orders (table)."""
    nation, customer, orders = (_t(spark, sf_dir, n) for n in ("nation", "customer", "orders"))
    one = _edges(nation, ("Table", "R", "n_regionkey"), ("View", "N", "n_nationkey"), F.lit("Direct"), F.lit("Exact"))
    two = _edges(customer, ("View", "N", "c_nationkey"), ("TempTable", "#C", "c_custkey"), F.when(F.col("c_acctbal") < 0, "Expression").otherwise("Direct"), F.when(F.col("c_mktsegment") == "BUILDING", "Medium").otherwise("Exact"))
    three = _edges(orders, ("TempTable", "#C", "o_custkey"), ("Table", "O", "o_orderkey"), F.when(F.col("o_orderstatus") == "F", "Aggregate").otherwise("Direct"), F.lit("High"))
    return one.unionByName(two).unionByName(three)


def collapse_fk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = closure.collapse(_fk_edges(spark, sf_dir))
    return out.select("SourceObject", "SourceObjectType", "TargetObject", "FlowKind", F.col("Hops").cast("bigint").alias("Hops"), "Path", "Confidence")


SQL: dict[str, str] = {}
SQL["collapse_fk_paths"] = """
SELECT 'R' || n_regionkey AS "SourceObject", 'Table' AS "SourceObjectType", 'O' || o_orderkey AS "TargetObject",
  CASE WHEN o_orderstatus = 'F' THEN 'Aggregate' WHEN c_acctbal < 0 THEN 'Expression' ELSE 'Direct' END AS "FlowKind",
  CAST(3 AS BIGINT) AS "Hops",
  'dbo.R' || n_regionkey || '.k → dbo.N' || n_nationkey || '.k → dbo.#C' || c_custkey || '.k → dbo.O' || o_orderkey || '.k' AS "Path",
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Medium' ELSE 'High' END AS "Confidence"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def _calls(df: DataFrame, caller, callee) -> DataFrame:
    return _object_rows(df, ModuleName=caller, Action=F.lit("Calls"), ObjectName=callee, ObjectType=F.lit("Procedure"))


def collapse_shared_temps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's loader reads #t, which its callee fills: column by column, or from ``*`` of a table of unknown shape."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("n"), (F.col("c_custkey") % 3).alias("how"))
    load, fill = F.concat(F.lit("load"), "k"), F.concat(F.lit("fill"), "k")

    def edge(rows: DataFrame, module, source: tuple, target: tuple) -> DataFrame:
        values = {"RunId": F.lit("r1"), "Server": F.lit("S"), "Database": F.lit("D"), "ModuleSchema": F.lit("dbo"), "ModuleName": module, "ModuleType": F.lit("Procedure"), "FlowKind": F.lit("Direct"), "Confidence": F.lit("Exact"), "Provenance": F.lit("Static")}
        for side, (type_, schema_name, name, column) in (("Source", source), ("Target", target)):
            values |= {side + "Server": F.lit("S"), side + "Database": F.lit("D"), side + "Schema": schema_name, side + "Object": name, side + "ObjectType": F.lit(type_), side + "Column": F.lit(column)}
        return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema("ColumnLineage")])

    dbo, temp = F.lit("dbo"), F.lit("#t")
    out = edge(c, load, ("TempTable", F.concat(F.lit("dbo."), load), temp, "k"), ("Table", dbo, F.concat(F.lit("O"), "k"), "k"))
    here = ("TempTable", F.concat(F.lit("dbo."), fill), temp)
    out = out.unionByName(edge(c.where("how = 0"), fill, ("Table", dbo, F.concat(F.lit("N"), "n"), "k"), (*here, "k")))
    out = out.unionByName(edge(c.where("how = 1"), fill, ("Unresolved", dbo, F.concat(F.lit("N"), "n"), "*"), (*here, "*")))
    return closure.collapse(out, _calls(c, load, fill)).select("ModuleName", "SourceObject", "SourceColumn", "TargetObject", F.col("Hops").cast("bigint").alias("Hops"))


SQL["collapse_shared_temps"] = """
SELECT 'load' || c_custkey AS "ModuleName", CASE WHEN c_custkey % 3 = 2 THEN '#t' ELSE 'N' || c_nationkey END AS "SourceObject",
  CASE WHEN c_custkey % 3 = 1 THEN '*' ELSE 'k' END AS "SourceColumn", 'O' || c_custkey AS "TargetObject",
  CAST(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 2 END AS BIGINT) AS "Hops"
FROM customer
"""


def collapse_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers → a nation's two views → its table; each of the two start edges emits five rows at most."""
    nation, supplier, customer = (_t(spark, sf_dir, n) for n in ("nation", "supplier", "customer"))
    kind, conf = F.lit("Direct"), F.lit("Exact")
    e = _edges(nation, ("View", "VS", "n_nationkey"), ("Table", "T", "n_nationkey"), kind, conf)
    e = e.unionByName(_edges(nation, ("View", "VC", "n_nationkey"), ("Table", "T", "n_nationkey"), kind, conf))
    e = e.unionByName(_edges(supplier, ("Table", "S", "s_suppkey"), ("View", "VS", "s_nationkey"), kind, conf))
    e = e.unionByName(_edges(customer, ("Table", "C", "c_custkey"), ("View", "VC", "c_nationkey"), kind, conf))
    out = closure.collapse(e, budget=5, wide=0)
    return out.select("SourceObject", "TargetObject", F.col("Hops").cast("bigint").alias("Hops"), "Path")


SQL["collapse_budget"] = """
WITH p AS (
  SELECT 'S' || s_suppkey AS s, 'VS' || n_nationkey AS v, 'T' || n_nationkey AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'VC' || n_nationkey, 'T' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'VS' || n_nationkey, 'VS' || n_nationkey, 'T' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'VC' || n_nationkey, 'VC' || n_nationkey, 'T' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)),
q AS (SELECT *, 'dbo.' || s || '.k → ' || CASE WHEN s = v THEN '' ELSE 'dbo.' || v || '.k → ' END || 'dbo.' || t || '.k' AS path FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY path) AS n FROM q)
SELECT s AS "SourceObject", t AS "TargetObject", CAST(CASE WHEN s = v THEN 1 ELSE 2 END AS BIGINT) AS "Hops", path AS "Path" FROM r WHERE n <= 5
"""


def collapse_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of views, each over all of the layer below: region → nations' views, five layers → a table. Paths are
    many, rows few; from a path's kinds the strongest holds."""
    region = _t(spark, sf_dir, "region")
    pairs = region.select(F.col("r_regionkey").alias("a")).crossJoin(region.select(F.col("r_regionkey").alias("b")))  # five by five rows
    kind, conf = F.lit("Direct"), F.lit("Exact")
    e = _edges(region, ("Table", "R", "r_regionkey"), ("View", "V0_", "r_regionkey"), F.when(F.col("r_regionkey") == 0, "Aggregate").otherwise("Direct"), conf)
    for layer in range(1, 6):
        e = e.unionByName(_edges(pairs, ("View", f"V{layer - 1}_", "a"), ("View", f"V{layer}_", "b"), kind, conf))
    e = e.unionByName(_edges(region, ("View", "V5_", "r_regionkey"), ("Table", "T", "r_regionkey"), F.when(F.col("r_regionkey") == 1, "Expression").otherwise("Direct"), conf))
    return closure.collapse(e, wide=50).select("SourceObject", "TargetObject", "FlowKind", F.col("Hops").cast("bigint").alias("Hops"), "Path")


SQL["collapse_diamonds"] = """
SELECT 'R' || a.r_regionkey AS "SourceObject", 'T' || b.r_regionkey AS "TargetObject",
  CASE WHEN a.r_regionkey = 0 THEN 'Aggregate' WHEN b.r_regionkey = 1 THEN 'Expression' ELSE 'Direct' END AS "FlowKind", CAST(7 AS BIGINT) AS "Hops",
  'dbo.R' || a.r_regionkey || '.k → dbo.V0_' || a.r_regionkey || '.k → dbo.V1_0.k → dbo.V2_0.k → dbo.V3_0.k → dbo.V4_0.k → dbo.V5_' || b.r_regionkey || '.k → dbo.T' || b.r_regionkey || '.k' AS "Path"
FROM region a, region b
"""


def query_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges in two databases; a node of one of them, both ways."""
    one = _place_edges(spark, sf_dir).withColumn("Path", F.lit("")).withColumn("Hops", F.lit(1))
    names = [f.name for f in schema("Collapsed")]
    two = one.withColumn("SourceDatabase", F.lit("E")).withColumn("TargetDatabase", F.lit("E")).withColumn("SourceObject", F.concat(F.lit("E"), "SourceObject"))
    two = two.unionByName(one.withColumn("SourceDatabase", F.lit("E")).withColumn("TargetDatabase", F.lit("E")))
    s = session.LineageSession(spark, spark.createDataFrame([], files.ENTRY))
    s.tables["Collapsed"] = one.select(*names).unionByName(two.select(*names))
    out = s.query("D.dbo.N3", "both")
    return out.select("Direction", "StartNode", "StartColumn", "EndDatabase", "EndObject", "Hops", "TerminalReason", "Path")


SQL["query_by_address"] = """
SELECT 'upstream' AS "Direction", 'D.dbo.N3' AS "StartNode", 'k' AS "StartColumn", 'D' AS "EndDatabase", 'R' || n_regionkey AS "EndObject", 1 AS "Hops",
  'PHYSICAL_SOURCE' AS "TerminalReason", 'D.dbo.R' || n_regionkey || '.k → D.dbo.N3.k' AS "Path" FROM nation WHERE n_nationkey = 3
UNION ALL
SELECT 'downstream', 'D.dbo.N3', 'k', 'D', 'S' || s_suppkey, 1, 'PHYSICAL_SOURCE', 'D.dbo.N3.k → D.dbo.S' || s_suppkey || '.k' FROM supplier WHERE s_nationkey = 3
"""


def lineage_concat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return tables.concat_parts([rows, rows], "ColumnLineage")


SQL["lineage_concat_dedup"] = "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem"


def _place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed edges region → nation → supplier."""
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    one = _edges(nation, ("Table", "R", "n_regionkey"), ("Table", "N", "n_nationkey"), F.lit("Direct"), F.lit("Exact"), "m1")
    two = _edges(supplier, ("Table", "N", "s_nationkey"), ("Table", "S", "s_suppkey"), F.when(F.col("s_acctbal") < 0, "Indirect").otherwise("Expression"), F.when(F.col("s_acctbal") < 1000, "Low").otherwise("High"), "m2")
    return one.unionByName(two)


def _starts(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(F.lit("D").alias("Database"), F.lit("dbo").alias("Schema"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("Object"), F.lit("k").alias("Column"))


_QUERY = ("StartNode", "EndObject", "Hops", "FlowKind", "Confidence", "TerminalReason", "Path", "Modules")


def query_up_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = closure.query_terminals(_place_edges(spark, sf_dir), _starts(_t(spark, sf_dir, "supplier"), "S", "s_suppkey"), "upstream", max_rows=None)
    return out.select(*_QUERY)


_KIND = "CASE WHEN s_acctbal < 0 THEN 'Indirect' ELSE 'Expression' END"
_CONF = "CASE WHEN s_acctbal < 1000 THEN 'Low' ELSE 'High' END"
_PATH = "'D.dbo.R' || n_regionkey || '.k → D.dbo.N' || n_nationkey || '.k → D.dbo.S' || s_suppkey || '.k'"
SQL["query_up_terminals"] = f"""
SELECT 'D.dbo.S' || s_suppkey AS "StartNode", 'R' || n_regionkey AS "EndObject", 2 AS "Hops", {_KIND} AS "FlowKind", {_CONF} AS "Confidence",
  'PHYSICAL_SOURCE' AS "TerminalReason", {_PATH} AS "Path", 'dbo.m1 > dbo.m2' AS "Modules"
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def query_down_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = closure.query_terminals(_place_edges(spark, sf_dir), _starts(_t(spark, sf_dir, "region"), "R", "r_regionkey"), "downstream", max_rows=None)
    return out.select(*_QUERY)


SQL["query_down_terminals"] = f"""
SELECT 'D.dbo.R' || n_regionkey AS "StartNode", 'S' || s_suppkey AS "EndObject", 2 AS "Hops", {_KIND} AS "FlowKind", {_CONF} AS "Confidence",
  'PHYSICAL_SOURCE' AS "TerminalReason", {_PATH} AS "Path", 'dbo.m1 > dbo.m2' AS "Modules"
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'D.dbo.R' || n_regionkey, 'N' || n_nationkey, 1, 'Direct', 'Exact', 'PHYSICAL_SOURCE',
  'D.dbo.R' || n_regionkey || '.k → D.dbo.N' || n_nationkey || '.k', 'dbo.m1'
FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
"""


def fn_upstream_all_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = closure.all_hops(_place_edges(spark, sf_dir), _starts(_t(spark, sf_dir, "supplier"), "S", "s_suppkey"), "upstream")
    return out.select("StartNode", "EndObject", "Hops", "FlowKind", "Confidence")


SQL["fn_upstream_all_hops"] = f"""
SELECT 'D.dbo.S' || s_suppkey AS "StartNode", 'N' || s_nationkey AS "EndObject", 1 AS "Hops", {_KIND} AS "FlowKind", {_CONF} AS "Confidence" FROM supplier
UNION ALL
SELECT 'D.dbo.S' || s_suppkey, 'R' || n_regionkey, 2, 'Direct', 'Exact' FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def fn_downstream_all_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = closure.all_hops(_place_edges(spark, sf_dir), _starts(_t(spark, sf_dir, "region"), "R", "r_regionkey"), "downstream")
    return out.select("StartNode", "EndObject", "Hops", "FlowKind", "Confidence")


SQL["fn_downstream_all_hops"] = f"""
SELECT 'D.dbo.R' || n_regionkey AS "StartNode", 'N' || n_nationkey AS "EndObject", 1 AS "Hops", 'Direct' AS "FlowKind", 'Exact' AS "Confidence" FROM nation
UNION ALL
SELECT 'D.dbo.R' || n_regionkey, 'S' || s_suppkey, 2, {_KIND}, {_CONF} FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def subgraph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops around nation 3: its region, that region's nations, its customers."""
    nation, customer = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = nation.select(name("R", "n_regionkey").alias("src"), name("N", "n_nationkey").alias("dst"), F.lit("Direct").alias("kind"), F.lit("m1").alias("module"))
    e = e.unionByName(customer.select(name("N", "c_nationkey").alias("src"), name("C", "c_custkey").alias("dst"), F.lit("Direct").alias("kind"), F.lit("m2").alias("module")))
    return closure.subgraph(e, spark.createDataFrame([("N3",)], "node string"), 2)


SQL["subgraph_hops"] = """
SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'Direct' AS kind, 'm1' AS module FROM nation
WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'Direct', 'm2' FROM customer WHERE c_nationkey = 3
"""


def _object_rows(df: DataFrame, **columns) -> DataFrame:
    base = {"RunId": F.lit("r1"), "Server": F.lit("S"), "Database": F.lit("D"), "ModuleSchema": F.lit("dbo"), "ModuleType": F.lit("Procedure"), "StatementNo": F.lit(1), "StatementType": F.lit("EXEC"), "Line": F.lit(1), "ObjectServer": F.lit("S"), "ObjectDatabase": F.lit("D"), "ObjectSchema": F.lit("dbo"), "Provenance": F.lit("Static"), "Confidence": F.lit("Exact")} | columns
    return df.select(*[base.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema("ObjectLineage")])


def interprocedural_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns call the next turn of their conversation; each turn writes a table named by its role."""
    c = _t(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("none")).alias("role")).groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    me = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    after = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") + 1).cast("string"))
    calls = _object_rows(c, ModuleName=me, Action=F.lit("Calls"), ObjectName=after, ObjectType=F.lit("Procedure"))
    writes = _object_rows(c, ModuleName=me, Action=F.lit("Insert"), ObjectName=F.concat(F.lit("t_"), F.col("role")), ObjectType=F.lit("Table"))
    out = closure.interprocedural(calls.unionByName(writes), max_depth=8)
    return out.select("ModuleName", "Action", "ObjectName", "Provenance", "Confidence", F.size(F.split("Note", " > ")).cast("bigint").alias("Depth"))


SQL["interprocedural_effects"] = """
WITH c AS (SELECT conv_id, turn, min(coalesce(role, 'none')) AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c),
walk AS (SELECT a.conv_id, a.turn AS start, b.turn - a.turn AS depth, b.role FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.island = b.island AND b.turn > a.turn AND b.turn - a.turn <= 8)
SELECT 'p' || conv_id || '_' || start AS "ModuleName", 'Insert' AS "Action", 't_' || role AS "ObjectName", 'Interprocedural' AS "Provenance", 'High' AS "Confidence", CAST(min(depth) + 1 AS BIGINT) AS "Depth"
FROM walk GROUP BY conv_id, start, role
"""


def trigger_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases insert into a user's table; a user with errors has a trigger on it that writes a log."""
    e = _t(spark, sf_dir, "events").where("user_id is not null")
    user = F.col("user_id").cast("string")
    buys = e.where("event_type = 'purchase'").select("user_id").distinct()
    errs = e.where("event_type = 'error'").select("user_id").distinct()
    writes = _object_rows(buys, ModuleName=F.concat(F.lit("buy"), user), Action=F.lit("Insert"), ObjectName=F.concat(F.lit("u"), user), ObjectType=F.lit("Table"))
    logs = _object_rows(errs, ModuleName=F.concat(F.lit("trg"), user), ModuleType=F.lit("Trigger"), Action=F.lit("Insert"), ObjectName=F.lit("log"), ObjectType=F.lit("Table"))
    text = lambda s: F.lit(s)
    triggers = errs.select(text("S").alias("Server"), text("D").alias("Database"), text("dbo").alias("ParentSchema"), F.concat(F.lit("u"), user).alias("ParentName"), text("dbo").alias("TriggerSchema"), F.concat(F.lit("trg"), user).alias("TriggerName"), F.when(F.col("user_id") % 2 == 0, "INSERT, UPDATE").otherwise("DELETE").alias("Events"), F.lit(False).alias("Disabled"))
    return closure.interprocedural(writes.unionByName(logs), triggers).select("ModuleName", "Action", "ObjectName", "Provenance", "Note")


SQL["trigger_effects"] = """
SELECT DISTINCT 'buy' || user_id AS "ModuleName", 'Insert' AS "Action", 'log' AS "ObjectName", 'Trigger' AS "Provenance",
  'dbo.buy' || user_id || ' > [trg]dbo.trg' || user_id AS "Note"
FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')
"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").otherwise("warning")
    return e.select(F.col("user_id").alias("ModuleName"), F.col("event_type").alias("Kind"), severity.alias("Severity"), F.col("props").alias("Name"))


def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_issues(_issues(spark, sf_dir), ["ModuleName"], kinds=3)


SQL["top_issues"] = """
WITH k AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, kind) AS r FROM k)
SELECT user_id AS "ModuleName", CAST(sum(n) AS BIGINT) AS "Issues", CAST(coalesce(sum(n) FILTER (kind = 'error'), 0) AS BIGINT) AS "Errors",
  CAST(coalesce(sum(n) FILTER (kind NOT IN ('error', 'view')), 0) AS BIGINT) AS "Warnings",
  string_agg(kind || '=' || n, '; ' ORDER BY r) FILTER (r <= 3) AS "TopKinds"
FROM r GROUP BY user_id ORDER BY 3 DESC, 2 DESC, 1 LIMIT 5000
"""


def unresolved_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unresolved_by_kind(_issues(spark, sf_dir), [])


SQL["unresolved_by_kind"] = """SELECT event_type AS "Kind", count(*) AS "Count", count(DISTINCT upper(coalesce(props, ''))) AS "DistinctNames", min(props) AS "Example" FROM events GROUP BY 1"""


def summary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as databases, documents as modules: labelled ones parsed, toxic ones in error."""
    d, given = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    m = d.join(given.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "Error").when(F.col("quality") == 1, "Parsed").when(F.col("quality") == 0, "ParsedWithHoles").otherwise("NoDefinition(CLR)")
    who = [F.lit("r1").alias("RunId"), F.lit("S").alias("Server"), F.col("source").alias("Database")]
    modules = m.select(*who, status.alias("ParseStatus"), F.lit(1).alias("Statements"), F.coalesce("quality", F.lit(0)).alias("ColumnEdges"), F.lit(1).alias("ObjectEdges"), F.coalesce("toxic", F.lit(0)).alias("UnresolvedNames"), F.lit(0).alias("ElapsedMs"), F.lit(False).alias("Reused"))
    dynamic = d.where("n_chars > 1000").select(*who, F.when(F.col("n_chars") > 2000, "Exact").otherwise("Partial").alias("Status"))
    out = tables.summary(modules, dynamic, modules.select(*who[:2], "Database", F.lit("x").alias("Kind")))
    return out.select("Database", *[F.col(c).cast("bigint").alias(c) for c in ("Modules", "Parsed", "ParsedWithHoles", "NoDefinition", "Errors", "DynamicSites", "DynamicResolved")], "ParseRate", "BindRate", "DynamicResolutionRate")


SQL["summary_rates"] = """
WITH m AS (SELECT d.source, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)),
s AS (SELECT source AS "Database", count(*) AS "Modules",
  count(*) FILTER (quality = 1 AND coalesce(toxic, 0) <> 1) AS "Parsed", count(*) FILTER (quality = 0 AND coalesce(toxic, 0) <> 1) AS "ParsedWithHoles",
  count(*) FILTER (quality IS NULL AND coalesce(toxic, 0) <> 1) AS "NoDefinition", count(*) FILTER (toxic = 1) AS "Errors",
  count(*) FILTER (n_chars > 1000) AS "DynamicSites", count(*) FILTER (n_chars > 2000) AS "DynamicResolved",
  sum(coalesce(quality, 0)) + count(*) AS edges, sum(coalesce(toxic, 0)) AS bad FROM m GROUP BY 1)
SELECT "Database", "Modules", "Parsed", "ParsedWithHoles", "NoDefinition", "Errors", "DynamicSites", "DynamicResolved",
  CASE WHEN "Modules" = "NoDefinition" THEN 1.0 ELSE round(("Parsed" + "ParsedWithHoles") / CAST("Modules" - "NoDefinition" AS DOUBLE), 4) END AS "ParseRate",
  CASE WHEN edges + bad = 0 THEN 1.0 ELSE round(edges / CAST(edges + bad AS DOUBLE), 4) END AS "BindRate",
  CASE WHEN "DynamicSites" = 0 THEN 1.0 ELSE round("DynamicResolved" / CAST("DynamicSites" AS DOUBLE), 4) END AS "DynamicResolutionRate"
FROM s
"""


def definition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", tables.definition_hash(F.col("text")).alias("DefinitionHash"))


SQL["definition_hash"] = """SELECT doc_id, upper(substr(sha256(text), 1, 32)) AS "DefinitionHash" FROM documents"""


def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text the benchmark run of short texts has met already, under any id."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", tables.definition_hash(F.col("text")).alias("DefinitionHash"))
    before = d.select("source", "DefinitionHash", F.when(F.col("n_chars") > 1000, "Timeout").otherwise("Parsed").alias("ParseStatus"))
    reused, anew = tables.split_reusable(d, before, ["source"])
    return reused.select("doc_id", F.lit(True).alias("Reused")).unionByName(anew.select("doc_id", F.lit(False).alias("Reused")))


SQL["incremental_reuse"] = """
SELECT doc_id, EXISTS (SELECT 1 FROM documents p WHERE p.source = d.source AND p.n_chars <= 1000 AND sha256(p.text) = sha256(d.text)) AS "Reused" FROM documents d
"""


def catalog_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as dependencies, orders as what analysis saw."""
    deps = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ReferencedName"))
    return tables.cross_check(deps, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ReferencedName")), ["ReferencedName"])


SQL["catalog_cross_check"] = """SELECT c_custkey AS "ReferencedName", EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS "FoundInAnalysis" FROM customer"""


def pattern_match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    patterns = spark.createDataFrame([("ECO%",), ("%steel",), ("STANDARD%_",), ("%A_O%",), ("nothing%",)], "pattern string")
    return tables.match_patterns(patterns, names, cap=3)


SQL["pattern_match_names"] = """
WITH p(pattern) AS (VALUES ('ECO%'), ('%steel'), ('STANDARD%_'), ('%A_O%'), ('nothing%')),
m AS (SELECT pattern, name, row_number() OVER (PARTITION BY pattern ORDER BY name) AS r FROM p JOIN (SELECT DISTINCT p_type AS name FROM part) ON upper(name) LIKE upper(pattern))
SELECT pattern, name FROM m WHERE r <= 3
"""


def html_decode_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    return _t(spark, sf_dir, "pages").select("page_id", tables.decode_entities(raw).alias("decoded"))


SQL["html_decode_normalise"] = """
WITH r AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, '<') OR contains(t, '>') THEN t ELSE
  replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') END AS decoded FROM r
"""


def regex_object_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of links, as names are taken from what can't be parsed."""
    hits = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select(F.explode(hits).alias("Name")).groupBy("Name").agg(F.count("*").alias("Count"))


SQL["regex_object_extract"] = """SELECT name AS "Name", count(*) AS "Count" FROM (SELECT unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS name FROM pages) GROUP BY 1"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("RunId"), F.lit("S").alias("Server"), F.col("event_type").alias("Database"))


def latest_run_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_run(_runs(spark, sf_dir), ["Server", "Database"])


SQL["latest_run_view"] = """
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS "RunId", 'S' AS "Server", event_type AS "Database" FROM events)
SELECT * FROM e WHERE "RunId" = (SELECT max("RunId") FROM e x WHERE x."Database" = e."Database")
"""


def nodes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nodes(_place_edges(spark, sf_dir)).select("Object", "ObjectType", "Column")


SQL["nodes_view"] = """
SELECT 'R' || n_regionkey AS "Object", 'Table' AS "ObjectType", 'k' AS "Column" FROM nation UNION SELECT 'N' || n_nationkey, 'Table', 'k' FROM nation
UNION SELECT 'N' || s_nationkey, 'Table', 'k' FROM supplier UNION SELECT 'S' || s_suppkey, 'Table', 'k' FROM supplier
"""


def object_edges_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.object_edges(_fk_edges(spark, sf_dir)).select("SourceObject", "TargetObject", "FlowKind")


SQL["object_edges_view"] = """
SELECT 'R' || n_regionkey AS "SourceObject", 'N' || n_nationkey AS "TargetObject", 'Direct' AS "FlowKind" FROM nation
UNION SELECT 'N' || c_nationkey, '#C' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'Expression' ELSE 'Direct' END FROM customer
UNION SELECT '#C' || o_custkey, 'O' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Aggregate' ELSE 'Direct' END FROM orders
"""

def _procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per part: a table, and a procedure that loads it through a temp table."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("file"), F.col("p_partkey").cast("string").alias("k"))
    text = F.concat(
        F.lit("CREATE TABLE dbo.src"), "k", F.lit(" (id int, price decimal(18,2), brand varchar(20), size int);\nGO\nCREATE TABLE dbo.out"), "k",
        F.lit(" (id int, total decimal(18,2), label varchar(50));\nGO\nCREATE PROCEDURE dbo.load"), "k",
        F.lit(" AS\nBEGIN\n  SELECT s.id, "), F.when(F.col("p_size") % 2 == 0, "SUM(s.price)").otherwise("s.price * 2"), F.lit(" AS total, s.brand INTO #t FROM dbo.src"), "k",
        F.lit(" s WHERE s.size > "), F.col("p_size").cast("string"), F.lit(" GROUP BY s.id, s.brand;\n  INSERT INTO dbo.out"), "k",
        F.lit(" (id, total, label) SELECT t.id, t.total, UPPER(t.brand) FROM #t t;\nEND"),
    )
    return p.select("file", text.alias("text"))


def _session(spark: SparkSession, sf_dir: str) -> session.LineageSession:
    return session.LineageSession.from_scripts(spark, files.read_script_table(_procedures(spark, sf_dir), "file", "text"))


def tsql_column_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse and bind a procedure for each part; its edges."""
    out = _session(spark, sf_dir).analyze()["ColumnLineage"]
    return out.select("ModuleName", "StatementType", "SourceObject", "SourceColumn", "TargetObject", "TargetColumn", "FlowKind", "Confidence", "Provenance")


SQL["tsql_column_lineage"] = """
WITH p AS (SELECT 'load' || p_partkey AS m, 'src' || p_partkey AS s, 'out' || p_partkey AS o, p_size % 2 = 0 AS agg FROM part),
e AS (
  SELECT m, 'SELECT INTO' AS st, s AS so, 'id' AS sc, '#t' AS tobj, 'id' AS tc, 'Direct' AS k FROM p
  UNION ALL SELECT m, 'SELECT INTO', s, 'price', '#t', 'total', CASE WHEN agg THEN 'Aggregate' ELSE 'Expression' END FROM p
  UNION ALL SELECT m, 'SELECT INTO', s, 'brand', '#t', 'brand', 'Direct' FROM p
  UNION ALL SELECT m, 'SELECT INTO', s, c, '#t', '*', 'Indirect' FROM p, (VALUES ('size'), ('id'), ('brand')) v(c)
  UNION ALL SELECT m, 'INSERT SELECT', '#t', c, o, c, 'Direct' FROM p, (VALUES ('id'), ('total')) v(c)
  UNION ALL SELECT m, 'INSERT SELECT', '#t', 'brand', o, 'label', 'Expression' FROM p)
SELECT m AS "ModuleName", st AS "StatementType", so AS "SourceObject", sc AS "SourceColumn", tobj AS "TargetObject", tc AS "TargetColumn", k AS "FlowKind", 'Exact' AS "Confidence", 'Static' AS "Provenance" FROM e
"""


def tsql_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same procedures from text to persistent flows."""
    s = _session(spark, sf_dir)
    t = s.analyze()
    out = closure.collapse(t["ColumnLineage"], t["ObjectLineage"], t["ResultSets"])
    return out.select("ModuleName", "SourceObject", "SourceColumn", "TargetObject", "TargetColumn", "FlowKind", F.col("Hops").cast("bigint").alias("Hops"), "Confidence")


SQL["tsql_collapsed"] = """
SELECT 'load' || p_partkey AS "ModuleName", 'src' || p_partkey AS "SourceObject", sc AS "SourceColumn", 'out' || p_partkey AS "TargetObject", tc AS "TargetColumn",
  CASE sc WHEN 'id' THEN 'Direct' WHEN 'brand' THEN 'Expression' ELSE CASE WHEN p_size % 2 = 0 THEN 'Aggregate' ELSE 'Expression' END END AS "FlowKind", CAST(2 AS BIGINT) AS "Hops", 'Exact' AS "Confidence"
FROM part, (VALUES ('id', 'id'), ('price', 'total'), ('brand', 'label')) v(sc, tc)
"""


def tsql_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the same procedures."""
    t = _session(spark, sf_dir).analyze()
    return tables.summary(t["Modules"], t["DynamicSql"], t["Unresolved"]).select("Database", *[F.col(c).cast("bigint").alias(c) for c in ("Modules", "Parsed", "Statements", "ColumnEdges", "DynamicSites")], "ParseRate", "BindRate")


SQL["tsql_summary"] = """
SELECT 'FILES' AS "Database", count(*) AS "Modules", count(*) AS "Parsed", 2 * count(*) AS "Statements", 9 * count(*) AS "ColumnEdges", CAST(0 AS BIGINT) AS "DynamicSites", CAST(1.0 AS DOUBLE) AS "ParseRate", CAST(1.0 AS DOUBLE) AS "BindRate" FROM part
"""


def etl_port_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with a mapping for each supplier; its physical lineage."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    xml = F.concat(
        F.lit('<POWERMART><REPOSITORY><FOLDER NAME="F'), "k", F.lit('"><SOURCE NAME="S'), "k", F.lit('" DBDNAME="DB" OWNERNAME="dbo"><SOURCEFIELD NAME="A"/><SOURCEFIELD NAME="B"/></SOURCE><TARGET NAME="T'), "k",
        F.lit('"><TARGETFIELD NAME="A"/><TARGETFIELD NAME="C"/></TARGET><MAPPING NAME="m"><TRANSFORMATION NAME="SQ" TYPE="Source Qualifier"><TRANSFORMFIELD NAME="A" PORTTYPE="INPUT/OUTPUT"/><TRANSFORMFIELD NAME="B" PORTTYPE="INPUT/OUTPUT"/></TRANSFORMATION><TRANSFORMATION NAME="E" TYPE="Expression"><TRANSFORMFIELD NAME="B" PORTTYPE="INPUT"/><TRANSFORMFIELD NAME="C" PORTTYPE="OUTPUT" EXPRESSION="UPPER(B)"/></TRANSFORMATION><INSTANCE NAME="S" TRANSFORMATION_NAME="S'), "k",
        F.lit('" TRANSFORMATION_TYPE="Source Definition"/><INSTANCE NAME="SQ" TRANSFORMATION_NAME="SQ" TRANSFORMATION_TYPE="Source Qualifier"/><INSTANCE NAME="E" TRANSFORMATION_NAME="E" TRANSFORMATION_TYPE="Expression"/><INSTANCE NAME="T" TRANSFORMATION_NAME="T'), "k",
        F.lit('" TRANSFORMATION_TYPE="Target Definition"/><CONNECTOR FROMINSTANCE="S" FROMFIELD="A" TOINSTANCE="SQ" TOFIELD="A"/><CONNECTOR FROMINSTANCE="S" FROMFIELD="B" TOINSTANCE="SQ" TOFIELD="B"/><CONNECTOR FROMINSTANCE="SQ" FROMFIELD="B" TOINSTANCE="E" TOFIELD="B"/><CONNECTOR FROMINSTANCE="SQ" FROMFIELD="A" TOINSTANCE="T" TOFIELD="A"/><CONNECTOR FROMINSTANCE="E" FROMFIELD="C" TOINSTANCE="T" TOFIELD="C"/></MAPPING></FOLDER></REPOSITORY></POWERMART>'),
    )
    return etl.run(s.select(xml.alias("text")))["EtlColumnLineage"].select("Folder", "SourceTable", "SourceColumn", "TargetTable", "TargetColumn", "FlowKind", F.col("Hops").cast("bigint").alias("Hops"))


SQL["etl_port_lineage"] = """
SELECT 'F' || s_suppkey AS "Folder", 'dbo.S' || s_suppkey AS "SourceTable", a AS "SourceColumn", 'T' || s_suppkey AS "TargetTable", c AS "TargetColumn", k AS "FlowKind", CAST(h AS BIGINT) AS "Hops"
FROM supplier, (VALUES ('A', 'A', 'Direct', 2), ('B', 'C', 'Expression', 4)) v(a, c, k, h)
"""

#: T-SQL queries that are run: the text for Spark (through the dialect), the SQL for comparison. ``corpus`` has those that are analysed.
CORPUS: dict[str, tuple[str, str]] = {
    "corpus_exec_joins": (
        "SELECT c.[c_custkey], n.n_name, ISNULL(o.total, 0) AS total FROM dbo.customer c INNER JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders WITH (NOLOCK) GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
        "SELECT c_custkey, n_name, coalesce(total, 0) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    ),
    "corpus_exec_full_join": (
        "SELECT s.s_nationkey, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, COUNT_BIG(*) AS n FROM supplier GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, COUNT_BIG(*) AS n FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = s.s_nationkey",
        "SELECT s_nationkey, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = s_nationkey",
    ),
    "corpus_exec_exists": (
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) OR c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) OR c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    ),
    "corpus_exec_rollup": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "corpus_exec_cube": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    ),
    "corpus_exec_grouping_sets": (
        "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, MIN(c_custkey) AS first FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
        "SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    ),
    "corpus_exec_window": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
        "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    ),
    "corpus_exec_top": (
        "SELECT TOP (10) p_partkey, p_size, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class FROM part ORDER BY p_size DESC, p_partkey",
        "SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class FROM part ORDER BY p_size DESC, p_partkey LIMIT 10",
    ),
    "corpus_exec_except": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    ),
    "corpus_exec_intersect": (
        "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0",
        "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0",
    ),
    "corpus_exec_union": (
        "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier WHERE s_acctbal BETWEEN 0 AND 500",
        "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier WHERE s_acctbal BETWEEN 0 AND 500",
    ),
    "corpus_exec_cte": (
        "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5) SELECT c.c_name, b.n, LEN(c.c_name) AS size FROM big b JOIN customer c ON c.c_custkey = b.o_custkey WHERE c.c_name LIKE '%1%'",
        "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5) SELECT c_name, n, CAST(length(c_name) AS INT) AS size FROM big JOIN customer ON c_custkey = o_custkey WHERE c_name LIKE '%1%'",
    ),
    "corpus_exec_pivot": (
        "SELECT * FROM (SELECT event_type, user_id, event_id FROM events) e PIVOT (COUNT(event_id) FOR event_type IN ('view' AS views, 'purchase' AS purchases))",
        "SELECT user_id, nullif(count(*) FILTER (event_type = 'view'), 0) AS views, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchases FROM events GROUP BY user_id",
    ),
    "corpus_exec_unpivot": (
        "SELECT l_orderkey, l_linenumber, what, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) x UNPIVOT (amount FOR what IN (l_discount, l_tax)) u",
        "SELECT l_orderkey, l_linenumber, 'l_discount' AS what, l_discount AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
    ),
}


def _corpus(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: _t(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if t in CORPUS[name][0]}
        return dialect.execute(spark, CORPUS[name][0], used)

    query.__name__ = name
    return query


def _rules(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus.rows(spark, name)

    query.__name__ = name
    return query


SQL |= {n: sql for n, (_, sql) in CORPUS.items()}
QUERIES = {n: f for n, f in list(globals().items()) if n in SQL} | {n: _corpus(n) for n in CORPUS} | {n: _rules(n) for n in corpus.SCRIPTS}
SQL |= {n: corpus.expected_sql(n) for n in corpus.SCRIPTS}
