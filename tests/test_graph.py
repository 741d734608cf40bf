"""Closures against plain walks on random graphs; table operators; sinks and sources."""

import random

import pytest
from pyspark.sql import functions as F

from tributary import sinks
from tributary.functions import dialect, lattice
from tributary.operators import closure, tables
from tributary.plans import etl, session
from tributary.schemas import DDL, FLOW_RANK, PATH_RANK, PERSISTENT, TRANSIENT, schema
from tributary.sources import files

KIND = {r: k for k, r in FLOW_RANK.items()}


def column_edges(spark, rows):
    """Rows ``(module, source, source type, target, target type, kind, confidence)``."""
    names = [f.name for f in schema("ColumnLineage")]
    out = []
    for m, s, st, t, tt, k, c in rows:
        v = dict.fromkeys(names)
        v |= {"RunId": "r", "Server": "S", "Database": "D", "ModuleSchema": "dbo", "ModuleName": m, "ModuleType": "Procedure", "FlowKind": k, "Confidence": c, "Provenance": "Static"}
        for side, o, ty in (("Source", s, st), ("Target", t, tt)):
            v |= {side + "Server": "S", side + "Database": "D", side + "Schema": "dbo", side + "Object": o, side + "ObjectType": ty, side + "Column": "c"}
        out.append(tuple(v[n] for n in names))
    return spark.createDataFrame(out, schema("ColumnLineage"))


def naive_collapse(rows, max_depth=32):
    """Kinds along simple paths, depth first."""
    out = {}
    into = {}
    local = lambda m, o, ty: (m, o) if ty == "TempTable" else ("", o)
    for m, s, st, t, tt, k, _ in rows:
        if k != "Indirect" and tt in TRANSIENT:
            into.setdefault(local(m, t, tt), []).append((s, st, k))

    def walk(m, target, node, type_, kind, hops, seen):
        nexts = into.get(local(m, node, type_), [])
        if type_ not in TRANSIENT or hops > max_depth or not nexts:
            key = (m, node, target, KIND[kind])
            out[key] = min(out.get(key, 99), hops)
            return
        for s, st, k in nexts:
            if s not in seen:
                walk(m, target, s, st, max(kind, FLOW_RANK[k]), hops + 1, seen | {s})

    for m, s, st, t, tt, k, _ in rows:
        if k != "Indirect" and tt in PERSISTENT and s != t:
            walk(m, t, s, st, FLOW_RANK[k], 1, {t, s})
    return out


@pytest.mark.parametrize("seed", range(2))
def test_collapse_is_all_simple_paths(spark, seed):
    rng = random.Random(seed)
    types = {f"n{i}": rng.choice(["Table", "View", "TempTable", "Procedure"]) for i in range(9)}
    rows = set()
    while len(rows) < 22:
        s, t = rng.sample(sorted(types), 2)
        rows.add((rng.choice(["m1", "m2"]), s, types[s], t, types[t], rng.choice(["Direct", "Expression", "Aggregate", "Indirect"]), "Exact"))
    got = {(r.ModuleName, r.SourceObject, r.TargetObject, r.FlowKind): r.Hops for r in closure.collapse(column_edges(spark, sorted(rows))).collect()}
    assert got == naive_collapse(sorted(rows))


def test_query_terminals(spark):
    rows = [("m1", "a", "Table", "b", "Table", "Direct", "Exact"), ("m2", "b", "Table", "c", "Table", "Indirect", "Low"), ("m3", "c", "Table", "b", "Table", "Aggregate", "High"), ("m4", "x", "External", "a", "Table", "Expression", "Exact")]
    start = spark.createDataFrame([("D", "dbo", "c", "c")], "Database string, Schema string, Object string, Column string")
    e = column_edges(spark, rows)
    got = {(r.EndObject, r.Hops, r.FlowKind, r.Confidence, r.TerminalReason) for r in closure.query_terminals(e, start).collect()}
    assert got == {("x", 3, "Indirect", "Low", "UNRESOLVED"), ("c", 2, "Indirect", "Low", "CYCLE")}
    got = {(r.EndObject, r.TerminalReason) for r in closure.query_terminals(e, start, max_hops=2).collect()}
    assert got == {("a", "MAX_HOPS"), ("c", "CYCLE")}
    hops = {(r.EndObject, r.Hops, r.FlowKind) for r in closure.all_hops(e, start).collect()}
    assert ("b", 1, "Indirect") in hops and ("a", 2, "Direct") in hops and ("x", 3, "Expression") in hops
    assert PATH_RANK["Indirect"] > PATH_RANK["Aggregate"]


def test_interprocedural_depth_and_first_hop(spark):
    names = [f.name for f in schema("ObjectLineage")]

    def row(m, action, o, ty, no):
        v = dict.fromkeys(names) | {"RunId": "r", "Server": "S", "Database": "D", "ModuleSchema": "dbo", "ModuleName": m, "ModuleType": "Procedure", "StatementNo": no, "StatementType": "EXEC", "Line": no, "Action": action, "ObjectServer": "S", "ObjectDatabase": "D", "ObjectSchema": "dbo", "ObjectName": o, "ObjectType": ty, "Provenance": "Static", "Confidence": "Exact"}
        return tuple(v[n] for n in names)

    rows = [row(f"p{i}", "Calls", f"p{i + 1}", "Procedure", 3) for i in range(12)] + [row("p3", "Calls", "p0", "Procedure", 4)] + [row(f"p{i}", "Insert", f"t{i}", "Table", 5) for i in range(13)]
    got = closure.interprocedural(spark.createDataFrame(rows, schema("ObjectLineage"))).collect()
    mine = {r.ObjectName: r for r in got if r.ModuleName == "p0"}
    assert set(mine) == {f"t{i}" for i in range(1, 9)} and mine["t2"].Note == "dbo.p0 > dbo.p1 > dbo.p2"
    assert all(r.StatementNo == 3 and r.Confidence == "High" for r in mine.values())


def test_shared_temps_and_result_sets(spark):
    script = open(__file__.replace("test_graph.py", "lineage_script.sql")).read()
    s = session.LineageSession.from_scripts(spark, files.read_script_table(spark.createDataFrame([("f", script)], "f string, t string"), "f", "t"))
    t = s.run_all()
    got = {(r.ModuleName, r.SourceObject, r.SourceColumn, r.TargetColumn, r.FlowKind, r.Hops) for r in t["Collapsed"].collect()}
    assert ("boss", "orders", "o_totalprice", "total", "Aggregate", 2) in got
    assert ("fire", "customer_summary", "custkey", "message", "Positional", 2) in got
    extra = {(r.ModuleName, r.Action, r.ObjectName, r.Provenance) for r in t["ObjectLineage"].collect()}
    assert ("fire", "Insert", "balance_history", "Trigger") in extra and ("boss", "Reads", "orders", "Interprocedural") in extra
    assert s.status() == {"prepass": "done", "analyze": "done", "merge": "done"}
    assert {r.EndObject for r in s.query("dbo.customer_summary.total").collect()} == {"orders"}
    assert '"FILES.dbo.orders" -> "FILES.dbo.customer_summary"' in s.graph("dbo.customer_summary")
    assert '"from": "FILES.dbo.orders"' in s.graph("dbo.customer_summary", "json") and "<graphml" in s.graph("dbo.customer_summary", "graphml")
    again = session.LineageSession(spark, s.entries, session.Config(run_id="r2"), previous={k: t[k] for k in session.ROW_TABLES})
    reused = again.analyze()
    assert reused["Modules"].where("Reused").count() == t["Modules"].count()
    assert reused["ColumnLineage"].count() == t["ColumnLineage"].count() and reused["ColumnLineage"].where("RunId <> 'r2'").count() == 0
    changed = session.LineageSession(spark, s.entries, session.Config(run_id="r3", settings={"patterns": 7}), previous={k: t[k] for k in (*session.ROW_TABLES, "Summary")})
    assert changed.analyze()["Modules"].where("Reused").count() == 0
    same = session.LineageSession(spark, s.entries, session.Config(run_id="r4"), previous={k: t[k] for k in (*session.ROW_TABLES, "Summary")})
    assert same.analyze()["Modules"].where("not Reused").count() == 0
    configured = session.LineageSession(spark, s.entries, session.Config(config_tables={"dbo.load_config.source_table": 5}), data={"dbo.load_config": spark.createDataFrame([("customer",), ("orders",)], "source_table string")})
    found = configured.analyze()["ColumnLineage"].where("ModuleName = 'dynamic_load' and SourceColumn = 'name'")
    assert {r.SourceObject for r in found.collect()} == {"customer", "orders"}
    tables.views(spark, t)
    assert spark.sql("SELECT * FROM vw_ColumnEdges").count() == t["Collapsed"].count() and spark.sql("SELECT * FROM vw_Nodes").count() > 0


def test_table_function(spark):
    session.register(spark)
    got = spark.sql("SELECT * FROM tsql_edges('CREATE VIEW dbo.v AS SELECT a.x FROM dbo.a a')").collect()
    assert [(r.SourceColumn, r.TargetColumn) for r in got] == [("x", "x")]


def test_etl(spark):
    text = open(__file__.replace("test_graph.py", "etl_export.xml")).read()
    t = etl.run(spark.createDataFrame([(text,)], "text string"))
    got = {(r.SourceSystem, r.SourceTable, r.SourceColumn, r.SourceObjectType, r.TargetColumn, r.FlowKind) for r in t["EtlColumnLineage"].collect()}
    assert ("SALES_PROD", "dbo.ORDERS", "PRICE", "Source", "TOTAL", "Aggregate") in got
    assert ("CRM_PROD", "crm.CUSTOMER", "FIRST", "Source", "LABEL", "Expression") in got
    assert ("CRM_PROD", "dbo.CUSTOMER", "LAST", "SqlOverrideTable", "LABEL", "Expression") in got
    assert ("REF_PROD", "REF.CITY", "REGION", "LookupTable", "REGION", "Expression") in got
    assert ("CRM_PROD", "dbo.EXTRA", "ACTIVE", "SqlOverrideTable", "CUSTKEY", "Indirect") in got
    assert any(x[3] == "Constant/Unconnected" and x[4] == "LOADED" for x in got)
    s = t["EtlSummary"].where("Folder = 'DWH'").first()
    assert (s.TargetColumns, s.CoveredColumns, s.Coverage) == (5, 5, 1.0)
    assert {(r.Action, r.ObjectName) for r in t["EtlObjectLineage"].collect()} >= {("TruncateAndWrites", "dwh.SUMMARY_V2"), ("TargetNotConnected", "UNUSED")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b.sql").write_text("SELECT 1\nGO 5 -- again\n\nSELECT 2\r\ngo\r\n", encoding="utf-8-sig")
    (tmp_path / "a.sql").write_text("CREATE TABLE dbo.a (x int)")
    rows = files.read_scripts(spark, str(tmp_path)).orderBy("file", "batch").collect()
    assert [(r.file, r.text.strip()) for r in rows] == [("a.sql", "CREATE TABLE dbo.a (x int)"), ("b.sql", "SELECT 1"), ("b.sql", "SELECT 2")]
    df = spark.createDataFrame([("r", "S", "D", 'k "q"', 2, 1, "a\nb")], DDL["UnresolvedByKind"])
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv_part(spark, str(tmp_path / "csv"), "UnresolvedByKind").collect() == df.collect()
    sinks.write_table(df, str(tmp_path / "t"), "UnresolvedByKind")
    assert spark.read.parquet(str(tmp_path / "t/UnresolvedByKind")).count() == 1
    assert "[Line] int NULL" in sinks.ddl("Unresolved") and "ADD [Note]" in sinks.ddl("Unresolved", {"RunId"}) and sinks.all_ddl().count("CREATE INDEX") == 4
    assert sinks.workbook_layout({"ColumnLineage": 4_000_000, "Summary": 3}) == {"Summary": 1} and sinks.workbook_layout({"ColumnLineage": 1_000_000}) == {"ColumnLineage": 2}
    (tmp_path / "c.json").write_text('{"a": [1, 2,], // x\n "u": "http://y", /* z */ }')
    assert files.read_json(str(tmp_path / "c.json")) == {"a": [1, 2], "u": "http://y"}


def test_filters(spark):
    db = spark.createDataFrame([("SALES",), ("SALES_2024",), ("TMP",)], "database string")
    assert {r[0] for r in files.filter_databases(db, ["*"], ["tmp"], [r"^(SALES)_\d{4}$"]).collect()} == {"SALES"}
    m = spark.createDataFrame([("dbo", "p"), ("dbo", "p_backup"), ("test", "q")], "schema string, name string")
    assert [tuple(r) for r in files.filter_modules(m, ["_BACKUP"], ["TEST"]).collect()] == [("dbo", "p")]
    j = spark.createDataFrame([("TSQL", "A"), ("CmdExec", "A"), ("tsql", "B")], "subsystem string, database string")
    assert files.filter_job_steps(j, ["b"]).count() == 1
    assert sorted(files.config_values(db, "database", 2)) <= ["SALES", "SALES_2024", "TMP"]


def test_catalog_tables(spark):
    one = lambda ddl, *rows: spark.createDataFrame(list(rows), "server string, database string, object_id int, " + ddl)
    e = files.entries_of_catalog(
        one("schema string, name string, type_code string", ("S", "D", 1, "dbo", "t", "U "), ("S", "D", 2, "dbo", "p", "P")),
        one("column_id int, name string, type_name string, is_identity boolean, is_computed boolean", ("S", "D", 1, 1, "id", "int", True, False), ("S", "D", 1, 2, "v", "int", False, False)),
        one("definition string", ("S", "D", 2, "CREATE PROCEDURE dbo.p @k int AS INSERT INTO dbo.t VALUES (@k)")),
        one("parameter_id int, name string", ("S", "D", 2, 1, "@k")),
        one("parent_schema string, parent_name string, events string"),
        one("base_object_name string"),
    )
    t = session.LineageSession(spark, e).analyze()
    assert [(r.SourceColumn, r.TargetColumn, r.FlowKind) for r in t["ColumnLineage"].collect()] == [("IN:@k", "v", "Positional")]


def test_dialect_and_lattice(spark):
    got = dialect.to_spark_sql("SELECT TOP 3 [a b], ISNULL(x, 'it''s') FROM dbo.t WITH (NOLOCK) ORDER BY x;")
    assert got.split() == r"SELECT `a b`, coalesce(x, 'it\'s') FROM t ORDER BY x LIMIT 3".split()
    df = spark.createDataFrame([("g", "n", "Direct", "Exact"), ("g", "n", "Aggregate", "Low"), ("g", "m", "Indirect", "High")], "g string, node string, FlowKind string, Confidence string")
    assert {tuple(r) for r in lattice.union(df, ["g"]).collect()} == {("g", "n", "Aggregate", "Low"), ("g", "m", "Indirect", "High")}
    assert [r[0] for r in df.orderBy("FlowKind").select(lattice.at_least(F.col("FlowKind"), "Expression")).collect()] == ["Aggregate", "Expression", "Indirect"]


def test_signature_follows_shapes(spark):
    a = spark.createDataFrame([("t", "x int"), ("u", "y int")], "name string, shape string")
    one = tables.engine_signature(a, "v1")
    assert one == tables.engine_signature(a.orderBy(F.desc("name")), "v1") != tables.engine_signature(a.limit(1), "v1") and len(one) == 32


def test_streaming_feed(spark, tmp_path):
    from tributary.streaming import feed

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1, "CREATE TABLE dbo.a (x int)"), ("a", 2, "CREATE VIEW dbo.v AS SELECT x FROM dbo.a")], "file string, batch int, text string")
    rows.coalesce(1).write.parquet(src)
    feed.start(feed.read_feed(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{out}/ColumnLineage").count() == 1
    rows.coalesce(1).write.mode("append").parquet(src)  # nothing new in it
    feed.start(feed.read_feed(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{out}/ColumnLineage").count() == 1


def test_unreadable_modules_refer_to_catalog_dependencies(spark):
    rows = [files.Entry("S", "D", "dbo", "t", "Table"), files.Entry("S", "D", "dbo", "clr", "ClrModule"), files.Entry("S", "D", "dbo", "p", "Procedure", definition="CREATE PROCEDURE dbo.p AS SELECT 1 AS c")]
    deps = spark.createDataFrame([("S", "D", "dbo", "clr", "S", "D", "dbo", "t"), ("S", "D", "dbo", "p", "S", "D", "dbo", "gone")], "Server string, Database string, ModuleSchema string, ModuleName string, ReferencedServer string, ReferencedDatabase string, ReferencedSchema string, ReferencedName string")
    s = session.LineageSession(spark, spark.createDataFrame([files.pack(e) for e in rows], files.ENTRY), deps=deps)
    t = s.run_all()
    assert {(r.ModuleName, r.ParseStatus) for r in t["Modules"].collect()} == {("clr", "NoDefinition(CLR)"), ("p", "Parsed")}
    assert [(r.ModuleName, r.Action, r.ObjectName, r.Provenance) for r in t["ObjectLineage"].where("Provenance = 'Catalog'").collect()] == [("clr", "References", "t", "Catalog")]
    assert {(r.ReferencedName, r.FoundInAnalysis) for r in t["CatalogDeps"].collect()} == {("t", True), ("gone", False)}
    assert [r.Name for r in t["Unresolved"].where("Kind = 'CatalogDepMissed'").collect()] == ["gone"]


def test_job_steps(spark):
    steps = spark.createDataFrame([("S", "D", "nightly", 1, "INSERT INTO dbo.t SELECT 1")], "server string, database string, job string, step_id int, command string")
    t = session.LineageSession(spark, files.entries_of_job_steps(steps)).analyze()
    assert [(r.ModuleSchema, r.ModuleName, r.ModuleType) for r in t["Modules"].collect()] == [("job", "nightly#1", "JobStep")]


def test_command_line(spark, tmp_path, capsys):
    from tributary.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sql").write_text("CREATE TABLE dbo.a (x int);\nGO\nCREATE TABLE dbo.b (y int);\nGO\nCREATE PROCEDURE dbo.p AS INSERT INTO dbo.b (y) SELECT x FROM dbo.a")
    main(["run", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    main(["graph", str(tmp_path / "out"), "dbo.b"])
    assert '"FILES.dbo.a" -> "FILES.dbo.b"' in capsys.readouterr().out


def test_budget_counts_for_each_start_edge(spark):
    rows = [("m", f"v{i}", "View", "out", "Table", "Direct", "Exact") for i in range(3)]
    rows += [("w", f"s{i}_{j}", "Table", f"v{i}", "View", "Direct", "Exact") for i in range(3) for j in range(4)]
    for wide in (0, 1000):
        assert closure.collapse(column_edges(spark, rows), budget=5, wide=wide).count() == 12
        assert {r.SourceObject for r in closure.collapse(column_edges(spark, rows), budget=2, wide=wide).collect()} == {f"s{i}_{j}" for i in range(3) for j in range(2)}


def test_merged_paths_change_nothing(spark):
    rng = random.Random(8)
    types = {f"n{i}": rng.choice(["Table", "View", "View", "Procedure"]) for i in range(12)}
    rows = set()
    while len(rows) < 34:
        s, t = rng.sample(sorted(types), 2)
        rows.add(("m1", s, types[s], t, types[t], rng.choice(["Direct", "Expression", "Aggregate"]), "Exact"))
    got = {(r.ModuleName, r.SourceObject, r.TargetObject, r.FlowKind): r.Hops for r in closure.collapse(column_edges(spark, sorted(rows)), wide=0).collect()}
    assert got == naive_collapse(sorted(rows))


def test_twenty_layers_of_diamonds(spark):
    rows = [("m", f"s{i}", "Table", f"v0_{i}", "View", "Direct", "Exact") for i in range(3)]
    rows += [("m", f"v{k}_{i}", "View", f"v{k + 1}_{j}", "View", "Direct", "Exact") for k in range(19) for i in range(3) for j in range(3)]
    rows += [("m", f"v19_{i}", "View", "out", "Table", "Direct", "Exact") for i in range(3)]
    got = closure.collapse(column_edges(spark, rows), wide=100).collect()  # 3**20 paths
    assert {(r.SourceObject, r.Hops) for r in got} == {(f"s{i}", 21) for i in range(3)} and len(got) == 3


def test_stars_of_shared_temps(spark):
    script = "CREATE PROCEDURE dbo.fill AS INSERT INTO #k SELECT * FROM unknown\nGO\nCREATE TABLE dbo.out (a int)\nGO\nCREATE PROCEDURE dbo.use_it AS BEGIN EXEC dbo.fill; INSERT INTO dbo.out (a) SELECT k.a FROM #k k; END"
    t = session.LineageSession.from_scripts(spark, files.read_script_table(spark.createDataFrame([("f", script)], "f string, t string"), "f", "t")).run_all()
    assert [(r.SourceObject, r.SourceColumn, r.TargetObject, r.Hops) for r in t["Collapsed"].collect()] == [("unknown", "*", "out", 2)]


def test_addresses_and_truncation(spark):
    names = [f.name for f in schema("Collapsed")]
    one = column_edges(spark, [("m1", "a", "Table", "b", "Table", "Direct", "Exact"), ("m2", "b", "Table", "c", "Table", "Direct", "Exact"), ("m3", "z", "Table", "c", "Table", "Direct", "Exact")]).withColumn("Path", F.lit("")).withColumn("Hops", F.lit(1)).select(*names)
    two = one.replace("D", "E", ["SourceDatabase", "TargetDatabase"]).replace("S", "S2", ["SourceServer", "TargetServer"])
    s = session.LineageSession(spark, spark.createDataFrame([], files.ENTRY))
    s.tables["Collapsed"] = one.unionByName(two)
    ends = lambda a, d="upstream": sorted((r.Direction, r.StartNode, r.EndDatabase, r.EndObject, r.Path) for r in s.query(a, d).collect())
    assert ends("D.dbo.c") == [("upstream", "D.dbo.c", "D", "a", "D.dbo.a.c → D.dbo.b.c → D.dbo.c.c"), ("upstream", "D.dbo.c", "D", "z", "D.dbo.z.c → D.dbo.c.c")]
    assert ends("S2.E.dbo.c.c") == [tuple(x.replace("D", "E") for x in r) for r in ends("D.dbo.c")]
    assert len(ends("dbo.c")) == 4 and len(ends("dbo.c.c")) == 4 and ends("S.E.dbo.c") == []
    assert [r[0] for r in ends("D.dbo.b", "both")] == ["downstream", "upstream"]
    s.config.max_query_rows = 1
    got = [(r.EndObject, r.TerminalReason) for r in s.query("D.dbo.c").collect()]
    assert got == [("z", "PHYSICAL_SOURCE"), (None, "MAX_ROWS")]
