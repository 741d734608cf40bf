"""Row tables of the lineage model, their vocabularies and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODULE = "RunId string, Server string, Database string, ModuleSchema string, ModuleName string"


def _node(prefix: str, *parts: str) -> str:
    return ", ".join(f"{prefix}{p} string" for p in parts)


#: Column order of every table; types are Spark DDL.
DDL: dict[str, str] = {
    "ColumnLineage": f"{MODULE}, ModuleType string, StatementNo int, StatementType string, Line int, {_node('Source', 'Server', 'Database', 'Schema', 'Object', 'ObjectType', 'Column')}, {_node('Target', 'Server', 'Database', 'Schema', 'Object', 'ObjectType', 'Column')}, FlowKind string, Expression string, Provenance string, Confidence string, Note string",
    "ObjectLineage": f"{MODULE}, ModuleType string, StatementNo int, StatementType string, Line int, Action string, {_node('Object', 'Server', 'Database', 'Schema', 'Name', 'Type')}, Provenance string, Confidence string, Note string",
    "Collapsed": f"{MODULE}, ModuleType string, {_node('Source', 'Server', 'Database', 'Schema', 'Object', 'ObjectType', 'Column')}, {_node('Target', 'Server', 'Database', 'Schema', 'Object', 'Column')}, FlowKind string, Hops int, Path string, Confidence string",
    "Modules": f"{MODULE}, ModuleType string, ParseStatus string, ParserUsed string, DefinitionLength int, Statements int, DynamicSites int, ColumnEdges int, ObjectEdges int, UnresolvedNames int, ElapsedMs int, ModifyDate timestamp, DefinitionHash string, Reused boolean, Errors string, Holes string",
    "DynamicSql": f"{MODULE}, StatementNo int, Line int, SinkKind string, Status string, Alternatives int, Template string, Holes string, EdgesProduced int, ParseError string",
    "Unresolved": f"{MODULE}, StatementNo int, Line int, Kind string, Severity string, Name string, Note string",
    "Statements": f"{MODULE}, StatementNo int, Line int, StatementType string, Dynamic boolean, SqlText string",
    "CatalogDeps": f"{MODULE}, {_node('Referenced', 'Server', 'Database', 'Schema', 'Name')}, FoundInAnalysis boolean",
    "TopIssues": f"{MODULE}, ParseStatus string, Issues int, Errors int, Warnings int, TopKinds string",
    "Query": f"RunId string, Direction string, StartNode string, StartColumn string, {_node('End', 'Server', 'Database', 'Schema', 'Object', 'ObjectType', 'Column')}, Hops int, FlowKind string, Confidence string, TerminalReason string, Path string, Modules string",
    "UnresolvedByKind": "RunId string, Server string, Database string, Kind string, Count int, DistinctNames int, Example string",
    "Summary": "RunId string, Server string, Database string, Modules int, Parsed int, ParsedWithHoles int, Quarantined int, NoDefinition int, Errors int, Statements int, ColumnEdges int, ObjectEdges int, DynamicSites int, DynamicResolved int, UnresolvedNames int, ParseRate double, BindRate double, DynamicResolutionRate double, CatalogDepsMissed int, ReusedModules int, EngineSignature string, ElapsedMs int",
    "EtlColumnLineage": "RunId string, Folder string, Mapping string, Session string, SourceSystem string, SourceTable string, SourceObjectType string, SourceColumn string, TargetSystem string, TargetTable string, TargetColumn string, FlowKind string, Hops int, Path string",
    "EtlPortLineage": "RunId string, Folder string, Mapping string, FromInstance string, FromPort string, ToInstance string, ToPort string, FlowKind string, Expression string",
    "EtlObjectLineage": "RunId string, Folder string, Mapping string, Session string, Action string, System string, ObjectName string, Confidence string",
    "EtlMappings": "RunId string, Folder string, Mapping string, Status string, Instances int, Connectors int, TargetColumns int, CoveredColumns int, Issues int",
    "EtlSessions": "RunId string, Folder string, Workflow string, Session string, Mapping string, Instance string, Connection string, Overrides string",
    "EtlUnresolved": "RunId string, Folder string, Mapping string, Kind string, Name string",
    "EtlSummary": "RunId string, Folder string, Mappings int, Errors int, TargetColumns int, CoveredColumns int, Coverage double",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


FLOW_RANK = {"Indirect": -1, "Direct": 0, "Positional": 1, "Expression": 2, "Aggregate": 3}
#: Along a traversed path an indirect step outranks all others.
PATH_RANK = FLOW_RANK | {"Indirect": 4}
CONFIDENCE_RANK = {"Exact": 0, "High": 1, "Medium": 2, "Low": 3}
PERSISTENT = ("Table", "External", "Unresolved", "System")
LOCAL = ("TempTable", "TableVariable", "Tvp")
TRANSIENT = (*LOCAL, "View", "ScalarFunction", "InlineTvf", "MsTvf", "Procedure")
EFFECTS = ("Reads", "Insert", "Update", "Delete", "Merge", "Truncate", "Create", "Drop", "Writes", "References")
EFFECT_TYPES = ("Table", "View", "External", "Unresolved", "System", "File", "Sequence", "Synonym")
CALLABLE = ("Procedure", "ClrProcedure", "ClrModule", "Unresolved", "External")
ERRORS = ("StatementError", "DynamicAssignError", "RemoteQueryNotParsed")
INFOS = ("SchemaAssumed", "ViewColumnsMissing", "DynamicPattern", "CursorNotFound")


def severity(kind: str) -> str:
    return "error" if kind in ERRORS else "info" if kind in INFOS else "warning"


def rank(col: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, r in ranks.items():
        out = F.when(col == name, r).otherwise(out)
    return out


def unrank(col: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for name, r in ranks.items():
        out = F.when(col == r, name).otherwise(out)
    return out
