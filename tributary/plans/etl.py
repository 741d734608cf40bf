"""Lineage of ETL mappings from repository exports (POWERMART XML).

A mapping is a graph of ports; mapplets are set into it with prefixed names. Port edges come from connectors, and
within transformations from expressions, conditions, groups, lookups and overrides. Per session and target column the
graph is walked back to physical sources, keeping the fewest hops per source and kind; a step that only controls
makes the path indirect. Exports are read and analysed in parallel, one file a time; mappings are bounded, so walks
stay in one task.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.durable import materialize
from tributary.names import split_name
from tributary.operators.tables import ratio
from tributary.schemas import FLOW_RANK, schema
from tributary.tsql.analyze import Analyzer, Scope
from tributary.tsql.lexer import ParseError
from tributary.tsql.model import KINDS, Catalog
from tributary.tsql.parser import Parser

#: Aggregate functions of the expression language, and words that aren't ports (fixed values).
AGGREGATE = re.compile(r"(?i)\b(SUM|AVG|MIN|MAX|COUNT|FIRST|LAST|MEDIAN|PERCENTILE|STDDEV|VARIANCE|MOVINGAVG|MOVINGSUM|CUME)\s*\(")
WORDS = set("AND OR NOT IN IS NULL TRUE FALSE LIKE BETWEEN SYSDATE SESSSTARTTIME SYSTIMESTAMP DD_INSERT DD_UPDATE DD_DELETE DD_REJECT PROC_RESULT SPOUTPUT".split())


class Port:
    def __init__(self, e: ET.Element):
        self.name, self.kind = e.get("NAME", ""), e.get("PORTTYPE") or "INPUT/OUTPUT"
        self.expression, self.group, self.ref = e.get("EXPRESSION") or "", e.get("GROUP") or "", e.get("REF_FIELD") or ""
        self.by = "YES" in ((e.get("GROUPBY") or "").upper(), (e.get("ISSORTKEY") or "").upper(), (e.get("SORTKEY") or "").upper())

    @property
    def input(self) -> bool:
        return "INPUT" in self.kind

    @property
    def output(self) -> bool:
        return "OUTPUT" in self.kind


class Instance:
    def __init__(self, name: str, type_: str, ports: list[Port], attrs: dict[str, str], groups: list[tuple[str, str]], definition: ET.Element | None, associated: list[str], database: str):
        self.name, self.type, self.attrs, self.groups, self.definition = name, type_, attrs, groups, definition
        self.ports = {p.name.upper(): p for p in ports}
        self.associated, self.database = associated, database

    def attr(self, *names: str) -> str:
        low = {k.lower(): v for k, v in self.attrs.items()}
        return next((low[n.lower()].strip() for n in names if low.get(n.lower(), "").strip()), "")


class Repository:
    """Folders of one export, with lookups of definitions: own folder, then through shortcuts, then anywhere."""

    def __init__(self, text: str):
        self.folders = {f.get("NAME", ""): f for f in ET.fromstring(text).iter("FOLDER")}
        self.index: dict[tuple[str, str, str], ET.Element] = {}
        self.anywhere: dict[tuple[str, str], ET.Element] = {}
        self.shortcuts: dict[tuple[str, str], tuple[str, str]] = {}
        for name, folder in self.folders.items():
            for e in folder:
                key = (e.get("NAME") or "").upper()
                if e.tag in ("SOURCE", "TARGET", "TRANSFORMATION", "MAPPLET"):
                    self.index.setdefault((name, e.tag, key), e)
                    self.anywhere.setdefault((e.tag, key), e)
                elif e.tag == "SHORTCUT":
                    self.shortcuts[name, key] = (e.get("FOLDERNAME") or name, (e.get("REFOBJECTNAME") or "").upper())

    def find(self, folder: str, tag: str, name: str) -> ET.Element | None:
        key = name.upper()
        if (e := self.index.get((folder, tag, key))) is not None:
            return e
        if (folder, key) in self.shortcuts:
            other, ref = self.shortcuts[folder, key]
            if (e := self.index.get((other, tag, ref))) is not None:
                return e
            key = ref
        return self.anywhere.get((tag, key))


class Mapping:
    """The port graph of one mapping."""

    def __init__(self, repository: Repository, folder: str, element: ET.Element):
        self.repository, self.folder, self.name = repository, folder, element.get("NAME", "")
        self.instances: dict[str, Instance] = {}
        self.edges: dict[tuple, tuple[str, str]] = {}  # (from instance, port, to instance, port) to (kind, expression)
        self.issues: list[tuple[str, str]] = []
        self.shown: dict[str, str] = {}  # nodes as they were written
        self.connectors = 0
        self.connected: set[tuple[str, str]] = set()
        self.mapplet_ports: dict[tuple[str, str], tuple[str, str]] = {}
        self._load(element, "")
        for i in list(self.instances.values()):
            self._inside(i)
        self.into: dict[tuple[str, str], list[tuple[tuple[str, str], str]]] = {}
        for (a, p, b, q), (kind, _) in self.edges.items():
            self.into.setdefault((b, q), []).append(((a, p), kind))

    def issue(self, kind: str, name: str) -> None:
        self.issues.append((kind, name))

    def edge(self, a: str, p: str, b: str, q: str, kind: str, expression: str = "") -> None:
        key = (a.upper(), p.upper(), b.upper(), q.upper())
        self.shown.setdefault(key[0], a)
        if key not in self.edges or FLOW_RANK[self.edges[key][0]] < FLOW_RANK[kind]:
            self.edges[key] = (kind, expression)

    def _load(self, element: ET.Element, prefix: str) -> None:
        local = {(t.get("NAME") or "").upper(): t for t in element.findall("TRANSFORMATION")}
        inner: set[str] = set()
        for e in element.findall("INSTANCE"):
            name, ref, type_ = e.get("NAME", ""), e.get("TRANSFORMATION_NAME") or e.get("NAME", ""), e.get("TRANSFORMATION_TYPE") or ""
            attrs = {a.get("NAME", ""): a.get("VALUE", "") for a in e.findall("TABLEATTRIBUTE")}
            associated = [a.get("NAME", "") for a in e.findall("ASSOCIATED_SOURCE_INSTANCE")]
            tag = {"Source Definition": "SOURCE", "Target Definition": "TARGET", "Mapplet": "MAPPLET"}.get(type_, "TRANSFORMATION")
            d = local.get(ref.upper()) if tag == "TRANSFORMATION" else None
            d = d if d is not None else self.repository.find(self.folder, tag, ref)
            if d is None:
                self.issue({"SOURCE": "SourceDefinitionNotFound", "TARGET": "TargetDefinitionNotFound", "MAPPLET": "MappletNotFound"}.get(tag, "TransformationNotFound"), ref)
            if tag == "MAPPLET" and d is not None:
                inner.add(name.upper())
                self._load(d, f"{prefix}{name}.")
                for t in d.findall("TRANSFORMATION"):
                    for f in t.findall("TRANSFORMFIELD"):
                        if t.get("TYPE") in ("Input Transformation", "Output Transformation"):
                            boundary = next((i.get("NAME", "") for i in d.findall("INSTANCE") if i.get("TRANSFORMATION_NAME") == t.get("NAME")), t.get("NAME", ""))
                            side = "in" if t.get("TYPE") == "Input Transformation" else "out"
                            self.mapplet_ports[f"{prefix}{name}".upper() + "|" + side, f.get("NAME", "").upper()] = (f"{prefix}{name}.{boundary}", f.get("NAME", ""))
                continue
            ports, groups = [], []
            if d is not None:
                fields = d.findall("TRANSFORMFIELD") + d.findall("SOURCEFIELD") + d.findall("TARGETFIELD")
                ports = [Port(f) for f in fields]
                attrs = {a.get("NAME", ""): a.get("VALUE", "") for a in d.findall("TABLEATTRIBUTE")} | attrs
                groups = [(g.get("NAME", ""), g.get("EXPRESSION") or "") for g in d.findall("GROUP")]
            self.instances[f"{prefix}{name}".upper()] = Instance(f"{prefix}{name}", type_ or (d.get("TYPE") if d is not None else ""), ports, attrs, groups, d, [prefix + a for a in associated], e.get("DBDNAME") or (d.get("DBDNAME") if d is not None else "") or "")
        for c in element.findall("CONNECTOR"):
            a, p, b, q = (c.get(k, "") for k in ("FROMINSTANCE", "FROMFIELD", "TOINSTANCE", "TOFIELD"))
            a, b = prefix + a, prefix + b
            a, p = self.mapplet_ports.get((a.upper() + "|out", p.upper()), (a, p))
            b, q = self.mapplet_ports.get((b.upper() + "|in", q.upper()), (b, q))
            self.edge(a, p, b, q, "Direct")
            self.connectors += 1
            self.connected |= {(a.upper(), p.upper()), (b.upper(), q.upper())}

    def refs(self, i: Instance, expression: str) -> list[str]:
        """Ports of an instance that an expression names."""
        bare = re.sub(r"'(?:[^']|'')*'", " ", expression)
        bare = re.sub(r":(LKP|SP|EXT)\.[\w$]+", " ", bare, flags=re.I)
        names = [m.group(1) for m in re.finditer(r"(?<![\w$.])([A-Za-z_][\w$]*)(?!\s*\()(?![\w$])", bare)]
        return list(dict.fromkeys(n.upper() for n in names if n.upper() not in WORDS and n.upper() in i.ports))

    def controls(self, i: Instance, names: list[str], only: set[str] | None = None) -> None:
        for p in i.ports.values():
            if p.output and (only is None or p.name.upper() in only):
                for n in names:
                    if n != p.name.upper():
                        self.edge(i.name, n, i.name, p.name, "Indirect")

    def _inside(self, i: Instance) -> None:
        t = i.type
        if t == "Source Qualifier" or t == "Application Source Qualifier":
            self._qualifier(i)
        elif t == "Lookup Procedure":
            self._lookup(i)
        elif t == "Stored Procedure":
            node = f"SP:{i.attr('Stored Procedure Name') or i.name}"
            for p in i.ports.values():
                if p.input:
                    self.edge(i.name, p.name, node, f"IN:{p.name}", "Direct")
                if p.output:
                    self.edge(node, f"OUT:{p.name}", i.name, p.name, "Direct")
        elif t == "Router":
            conditions = {g: x for g, x in i.groups if x}
            for p in i.ports.values():
                if p.ref:
                    self.edge(i.name, p.ref, i.name, p.name, "Direct")
                    for n in self.refs(i, conditions.get(p.group, "")):
                        self.edge(i.name, n, i.name, p.name, "Indirect")
            return
        condition = i.attr("Filter Condition") if t == "Filter" else i.attr("Update Strategy Expression") if t == "Update Strategy" else i.attr("Join Condition") if t == "Joiner" else ""
        if condition:
            self.controls(i, self.refs(i, condition))
        if t in ("Aggregator", "Rank", "Sorter"):
            self.controls(i, [p.name.upper() for p in i.ports.values() if p.by])
        for p in i.ports.values():
            self._port(i, p)

    def _port(self, i: Instance, p: Port) -> None:
        if i.type in ("Source Definition", "Target Definition", "Source Qualifier", "Input Transformation", "Output Transformation", "Lookup Procedure", "Stored Procedure"):
            return
        if not (p.output or "VARIABLE" in p.kind):
            return
        if p.expression and p.expression.upper() != p.name.upper():
            kind = "Aggregate" if AGGREGATE.search(p.expression) and i.type in ("Aggregator", "Rank", "Expression") else "Expression"
            names = [n for n in self.refs(i, p.expression) if n != p.name.upper()]
            for n in names:
                self.edge(i.name, n, i.name, p.name, kind, p.expression)
            called = False
            for what, ref in re.findall(r"(?i):(LKP|SP)\.([\w$]+)", p.expression):
                called = True
                self._unconnected(i, p, what.upper(), ref)
            if not names and not called and re.search(r"[A-Za-z_]\w*\s*(?!\()", re.sub(r"'(?:[^']|'')*'|\$\$?\w+", "", p.expression)) and not set(re.findall(r"[A-Za-z_]\w*", p.expression.upper())) & WORDS:
                self.issue("ExpressionRefsNotFound", f"{i.name}.{p.name}")
        elif not p.input:
            same = next((q for q in i.ports.values() if q.input and q.name.upper().rstrip("0123456789") == p.name.upper().rstrip("0123456789")), None)
            if i.type == "Union" or i.groups:
                base = p.name.upper()
                hits = [q for q in i.ports.values() if q.input and (q.name.upper() == base or re.fullmatch(re.escape(base) + r"\d+", q.name.upper()))]
                for q in hits:
                    self.edge(i.name, q.name, i.name, p.name, "Direct")
                same = same or (hits[0] if hits else None)
            elif same is not None:
                self.edge(i.name, same.name, i.name, p.name, "Direct")
            if same is None and i.type not in ("Sequence", "Sequence Generator", "Normalizer", "XML Source Qualifier"):
                self.issue("OutputPortWithoutSource", f"{i.name}.{p.name}")

    def _unconnected(self, i: Instance, p: Port, what: str, ref: str) -> None:
        target = self.instances.get(ref.upper())
        if target is None:
            d = self.repository.find(self.folder, "TRANSFORMATION", ref)
            if d is None:
                self.issue("TransformationNotFound", ref)
                return
            target = Instance(ref, d.get("TYPE") or "", [Port(f) for f in d.findall("TRANSFORMFIELD")], {a.get("NAME", ""): a.get("VALUE", "") for a in d.findall("TABLEATTRIBUTE")}, [], d, [], "")
            self.instances[ref.upper()] = target
            self._inside(target)
        if what == "LKP":
            back = next((q for q in target.ports.values() if "RETURN" in q.kind), None)
            if back is not None:
                self.edge(target.name, back.name, i.name, p.name, "Expression", p.expression)
        else:
            self.edge(f"SP:{target.attr('Stored Procedure Name') or ref}", "OUT:RETURN", i.name, p.name, "Expression", p.expression)

    def _lookup(self, i: Instance) -> None:
        node = f"LKP:{i.attr('Lookup table name') or i.name}"
        for p in i.ports.values():
            if "LOOKUP" in p.kind:
                self.edge(node, p.name, i.name, p.name, "Direct")
        names = self.refs(i, i.attr("Lookup condition"))
        self.controls(i, names, {p.name.upper() for p in i.ports.values() if p.output and "LOOKUP" in p.kind})
        override = i.attr("Lookup Sql Override")
        if override and parse_override(override) is None:
            self.issue("LookupSqlOverrideNotParsed", i.name)

    def _qualifier(self, i: Instance) -> None:
        for text in (i.attr("Source Filter"), i.attr("User Defined Join")):
            bare = re.sub(r"'(?:[^']|'')*'", " ", text)
            for table, column in re.findall(r"([A-Za-z_][\w$]*)\.([A-Za-z_][\w$]*)", bare):
                source = self._source(i, table)
                if source is not None:
                    self._controls_outputs(i, source.name, column)
        override = i.attr("Sql Query")
        if not override:
            return
        parsed = parse_override(override)
        outputs = [p for p in i.ports.values() if p.output and any(a == i.name.upper() and q == p.name.upper() for a, q in self.connected)]
        if parsed is None:
            self.issue("SqlOverrideNotParsed", i.name)
            for table in re.findall(r"(?i)\b(?:from|join)\s+([\w$.\[\]\"]+)", override):
                for p in outputs:
                    self.edge(f"SQL:{table}", "*", i.name, p.name, "Positional")
            return
        items, controls = parsed
        for p, sources in zip(outputs, items, strict=False):
            for table, column, kind in sources:
                self.edge(f"SQL:{table}", column, i.name, p.name, kind if kind != "Direct" else "Direct", override[:200])
        for table, column in controls:
            self._controls_outputs(i, f"SQL:{table}", column)

    def _source(self, i: Instance, table: str) -> Instance | None:
        for name in i.associated:
            s = self.instances.get(name.upper())
            if s is not None and table.upper() in (s.name.upper(), (s.definition.get("NAME", "") if s.definition is not None else "").upper()):
                return s
        return None

    def _controls_outputs(self, i: Instance, node: str, column: str) -> None:
        for p in i.ports.values():
            if p.output:
                self.edge(node, column, i.name, p.name, "Indirect")

    def sources_of(self, target: tuple[str, str]) -> dict[tuple[str, str, str], tuple[int, list[str]]]:
        """Physical ends behind a port: ``(node, port, kind)`` with the fewest hops and a path.

        Shortest first over (port, kind so far): each pair is settled once, so cycles and diamonds cost nothing and the
        work is bounded by the ports of the mapping. All of it is done; there is no other bound.
        """
        start = (target[0], target[1], "Direct")
        best: dict[tuple[str, str, str], tuple[int, list[str]]] = {}
        queue, seen = deque([(start, 0, [f"{target[0]}.{target[1]}"])]), {start}
        while queue:
            (node, port, kind), hops, path = queue.popleft()
            steps = self.into.get((node, port), [])
            if not steps:
                if hops:
                    best.setdefault((node, port, kind), (hops, path))
                continue
            for (a, p), k in steps:
                merged = "Indirect" if "Indirect" in (k, kind) else k if FLOW_RANK[k] > FLOW_RANK[kind] else kind
                state = (a, p, merged)
                if state not in seen:
                    seen.add(state)
                    queue.append((state, hops + 1, [f"{a}.{p}", *path]))
        return best


def parse_override(text: str) -> tuple[list[list[tuple[str, str, str]]], list[tuple[str, str]]] | None:
    """Select items of an override as sources ``(table, column, kind)``, and what its conditions name."""
    sql = re.sub(r"\$\$\w+", "1", text).replace("(+)", "")
    sql = re.sub(r"(?i)\bNVL\s*\(", "ISNULL(", sql)
    try:
        q = Parser(sql.rstrip().rstrip(";")).query()
    except (ParseError, RecursionError):
        return None
    a = Analyzer(Catalog(), "", "", "dbo", "override", "View")
    a.text, a.silent = sql, 1
    columns, control = a.query(q, Scope())
    table = lambda o: f"{o.schema}.{o.name}" if o.schema else o.name
    return [[(table(o), c, KINDS[k]) for o, c, k, _ in d.data.values()] for _, d, _ in columns], [(table(o), c) for o, c, _ in control.control.values()]


class Session:
    def __init__(self, e: ET.Element, workflow: str):
        self.name, self.mapping, self.workflow = e.get("NAME", ""), e.get("MAPPINGNAME", ""), workflow
        self.connection: dict[str, str] = {}
        self.attrs: dict[str, dict[str, str]] = {}
        self.variables = {a.get("NAME", ""): a.get("VALUE", "") for a in e.findall("ATTRIBUTE")}
        for x in [*e.findall("SESSIONEXTENSION"), *e.findall("SESSTRANSFORMATIONINST")]:
            name = x.get("SINSTANCENAME", "").upper()
            for c in x.findall("CONNECTIONREFERENCE"):
                if c.get("CONNECTIONNAME"):
                    self.connection[name] = c.get("CONNECTIONNAME", "")
            self.attrs.setdefault(name, {}).update({a.get("NAME", "").lower(): a.get("VALUE", "") for a in x.findall("ATTRIBUTE")})
            if v := self.attrs[name].get("connection information"):
                self.connection.setdefault(name, v)

    def system(self, name: str, fallback: str) -> str:
        c = self.connection.get(name.upper()) or fallback
        if c in ("$Source", "$Target"):
            found = self.variables.get(f"{c} connection value") or self.variables.get(f"{c[1:]} connection value")
            others = {v for k, v in self.connection.items() if not v.startswith("$")}
            c = found or (next(iter(others)) if len(others) == 1 else c)
        return c


def sessions_of(folder: ET.Element) -> list[Session]:
    out = [Session(s, "") for s in folder.findall("SESSION")]
    reusable = {s.name for s in out}
    for w in [*folder.findall("WORKFLOW"), *folder.findall("WORKLET")]:
        out += [Session(s, w.get("NAME", "")) for s in w.findall("SESSION")]
        for t in w.findall("TASKINSTANCE"):
            if (t.get("TASKTYPE") or t.get("TYPE")) == "Session" and t.get("TASKNAME") in reusable:
                for s in out:
                    if s.name == t.get("TASKNAME") and not s.workflow:
                        s.workflow = w.get("NAME", "")
    return out


def physical(m: Mapping, s: Session | None, node: str, port: str) -> tuple[str, str, str, str]:
    """System, table, type and column of an end of a walk."""
    i = m.instances.get(node)
    written = m.shown.get(node, node)
    if node.startswith("LKP:"):
        owner = next((x for x in m.instances.values() if x.type == "Lookup Procedure" and (x.attr("Lookup table name") or x.name).upper() == node[4:].upper()), None)
        system = s.system(owner.name, owner.attr("Connection Information")) if s and owner else owner.attr("Connection Information") if owner else ""
        return system, written[4:], "LookupTable", port
    if node.startswith("SQL:"):
        owner = next((b for (a, _, b, _) in m.edges if a == node), "")
        q = m.instances.get(owner)
        base = next((x for x in (q.associated if q else [])), "")
        return (s.system(base, "") if s else ""), written[4:], "SqlOverrideTable", port
    if node.startswith("SP:"):
        return "", written[3:], "Procedure", port
    if i is None:
        return "", node, "?", port
    if i.type in ("Source Definition", "Target Definition"):
        over = s.attrs.get(node, {}) if s else {}
        d = i.definition
        file = over.get("source filename") or over.get("output filename")
        if file:
            return over.get("source file directory") or over.get("output file directory") or "", file, "File", port
        table = over.get("source table name") or over.get("target table name") or (d.get("NAME", "") if d is not None else i.name)
        owner = over.get("owner name") or over.get("table name prefix") or (d.get("OWNERNAME") or "" if d is not None else "")
        return (s.system(i.name, i.database) if s else i.database), f"{owner}.{table}" if owner else table, "Source" if i.type == "Source Definition" else "Target", port
    return "", f"{i.name}.{port}", "Constant/Unconnected", port


def analyse(text: str, run_id: str) -> list[tuple[str, dict]]:
    """All rows of one export, with the table each belongs to."""
    out: list[tuple[str, dict]] = []
    repository = Repository(text)
    for folder, element in repository.folders.items():
        sessions = sessions_of(element)
        base = {"RunId": run_id, "Folder": folder}
        for s in sessions:
            for name in sorted(set(s.connection) | set(s.attrs)):
                out.append(("EtlSessions", {**base, "Workflow": s.workflow, "Session": s.name, "Mapping": s.mapping, "Instance": name, "Connection": s.connection.get(name, ""), "Overrides": "; ".join(f"{k}={v}" for k, v in sorted(s.attrs.get(name, {}).items()) if v)}))
        totals = [0, 0, 0, 0]
        for e in element.findall("MAPPING"):
            totals[0] += 1
            try:
                m = Mapping(repository, folder, e)
                rows, columns, covered = mapping_rows(m, [s for s in sessions if s.mapping == m.name] or [None])
            except Exception as x:  # one mapping's failure is a row
                totals[1] += 1
                out.append(("EtlMappings", {**base, "Mapping": e.get("NAME", ""), "Status": "Error", "Instances": 0, "Connectors": 0, "TargetColumns": 0, "CoveredColumns": 0, "Issues": 1}))
                out.append(("EtlUnresolved", {**base, "Mapping": e.get("NAME", ""), "Kind": "MappingError", "Name": f"{type(x).__name__}: {x}"}))
                continue
            totals[2], totals[3] = totals[2] + columns, totals[3] + covered
            out += [(t, {**base, "Mapping": m.name, **r}) for t, r in rows]
            out += [("EtlUnresolved", {**base, "Mapping": m.name, "Kind": k, "Name": n}) for k, n in dict.fromkeys(m.issues)]
            out.append(("EtlMappings", {**base, "Mapping": m.name, "Status": "OkWithUnresolved" if m.issues else "Ok", "Instances": len(m.instances), "Connectors": m.connectors, "TargetColumns": columns, "CoveredColumns": covered, "Issues": len(set(m.issues))}))
    return out


def mapping_rows(m: Mapping, sessions: list[Session | None]) -> tuple[list[tuple[str, dict]], int, int]:
    out: list[tuple[str, dict]] = []
    for (a, p, b, q), (kind, expression) in m.edges.items():
        out.append(("EtlPortLineage", {"FromInstance": a, "FromPort": p, "ToInstance": b, "ToPort": q, "FlowKind": kind, "Expression": expression}))
    columns = covered = 0
    for k, s in enumerate(sessions):
        name = s.name if s else ""
        for i in list(m.instances.values()):
            key = i.name.upper()
            if i.type == "Source Definition":
                system, table, _, _ = physical(m, s, key, "")
                out.append(("EtlObjectLineage", {"Session": name, "Action": "Reads", "System": system, "ObjectName": table, "Confidence": "High" if s else "Medium"}))
            elif i.type == "Lookup Procedure":
                system, table, _, _ = physical(m, s, f"LKP:{i.attr('Lookup table name') or i.name}".upper(), "")
                out.append(("EtlObjectLineage", {"Session": name, "Action": "Lookup", "System": system, "ObjectName": i.attr("Lookup table name") or i.name, "Confidence": "High" if s else "Medium"}))
            elif i.type == "Stored Procedure":
                out.append(("EtlObjectLineage", {"Session": name, "Action": "Calls", "System": "", "ObjectName": i.attr("Stored Procedure Name") or i.name, "Confidence": "Medium"}))
            elif i.type == "Source Qualifier" and i.attr("Sql Query"):
                for node in sorted({a for (a, _, b, _) in m.edges if b == key and a.startswith("SQL:")}):
                    system, table, _, _ = physical(m, s, node, "")
                    out.append(("EtlObjectLineage", {"Session": name, "Action": "ReadsViaSql", "System": system, "ObjectName": table, "Confidence": "High"}))
            if i.type == "Source Qualifier" or i.type == "Target Definition":
                for attr in ("Pre SQL", "Post SQL", "Update Override"):
                    for table in re.findall(r"(?i)\b(?:from|join|into|update|table)\s+([\w$.\[\]]+)", i.attr(attr)):
                        out.append(("EtlObjectLineage", {"Session": name, "Action": "ReadsViaSql", "System": "", "ObjectName": ".".join(split_name(table)), "Confidence": "Low"}))
            if i.type != "Target Definition":
                continue
            system, table, _, _ = physical(m, s, key, "")
            fed = [p for p in i.ports.values() if (key, p.name.upper()) in m.into]
            truncate = (s.attrs.get(key, {}).get("truncate target table option", "") if s else "").upper() == "YES"
            out.append(("EtlObjectLineage", {"Session": name, "Action": "TargetNotConnected" if not fed else "TruncateAndWrites" if truncate else "Writes", "System": system, "ObjectName": table, "Confidence": "High" if s else "Medium"}))
            for p in fed:
                ends = m.sources_of((key, p.name.upper()))
                if k == 0:
                    columns, covered = columns + 1, covered + bool(ends)
                for (node, port, kind), (hops, path) in ends.items():
                    sys_, tab, type_, col = physical(m, s, node, port)
                    out.append(("EtlColumnLineage", {"Session": name, "SourceSystem": sys_, "SourceTable": tab, "SourceObjectType": type_, "SourceColumn": col, "TargetSystem": system, "TargetTable": table, "TargetColumn": p.name, "FlowKind": kind, "Hops": hops, "Path": " → ".join(path)}))
    return out, columns, covered


ETL_TABLES = ("EtlColumnLineage", "EtlPortLineage", "EtlObjectLineage", "EtlMappings", "EtlSessions", "EtlUnresolved")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """``(text)``: whole XML exports under a path."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path).withColumnRenamed("value", "text")


def run(exports: DataFrame, run_id: str = "r1") -> dict[str, DataFrame]:
    """Analyse exports; seven tables."""

    def each(frames):
        for f in frames:
            rows = [(t, json.dumps(r)) for text in f["text"] for t, r in analyse(text, run_id)]
            yield pd.DataFrame(rows, columns=["table", "payload"])

    raw = materialize(exports.select("text").mapInPandas(each, "table string, payload string"), "etl")
    out = {t: raw.where(F.col("table") == t).select(F.from_json("payload", schema(t)).alias("r")).select("r.*") for t in ETL_TABLES}
    m = out["EtlMappings"].groupBy("RunId", "Folder").agg(F.count("*").cast("int").alias("Mappings"), F.count_if(F.col("Status") == "Error").cast("int").alias("Errors"), F.sum("TargetColumns").cast("int").alias("TargetColumns"), F.sum("CoveredColumns").cast("int").alias("CoveredColumns"))
    out["EtlSummary"] = m.withColumn("Coverage", ratio(F.col("CoveredColumns"), F.col("TargetColumns")))
    return out
