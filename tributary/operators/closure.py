"""Bounded closures over edge tables: collapse, terminal queries, all-hop queries, sub-graphs, effects of calls.

Every closure is a loop of equi-joins of a frontier with an adjacency. Rounds are written to the shared folder,
so plans stay short; the loop ends when the frontier is empty or the depth bound is met. Paths are simple: the
nodes on a path travel with it as an array, which depth bounds keep short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.durable import materialize, release
from tributary.names import fold_column, node_key
from tributary.schemas import CALLABLE, CONFIDENCE_RANK, EFFECT_TYPES, EFFECTS, FLOW_RANK, LOCAL, PATH_RANK, PERSISTENT, TRANSIENT, rank, unrank

MODULE_KEY = ("Server", "Database", "ModuleSchema", "ModuleName")
ARROW = " → "
WIDE = 200_000  # paths in a round beyond which alike ones are merged


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _object_key(side: str) -> Column:
    return node_key(*[F.col(side + p) for p in ("Server", "Database", "Schema", "Object")])


def _text(side: str) -> Column:
    return F.concat_ws(".", F.col(side + "Schema"), F.col(side + "Object"), F.col(side + "Column"))


def _local_key(module: Column, type_: Column, key: Column) -> Column:
    """Temps and table variables are nodes of one module; all others are nodes of the whole graph."""
    return F.when(type_.isin(*LOCAL), F.concat_ws("\x1e", module, key)).otherwise(key)


def collapse(edges: DataFrame, objects: DataFrame | None = None, result_sets: DataFrame | None = None, max_depth: int = 32, budget: int = 5000, wide: int = WIDE) -> DataFrame:
    """Paths from persistent sources to persistent targets through temps, views, functions and procedures.

    ``edges`` is ColumnLineage. ``objects`` (ObjectLineage) gives the calls along which a ``#temp`` that a module
    doesn't fill is looked for in its callees, then its callers. ``result_sets (ObjectKey.., Ordinal, Name)``
    turns positions of a procedure's first result set into names. The strongest kind and the worst confidence of
    a path hold for it; of several paths with one kind, the shortest, then first in order, is kept. A start edge
    emits ``budget`` rows at most, the shortest paths first.

    Paths can be many more than rows. Once a round holds more than ``wide`` of them, only the least path is kept for
    each start edge, node and kind where the node lies on no cycle: from there on all of them continue alike.
    """
    flow = edges.where(F.col("FlowKind") != "Indirect")
    module = node_key(*[F.col(c) for c in MODULE_KEY])
    flow = flow.select(
        "*",
        module.alias("mod"),
        _object_key("Source").alias("s_obj"),
        fold_column(F.col("SourceColumn")).alias("s_col"),
        _object_key("Target").alias("t_obj"),
        fold_column(F.col("TargetColumn")).alias("t_col"),
        rank(F.col("FlowKind"), FLOW_RANK).alias("kind"),
        F.coalesce(rank(F.col("Confidence"), CONFIDENCE_RANK), F.lit(3)).alias("conf"),
    )
    if result_sets is not None:
        names = result_sets.select(node_key(*[F.col(c) for c in ("Server", "Database", "Schema", "Object")]).alias("s_obj"), F.concat(F.lit("RS1:#"), F.col("Ordinal").cast("string")).alias("s_col"), F.upper(F.concat(F.lit("RS1:"), F.col("Name"))).alias("named"), F.concat(F.lit("RS1:"), F.col("Name")).alias("shown"))
        flow = flow.join(names, ["s_obj", "s_col"], "left").withColumn("s_col", F.coalesce("named", "s_col")).withColumn("SourceColumn", F.coalesce("shown", "SourceColumn")).drop("named", "shown")
    source = F.struct(*[F.col(c) for c in ("SourceServer", "SourceDatabase", "SourceSchema", "SourceObject", "SourceObjectType", "SourceColumn")])
    adjacency = materialize(
        flow.where(F.col("TargetObjectType").isin(*TRANSIENT)).select(
            _local_key(F.col("mod"), F.col("TargetObjectType"), F.col("t_obj")).alias("a_obj"),
            F.col("t_obj").alias("a_tobj"),
            F.col("t_col").alias("a_col"),
            F.col("mod").alias("a_mod"),
            fold_column(F.col("TargetObject")).alias("a_name"),
            source.alias("a_src"),
            F.col("s_obj").alias("a_sobj"),
            F.col("s_col").alias("a_scol"),
            _text("Source").alias("a_text"),
            F.col("kind").alias("a_kind"),
            F.col("conf").alias("a_conf"),
        ),
        "adjacency",
    )
    columns = adjacency.select(F.col("a_obj").alias("k_obj"), F.col("a_col").alias("k_col")).distinct().withColumn("exact", F.lit(True))
    stars = columns.where("k_col = '*'").select("k_obj", F.lit(True).alias("star"))
    shared = _shared_temps(objects, adjacency) if objects is not None else None
    if shared is not None and shared.isEmpty():
        shared = None
    plain = shared is None and stars.isEmpty()  # then only the exact column can be found
    owner = ("RunId", "Server", "Database", "ModuleSchema", "ModuleName", "ModuleType")
    target = ("TargetServer", "TargetDatabase", "TargetSchema", "TargetObject", "TargetColumn")
    start = flow.where(F.col("TargetObjectType").isin(*PERSISTENT)).select(
        *owner,
        F.col("mod").alias("ctx"),
        *target,
        source.alias("src"),
        F.col("s_obj").alias("c_obj"),
        F.col("s_col").alias("c_col"),
        "kind",
        "conf",
        F.lit(1).alias("Hops"),
        F.array(_text("Source"), _text("Target")).alias("path"),
        F.array(F.concat_ws("\x1f", "t_obj", "t_col"), F.concat_ws("\x1f", "s_obj", "s_col")).alias("seen"),
    )
    start = start.where(F.size(F.array_distinct("seen")) == 2).distinct().withColumn("sid", F.monotonically_increasing_id())
    fields = start.columns
    frontier, emitted, cyclic, rounds = materialize(start, "collapse-0"), [], None, []
    state = ["sid", "ctx", "c_obj", "c_col", "kind"]
    for depth in range(1, max_depth + 2):
        rounds.append(frontier)
        walking = F.col("src.SourceObjectType").isin(*TRANSIENT) & (F.col("Hops") <= max_depth)
        emitted.append(frontier.where(~walking))
        at = frontier.where(walking).withColumn("look_obj", _local_key(F.col("ctx"), F.col("src.SourceObjectType"), F.col("c_obj"))).withColumn("look_col", F.col("c_col"))
        if not plain:
            at = _look_up(at, columns, stars, shared)
        # One join both walks on and finds what leads nowhere.
        at = at.join(adjacency.drop("a_tobj"), (F.col("look_obj") == F.col("a_obj")) & (F.col("look_col") == F.col("a_col")), "left").drop("look_obj", "look_col", "a_obj", "a_col", "a_mod", "a_name")
        at = materialize(at, f"collapse-{depth}")
        rounds.append(at)
        emitted.append(at.where("a_src is null").select(*fields))
        node = F.concat_ws("\x1f", "a_sobj", "a_scol")
        frontier = at.where(F.col("a_src").isNotNull() & ~F.array_contains("seen", node)).select(
            *owner,
            "ctx",
            *target,
            F.col("a_src").alias("src"),
            F.col("a_sobj").alias("c_obj"),
            F.col("a_scol").alias("c_col"),
            F.greatest("kind", "a_kind").alias("kind"),
            F.greatest("conf", "a_conf").alias("conf"),
            (F.col("Hops") + 1).alias("Hops"),
            F.concat(F.array("a_text"), "path").alias("path"),
            F.concat(F.array(node), "seen").alias("seen"),
            "sid",
        )
        held = frontier.count()
        if not held:
            break
        if held > wide:
            if cyclic is None:
                cyclic = _on_cycles(adjacency, shared)
            free = frontier.join(cyclic.select(F.col("n").alias("c_obj")), "c_obj", "left_anti")
            least = free.groupBy(*state).agg(F.min(F.struct("Hops", "path", "conf", F.struct(*[F.col(c) for c in fields if c not in (*state, "Hops", "path", "conf")]).alias("rest"))).alias("b"))
            least = least.select(*state, "b.Hops", "b.path", "b.conf", "b.rest.*").select(*fields)
            frontier = least.unionByName(frontier.join(cyclic.select(F.col("n").alias("c_obj")), "c_obj", "left_semi").select(*fields))
            if budget:  # start edges that have emitted all they may, all by shorter paths
                done = _union(emitted).select("sid", "c_obj", "c_col", "kind").distinct().groupBy("sid").count().where(F.col("count") >= budget)
                frontier = frontier.join(done, "sid", "left_anti")
        frontier = materialize(frontier, f"frontier-{depth}")
    out = _union(emitted).withColumn("Path", F.array_join("path", ARROW))
    key = [*owner, *target, "src", "kind"]
    best = out.groupBy(*key, "sid").agg(F.min(F.struct("Hops", "Path", "conf")).alias("best"))
    if budget:
        best = best.withColumn("n", F.row_number().over(Window.partitionBy("sid").orderBy("best.Hops", "best.Path", "kind"))).where(F.col("n") <= budget)
    best = best.groupBy(*key).agg(F.min("best").alias("best"))
    best = best.select(*owner, "src.*", *target, unrank(F.col("kind"), FLOW_RANK).alias("FlowKind"), "best.Hops", "best.Path", unrank(F.col("best.conf"), CONFIDENCE_RANK).alias("Confidence"))
    best = materialize(best, "collapsed")
    release(adjacency, *rounds, *[x for x in (cyclic, shared) if x is not None])
    return best


def _look_up(at: DataFrame, columns: DataFrame, stars: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Which node's edges to walk: the column's own, else the object's ``*``, else those of a temp that others fill."""
    at = at.withColumnRenamed("look_obj", "l_obj").drop("look_col")
    at = at.join(columns, (F.col("l_obj") == F.col("k_obj")) & (F.col("c_col") == F.col("k_col")), "left").drop("k_obj", "k_col")
    at = at.join(stars, F.col("l_obj") == F.col("k_obj"), "left").drop("k_obj")
    at = at.withColumn("look_obj", F.when(F.col("exact") | F.col("star"), F.col("l_obj"))).withColumn("look_col", F.when(F.col("exact"), F.col("c_col")).when(F.col("star"), F.lit("*")))
    if shared is not None:
        temp = F.col("src.SourceObject").startswith("#") & ~F.col("src.SourceObject").startswith("##") & F.col("look_obj").isNull()
        at = at.withColumn("temp", F.when(temp, fold_column(F.col("src.SourceObject"))))
        any_ = shared.where("h_col = '*'").select(F.col("h_mod").alias("s_mod"), F.col("h_name").alias("s_name"), F.col("there").alias("s_there"))
        own = shared.where("h_col <> '*'").select("h_mod", "h_name", "h_col", "there")
        at = at.join(own, (F.col("ctx") == F.col("h_mod")) & (F.col("temp") == F.col("h_name")) & (F.col("c_col") == F.col("h_col")), "left")
        at = at.join(any_, (F.col("ctx") == F.col("s_mod")) & (F.col("temp") == F.col("s_name")), "left")
        # The nearest module that fills the column or all columns; in one module the column goes first.
        first = F.least(F.when(F.col("there").isNotNull(), F.struct("there.far", "there.h_ctx", F.lit(0).alias("star"), "there.h_obj")), F.when(F.col("s_there").isNotNull(), F.struct("s_there.far", "s_there.h_ctx", F.lit(1).alias("star"), "s_there.h_obj")))
        at = at.withColumn("first", first).withColumn("ctx", F.coalesce("first.h_ctx", "ctx")).withColumn("look_obj", F.coalesce("look_obj", "first.h_obj"))
        at = at.withColumn("look_col", F.coalesce("look_col", F.when(F.col("first.star") == 1, F.lit("*")).when(F.col("first").isNotNull(), F.col("c_col"))))
        at = at.drop("temp", "h_mod", "h_name", "h_col", "there", "s_mod", "s_name", "s_there", "first", "star")
    return at.drop("exact", "star", "l_obj")


def _on_cycles(adjacency: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Objects ``n`` that may lie on a cycle: what is left when objects without way in or way out go, again and again."""
    e = adjacency.select(F.col("a_tobj").alias("u"), F.col("a_sobj").alias("v"))
    if shared is not None:  # a temp leads to all temps of its name that others fill
        name = fold_column(F.col("a_src.SourceObject"))
        e = e.unionByName(adjacency.select(F.col("a_sobj").alias("u"), name.alias("h_name")).join(shared.select("h_name", F.col("there.h_tobj").alias("v")).distinct(), "h_name").select("u", "v"))
    e = materialize(e.distinct(), "object-edges")
    n, before = e.count(), -1
    while n and n != before:
        inner = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        less = materialize(inner, "object-edges")
        release(e)
        e, before = less, n
        n = e.count()
    out = materialize(e.select(F.col("u").alias("n")).distinct(), "on-cycles")
    release(e)
    return out


def call_edges(objects: DataFrame, functions: bool = False) -> DataFrame:
    """Distinct calls ``(caller, callee)`` between module keys."""
    kinds = (*CALLABLE, "ScalarFunction", "InlineTvf", "MsTvf") if functions else CALLABLE
    return objects.where((F.col("Action") == "Calls") & F.col("ObjectType").isin(*kinds)).select(node_key(*[F.col(c) for c in MODULE_KEY]).alias("caller"), node_key(*[F.col("Object" + p) for p in ("Server", "Database", "Schema", "Name")]).alias("callee")).distinct()


def _shared_temps(objects: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Where a temp that a module doesn't fill is filled: ``(h_mod, h_name, h_col)`` to the first callee, else caller, and its temp."""
    calls = call_edges(objects.where(F.col("Provenance").isin("Static", "DynamicStatic")), functions=True)
    near = calls.select(F.col("caller").alias("h_mod"), F.col("callee").alias("h_ctx"), F.lit(0).alias("far")).unionByName(calls.select(F.col("callee").alias("h_mod"), F.col("caller").alias("h_ctx"), F.lit(1).alias("far")))
    filled = adjacency.where(F.col("a_name").startswith("#") & ~F.col("a_name").startswith("##")).select("a_mod", "a_name", "a_obj", "a_tobj", "a_col").distinct()
    met = near.join(filled, F.col("h_ctx") == F.col("a_mod")).select("h_mod", F.col("a_name").alias("h_name"), "h_ctx", "far", F.col("a_obj").alias("h_obj"), F.col("a_tobj").alias("h_tobj"), F.col("a_col").alias("h_col"))
    return materialize(met.groupBy("h_mod", "h_name", "h_col").agg(F.min(F.struct("far", "h_ctx", "h_obj", "h_tobj")).alias("there")), "shared-temps")


def interprocedural(objects: DataFrame, triggers: DataFrame | None = None, max_depth: int = 8) -> DataFrame:
    """Effects that a module has through what it calls and through the triggers it fires, as ObjectLineage rows.

    ``triggers``: ``(Server, Database, ParentSchema, ParentName, TriggerSchema, TriggerName, Events, Disabled)``.
    Each reached module counts once per start, at its least depth; rows carry the statement of the first hop.
    """
    rows = objects.where(~F.col("Provenance").isin("Interprocedural", "Trigger")).withColumn("mod", node_key(*[F.col(c) for c in MODULE_KEY])).withColumn("obj", node_key(*[F.col("Object" + p) for p in ("Server", "Database", "Schema", "Name")]))
    own = rows.where(F.col("Action").isin(*EFFECTS) & F.col("ObjectType").isin(*EFFECT_TYPES))
    statement = F.struct("StatementNo", "StatementType", "Line")
    name = F.concat_ws(".", "ObjectSchema", "ObjectName")
    hops = rows.where((F.col("Action") == "Calls") & F.col("ObjectType").isin(*CALLABLE)).select("mod", F.col("obj").alias("next"), name.alias("label"), statement.alias("first"))
    if triggers is not None:
        fired = triggers.where(~F.coalesce("Disabled", F.lit(False))).select(node_key(F.col("Server"), F.col("Database"), F.col("ParentSchema"), F.col("ParentName")).alias("obj"), node_key(F.col("Server"), F.col("Database"), F.col("TriggerSchema"), F.col("TriggerName")).alias("next"), F.concat(F.lit("[trg]"), F.concat_ws(".", "TriggerSchema", "TriggerName")).alias("label"), F.upper(F.coalesce("Events", F.lit(""))).alias("events"))
        writes = own.where(F.col("Action").isin("Insert", "Update", "Delete", "Merge"))
        verb = F.when(F.col("Action") == "Merge", "INSERT").otherwise(F.upper("Action"))
        hops = hops.unionByName(writes.join(fired, "obj").where((F.col("events") == "") | F.contains(F.col("events"), verb)).select("mod", "next", "label", statement.alias("first")))
    hops = materialize(hops.groupBy("mod", "next").agg(F.min(F.struct("first", "label")).alias("h")).select("mod", "next", "h.first", "h.label"), "calls")
    owner = ("RunId", "Server", "Database", "ModuleSchema", "ModuleName", "ModuleType")
    starts = rows.join(hops.select("mod").distinct(), "mod", "left_semi").groupBy("mod").agg(F.min(F.struct(*owner)).alias("o")).select(F.col("mod").alias("start"), "o.*")
    lead = F.concat_ws(".", "ModuleSchema", "ModuleName")
    step = starts.join(hops, F.col("start") == F.col("mod")).where("next <> start").select("start", *owner, F.col("next").alias("node"), "first", F.concat_ws(" > ", lead, "label").alias("Note"), F.lit(1).alias("depth"))
    reached = frontier = materialize(step, "reach-1")
    for depth in range(2, max_depth + 1):
        step = frontier.join(hops.select("mod", "next", F.col("label").alias("l")), F.col("node") == F.col("mod")).where("next <> start")
        step = step.select("start", *owner, F.col("next").alias("node"), "first", F.concat_ws(" > ", "Note", "l").alias("Note"), F.lit(depth).alias("depth"))
        step = step.groupBy("start", *owner, "node", "depth").agg(F.min(F.struct("Note", "first")).alias("b")).select("start", *owner, "node", "b.first", "b.Note", "depth")
        frontier = materialize(step.join(reached.select("start", "node"), ["start", "node"], "left_anti"), f"reach-{depth}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    effect = own.select(F.col("mod").alias("node"), "Action", "obj", "ObjectServer", "ObjectDatabase", "ObjectSchema", "ObjectName", "ObjectType", "Confidence")
    met = reached.join(effect, "node")
    first = met.groupBy("start", *owner, "Action", "obj").agg(F.min(F.struct("depth", "Note", "first", "ObjectServer", "ObjectDatabase", "ObjectSchema", "ObjectName", "ObjectType", "Confidence")).alias("e"))
    return first.select(
        *owner,
        *("e.first.StatementNo", "e.first.StatementType", "e.first.Line", "Action"),
        *("e.ObjectServer", "e.ObjectDatabase", "e.ObjectSchema", "e.ObjectName", "e.ObjectType"),
        F.when(F.contains(F.col("e.Note"), F.lit("[trg]")), "Trigger").otherwise("Interprocedural").alias("Provenance"),
        F.when(F.col("e.Confidence") == "Exact", "High").otherwise(F.col("e.Confidence")).alias("Confidence"),
        F.col("e.Note").alias("Note"),
    )


def _place(side: str) -> Column:
    """A node as queries show it: with its database."""
    return F.concat_ws(".", *[F.col(side + c) for c in ("Database", "Schema", "Object", "Column")])


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Collapsed edges as ``from`` → ``to`` in walking direction; server takes no part in keys."""
    a, b = ("Target", "Source") if direction == "upstream" else ("Source", "Target")
    key = lambda s: node_key(F.col(s + "Database"), F.col(s + "Schema"), F.col(s + "Object"), F.col(s + "Column"))
    type_ = F.col(b + "ObjectType") if b + "ObjectType" in edges.columns else F.lit("Table")
    return edges.select(
        key(a).alias("f"),
        _place(a).alias("f_text"),
        key(b).alias("t"),
        _place(b).alias("t_text"),
        F.struct(*[F.col(b + p).alias("End" + p) for p in ("Server", "Database", "Schema", "Object")], type_.alias("EndObjectType"), F.col(b + "Column").alias("EndColumn")).alias("end"),
        rank(F.col("FlowKind"), PATH_RANK).alias("k"),
        rank(F.col("Confidence"), CONFIDENCE_RANK).alias("c"),
        F.concat_ws(".", "ModuleSchema", "ModuleName").alias("m"),
    )


def _start_node(*more: str) -> Column:
    return F.concat_ws(".", "Database", "Schema", "Object", *more)


def query_terminals(edges: DataFrame, starts: DataFrame, direction: str = "upstream", max_hops: int = 10, max_rows: int | None = 500_000) -> DataFrame:
    """Where walks from ``starts (Database, Schema, Object, Column)`` end, over Collapsed edges; ``direction`` may be ``both``.

    Ends are sources with no further edge, unresolved ends, the hop bound, and nodes already on the path.
    The kind is the strongest on the path (indirect outranks), the confidence the worst. Beyond ``max_rows`` the
    first in order of hops and path are kept, and a row with the reason ``MAX_ROWS`` says that there are more.
    """
    if direction == "both":
        return query_terminals(edges, starts, "upstream", max_hops, max_rows).unionByName(query_terminals(edges, starts, "downstream", max_hops, max_rows))
    adj = materialize(_oriented(edges, direction), "oriented")
    has = adj.select(F.col("f").alias("n")).distinct().withColumn("more", F.lit(True))
    begin = starts.select(node_key(F.col("Database"), F.col("Schema"), F.col("Object"), F.col("Column")).alias("f"), _start_node().alias("StartNode"), F.col("Column").alias("StartColumn")).distinct()
    order = (lambda new, old: F.concat(F.array(new), old)) if direction == "upstream" else (lambda new, old: F.concat(old, F.array(new)))
    frontier = begin.join(adj, "f").select("StartNode", "StartColumn", F.col("t").alias("node"), "end", "k", "c", F.lit(1).alias("Hops"), order(F.col("t_text"), F.array("f_text")).alias("path"), F.array("m").alias("mods"), F.array("f").alias("seen"))
    ends, found, cut = [], 0, False
    for depth in range(1, max_hops + 1):
        at = frontier.join(has, F.col("node") == F.col("n"), "left")
        cycle = F.array_contains("seen", F.col("node"))
        reason = F.when(cycle, "CYCLE").when(F.col("more").isNull(), F.when(F.col("end.EndObjectType").isin("Unresolved", "External"), "UNRESOLVED").otherwise("PHYSICAL_SOURCE")).when(F.lit(depth >= max_hops), "MAX_HOPS")
        at = materialize(at.withColumn("TerminalReason", reason).drop("n", "more"), f"ends-{depth}")
        ends.append(at.where("TerminalReason is not null"))
        n = at.groupBy(F.col("TerminalReason").isNull().alias("open")).count().collect()  # two rows
        ended, live = sum(r["count"] for r in n if not r["open"]), sum(r["count"] for r in n if r["open"])
        found += ended
        if not live:
            break
        walks = at.where("TerminalReason is null")
        if max_rows and found >= max_rows:  # what is still open ends by longer paths
            cut = True
            break
        if max_rows and live > max_rows:  # every open walk ends in a row at least
            walks, cut = walks.orderBy("path", "mods", "StartNode", "StartColumn", "k", "c").limit(max_rows), True
        step = walks.join(adj.select("f", "t", "t_text", F.col("end").alias("e2"), F.col("k").alias("k2"), F.col("c").alias("c2"), "m"), F.col("node") == F.col("f"))
        frontier = step.select("StartNode", "StartColumn", F.col("t").alias("node"), F.col("e2").alias("end"), F.greatest("k", "k2").alias("k"), F.greatest("c", "c2").alias("c"), (F.col("Hops") + 1).alias("Hops"), order(F.col("t_text"), F.col("path")).alias("path"), order(F.col("m"), F.col("mods")).alias("mods"), F.concat("seen", F.array("node")).alias("seen"))
    out = _union(ends).select(F.lit(direction).alias("Direction"), "StartNode", "StartColumn", "end.*", "Hops", unrank(F.col("k"), PATH_RANK).alias("FlowKind"), unrank(F.col("c"), CONFIDENCE_RANK).alias("Confidence"), "TerminalReason", F.array_join("path", ARROW).alias("Path"), F.array_join("mods", " > ").alias("Modules"))
    if max_rows and (cut or found > max_rows):
        kept = out.orderBy("Hops", "Path", "Modules", "StartNode", "StartColumn", "FlowKind", "Confidence").limit(max_rows)
        mark = {"Direction": F.lit(direction), "TerminalReason": F.lit("MAX_ROWS")}
        more = edges.sparkSession.range(1).select(*[mark.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in out.schema])
        return kept.unionByName(more)
    return out


def all_hops(edges: DataFrame, starts: DataFrame, direction: str = "upstream", max_hops: int = 10) -> DataFrame:
    """Every node on walks from ``starts``, with the kind and confidence of the last edge; a null start column means all."""
    adj = materialize(_oriented(edges, direction), "oriented")
    obj, col = F.regexp_replace("f", "\x1f[^\x1f]*$", ""), F.regexp_extract("f", "([^\x1f]*)$", 1)
    begin = starts.select(node_key(F.col("Database"), F.col("Schema"), F.col("Object")).alias("s_obj"), F.when(F.col("Column").isNotNull(), fold_column(F.col("Column"))).alias("s_col"), _start_node().alias("StartNode")).distinct()
    first = adj.withColumn("s_obj", obj).join(begin, "s_obj").where(F.col("s_col").isNull() | (F.col("s_col") == col))
    frontier = materialize(first.select("StartNode", F.col("t").alias("node"), "end", "k", "c", F.lit(1).alias("Hops"), F.array("t").alias("seen")), "hop-1")
    found = [frontier]
    for depth in range(2, max_hops + 1):
        step = frontier.drop("end", "k", "c", "Hops").join(adj, F.col("node") == F.col("f")).where(~F.array_contains("seen", F.col("t")))
        frontier = materialize(step.select("StartNode", F.col("t").alias("node"), "end", "k", "c", F.lit(depth).alias("Hops"), F.concat("seen", F.array("t")).alias("seen")), f"hop-{depth}")
        if frontier.isEmpty():
            break
        found.append(frontier)
    return _union(found).select("StartNode", "end.*", "Hops", unrank(F.col("k"), PATH_RANK).alias("FlowKind"), unrank(F.col("c"), CONFIDENCE_RANK).alias("Confidence"))


def subgraph(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """Edges among the nodes within ``hops`` of ``starts (node)``, direction ignored; ``edges (src, dst, kind, module)``."""
    e = edges.where("src <> dst")
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = frontier = materialize(starts.select("node").distinct(), "ring-0")
    for depth in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti"), f"ring-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    inside = e.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.groupBy("src", "dst").agg(F.min(F.struct("module", "kind")).alias("b")).select("src", "dst", "b.kind", "b.module")
