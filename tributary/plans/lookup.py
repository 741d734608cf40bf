"""Analysis of modules with a catalog too large to send to all tasks: each module is given the objects it asks for.

The first round gives a module what the text after its verbs names. Analysis notes all names it looks up; a module that
has looked up others is analysed again with those as well, until it asks for nothing new. What it has not been given it
thus knows not to be there, and results are those of the whole catalog. Nothing of this goes through the driver but the databases.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.durable import materialize, release
from tributary.names import fold, split_name
from tributary.sources import files
from tributary.tsql.analyze import NAME_AFTER
from tributary.tsql.model import Column, Entry, Partial

NAME, ORDER = ["fs", "fd", "fn"], ["overlay", "source", "at"]
FIELDS = [c.split()[0] for c in files.ENTRY.split(", ")]


def asked_first(e: Entry) -> set[tuple]:
    """Keys of the names that a module probably looks up: its own, its parent's, those after verbs."""
    names = [*(e.table or [])[-1:], *(split_name(n)[-1] for _, n in NAME_AFTER.findall(e.definition or ""))]
    return {(fold(e.server), fold(e.database), fold(n)) for n in (e.name, *(n for n in names if n and n[0] not in "#@"))}


def index(slim: DataFrame, facts: DataFrame) -> DataFrame:
    """Catalog objects and tables that code creates, by name; ``ORDER`` is theirs in the catalog."""
    out = "fs string, fd string, fk string, fn string, database string, overlay int, source string, at long, payload string"

    def row(e: Entry, at: int) -> tuple:
        payload = json.dumps([*files.pack(e), e.overlay])
        k = e.obj.key
        return (k[0], k[1], k[2], k[3], e.database, int(e.overlay), e.source or "", at, payload)

    def known(frames):
        for f in frames:
            yield pd.DataFrame([row(files.unpack(r), r["at"]) for r in f.to_dict("records")], columns=[c.split()[0] for c in out.split(", ")])

    def made(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                parts = split_name(r["name"])
                cols = [Column(*c) for c in json.loads(r["values"][0])] if len(r["values"]) else None
                rows.append(row(Entry(r["server"], r["database"], parts[-2] if len(parts) > 1 else "dbo", parts[-1], "Table", cols, overlay=True, source=r["name"]), 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    rows = slim.select(*FIELDS, F.monotonically_increasing_id().alias("at")).mapInPandas(known, out)
    return materialize(rows.unionByName(facts.where("kind = 'table'").mapInPandas(made, out)), "catalog")


def literals(facts: DataFrame) -> DataFrame:
    """``(own, literals)``: what is passed to a procedure, by its key, as JSON of ``[parameter, values]``."""

    def keyed(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                parts = split_name(r["name"])
                key = json.dumps([fold(r["server"]), fold(r["database"]), fold(parts[-2] if len(parts) > 1 else "dbo"), fold(parts[-1])])
                rows.append((key, r["name"], r["param"], json.dumps([r["param"], list(r["values"])])))
            yield pd.DataFrame(rows, columns=["own", "name", "param", "literal"])

    rows = facts.where("kind = 'arg'").mapInPandas(keyed, "own string, name string, param string, literal string")
    return rows.groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "param", "literal"))), lambda x: x["literal"]).alias("literals"))


def _entry(payload: str) -> Entry:
    *fields, overlay = json.loads(payload)
    e = files.unpack(dict(zip(FIELDS, fields, strict=True)))
    e.overlay = overlay
    return e


def _found(objects: DataFrame, sought: DataFrame) -> DataFrame:
    """``(seek, hits)`` for requests ``seek`` of ``Partial.matching``: the first objects that fit, in the catalog's order."""
    order = F.struct(*ORDER)
    # Of objects with one key the last replaces the others, at the place of the first; what code creates replaces nothing.
    once = objects.groupBy("fs", "fd", "fk", "fn").agg(F.min(order).alias("place"), F.max_by("payload", F.when(F.col("overlay") == 0, order)).alias("last"), F.min_by("payload", order).alias("first"))
    once = once.select("fs", "fd", "fk", "place", F.coalesce("last", "first").alias("payload"))
    seeks = sought.select("seek").distinct().select("seek", F.get_json_object("seek", "$[0]").alias("fs"), F.get_json_object("seek", "$[1]").alias("fd"))

    def fits(frames):
        for f in frames:
            keep = []
            for seek, schema, payload in zip(f["seek"], f["fk"], f["payload"], strict=True):
                _, _, types, pattern, _, wanted = json.loads(seek)
                e = _entry(payload)
                keep.append(e.type in types and re.match(pattern, e.name, re.I) is not None and (not wanted or schema == wanted))
            yield f[keep]

    pairs = seeks.join(once, ["fs", "fd"]).select("seek", "fk", "place", "payload")
    hits = pairs.mapInPandas(fits, pairs.schema)
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("seek").orderBy("place"))).where(F.col("n") <= F.get_json_object("seek", "$[4]").cast("int"))
    hits = hits.groupBy("seek").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "payload"))), lambda x: x["payload"]).alias("hits"))
    return seeks.select("seek").join(hits.hint("merge"), "seek", "left").select("seek", F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))


def analysed(todo: DataFrame, objects: DataFrame, args: DataFrame, patterns: list[str], spread: Callable[[DataFrame], DataFrame], one: Callable[..., list[tuple]]) -> DataFrame:
    """``(table, payload)`` of all modules of ``todo``; ``one(catalog, entry, row, args)`` gives those of a module."""
    seen: dict = {}
    for r in objects.groupBy("fs", "fd").agg(F.max_by("database", F.struct(*ORDER)).alias("database")).collect():  # one for each database
        seen.setdefault(r.fs, {})[r.fd] = r.database
    columns = todo.columns
    todo = materialize(todo.withColumn("mid", F.monotonically_increasing_id()), "modules")

    def first(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                e = files.unpack(r)
                own = json.dumps(list(e.obj.key))
                rows += [(r["mid"], *name, own if name[2] == fold(e.name) else None) for name in asked_first(e)]
            yield pd.DataFrame(rows, columns=["mid", *NAME, "own"])

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                e = files.unpack(r)
                asked = asked_first(e) if r["asked"] is None else {tuple(json.loads(x)) for x in r["asked"]}
                scans = {x["seek"]: [_entry(p) for p in x["hits"]] for x in (r["scans"] if r["scans"] is not None else ())}
                catalog, passed = Partial(seen, [_entry(p) for p in (r["given"] if r["given"] is not None else ())], scans, patterns), {}
                own = catalog.held(e.obj.key)
                for p, values in map(json.loads, r["literals"] if r["literals"] is not None and own is not None else ()):
                    p = own.params[int(p[1:]) - 1] if p[1:].isdigit() and int(p[1:]) <= len(own.params) else p
                    passed.setdefault(fold(p), []).extend(values)
                rows = one(catalog, e, r, {own.obj.key: passed} if passed else {})
                if catalog.asked <= asked and not catalog.sought:
                    out += [(r["mid"], t, p) for t, p in rows]
                else:
                    out += [(r["mid"], "?name", json.dumps(x)) for x in asked | catalog.asked]
                    out += [(r["mid"], "?seek", x) for x in catalog.sought | set(scans)]
            yield pd.DataFrame(out, columns=["mid", "table", "payload"])

    wanted = materialize(todo.mapInPandas(first, "mid long, fs string, fd string, fn string, own string"), "wanted")
    passed = wanted.where("own is not null").select("mid", "own").join(args.hint("merge"), "own").select("mid", "literals")
    passed = materialize(passed, "passed")
    asked, scans, done, used = None, None, [], [wanted]
    while True:
        given = wanted.join(objects.select(*NAME, *ORDER, "payload").hint("merge"), NAME).groupBy("mid").agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "payload"))), lambda x: x["payload"]).alias("given"))
        rows = todo.join(given.hint("merge"), "mid", "left").join(passed.hint("merge"), "mid", "left")
        rows = rows.join(asked.hint("merge"), "mid") if asked is not None else rows.withColumn("asked", F.lit(None).cast("array<string>"))
        rows = rows.join(scans.hint("merge"), "mid", "left") if scans is not None else rows.withColumn("scans", F.lit(None).cast("array<struct<seek:string,hits:array<string>>>"))
        raw = materialize(spread(rows.select(*columns, "mid", "given", "literals", "asked", "scans")).mapInPandas(run, "mid long, table string, payload string"), "analysis")
        done.append(raw.where("table not like '?%'").select("table", "payload"))
        names = raw.where("table = '?name'")
        if names.isEmpty():
            break
        asked = names.groupBy("mid").agg(F.collect_list("payload").alias("asked"))
        part = lambda i: F.get_json_object("payload", f"$[{i}]")
        wanted = names.select("mid", part(0).alias("fs"), part(1).alias("fd"), part(2).alias("fn"))
        sought = raw.where("table = '?seek'").select("mid", F.col("payload").alias("seek"))
        scans = None
        if not sought.isEmpty():
            met = sought.join(materialize(_found(objects, sought), "found").hint("merge"), "seek")
            scans = met.groupBy("mid").agg(F.collect_list(F.struct("seek", "hits")).alias("scans"))
    release(todo, passed, *used)
    return reduce(DataFrame.unionByName, done)
