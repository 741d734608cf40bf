"""A catalog too large to send to all tasks: modules are given what they ask for, with the results of the whole catalog."""

import json
from pathlib import Path

from tributary import corpus
from tributary.plans import session
from tributary.sources import files

MORE = """
CREATE TABLE dbo.sales_2019 (id int, total int);
GO
CREATE TABLE dbo.sales_2020 (id int, total int);
GO
CREATE TABLE other.lonely (id int);
GO
CREATE VIEW dbo.v_one AS SELECT id, total FROM dbo.sales_2019
GO
CREATE VIEW dbo.v_two AS SELECT id, total AS twice FROM v_one
GO
CREATE VIEW dbo.v_three AS SELECT * FROM v_two
GO
CREATE PROCEDURE dbo.chain AS INSERT INTO made_here SELECT * FROM v_three, lonely
GO
CREATE PROCEDURE dbo.years @y varchar(4), @t varchar(20) AS
BEGIN
  DECLARE @s nvarchar(200) = 'INSERT INTO dbo.sum_' + @t + ' SELECT id, total FROM dbo.sales_' + @y;
  EXEC (@s);
  SET @s = 'load_' + @y; EXEC @s
END
GO
CREATE PROCEDURE dbo.load_a AS CREATE TABLE dbo.sum_x (id int, total int)
GO
CREATE PROCEDURE dbo.load_b AS EXEC dbo.years @t = 'x', @y = @@SPID
GO
CREATE SYNONYM dbo.syn FOR dbo.v_three
GO
CREATE PROCEDURE dbo.by_synonym AS SELECT id, twice INTO dbo.kept FROM syn
"""


def found(s, names):
    out = {}
    for t in names:
        rows = s.tables[t].drop("ElapsedMs").toPandas()
        out[t] = sorted(json.dumps(r, default=str, sort_keys=True) for r in rows.to_dict("records"))
    return out


def test_lookups_find_what_the_whole_catalog_gives(spark, monkeypatch):
    scripts = [("more", MORE), ("tables", corpus.TABLES), ("lineage", (Path(__file__).parent / "lineage_script.sql").read_text()), *corpus.SCRIPTS.items()]
    rows = files.read_script_table(spark.createDataFrame(scripts, "f string, t string"), "f", "t")
    config = session.Config(archive_patterns=[r"^(.*)_\d{4}$"])
    tables = (*session.ROW_TABLES, "ResultSets")
    whole = session.LineageSession.from_scripts(spark, rows, config)
    whole.analyze()
    want = found(whole, tables)
    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(session, "FEW", 10)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(v) or send(self, v))
    parts = session.LineageSession.from_scripts(spark, rows, config)
    parts.analyze()
    assert not sent and all(want.values())
    got = found(parts, tables)
    for t in tables:
        assert got[t] == want[t], t
