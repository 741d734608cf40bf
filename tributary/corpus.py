"""Scripts for the registered queries of the analyser, one for each group of its rules.

Every script is analysed with the tables of ``TABLES``; ``rows`` shows what was found as ``(Part, Name, What, Detail)``:
flows (``source -> target`` and kind), objects (action and type), issues and dynamic statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.plans.session import Config, LineageSession
from tributary.sources import files

TABLES = """
CREATE TABLE dbo.customer (id int, name varchar(20), nation int, balance decimal(18,2));
GO
CREATE TABLE dbo.orders (id int, customer int, total decimal(18,2), day date, tags varchar(100));
GO
CREATE TABLE dbo.summary (id int, name varchar(20), total decimal(18,2), rank int);
GO
CREATE TABLE dbo.audit (what varchar(20), old decimal(18,2), new decimal(18,2));
GO
CREATE VIEW dbo.v_orders AS SELECT o.id, o.total * 2 AS twice FROM dbo.orders o WHERE o.day > '2020-01-01'
GO
CREATE FUNCTION dbo.f_orders (@c int) RETURNS TABLE AS RETURN SELECT o.id, o.total FROM dbo.orders o WHERE o.customer = @c
GO
CREATE FUNCTION dbo.f_tax (@x decimal(18,2)) RETURNS decimal(18,2) AS BEGIN RETURN @x * 0.2 END
GO
CREATE FUNCTION dbo.f_many (@c int) RETURNS @r TABLE (id int, total decimal(18,2)) AS BEGIN INSERT INTO @r (id, total) SELECT id, total FROM dbo.orders; RETURN END
GO
CREATE PROCEDURE dbo.give AS SELECT id, name FROM dbo.customer
GO
CREATE SYNONYM dbo.clients FOR dbo.customer
GO
"""

SCRIPTS = {
    "rules_sources_named": "INSERT INTO dbo.summary (id, name) SELECT c.id, c.name FROM dbo.clients c;\nINSERT INTO dbo.summary (id, total) SELECT v.id, v.twice FROM dbo.v_orders v;\nWITH t (a, b) AS (SELECT id, total FROM dbo.orders) INSERT INTO dbo.summary (id, total) SELECT a, b FROM t;\nINSERT INTO dbo.summary (id, total) SELECT d.k, d.t FROM (SELECT customer, total FROM dbo.orders) d (k, t);\nDECLARE @t TABLE (id int, n varchar(20));\nINSERT INTO @t (id, n) SELECT id, name FROM dbo.customer;\nINSERT INTO dbo.summary (id, name) SELECT id, n FROM @t;",
    "rules_sources_functions": "INSERT INTO dbo.summary (id, total) SELECT f.id, f.total FROM dbo.customer c CROSS APPLY dbo.f_orders(c.id) f;\nINSERT INTO dbo.summary (id, total) SELECT f.id, f.total FROM dbo.f_many(1) f;\nINSERT INTO dbo.summary (name) SELECT s.value FROM dbo.orders o CROSS APPLY STRING_SPLIT(o.tags, ',') s;\nINSERT INTO dbo.summary (id, name) SELECT j.k, j.n FROM dbo.orders o CROSS APPLY OPENJSON(o.tags) WITH (k int, n varchar(20)) j;\nINSERT INTO dbo.summary (id, name) SELECT x.a, x.b FROM (VALUES (1, 'p'), (2, 'q')) x (a, b);",
    "rules_sources_pivot": "INSERT INTO dbo.summary (id, total) SELECT p.customer, p.[1] FROM (SELECT customer, id, total FROM dbo.orders) s PIVOT (SUM(total) FOR id IN ([1], [2])) p;\nINSERT INTO dbo.audit (what, new) SELECT u.kind, u.amount FROM (SELECT id, total, total AS other FROM dbo.orders) s UNPIVOT (amount FOR kind IN (total, other)) u;",
    "rules_sources_remote": "INSERT INTO dbo.summary (id, name) SELECT id, name FROM OPENQUERY(FAR, 'SELECT id, name FROM crm.dbo.people');\nINSERT INTO dbo.summary (id) SELECT b.x FROM OPENROWSET(BULK 'c:\\in.csv', FORMATFILE = 'c:\\f.xml') b;\nBULK INSERT dbo.summary FROM 'c:\\in.csv';\nINSERT INTO dbo.summary (id) SELECT q.k FROM NOWHERE.dbo.t q;",
    "rules_projection": "INSERT INTO dbo.summary SELECT id, name, balance, nation FROM dbo.customer;\nINSERT INTO dbo.summary (id, total) SELECT id, balance + nation FROM dbo.customer;\nINSERT INTO dbo.summary (name) SELECT UPPER(name) FROM dbo.customer WHERE balance > 0;\nINSERT INTO dbo.summary (total) SELECT CASE WHEN nation = 1 THEN balance ELSE 0 END FROM dbo.customer;\nINSERT INTO dbo.summary (total) SELECT IIF(nation = 1, balance, id) FROM dbo.customer;\nINSERT INTO dbo.summary (total) SELECT dbo.f_tax(balance) FROM dbo.customer;\nINSERT INTO dbo.summary (id) SELECT c.* FROM (SELECT id FROM dbo.customer) c;",
    "rules_joins": "INSERT INTO dbo.summary (id, total) SELECT c.id, o.total FROM dbo.customer c LEFT JOIN dbo.orders o ON o.customer = c.id;\nINSERT INTO dbo.summary (id, total) SELECT c.id, x.t FROM dbo.customer c OUTER APPLY (SELECT TOP 1 o.total AS t FROM dbo.orders o WHERE o.customer = c.id ORDER BY o.day) x;\nINSERT INTO dbo.summary (id) SELECT c.id FROM dbo.customer c WHERE EXISTS (SELECT 1 FROM dbo.orders o WHERE o.customer = c.id);\nINSERT INTO dbo.summary (id, total) SELECT c.id, (SELECT MAX(o.total) FROM dbo.orders o WHERE o.customer = c.id) FROM dbo.customer c;\nINSERT INTO dbo.summary (id) SELECT id FROM dbo.customer WHERE nation IN (SELECT id FROM dbo.orders);",
    "rules_aggregates": "INSERT INTO dbo.summary (id, total) SELECT customer, SUM(total) FROM dbo.orders GROUP BY customer HAVING COUNT(*) > 1;\nINSERT INTO dbo.summary (id, total) SELECT customer, AVG(DISTINCT total) FROM dbo.orders GROUP BY ROLLUP (customer);\nINSERT INTO dbo.summary (rank) SELECT COUNT(*) FROM dbo.orders;\nINSERT INTO dbo.summary (name) SELECT STRING_AGG(name, ',') WITHIN GROUP (ORDER BY id) FROM dbo.customer;",
    "rules_windows": "INSERT INTO dbo.summary (id, rank) SELECT id, ROW_NUMBER() OVER (PARTITION BY customer ORDER BY day) FROM dbo.orders;\nINSERT INTO dbo.summary (id, total) SELECT id, SUM(total) OVER (PARTITION BY customer) FROM dbo.orders;\nINSERT INTO dbo.summary (id, total) SELECT id, LAG(total, 1, 0) OVER (ORDER BY day) FROM dbo.orders;\nINSERT INTO dbo.summary (id) SELECT TOP (5) id FROM dbo.orders ORDER BY total DESC;\nINSERT INTO dbo.summary (id) SELECT id FROM dbo.orders ORDER BY day OFFSET 5 ROWS FETCH NEXT 5 ROWS ONLY;",
    "rules_set_operations": "INSERT INTO dbo.summary (id) SELECT id FROM dbo.customer UNION ALL SELECT customer FROM dbo.orders;\nINSERT INTO dbo.summary (id) SELECT id FROM dbo.customer EXCEPT SELECT customer FROM dbo.orders;\nINSERT INTO dbo.summary (id) SELECT id FROM dbo.customer INTERSECT SELECT customer FROM dbo.orders;",
    "rules_updates": "UPDATE s SET s.total = o.total, s.rank += 1 FROM dbo.summary s JOIN dbo.orders o ON o.id = s.id WHERE o.day > '2020-01-01';\nUPDATE dbo.summary SET total = balance FROM dbo.customer c WHERE c.id = dbo.summary.id;\nDELETE s OUTPUT 'gone', deleted.total INTO dbo.audit (what, old) FROM dbo.summary s JOIN dbo.customer c ON c.id = s.id WHERE c.balance < 0;\nUPDATE dbo.summary SET total = 0 OUTPUT deleted.total, inserted.total INTO dbo.audit (old, new) WHERE id = 1;\nTRUNCATE TABLE dbo.audit;",
    "rules_merge": "MERGE INTO dbo.summary AS t USING (SELECT customer, SUM(total) AS total FROM dbo.orders GROUP BY customer) AS s ON t.id = s.customer WHEN MATCHED AND s.total > 10 THEN UPDATE SET t.total = s.total WHEN NOT MATCHED THEN INSERT (id, total) VALUES (s.customer, s.total) WHEN NOT MATCHED BY SOURCE THEN DELETE OUTPUT $action, deleted.total, inserted.total INTO dbo.audit (what, old, new);",
    "rules_tables_made": "SELECT id, name INTO #t FROM dbo.customer;\nSELECT id, total INTO dbo.fresh FROM dbo.orders;\nCREATE TABLE #u (a int, b AS a * 2);\nINSERT INTO #u (a) SELECT id FROM #t;\nINSERT INTO dbo.summary (id, total) SELECT a, b FROM #u;\nALTER TABLE #u ADD c int;\nDROP TABLE #t;",
    "rules_variables": "DECLARE @x int = (SELECT MAX(id) FROM dbo.customer), @y decimal(18,2);\nSELECT @y = balance FROM dbo.customer WHERE id = @x;\nSET @y += 1;\nINSERT INTO dbo.summary (id, total) VALUES (@x, @y);\nIF @y > 0 SET @x = (SELECT MIN(id) FROM dbo.orders) ELSE SET @x = 0;\nUPDATE dbo.summary SET rank = @x;",
    "rules_cursors": "DECLARE @i int, @n varchar(20);\nDECLARE c CURSOR FOR SELECT id, name FROM dbo.customer WHERE balance > 0;\nOPEN c;\nFETCH NEXT FROM c INTO @i, @n;\nWHILE @@FETCH_STATUS = 0\nBEGIN\n  INSERT INTO dbo.summary (id, name) VALUES (@i, @n);\n  FETCH NEXT FROM c INTO @i, @n;\nEND\nCLOSE c; DEALLOCATE c;",
    "rules_calls": "CREATE PROCEDURE dbo.caller @p int, @out int OUTPUT AS\nBEGIN\n  DECLARE @r int;\n  INSERT INTO dbo.summary (id, name) EXEC dbo.give;\n  EXEC @r = dbo.missing @a = @p, @b = @out OUTPUT;\n  INSERT INTO dbo.summary (rank, total) VALUES (@r, @out);\n  EXEC msdb.dbo.sp_start_job @job_name = 'nightly';\n  SELECT id, balance FROM dbo.customer;\n  SELECT @out = MAX(id) FROM dbo.orders;\n  RETURN 1;\nEND",
    "rules_trigger": "CREATE TRIGGER dbo.tr ON dbo.summary AFTER UPDATE AS\nINSERT INTO dbo.audit (what, old, new) SELECT 'u', d.total, i.total FROM inserted i JOIN deleted d ON d.id = i.id",
    "rules_dynamic": "DECLARE @s nvarchar(max) = N'INSERT INTO dbo.summary (id) SELECT id FROM dbo.' + N'customer';\nEXEC (@s);\nDECLARE @t sysname = QUOTENAME('orders');\nEXEC sp_executesql N'SELECT @o = MAX(total) FROM dbo.orders WHERE id = @i', N'@i int, @o decimal(18,2) OUTPUT', @i = 1, @o = @s OUTPUT;\nDECLARE @q nvarchar(max) = CONCAT(N'DELETE FROM dbo.', @t, N' WHERE id = ', 5);\nEXEC (@q);\nDECLARE @proc sysname = N'dbo.give';\nEXEC @proc;\nDECLARE @bad nvarchar(max) = N'TRUNCATE TABLE dbo.audit; SELECT ((( FROM dbo.customer';\nEXEC (@bad);",
    "rules_strings": "CREATE PROCEDURE dbo.strings @name sysname = 'customer' AS\nBEGIN\n  DECLARE @s nvarchar(max) = REPLACE(N'SELECT id FROM dbo.{t}', N'{t}', @name);\n  EXEC (@s);\n  DECLARE @f nvarchar(max) = FORMATMESSAGE(N'INSERT INTO dbo.%s (id) SELECT id FROM dbo.%s', N'summary', N'orders');\n  EXEC (@f);\n  DECLARE @w nvarchar(max) = CONCAT_WS(N' ', N'TRUNCATE', N'TABLE', OBJECT_SCHEMA_NAME(@@PROCID) + N'.audit');\n  EXEC (@w);\n  DECLARE @u nvarchar(max) = UPPER(N'select name from dbo.') + COALESCE(NULL, N'customer');\n  EXEC (@u);\nEND",
    "rules_archives": "CREATE PROCEDURE dbo.years @y int AS\nBEGIN\n  INSERT INTO dbo.summary (id) SELECT id FROM FILES_2021.dbo.customer;\n  DECLARE @s nvarchar(max) = N'INSERT INTO dbo.summary (total) SELECT total FROM FILES_' + CAST(@y AS nvarchar(4)) + N'.dbo.orders';\n  EXEC (@s);\n  DECLARE @d nvarchar(max) = N'SELECT a FROM OTHER_' + CAST(@y AS nvarchar(4)) + N'.dbo.t';\n  EXEC (@d);\n  SELECT name FROM master.dbo.sysdatabases;\n  INSERT INTO dbo.summary (name) SELECT name FROM HERE.FILES.dbo.customer;\n  INSERT INTO dbo.summary (id) SELECT k FROM FAR.crm.dbo.people;\nEND",
}


#: What the rules find, one row a line: ``Part | Name | What | Detail``.
EXPECTED = {
    "rules_sources_named": r"""
flow | FILES.@t.id -> summary.id | Direct | Exact Static
flow | FILES.@t.n -> summary.name | Direct | Exact Static
flow | FILES.customer.id -> @t.id | Direct | Exact Static
flow | FILES.customer.id -> summary.id | Direct | Exact Static
flow | FILES.customer.name -> @t.n | Direct | Exact Static
flow | FILES.customer.name -> summary.name | Direct | Exact Static
flow | FILES.orders.customer -> summary.id | Direct | Exact Static
flow | FILES.orders.id -> summary.id | Direct | Exact Static
flow | FILES.orders.total -> summary.total | Direct | Exact Static
flow | FILES.v_orders.id -> summary.id | Direct | Exact Static
flow | FILES.v_orders.twice -> summary.total | Direct | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.FILES.dbo.v_orders | Reads | View Exact
object | FILES.FILES.file.b_script#1.@t | Insert | TableVariable Exact
object | FILES.FILES.file.b_script#1.@t | Reads | TableVariable Exact
""",
    "rules_sources_functions": r"""
flow | FILES.customer.id -> f_orders.IN:@c | Direct | Exact Static
flow | FILES.customer.id -> summary.* | Indirect | Exact Static
flow | FILES.f_many.id -> summary.id | Direct | Exact Static
flow | FILES.f_many.total -> summary.total | Direct | Exact Static
flow | FILES.f_orders.id -> summary.id | Direct | Exact Static
flow | FILES.f_orders.total -> summary.total | Direct | Exact Static
flow | FILES.orders.tags -> summary.id | Expression | Exact Static
flow | FILES.orders.tags -> summary.name | Expression | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.f_many | Calls | MsTvf Exact
object | FILES.FILES.dbo.f_many | Reads | MsTvf Exact
object | FILES.FILES.dbo.f_orders | Calls | InlineTvf Exact
object | FILES.FILES.dbo.f_orders | Reads | InlineTvf Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_sources_pivot": r"""
flow | FILES.orders.customer -> summary.id | Direct | Exact Static
flow | FILES.orders.id -> summary.* | Indirect | Exact Static
flow | FILES.orders.total -> audit.new | Direct | Exact Static
flow | FILES.orders.total -> audit.what | Expression | Exact Static
flow | FILES.orders.total -> summary.total | Aggregate | Exact Static
object | FILES.FILES.dbo.audit | Insert | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_sources_remote": r"""
flow | .c:\in.csv.* -> summary.id | Positional | High Static
flow | .c:\in.csv.* -> summary.name | Positional | High Static
flow | .c:\in.csv.* -> summary.rank | Positional | High Static
flow | .c:\in.csv.* -> summary.total | Positional | High Static
flow | .c:\in.csv.x -> summary.id | Direct | High Static
flow | NOWHERE.t.k -> summary.id | Direct | Medium Static
flow | crm.people.id -> summary.id | Direct | Medium Static
flow | crm.people.name -> summary.name | Direct | Medium Static
issue | FAR | LinkedServerNotScanned | warning
issue | NOWHERE | DatabaseNotScanned | warning
object | FAR.crm.dbo.people | Reads | External Medium
object | FILE...c:\in.csv | Reads | File High
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.NOWHERE.dbo.t | Reads | External Medium
""",
    "rules_projection": r"""
flow | FILES.customer.balance -> f_tax.IN:@x | Direct | Exact Static
flow | FILES.customer.balance -> summary.* | Indirect | Exact Static
flow | FILES.customer.balance -> summary.total | Expression | Exact Static
flow | FILES.customer.balance -> summary.total | Positional | High Static
flow | FILES.customer.id -> summary.id | Direct | Exact Static
flow | FILES.customer.id -> summary.id | Positional | High Static
flow | FILES.customer.id -> summary.total | Expression | Exact Static
flow | FILES.customer.name -> summary.name | Expression | Exact Static
flow | FILES.customer.name -> summary.name | Positional | High Static
flow | FILES.customer.nation -> summary.* | Indirect | Exact Static
flow | FILES.customer.nation -> summary.rank | Positional | High Static
flow | FILES.customer.nation -> summary.total | Expression | Exact Static
flow | FILES.f_tax.RETURN -> summary.total | Expression | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.f_tax | Calls | ScalarFunction Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_joins": r"""
flow | FILES.customer.id -> summary.* | Indirect | Exact Static
flow | FILES.customer.id -> summary.id | Direct | Exact Static
flow | FILES.customer.nation -> summary.* | Indirect | Exact Static
flow | FILES.orders.customer -> summary.* | Indirect | Exact Static
flow | FILES.orders.day -> summary.* | Indirect | Exact Static
flow | FILES.orders.id -> summary.* | Indirect | Exact Static
flow | FILES.orders.total -> summary.total | Aggregate | Exact Static
flow | FILES.orders.total -> summary.total | Direct | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_aggregates": r"""
flow | FILES.customer.id -> summary.* | Indirect | Exact Static
flow | FILES.customer.name -> summary.name | Aggregate | Exact Static
flow | FILES.orders.* -> summary.* | Indirect | Exact Static
flow | FILES.orders.* -> summary.rank | Aggregate | Exact Static
flow | FILES.orders.customer -> summary.* | Indirect | Exact Static
flow | FILES.orders.customer -> summary.id | Direct | Exact Static
flow | FILES.orders.total -> summary.total | Aggregate | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_windows": r"""
flow | FILES.orders.customer -> summary.* | Indirect | Exact Static
flow | FILES.orders.day -> summary.* | Indirect | Exact Static
flow | FILES.orders.id -> summary.id | Direct | Exact Static
flow | FILES.orders.total -> summary.* | Indirect | Exact Static
flow | FILES.orders.total -> summary.total | Aggregate | Exact Static
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_set_operations": r"""
flow | FILES.customer.id -> summary.id | Direct | Exact Static
flow | FILES.orders.customer -> summary.* | Indirect | Exact Static
flow | FILES.orders.customer -> summary.id | Direct | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_updates": r"""
flow | FILES.customer.balance -> summary.* | Indirect | Exact Static
flow | FILES.customer.balance -> summary.total | Direct | Exact Static
flow | FILES.customer.id -> summary.* | Indirect | Exact Static
flow | FILES.orders.day -> summary.* | Indirect | Exact Static
flow | FILES.orders.id -> summary.* | Indirect | Exact Static
flow | FILES.orders.total -> summary.total | Direct | Exact Static
flow | FILES.summary.id -> summary.* | Indirect | Exact Static
flow | FILES.summary.rank -> summary.rank | Expression | Exact Static
flow | FILES.summary.total -> audit.new | Direct | Exact Static
flow | FILES.summary.total -> audit.old | Direct | Exact Static
object | FILES.FILES.dbo.audit | Insert | Table Exact
object | FILES.FILES.dbo.audit | Truncate | Table Exact
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Delete | Table Exact
object | FILES.FILES.dbo.summary | Reads | Table Exact
object | FILES.FILES.dbo.summary | Update | Table Exact
""",
    "rules_merge": r"""
flow | FILES.orders.customer -> summary.* | Indirect | Exact Static
flow | FILES.orders.customer -> summary.id | Direct | Exact Static
flow | FILES.orders.total -> audit.new | Aggregate | Exact Static
flow | FILES.orders.total -> summary.* | Indirect | Exact Static
flow | FILES.orders.total -> summary.total | Aggregate | Exact Static
flow | FILES.summary.id -> summary.* | Indirect | Exact Static
flow | FILES.summary.total -> audit.old | Direct | Exact Static
object | FILES.FILES.dbo.audit | Insert | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Delete | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.FILES.dbo.summary | Merge | Table Exact
object | FILES.FILES.dbo.summary | Update | Table Exact
""",
    "rules_tables_made": r"""
flow | FILES.#t.id -> #u.a | Direct | Exact Static
flow | FILES.#u.a -> #u.b | Expression | Exact Static
flow | FILES.#u.a -> summary.id | Direct | Exact Static
flow | FILES.#u.b -> summary.total | Direct | Exact Static
flow | FILES.customer.id -> #t.id | Direct | Exact Static
flow | FILES.customer.name -> #t.name | Direct | Exact Static
flow | FILES.orders.id -> fresh.id | Direct | Exact Static
flow | FILES.orders.total -> fresh.total | Direct | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.fresh | Create | Table High
object | FILES.FILES.dbo.fresh | Insert | Table High
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.FILES.file.b_script#1.#t | Create | TempTable Exact
object | FILES.FILES.file.b_script#1.#t | Drop | TempTable Exact
object | FILES.FILES.file.b_script#1.#t | Insert | TempTable Exact
object | FILES.FILES.file.b_script#1.#t | Reads | TempTable Exact
object | FILES.FILES.file.b_script#1.#u | Alter | TempTable Exact
object | FILES.FILES.file.b_script#1.#u | Create | TempTable Exact
object | FILES.FILES.file.b_script#1.#u | Insert | TempTable Exact
object | FILES.FILES.file.b_script#1.#u | Reads | TempTable Exact
""",
    "rules_variables": r"""
flow | FILES.customer.balance -> summary.total | Expression | Exact Static
flow | FILES.customer.id -> summary.* | Indirect | Exact Static
flow | FILES.customer.id -> summary.id | Aggregate | Exact Static
flow | FILES.orders.id -> summary.rank | Aggregate | Exact Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.FILES.dbo.summary | Update | Table Exact
""",
    "rules_cursors": r"""
flow | FILES.customer.balance -> summary.* | Indirect | Exact Static
flow | FILES.customer.id -> summary.id | Positional | High Static
flow | FILES.customer.name -> summary.name | Positional | High Static
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_calls": r"""
flow | FILES.caller.IN:@out -> missing.IN:@b | Direct | Exact Static
flow | FILES.caller.IN:@p -> missing.IN:@a | Direct | Exact Static
flow | FILES.customer.balance -> caller.RS1:balance | Direct | Exact Static
flow | FILES.customer.id -> caller.RS1:id | Direct | Exact Static
flow | FILES.give.RS1:#1 -> summary.id | Positional | High Static
flow | FILES.give.RS1:#2 -> summary.name | Positional | High Static
flow | FILES.missing.OUT:@b -> summary.total | Direct | Low Static
flow | FILES.missing.RETURN -> summary.rank | Direct | Low Static
flow | FILES.orders.id -> caller.OUT:@out | Aggregate | Exact Static
issue | dbo.missing | ObjectNotFound | warning
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.give | Calls | Procedure Exact
object | FILES.FILES.dbo.missing | Calls | Unresolved Low
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.msdb.job.JOB:nightly | Calls | JobStep Exact
""",
    "rules_trigger": r"""
flow | FILES.summary.id -> audit.* | Indirect | Exact Static
flow | FILES.summary.total -> audit.new | Direct | Exact Static
flow | FILES.summary.total -> audit.old | Direct | Exact Static
object | FILES.FILES.dbo.audit | Insert | Table Exact
object | FILES.FILES.dbo.summary | Reads | Table Exact
""",
    "rules_dynamic": r"""
dynamic | DELETE FROM dbo.[orders] WHERE id = 5 | EXEC() | Exact
dynamic | INSERT INTO dbo.summary (id) SELECT id FROM dbo.customer | EXEC() | Exact
dynamic | SELECT @o = MAX(total) FROM dbo.orders WHERE id = @i | sp_executesql | Exact
dynamic | TRUNCATE TABLE dbo.audit; SELECT ((( FROM dbo.customer | EXEC() | Partial
dynamic | dbo.give | EXEC @proc | Exact
flow | FILES.customer.id -> summary.id | Direct | Exact DynamicStatic
flow | FILES.orders.id -> orders.* | Indirect | Exact DynamicStatic
object | FILES.FILES.dbo.audit | Truncate | Table Low
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.customer | Reads | Table Low
object | FILES.FILES.dbo.give | Calls | Procedure Exact
object | FILES.FILES.dbo.orders | Delete | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_strings": r"""
dynamic | INSERT INTO dbo.summary (id) SELECT id FROM dbo.orders | EXEC() | Exact
dynamic | SELECT NAME FROM DBO.customer | EXEC() | Exact
dynamic | SELECT id FROM dbo.⟨@name⟩ | EXEC() | Exact
dynamic | TRUNCATE TABLE dbo.audit | EXEC() | Exact
flow | FILES.customer.id -> strings.RS1:id | Direct | Exact DynamicStatic
flow | FILES.customer.name -> strings.RS2:NAME | Direct | Exact DynamicStatic
flow | FILES.orders.id -> summary.id | Direct | Exact DynamicStatic
object | FILES.FILES.dbo.audit | Truncate | Table Exact
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
""",
    "rules_archives": r"""
dynamic | INSERT INTO dbo.summary (total) SELECT total FROM FILES_⟨@y⟩.dbo.orders | EXEC() | Exact
dynamic | SELECT a FROM OTHER_⟨@y⟩.dbo.t | EXEC() | Exact
flow | FILES.customer.id -> summary.id | Direct | Exact Static
flow | FILES.customer.name -> summary.name | Direct | Exact Static
flow | FILES.orders.total -> summary.total | Direct | Exact DynamicStatic
flow | OTHER_%.t.a -> years.RS1:a | Direct | Low DynamicStatic
flow | crm.people.k -> summary.id | Direct | Medium Static
flow | master.sysdatabases.name -> years.RS2:name | Direct | Medium Static
issue | FAR | LinkedServerNotScanned | warning
issue | OTHER_%.dbo.t | DynamicDatabaseName | warning
object | FAR.crm.dbo.people | Reads | External Medium
object | FILES.FILES.dbo.customer | Reads | Table Exact
object | FILES.FILES.dbo.orders | Reads | Table Exact
object | FILES.FILES.dbo.summary | Insert | Table Exact
object | FILES.OTHER_%.dbo.t | Reads | Unresolved Low
object | FILES.master.dbo.sysdatabases | Reads | System Medium
""",
}


def expected_sql(name: str) -> str:
    """The expected rows of a script as a query."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n  ".join("(" + ", ".join(map(quote, line.split(" | "))) + ")" for line in EXPECTED[name].strip().split("\n"))
    return f'SELECT * FROM (VALUES\n  {values}) t("Part", "Name", "What", "Detail")'


def rows(spark: SparkSession, name: str) -> DataFrame:
    """What the analyser finds in a script, ``(Part, Name, What, Detail)``, each once."""
    texts = spark.createDataFrame([("a_tables", TABLES), ("b_script", SCRIPTS[name])], "file string, text string")
    config = Config(archive_patterns=[r"^(FILES)_\d{4}$"], linked_servers={"HERE": ["FILES", ""]})
    t = LineageSession.from_scripts(spark, files.read_script_table(texts, "file", "text"), config).analyze()
    mine = ~F.col("ModuleName").isin("v_orders", "f_orders", "f_tax", "f_many", "give") & ~F.startswith(F.col("ModuleName"), F.lit("a_tables"))
    text = lambda *c: F.concat_ws(".", *[F.col(x) for x in c])
    parts = [
        t["ColumnLineage"].where(mine).select(F.lit("flow").alias("Part"), F.concat_ws(" -> ", text("SourceDatabase", "SourceObject", "SourceColumn"), text("TargetObject", "TargetColumn")).alias("Name"), F.col("FlowKind").alias("What"), F.concat_ws(" ", "Confidence", "Provenance").alias("Detail")),
        t["ObjectLineage"].where(mine).select(F.lit("object"), text("ObjectServer", "ObjectDatabase", "ObjectSchema", "ObjectName"), "Action", F.concat_ws(" ", "ObjectType", "Confidence")),
        t["Unresolved"].where(mine).select(F.lit("issue"), "Name", "Kind", "Severity"),
        t["DynamicSql"].where(mine).select(F.lit("dynamic"), "Template", "SinkKind", "Status"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
