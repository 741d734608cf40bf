CREATE TABLE dbo.customer (c_custkey int IDENTITY, c_name nvarchar(50), c_nationkey int, c_acctbal decimal(18,2), c_mktsegment varchar(20));
GO
CREATE TABLE dbo.orders (o_orderkey int, o_custkey int, o_totalprice decimal(18,2), o_orderdate datetime, o_orderstatus char(1));
GO
CREATE TABLE dbo.customer_summary (custkey int, label nvarchar(80), total decimal(18,2), n int, loaded datetime);
GO
CREATE TABLE dbo.audit_log (log_id int IDENTITY, message nvarchar(max), at datetime);
GO
CREATE TABLE dbo.balance_history (custkey int, old_balance decimal(18,2), new_balance decimal(18,2), at datetime);
GO
CREATE TABLE dbo.load_config (id int, source_table sysname, active bit);
GO
CREATE VIEW dbo.v_open AS
SELECT o.o_orderkey, c.c_name + N' #' + CAST(c.c_custkey AS nvarchar(10)) AS label, o.o_totalprice AS price, c.c_custkey AS custkey
FROM dbo.orders o INNER JOIN dbo.customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O';
GO
CREATE FUNCTION dbo.fn_tax (@amount decimal(18,2)) RETURNS decimal(18,2) AS BEGIN RETURN @amount * 1.2 END
GO
CREATE FUNCTION dbo.fn_orders (@custkey int) RETURNS TABLE AS RETURN (SELECT o_orderkey, o_totalprice FROM dbo.orders WHERE o_custkey = @custkey);
GO
CREATE TRIGGER dbo.tr_balance ON dbo.customer AFTER UPDATE AS
BEGIN
  INSERT INTO dbo.balance_history (custkey, old_balance, new_balance, at)
  SELECT d.c_custkey, d.c_acctbal, i.c_acctbal, GETDATE() FROM inserted i JOIN deleted d ON d.c_custkey = i.c_custkey;
END
GO
CREATE PROCEDURE dbo.load_summary @since datetime = '2024-01-01' AS
BEGIN
  SET NOCOUNT ON;
  SELECT o_custkey, SUM(o_totalprice) AS total, COUNT(*) AS n INTO #sums FROM dbo.orders WHERE o_orderdate >= @since GROUP BY o_custkey;
  CREATE TABLE #result (custkey int, label nvarchar(80), total decimal(18,2), n int);
  INSERT INTO #result SELECT s.o_custkey, c.c_name, s.total, s.n FROM #sums s LEFT JOIN dbo.customer c ON c.c_custkey = s.o_custkey;
  MERGE dbo.customer_summary AS t USING #result AS r ON t.custkey = r.custkey
  WHEN MATCHED THEN UPDATE SET label = r.label, total = r.total, n = r.n
  WHEN NOT MATCHED THEN INSERT (custkey, label, total, n, loaded) VALUES (r.custkey, r.label, r.total, r.n, GETDATE())
  OUTPUT inserted.label, GETDATE() INTO dbo.audit_log (message, at);
  SELECT custkey, total FROM dbo.customer_summary ORDER BY total DESC;
END
GO
CREATE PROCEDURE dbo.fire AS
BEGIN
  UPDATE dbo.customer SET c_acctbal = c_acctbal + 1 WHERE c_custkey = 1;
  INSERT INTO dbo.audit_log (message, at) EXEC dbo.load_summary;
END
GO
CREATE PROCEDURE dbo.dynamic_load @table sysname = 'customer' AS
BEGIN
  DECLARE @sql nvarchar(max) = N'INSERT INTO dbo.audit_log (message) SELECT c_name FROM dbo.' + @table + ' WHERE c_acctbal > 0';
  EXEC (@sql);
  DECLARE @n int;
  EXEC sp_executesql N'SELECT @cnt = COUNT(*) FROM dbo.orders WHERE o_orderstatus = @st', N'@cnt int OUTPUT, @st char(1)', @cnt = @n OUTPUT, @st = 'O';
  INSERT INTO dbo.audit_log (message) VALUES (CAST(@n AS nvarchar(20)));
  DECLARE cur CURSOR FOR SELECT source_table FROM dbo.load_config WHERE active = 1;
  DECLARE @src sysname;
  OPEN cur;
  FETCH NEXT FROM cur INTO @src;
  WHILE @@FETCH_STATUS = 0
  BEGIN
    SET @sql = 'INSERT INTO dbo.audit_log (message) SELECT name FROM ' + QUOTENAME(@src);
    EXEC sp_executesql @sql;
    FETCH NEXT FROM cur INTO @src;
  END
  CLOSE cur; DEALLOCATE cur;
END
GO
CREATE PROCEDURE dbo.worker AS
BEGIN
  INSERT INTO #work (custkey, total) SELECT o_custkey, SUM(o_totalprice) FROM dbo.orders GROUP BY o_custkey;
END
GO
CREATE PROCEDURE dbo.boss AS
BEGIN
  CREATE TABLE #work (custkey int, total decimal(18,2));
  EXEC dbo.worker;
  INSERT INTO dbo.customer_summary (custkey, total) SELECT custkey, total FROM #work;
END
GO
CREATE PROCEDURE dbo.broken AS
BEGIN
  SELECT c_name FROM dbo.customer;
  SELEC nothing at all;
  INSERT INTO dbo.audit_log (message) SELECT c_name FROM dbo.customer;
END
GO
