"""T-SQL SELECTs for Spark: the few forms Spark's parser doesn't take are rewritten on tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.tsql.lexer import tokenize

#: Functions by their name in Spark SQL (fixed values).
FUNCTIONS = {"ISNULL": "coalesce", "GETDATE": "current_timestamp", "SYSDATETIME": "current_timestamp", "LEN": "length", "CHARINDEX": "locate", "REPLICATE": "repeat", "DATALENGTH": "octet_length", "STDEV": "stddev", "STDEVP": "stddev_pop", "VAR": "variance", "VARP": "var_pop", "COUNT_BIG": "count", "DATEPART": "date_part", "NEWID": "uuid"}


def to_spark_sql(text: str) -> str:
    """Brackets to backquotes, function names, TOP to LIMIT, table hints and default-schema prefixes dropped."""
    toks = tokenize(text)[:-1]
    out: list[str] = []
    limits: list[tuple[int, str]] = []  # of the open queries: depth and limit
    depth = i = 0

    def close(d: int) -> None:
        while limits and limits[-1][0] >= d:
            out.append(f" LIMIT {limits.pop()[1]}")

    while i < len(toks):
        t, nxt = toks[i], toks[i + 1].up if i + 1 < len(toks) else ""
        gap = text[toks[i - 1].end : t.start] if i else ""
        out.append(" " if gap else "")
        if t.up == "TOP" and i and toks[i - 1].up in ("SELECT", "DISTINCT", "ALL"):
            j = i + 1
            if toks[j].up == "(":
                n, i = toks[j + 1].text, j + 3
            else:
                n, i = toks[j].text, j + 1
            limits.append((depth, n))
            continue
        if t.up == "WITH" and nxt == "(" and i and toks[i - 1].up not in (")", ";") and toks[i + 2].up in ("NOLOCK", "READPAST", "UPDLOCK", "TABLOCK", "HOLDLOCK", "ROWLOCK"):
            while toks[i].up != ")":
                i += 1
        elif t.up == "(":
            depth += 1
            out.append("(")
        elif t.up == ")":
            close(depth)
            depth -= 1
            out.append(")")
        elif t.up in ("UNION", "EXCEPT", "INTERSECT"):
            close(depth)
            out.append(t.text)
        elif t.up == "DBO" and nxt == ".":
            i += 1
        elif t.kind == "qid":
            out.append("`" + t.text.replace("`", "``") + "`")
        elif t.kind == "str":
            out.append("'" + t.text.replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif nxt == "(" and t.up in FUNCTIONS:
            out.append(FUNCTIONS[t.up])
        elif t.up == ";":
            close(0)
        else:
            out.append(t.text)
        i += 1
    close(0)
    return "".join(out).strip()


def execute(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run a T-SQL SELECT over data frames."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(to_spark_sql(text))
