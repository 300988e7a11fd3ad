"""Run a query and its SQL on the same tables and compare the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return round(float(value), 6)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(str(v) for v in r)
    )


def check(spark, con, query, sql, sf_dir):
    """(error text or None, number of rows)."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (None if mine else "no rows"), len(mine)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}; {_first(mine, theirs)}", len(mine)
    if mine != theirs:
        bad = sum(a != b for a, b in zip(mine, theirs))
        return f"{bad} rows differ; {_first(mine, theirs)}", len(mine)
    return None, len(mine)


def _first(mine, theirs):
    a, b = set(map(str, mine)), set(map(str, theirs))
    return f"only spark: {sorted(a - b)[:2]} only sql: {sorted(b - a)[:2]}"
