"""Rows of Spark and DuckDB in one comparable form."""


def rows_of(df):
    """Rows as a sorted list of comparable tuples, columns by name, floats to nine digits."""
    cols = sorted(df.columns)
    return sorted(repr(tuple(_cell(r[c]) for c in cols)) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(repr(tuple(_cell(r[i]) for i in at)) for r in cur.fetchall())


def _cell(v):
    return round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int, str)) else str(v)
