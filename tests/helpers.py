"""Rows of Spark and DuckDB results in one comparable form."""


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in cols]).collect())


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted([plain(row[k]) for k in at] for row in r.fetchall())
