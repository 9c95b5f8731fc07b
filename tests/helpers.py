"""Comparing results of Spark and DuckDB."""

DATA = "/root/testdata/sf0.001"


def plain(v):
    """A value in a form in which Spark's and DuckDB's are equal."""
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.select(*cols).collect())


def rows_of_sql(con, sql):
    r = con.sql(sql)
    names = r.columns
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
