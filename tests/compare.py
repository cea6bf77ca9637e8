"""Rows of a Spark frame and of a DuckDB query as comparable multisets."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())


def assert_same(df, con, sql):
    (a, x), (b, y) = spark_rows(df), duck_rows(con, sql)
    assert a == b
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])
