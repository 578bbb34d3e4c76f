"""Comparison of a query's rows with those of its SQL, whatever their order."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())
