from collections import Counter


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(rows):
    return Counter(repr([plain(v) for v in r]) for r in rows)


def compare(spark, duck, sf, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert bag(got) == bag([[r[i] for i in at] for r in result.fetchall()])
