"""Results of a query and of its SQL, as comparable multisets of rows."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "as_tuple"):
        return float(x)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(map(repr, map(plain, r))) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(repr(plain(r[i])) for i in order) for r in found.fetchall())
