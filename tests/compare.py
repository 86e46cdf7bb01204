"""Results of a query beside those of its SQL in DuckDB."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    def one(v):
        if v is None or v != v:
            return "None"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, np.floating)) else str(v)

    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


def oracle(sql, folder, tables=TABLES):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.sql(sql).df()
