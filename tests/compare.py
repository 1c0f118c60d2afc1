"""Holds a Spark result against DuckDB's for the same tables, the way the driver does."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and pd.isna(x)):
            return "∅"
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int | float):
            return f"{float(x):.6g}" if isinstance(x, float) and not float(x).is_integer() else str(int(x))
        return str(x)

    names = sorted(df.columns)
    return [names, sorted(tuple(cell(x) for x in row) for row in df[names].itertuples(index=False, name=None))]


def same(spark_df, sql: str, sf_dir: str) -> None:
    got, want = canonical(spark_df.toPandas()), canonical(oracle(sql, sf_dir))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    differ = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not differ, differ[:3]
