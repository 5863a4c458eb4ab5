"""How a Spark result and a SQL result are compared: as sets of rows, numbers to eight digits."""
import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    return f"{float(v) + 0.0:.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def canon(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_text, r)) for r in df.itertuples(index=False))
