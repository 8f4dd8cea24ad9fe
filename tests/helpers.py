import datetime as dt
import decimal
import math

import pandas as pd


def canon(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return pd.Timestamp(v).isoformat()
    try:
        if pd.isna(v):
            return "None"
    except (TypeError, ValueError):
        pass
    return str(v)


def rows_of(pdf: pd.DataFrame):
    # a nullable long is float64 from Spark's toPandas and Int64 from DuckDB's df: one form for both
    pdf = pdf.astype({c: "float64" for c, t in pdf.dtypes.items() if str(t) == "Int64"})
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(canon(r[c]) for c in cols) for r in pdf.to_dict("records"))


def ts(s):
    return dt.datetime.fromisoformat(s)
