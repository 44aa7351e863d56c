"""Row-by-row comparison of a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _text(value) -> str:
    if value is None or value is pd.NA or value != value:
        return "<null>"
    return repr(float(value)) if isinstance(value, float) else str(value)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""

    df = df[sorted(df.columns)].astype("object")
    for c in df.columns:
        df[c] = df[c].map(_text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results, or None."""

    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    if a.equals(b):
        return None
    rows = (a != b).any(axis=1)
    return f"VALUES {rows.sum()}\n{a[rows].head(4).to_string()}\n{b[rows].head(4).to_string()}"
