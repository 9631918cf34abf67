"""Side-by-side check of a registered query: Spark rows against DuckDB rows."""

import math
from pathlib import Path


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.10g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.10g}"
    if isinstance(value, int):
        return f"{float(value):.10g}" if abs(value) < 1 << 53 else str(value)
    return str(value)


def duck_rows(sf_dir: str, sql: str):
    import duckdb
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def compare(spark, fn, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = fn(spark, sf_dir)
    rows = df.collect()
    names, expected = duck_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    got = sorted([tuple(_plain(r[c]) for c in order) for r in rows], key=repr)
    want = sorted([tuple(_plain(r[names.index(c)]) for c in order) for r in expected], key=repr)
    if len(got) != len(want):
        extra = [g for g in got if g not in set(want)][:3]
        missing = [w for w in want if w not in set(got)][:3]
        return f"{len(got)} rows and {len(want)}; only in Spark {extra}; only in DuckDB {missing}; columns {order}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ; columns {order}; e.g. {bad[0]}" if bad else None
