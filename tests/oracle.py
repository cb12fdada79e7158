"""Run registered queries beside their DuckDB SQL: python tests/oracle.py [sf] [name...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def compare(spark, name, sf_dir, query, sql):
    """None if both give the same multiset of rows, else a short difference."""
    import duckdb
    import pandas as pd

    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} | {sorted(want.columns)}"
    cols = sorted(got.columns)

    def rows(df):
        return sorted(tuple("null" if pd.isna(v) is True or v is pd.NA else f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))

    a, b = rows(got), rows(want)
    if a != b:
        x = next(((i, p, q) for i, (p, q) in enumerate(zip(a, b)) if p != q), "length")
        return f"{name}: {len(a)} rows, {len(b)} expected; first difference {str(x)[:600]}"
    return None


if __name__ == "__main__":
    import os

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            if name in sql:
                said = compare(spark, name, f"/root/testdata/sf{sf}", queries[name], sql[name]) or "same"
            else:
                said = f"{queries[name](spark, f'/root/testdata/sf{sf}').count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
