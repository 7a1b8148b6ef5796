"""Compare registered queries with their SQL: python tests/check_oracles.py <sf dir> [prefix ...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return str([text(x) for x in v])
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v))
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else what differs."""
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} rows != {len(b)} rows; first differing: {bad}"
    return None if a else "no rows"


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                message = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            message = f"{type(error).__name__}: {str(error)[:700]}"
        failed += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name:34s} {time.time() - start:6.1f}s "
              f"{'' if name in oracles else '(rows only) '}{message or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
