"""Run queries against their SQL on DuckDB: ``python -m checks.compare [sf_dir] [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from labelmill.staging import scratch

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def local_session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelmill-checks")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None):
    """(ok, message)."""
    start = time.time()
    with scratch(spark):
        df = query(spark, sf_dir)
        got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{name}: {len(a)} rows equal, {took:.1f}s"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"{name}: {len(a)} vs {len(b)} rows, {sorted(names)}; first differences {diff}"


def main():
    from checks import catalog

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(catalog.QUERIES)
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, message = compare(spark, con, sf_dir, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
        except Exception as error:
            ok, message = False, f"{name}: {type(error).__name__} {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", message[:1500], flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
