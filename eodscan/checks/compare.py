"""Run registered queries against their SQL: python -m eodscan.checks.compare SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eodscan")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/eodscan-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, sf_dir: str, name: str, run, sql: str | None) -> tuple[bool | None, str]:
    started = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    took = f"{time.time() - started:.1f}s"
    if sql is None:
        return None, f"{len(got)} rows, no SQL, {took}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows equal, {took}"
    only_spark, only_sql = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    detail = f"{len(a)} vs {len(b)} rows, {len(only_spark)} only in Spark, {len(only_sql)} only in SQL"
    return False, f"{detail}\n    {only_spark[:2]}\n    {only_sql[:2]}"


def main(sf_dir: str, only: list[str]) -> int:
    from eodscan.checks.oracles import oracle_sql
    from eodscan.checks.queries import queries

    spark, sql, failed = session(), oracle_sql(), []
    for name, run in queries().items():
        if only and name not in only:
            continue
        try:
            ok, text = compare(spark, sf_dir, name, run, sql.get(name))
        except Exception as problem:  # report and go on with the next query
            ok, text = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{'ran ' if ok is None else 'ok  ' if ok else 'FAIL'} {name}: {text}", flush=True)
        failed += [name] if ok is False else []
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
