"""Compare registered queries with their SQL on the given tables."""

import math
import sys
import time

import duckdb

from riskfabric.plans.catalog import TABLES


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, function, sql):
    started = time.time()
    df = function(spark, folder)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return None, f"{len(got)} rows (no SQL) {took:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left == right:
        return True, f"{len(got)} rows {took:.1f}s"
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return False, f"{len(left)} vs {len(right)} rows\n   columns {sorted(columns)}\n   spark {only_left}\n   sql   {only_right}"


if __name__ == "__main__":
    from riskfabric.session import build_session
    import __spark_entry__ as entry
    folder, patterns = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, bad = entry.oracle_sql(), []
    for name, function in entry.queries().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        try:
            ok, note = compare(spark, con, folder, name, function, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, note, flush=True)
        if ok is False:
            bad.append(name)
    print("failed:", bad)
