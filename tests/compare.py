"""Run registered queries against DuckDB: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pyarrow as pa  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def type_name(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{type_name(t.value_type)}>"
    return str(t)


def naive(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows(table: pa.Table, names: list[str]) -> list[tuple]:
    columns = [[naive(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    names = sorted(spark_table.column_names)
    if names != sorted(duck_table.column_names):
        return f"columns {names} != {sorted(duck_table.column_names)}"
    for n in names:
        a, b = type_name(spark_table.schema.field(n).type), type_name(duck_table.schema.field(n).type)
        if a != b:
            return f"type of {n}: spark {a} duckdb {b}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows: spark {spark_table.num_rows} duckdb {duck_table.num_rows}"
    left, right = rows(spark_table, names), rows(duck_table, names)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)} rows differ, first: " + "; ".join(
            f"{n}: {x!r:.300} != {y!r:.300}" for n, x, y in zip(names, a, b) if x != y
        )
    return None


def main(argv: list[str]) -> int:
    from docspark.plans import QUERIES
    from docspark.session import get_session

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder, argv = argv[0], argv[1:]
    spark = get_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.maxResultSize": "4g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name, q in QUERIES.items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            got = q(spark, folder).toArrow()
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if q.oracle is None:
            print(f"rows  {name}: {got.num_rows} rows {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(q.oracle).to_arrow_table()
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ORACLE {name}: {str(error)[:800]}", flush=True)
            continue
        problem = difference(got, want)
        failed += problem is not None
        print(f"{'FAIL ' if problem else 'ok   '} {name}: {got.num_rows} rows spark {took:.1f}s "
              f"duckdb {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
